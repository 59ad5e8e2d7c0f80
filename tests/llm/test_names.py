"""Linking of names and addresses."""

import random

import numpy as np
import pyarrow as pa
import pytest

from chronoweave.llm import names
from chronoweave.storage import materialize


@pytest.mark.parametrize("name,tokens", [
    ("Dr. Ilka Dorvenar [away]", ["ilka", "dorvenar"]), ("Dorvenar, Ilka / platform", ["dorvenar", "ilka"]), ("AnnaBell", ["anna", "bell"]),
    ("Acme S.A.", ["acme"]), ("Ничолас Левин", ["nicholas", "levin"]), ("GrÃ¼n, Ã…sa", ["grun", "asa"]), ("a@b.example", []), (None, []), ("", []), ("J\xa0Smith", ["j", "smith"]),
])
def test_tokens(name, tokens):
    assert names.name_tokens(name) == tokens


def test_near_is_a_typo_or_two():
    assert names.near("dorvenar", "dorvenra") and names.near("dorvenar", "dorvennarr") and not names.near("dorvenar", "salvetar") and not names.near("abc", "abd")


def test_groups(spark):
    rows = [
        (1, "Ilka Dorvenar", "ilka.d@x.example"), (2, "Dorvenar, Ilka", "ILKA.D+git@x.example "), (3, "I. Dorvenar", "77+ilka.d@users.noreply.y.example"), (4, None, "ilka.d@z.example"),
        (5, "Ilka Dorvenar", None), (6, "Ilka Dorvenra", "ilka.d@x.example"),
        (10, "Tess Quor", "team-1@x.example"), (11, "Bram Ostvelder", "team-1@x.example"), (12, "Bram Ostvelder", "TEAM-1@x.example"), (13, "team", "team-1@x.example"),
        (20, "Sam Field", "sfield@x.example"), (21, "Sam Field", "other77@y.example"), (22, "Sam Field", ""),
        (30, "Acme Tools Bot", "ci@acme-tools.example"), (31, "Acme Tools Inc", "mirror@acme-tools.example"), (32, "Sam Acton", "ci@other.example"),
        (40, None, None), (41, "", ""), (42, "Only Name", None), (43, "Only  name", ""),
        (50, "Anna Longone", "annalo@x.example"), (51, "Anna Lotsmore", "annalo@y.example"),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "identity_id bigint, name string, email string, node string")
    pairs = {tuple(r) for r in names.identity_pairs(df).collect()}
    groups = [[1, 2, 3, 4, 5, 6], [11, 12], [30, 31], [42, 43]]
    assert pairs == {(a, b) for g in groups for a in g for b in g if a < b}
    assert names.identity_pairs(df.limit(0)).collect() == []


def test_other_people_and_other_accounts(spark):
    rows = [
        (1, "Alex Kim", "alex@acme.com"), (2, "Alex Wong", "alex@globex.org"), (3, "Kim", "dev@a.com"), (4, "Zoe", "dev@b.org"),
        (5, "John Smith", "jsmith@a.com"), (6, "Jane Smith", "jsmith@b.org"), (7, "Jonathan Smithson", "jonathan.smithson@acme.com"), (8, "Jonathan Smithson", "jsmithson@gmail.com"),
    ]
    df = spark.createDataFrame(rows, "identity_id bigint, name string, email string")
    assert [tuple(r) for r in names.identity_pairs(df).collect()] == [(7, 8)]


def people(seed, n=120):
    """(rows, person): names and accounts of invented people, spelled in several ways, at several hosts."""
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice(("ba", "lor", "min", "tav", "esk", "und", "ri", "qua", "fen", "hol")) for _ in range(rng.randrange(2, 4)))
    rows, person = [], []
    for p in range(n):
        given, last = part().capitalize(), part().capitalize() + part()
        account = rng.choice((f"{given}.{last}", f"{given[0]}{last}", part() + str(rng.randrange(999)))).lower()
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(last) - 1)
            name = rng.choice((f"{given} {last}", f"{last}, {given}", f"{given} {last[:at]}{last[at + 1]}{last[at]}{last[at + 2 :]}", f"{given[0]}. {last}", None))
            rows.append((len(rows), name, f"{account}@{rng.choice(('a.example', 'b.example', 'c.example'))}"))
            person.append(p)
    return rows, person


def score(pairs, person):
    true = {(a, b) for b in range(len(person)) for a in range(b) if person[a] == person[b]}
    return len(pairs & true) / max(1, len(pairs)), len(pairs & true) / len(true)


def test_names_decide(spark, monkeypatch):
    """Without the n-grams of names other links come out, and worse ones: the cosine isn't an ornament."""
    rows, person = people(3)
    rows += [(len(rows) + i, f"{n}", "desk@a.example") for i, n in enumerate(("Ona Trelk", "Ona Trelk", "Ona Trellk", "Rud Vasker", "Vasker, Rud", "Min Holquafen"))]
    person += [900, 900, 900, 901, 901, 902]
    df = materialize(spark.createDataFrame(rows, "identity_id bigint, name string, email string"), "people")
    with_names = {tuple(r) for r in names.identity_pairs(df).collect()}
    precision, recall = score(with_names, person)
    assert precision > 0.97 and recall > 0.9
    monkeypatch.setattr(names, "_grams", names.F.pandas_udf(lambda t: t.map(lambda _: []), "array<int>"))
    without = {tuple(r) for r in names.identity_pairs(df).collect()}
    assert without != with_names and sum(score(without, person)) < precision + recall - 0.05


def made(spark, rows):
    """(vectors, weights) of identities as ``link_identities`` makes them, for the parts of the join to be tested alone."""
    held = {}
    original = names._candidates

    def candidates(vectors, weights):
        held.update(vectors=vectors, weights=weights)
        return original(vectors, weights)

    names._candidates = candidates
    try:
        names.link_identities(spark.createDataFrame(rows, "identity_id bigint, name string, email string")).count()
    finally:
        names._candidates = original
    return held["vectors"], held["weights"]


@pytest.mark.parametrize("block", [1_000, 7])
def test_the_join_loses_no_pair(spark, monkeypatch, block):
    """All pairs of the all-pairs cosine are among the candidates, also where posting lists fall into many blocks."""
    monkeypatch.setattr(names, "BLOCK", block)
    rows, _ = people(5, 70)
    rows += [(1000 + i, n, "desk@a.example") for i, n in enumerate(("Ona Trelk", "Rud Vasker", "Min Holquafen", "Ona Trellk", "Pia Loresk"))]
    vectors, weights = made(spark, rows)
    records = [r.asDict() for r in vectors.collect()]
    found = {(r.a, r.b) for r in names._candidates(vectors, weights).collect()}
    n, missing, all_ = len(records), 0, 0
    ints = pa.list_(pa.int32())
    side = lambda rs: {k: pa.array([r[k] for r in rs], ints) if k in ("ng", "lg") else [r[k] for r in rs] for k in ("ng", "lg", "share", "local", "domain")}
    for i in range(1, n):
        for j, c in enumerate(names._cosines(side([records[i]] * i), side(records[:i]), weights.value)):
            x, y = records[i], records[j]
            if c >= names.THRESHOLD and not (x["crowded"] and not x["ng"] or y["crowded"] and not y["ng"]):
                all_ += 1
                missing += tuple(sorted((x["node"], y["node"]))) not in found
    assert all_ > 50 and missing == 0


def test_large_components_come_out_like_small_ones(spark):
    rows, _ = people(7, 30)
    df = materialize(spark.createDataFrame(rows, "identity_id bigint, name string, email string"), "people")
    groups = lambda done: {frozenset(r.ids) for r in done.groupBy("group").agg(names.F.collect_list("identity_id").alias("ids")).collect()}
    assert groups(names.link_identities(df)) == groups(names.link_identities(df, local_component=1))


def test_short_forms_are_learnt(spark):
    rows = []
    for i, last in enumerate(("Dorvenar", "Quilmesk", "Ostvelder")):
        rows += [(10 * i, f"Theodore {last}", f"t{i}{last.lower()}@x.example"), (10 * i + 1, f"Ted {last}", f"t{i}{last.lower()}@x.example")]
    rows += [(50, "Theodore Brankvist", "tbrankvist@x.example"), (51, "Ted Brankvist", "tbrankvist@y.example"), (60, "Zoe Brankvist", "tbrankvist@z.example")]
    df = spark.createDataFrame(rows, "identity_id bigint, name string, email string")
    assert {tuple(r) for r in names.identity_pairs(df).collect()} == {(0, 1), (10, 11), (20, 21), (50, 51)}


def test_average_linkage_cuts_a_chain():
    at = lambda degrees: {0: float(np.cos(np.radians(degrees))), 1: float(np.sin(np.radians(degrees)))}
    links = [(0, 1), (1, 2), (2, 3)]
    found = names.average_linkage([at(x) for x in (0, 40, 80, 120)], links, 0.5)
    assert found[0] == found[1] and found[2] == found[3] and found[0] != found[2]
    assert names.average_linkage([at(0)] * 3, [(0, 1), (1, 2)]) == [0, 0, 0]


def row(name, local="", domain="", shared=False):
    return {"name_key": name, "local": local, "domain": domain, "shared": shared}


@pytest.mark.parametrize("a,b,against", [
    (row("samuel s", "x", "a"), row("sam sevnev", "x", "b"), False), (row("quillev xiulan", "x", "a"), row("ksiulan kvillev", "x", "b"), False),
    (row("hesket milo", "x", "a"), row("quorlin tessa", "x", "b"), True), (row("", "x", "a"), row("hesket milo", "x", "b"), False),
    (row("richard morquil", "richardmo", "a"), row("morkvil richard", "richardmo", "b"), False), (row("richard morquil", "richardmo", "a"), row("moltanev richard", "richardmo", "b"), True),
    (row("hesket milo", "x", "a", True), row("milo quorlin", "x", "a", True), True), (row("hesket milo"), row("hesket milo", "x", "b"), False), (row("hesket"), row("hesket milo", "x", "b"), True),
])
def test_contradictions(a, b, against):
    assert names.contradiction(a, b)[0] is against and names.contradiction(b, a)[0] is against
