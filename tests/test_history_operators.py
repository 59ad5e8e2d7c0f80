"""Reachability, planning, changes, enrichment, sinks and state against brute force and small cases."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from chronoweave.enrich import file_types, plugins
from chronoweave.functions import values
from chronoweave.operators import changes, graph, planning, project, sink, state
from chronoweave.plans import history_queries


def brute(parents, starts):
    seen, stack = set(), [s for s in starts if s in parents]
    while stack:
        n = stack.pop()
        if n not in seen:
            seen.add(n)
            stack += [p for p in parents[n] or () if p in parents]
    return seen


def dag(spark, parents, place=None):
    return spark.createDataFrame([(n, p, (place or {}).get(n, 0)) for n, p in parents.items()], "node string, parents array<string>, place int")


CASES = {
    "linear": ({"root": [], "middle": ["root"], "head": ["middle"]}, "head", None, {"root", "middle", "head"}),
    "head is the exclude": ({"root": [], "head": ["root"]}, "head", "head", set()),
    "exclude lies above": ({"root": [], "head": ["root"], "later": ["head"]}, "head", "later", set()),
    "forked before, merged after": ({"root": [], "rel": ["root"], "main": ["rel"], "s1": ["root"], "s2": ["s1"], "head": ["main", "s2"]}, "head", "rel", {"main", "s1", "s2", "head"}),
    "criss-cross": ({"r": [], "a": ["r"], "b": ["r"], "c": ["a", "b"], "d": ["b", "a"], "h": ["c", "d"]}, "h", None, {"r", "a", "b", "c", "d", "h"}),
    "octopus": ({"r": None, "a": ["r"], "b": ["r"], "c": ["r"], "h": ["a", "b", "c"]}, "h", "b", {"a", "c", "h"}),
    "unknown parents": ({"a": ["gone"], "h": ["a", "lost"]}, "h", None, {"a", "h"}),
    "unknown exclude": ({"a": [], "h": ["a"]}, "h", "gone", {"a", "h"}),
    "disconnected": ({"x": [], "r": [], "h": ["r"]}, "h", "x", {"r", "h"}),
}


def test_differences_of_small_graphs(spark):
    plans, parents, place, want = [], {}, {}, set()
    for i, (graph_, head, exclude, members) in enumerate(CASES.values()):
        name = lambda n, i=i: f"{i}:{n}"
        parents |= {name(k): [name(p) for p in v] if v is not None else None for k, v in graph_.items()}
        place |= {name(k): -j for j, k in enumerate(graph_)}
        plans.append((i, name(head), name(exclude) if exclude else None))
        want |= {(i, name(m)) for m in members}
    df = spark.createDataFrame(plans, "ref_index int, head string, exclude string")
    for block in (1_000, 10):
        got = graph.reachable_difference(dag(spark, parents, place), df, block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_random_graphs_in_any_layout(spark):
    random.seed(11)
    parents = {f"n{i:03d}": [f"n{random.randrange(max(0, i - 20), i):03d}" for _ in range(random.choice([1, 1, 2, 3]))] if i > 3 else [] for i in range(300)}
    place = {n: int(n[1:]) if int(n[1:]) % 7 else random.randrange(300) for n in parents}
    starts = [("w1", "n299"), ("w1", "n150"), ("w2", "n040"), ("w3", "none")]
    got = graph.reachable(dag(spark, parents, place), spark.createDataFrame(starts, "walk string, node string"), 70).collect()
    want = {("w1", n) for n in brute(parents, ["n299", "n150"])} | {("w2", n) for n in brute(parents, ["n040"])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    tips = [("g", "n290"), ("g", "n295"), ("g", "n299"), ("one", "n010"), ("none", "n000"), ("none", "n001")]
    bases = {r.group: r.base for r in graph.merge_bases(dag(spark, parents, place), spark.createDataFrame(tips, "group string, node string")).collect()}
    common = set.intersection(*(brute(parents, [t]) for g, t in tips if g == "g"))
    inner = {p for c in common for p in parents[c]}
    assert bases == {"g": min(common - inner), "one": "n010", "none": None}


@pytest.mark.parametrize("shuffled", [False, True])
def test_loops_and_shuffled_layouts(spark, shuffled):
    rng = random.Random(5)
    n = 24 if shuffled else 240
    parents = {f"n{i:03d}": [f"n{max(0, i - rng.randrange(1, 4)):03d}" for _ in range(rng.choice([1, 2]))] if i else [] for i in range(n)}
    parents[f"n{n // 5:03d}"] = [f"n{n // 2:03d}", f"n{n // 5 - 1:03d}"]  # a loop over several blocks
    parents[f"n{n - 4:03d}"] = [f"n{n - 4:03d}", f"n{n // 2:03d}"]
    place = {node: rng.randrange(n) if shuffled else int(node[1:]) for node in parents}
    starts = [("w1", f"n{n - 1:03d}"), ("w2", f"n{n // 4:03d}"), ("w2", f"n{n - 4:03d}"), ("w3", "n000")]
    got = graph.reachable(dag(spark, parents, place), spark.createDataFrame(starts, "walk string, node string"), n // 4).collect()
    want = {(w, x) for w in ("w1", "w2", "w3") for x in brute(parents, [x for v, x in starts if v == w])}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_rounds_follow_the_logarithm(spark, monkeypatch):
    """A hundred blocks one behind another are walked in a few rounds, and nothing that was reached is written again."""
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, label, _own=graph.materialize: written.append(label) or _own(df, label))
    parents = {f"n{i:05d}": [f"n{i - 1:05d}"] if i else [] for i in range(2_000)}
    place = {n: int(n[1:]) for n in parents}
    got = graph.reachable(dag(spark, parents, place), spark.createDataFrame([("w", "n01999"), ("v", "n00500")], "walk string, node string"), 20)
    assert got.groupBy("walk").count().orderBy("walk").collect() == [("v", 501), ("w", 2_000)]
    assert written.count("walked") <= 4 and "reached" not in written


def test_lines_that_go_round_end_where_they_began(spark):
    parents = {f"n{i:02d}": f"n{i - 1:02d}" if i else "n37" for i in range(60)}  # n00 leads back to n37
    df = spark.createDataFrame([(n, p, int(n[1:])) for n, p in parents.items()], "node string, parent string, place int")
    for start in ("n55", "n10"):
        pieces = graph.follow(df, spark.createDataFrame([(start,)], "node string"), 7).orderBy("piece").collect()
        line = [n for r in pieces for n in r.path]
        want, node = [], start
        while node not in want:
            want.append(node)
            node = parents[node]
        assert line == want


def test_plans(spark):
    resolved = spark.createDataFrame([(0, "main", "branch", "5"), (1, "v1", "tag-lightweight", "10"), (2, "develop", "branch", "20"), (3, "gone", "commit-oid", None)], "ref_index int, name string, ref_type string, head string")
    prior = spark.createDataFrame([("main", "branch", "1", 0), ("main", "branch", "3", 1)], "ref string, ref_type string, tip_oid string, position int")
    plans = planning.make_plans(resolved, prior, merge_base="2")
    assert [(r.ref_index, r.exclude) for r in plans.orderBy("ref_index").collect()] == [(0, "3"), (1, None), (2, "2")]
    assert {r.exclude for r in planning.make_plans(resolved, prior, since="9").collect()} == {"9"}
    assert {r.exclude for r in planning.make_plans(resolved, prior, since_date=True).collect()} == {None}
    assert [r.name for r in planning.missing_refs(resolved).collect()] == ["gone"]
    assert [r.name for r in planning.new_branches(resolved, prior).collect()] == ["develop"]
    known = spark.createDataFrame([("3",)], "oid string")
    fell = planning.drop_unknown_excludes(plans, known).orderBy("ref_index").collect()
    assert [(r.exclude, r.fell_back) for r in fell] == [("3", False), (None, False), (None, True)]


@pytest.mark.parametrize("seconds,offset,want", [
    (0, 540, "1970-01-01T09:00:00+09:00"), (0, -300, "1969-12-31T19:00:00-05:00"), (1705276800, 540, "2024-01-15T09:00:00+09:00"), (0, 330, "1970-01-01T05:30:00+05:30"), (None, 0, None),
])
def test_iso_timestamps(spark, seconds, offset, want):
    row = spark.createDataFrame([(seconds, offset)], "s bigint, o int").select(values.iso_timestamp(F.col("s"), F.col("o")).alias("t")).head()
    assert row.t == want


def test_line_counts(spark):
    assert changes.changed_lines(None, b"one\ntwo\n") == (2, 0)
    assert changes.changed_lines(b"one\ntwo\n", b"one\nthree\nfour\n") == (2, 1)
    assert changes.changed_lines(b"gone\n", None) == (0, 1)
    assert changes.changed_lines(b"a\nb", b"a\nb\n") == (1, 1)
    assert changes.changed_lines(b"\xef\xbb\xbfa\n", b"a\n") == (0, 0)
    random.seed(12)
    for _ in range(60):
        a, b = ([random.choice("abcd") for _ in range(random.randrange(14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        common = table[-1][-1]
        assert common >= sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks())
        assert changes.changed_lines("".join(x + "\n" for x in a).encode(), "".join(x + "\n" for x in b).encode()) == (len(b) - common, len(a) - common)


def test_guards(spark):
    nul = b"a" * 8_000 + b"\x00"
    rows = [(1, b"x\x00", b""), (2, None, nul), (3, None, b"1234"), (4, b"12\x0045", None), (5, None, None)]
    df = spark.createDataFrame(rows, "i int, before_content binary, after_content binary")
    got = {r.i: (r.additions, r.deletions, r.skipped) for r in changes.with_line_counts(df).collect()}
    assert got == {1: (None, None, "binary"), 2: (1, 0, None), 3: (1, 0, None), 4: (None, None, "binary"), 5: (0, 0, None)}
    sized = {r.i: r.skipped for r in changes.with_line_counts(df, 4).collect()}
    assert sized == {1: "binary", 2: "size", 3: None, 4: "size", 5: None}


def test_binary_documents_of_any_id(spark, tmp_path):
    """Ids beyond an int, below zero and null give what the SQL says; a NUL beyond byte 8,000 or the text's end doesn't count."""
    ids = [-(2**63), -1, 0, 1, 79, 80, 21_474_836, 21_474_837, 2**63 - 1, None]
    texts = ["", "a", "x" * 200, "ö" * 9_000]
    rows = [(i, t) for i in ids for t in texts] + [(7, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.is_binary) for r in history_queries.binary_documents(spark, str(tmp_path)).collect()]
    want = [(i, None if i is None else i * 100 < min(8_000, len(t.encode()))) for i, t in rows if t is not None]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_tree_changes(spark):
    trees = [("c", "a", "1", "100644"), ("c", "b", "2", "100755"), ("c", "l", "9", "160000"), ("p", "a", "1", "100644"), ("p", "b", "2", "100644"), ("p", "old", "3", "120000"), ("p", "l", "4", "100644")]
    got = changes.tree_changes(spark.createDataFrame(trees, "oid string, path string, blob_oid string, mode string"), spark.createDataFrame([("c", ["p", "q"]), ("p", [])], "oid string, parents array<string>"))
    assert {(r.oid, r.path, r.status) for r in got.collect()} == {("c", "b", "modified"), ("c", "old", "deleted"), ("c", "l", "deleted"), ("p", "a", "added"), ("p", "b", "added"), ("p", "old", "added"), ("p", "l", "added")}


@pytest.mark.parametrize("path,rules,want", [
    ("SRC/INDEX.TS", None, "TypeScript"), ("src\\index.ts", None, "TypeScript"), ("package.json", None, "npm package manifest"), ("types/index.d.ts", [("*.ts", "A"), ("*.d.ts", "B")], "B"),
    ("dockerfile", None, "Unknown"), ("include/header.h", None, "Unknown"), ("conventions.java.gradle.kts", None, "Gradle script"), ("a/Makefile", [("Makefile", "Mine")], "Mine"), ("", None, "Unknown"),
])
def test_file_types(spark, path, rules, want):
    assert spark.createDataFrame([(path,)], "p string").select(file_types.classify(F.col("p"), rules)["name"].alias("n")).head().n == want


def test_file_type_rules_are_checked():
    for bad in ([("*.", "x")], [("a*b", "x")], [("*.a", "x"), ("*.A", "y")], [("", "x")], [("*.a", "")]):
        with pytest.raises(ValueError):
            file_types.check_rules(bad)


def test_assay_metrics_need_both_counts(spark):
    df = spark.createDataFrame([(5, 2), (None, 5), (3, None)], "a bigint, d bigint").select(plugins.assay_metrics(F.col("a"), F.col("d")).alias("m")).collect()
    assert [tuple(r.m) for r in df] == [(3, 7, 5), (None, None, None), (None, None, None)]


def test_custom_fields():
    for bad in ({}, {"1x": 1}, {"a": {"b": 1}}, None, [1], float("nan"), {"a": float("inf")}):
        with pytest.raises(ValueError):
            plugins.custom_field(bad)


def test_identity_profiles(spark):
    profiles = spark.createDataFrame([(0, "a@x", None, "A", "a@y", "t"), (1, "a@x", "B", "Z", "z@y", None), (2, None, "C", "Cc", "c@y", "")], "position int, match_email string, match_name string, name string, email string, team string")
    people = spark.createDataFrame([(1, "B", "a@x"), (2, "B", "q@x"), (3, "C", None), (4, None, None)], "i int, name string, email string")
    got = {r.i: (r.profile_name, r.profile_email, r.matched_by, r.team) for r in plugins.identity_profiles(people, profiles).collect()}
    assert got == {1: ("A", "a@y", "email", "t"), 2: ("Z", "z@y", "name", None), 3: ("Cc", "c@y", "name", ""), 4: (None, None, None, None)}
    warnings = plugins.check_profiles([{"match_email": "a", "name": "n", "email": "e"}, {"match_email": "a", "name": "n", "email": "e", "x": 1}], [])
    assert len(warnings) == 2
    for bad in ([], [{"name": "n", "email": "e"}], [{"match_name": "a", "name": "", "email": "e"}]):
        with pytest.raises(ValueError):
            plugins.check_profiles(bad, [])


def test_conventional_commits():
    got = plugins.parse_conventional("feat(parser)!: add docs\n\nExpand it.\n\nBREAKING CHANGE: all new\nmore\nRefs: #123 @you")
    assert (got["type"], got["scope"], got["subject"], got["body"]) == ("feat", "parser", "add docs", "Expand it.")
    assert got["notes"] == [{"title": "BREAKING CHANGE", "text": "all new\nmore"}] and got["references"][0]["issue"] == "123" and got["mentions"] == ["you"]
    assert plugins.parse_conventional("no type")["type"] is None and plugins.parse_conventional(" ") is None


class Upper:
    def init(self, runtime):
        pass

    def project(self, fact):
        if fact["name"] is None:
            return plugins.Outcome("skip")
        if fact["name"] == "bad":
            raise KeyError("bad")
        return plugins.Outcome("success", {"upper": fact["name"].upper()})


def test_plugins(spark):
    df = spark.createDataFrame([("a",), (None,), ("bad",)], "name string")
    out = plugins.enrich(df, [plugins.Extension("up-1", Upper()), plugins.Extension("c", plugins.custom_field(1))])
    got = [json.loads(r.value) for r in project.json_lines(out).collect()]
    assert [g["extensions"] for g in got] == [{"up-1": {"upper": "A"}, "c": 1}, {"up-1": None, "c": 1}, {"up-1": None, "c": 1}]
    assert plugins.enrich(df, []) is df
    with pytest.raises(Exception, match="up-1 failed"):
        plugins.enrich(df, [plugins.Extension("up-1", Upper(), "fatal")]).collect()
    with pytest.raises(ValueError):
        plugins.Extension("Up", Upper())


def test_rotation(spark, tmp_path):
    lines = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(23)], "i int, value string").repartition(3)
    by_lines = sink.rotate_by_lines(lines, ["i"], 10).orderBy("i").collect()
    assert [r.file for r in by_lines] == [i // 10 + 1 for i in range(23)]
    sized = lines.select("i", sink.line_bytes().alias("n_bytes"))
    got = sink.rotate_by_bytes(sized, ["i"], 7, 4).orderBy("i").collect()
    file, held, count, want = 1, 0, 0, []
    for i in range(23):
        want.append(file)
        held, count = held + i % 5 + 1, count + 1
        if held >= 7 or count >= 4:
            file, held, count = file + 1, 0, 0
    assert [r.file for r in got] == want
    done = sink.write_json_lines(lines.join(sink.rotate_by_bytes(sized, ["i"], 7, 4).select("i", "file"), "i"), str(tmp_path), "p", "S")
    names = sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith("."))
    assert done["files"] == len(names) == max(want) and names[0] == "p-S-000001.jsonl" and done["records"] == 23
    assert "".join(p.read_text() for p in sorted(tmp_path.glob("*.jsonl"))) == "".join("x" * (i % 5) + "\n" for i in range(23))


def test_state(tmp_path):
    path = str(tmp_path / "s.json")
    with pytest.raises(state.StateError):
        state.load_state(path, "/r")
    assert state.load_state(path, "/r", "snapshot", "t")[1]
    made = state.next_state([{"name": "main", "ref_type": "branch", "head": "a" * 40}], "/r", "t")
    assert state.write_state(path, made) and not state.write_state(path, state.empty_state("/r", "t"))
    assert state.load_state(path, "/r") == (made, False)
    for change in ({"version": 1}, {"repositoryPath": "/q"}, {"refs": [made["refs"][0] | {"refType": "x"}]}, {"refs": [made["refs"][0] | {"tipOid": "A"}]}):
        with pytest.raises(state.StateError):
            state.check_state(made | change, "/r")


def test_values(spark):
    assert values.parse_byte_size("10K") == 10_240 and values.parse_positive("12") == 12
    for bad in ("", "1T", "-1", "0"):
        with pytest.raises(ValueError):
            values.parse_byte_size(bad)
    for bad in ("0", "01", "1.5", "9" * 20):
        with pytest.raises(ValueError):
            values.parse_positive(bad)
    rows = [("https://h/a/b.git", "/x/y/", "b"), ("https://h/a/", "/x/y/", "y"), (None, "/x/z", "z")]
    df = spark.createDataFrame(rows, "u string, p string, want string").select("want", values.repository_name(F.col("u"), F.col("p")).alias("got"))
    assert all(r.want == r.got for r in df.collect())
