"""Variant spellings of people and organisations, linked across name and e-mail.

Each distinct (name, address) becomes a unit vector with two blocks. The name block holds hashed character n-grams of the
cleaned name, the account block n-grams of the address's local part, the local part as a whole and the domain; n-grams are
weighted by their inverse frequency over all rows. How the blocks share the weight is told by the data: a name counts by
its information (a lone given name says little), an account by its coherence, the mean cosine of the full names that write
from it, so that a mailbox of many people says little however many they are.

1. A sparse similarity join finds all pairs that can reach the threshold: pairs with one local part, and pairs that share
   one of the rare n-grams at the front of their name vectors, which are indexed until what is left can't reach the
   threshold. Posting lists are cut into blocks of bounded size, and a block pair is scored by one matrix product.
2. The exact cosine decides; a check then takes away pairs whose names contradict each other across different addresses.
   Short forms of names are learnt from the data: two tokens that replace each other at several addresses.
3. Within connected components, average linkage on the cosines makes the groups. The mean cosine of two groups is the
   product of their vector sums, so no matrix of all pairs is needed. All groups that are each other's nearest are merged
   at once, in one task for small components and by joins for large ones, with the same result.

There is no cap of n on the partners of a row: the threshold join keeps all of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chronoweave.llm.minhash import by_group, connected_components
from chronoweave.storage import materialize

#: Cosine of a link, mean cosine of a group, length of n-grams, buckets of their hashes.
THRESHOLD, LINKAGE, GRAM, GRAM_BUCKETS = 0.54, 0.4, 5, 1 << 18
#: Shares of the whole local part and of the domain in the account block, weight of a coherent account against a full name.
LOCAL_SHARE, DOMAIN_SHARE, ACCOUNT_WEIGHT = 0.5, 0.05, 1.25
#: Coherence from which an account counts in full, below which it is shared, and that of a local part used by anyone.
COHERENT, SHARED, ANYONE = 0.35, 0.25, 0.05
#: Rows of a block of a posting list, nodes of a component that one task clusters, addresses that show a short form.
BLOCK, LOCAL_COMPONENT, LEAST_SUPPORT = 1_000, 2_000, 2
#: A name without an address must fit one account better than any other by this much.
MARGIN = 0.08

# Service accounts, mailboxes of teams, titles, legal forms and fillers in names.
SERVICE = frozenset("ci bot noreply no-reply donotreply release releases mirror sync info admin root build builds deploy support help hello contact mail webmaster security automation builder cron jenkins git svn".split())
TEAM = re.compile(r"(?:dev|team|infra|build|ops|qa|admin|release|test|staff|office|desk|sre|support|web|ci)[-_.]?\d+$")
TITLES = frozenset("dr ing prof mr mrs ms mx herr frau hr fr jr sr phd msc bsc dipl mag sir".split())
FILLERS = frozenset("the team bot sa s.a inc ltd llc gmbh co corp ag plc bv oy ab".split())
# Cyrillic and Greek letters in Latin script.
LATIN = dict(
    zip(
        "абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ",
        "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya i yi ye g".replace("_", "").split(" "),
        strict=True,
    )
) | dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split(), strict=True))
LATIN |= {"х": "h", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "þ": "th", "ð": "d"}
# Latin spellings and what they become by way of Cyrillic.
SOUNDS = (("qu", "kv"), ("ph", "f"), ("ch", "k"), ("ck", "k"), ("x", "ks"), ("j", "y"), ("c", "k"), ("w", "v"), ("th", "t"), ("ia", "a"), ("h", ""))
MOJIBAKE = re.compile("[ÃÂÄÅÐÑ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


def repaired(text: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, put right where it can be."""
    if MOJIBAKE.search(text):
        for codec in ("cp1252", "latin-1"):
            try:
                return text.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
    return text


def plain(text: str) -> str:
    """Lower case, Latin script, no accents."""
    text = "".join(LATIN.get(c, c) for c in text.lower())
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return "".join(LATIN.get(c, c) for c in text)


def name_tokens(name: str | None) -> list[str]:
    """Cleaned parts of a name: no titles, tags in brackets, affiliations or case; joined words are split at capitals."""
    if not name or "@" in name.strip("@ ") and " " not in name.strip():
        return []
    name = unicodedata.normalize("NFC", repaired(name.replace("\xa0", " "))).strip()
    name = re.sub(r"\[[^\]]*\]|\([^)]*\)|\s[/|–-]\s.*$", " ", name)
    name = re.sub(r"\b(?:[^\W\d_]\.){2,}", lambda m: m.group().replace(".", ""), name)  # S.A. is one word
    if not re.search(r"[\s_.@]", name):
        name = re.sub(r"(?<=[a-zà-ÿа-яё])(?=[A-ZÀ-ÞА-ЯЁ])", " ", name)
    words = [w for w in re.split(r"[\s_.,@/+&-]+", plain(name)) if w]
    return [w for w in words if w not in TITLES and w not in FILLERS]


def address_parts(email: str | None) -> tuple[str, str]:
    """(local part without tag and relay number, domain), lower case; empty where there is none."""
    email = plain((email or "").replace("\xa0", " ").strip())
    local, _, domain = email.partition("@")
    local, domain = local.strip(), domain.strip()
    if "noreply" in domain and (m := re.match(r"\d+\+(.+)", local)):
        local = m.group(1)
    return (local.split("+")[0] or local), domain


@lru_cache(1 << 16)
def near(a: str, b: str) -> bool:
    """Equal but for a typo or two, by length."""
    if a == b:
        return True
    limit = 0 if min(len(a), len(b)) < 4 else 1 if min(len(a), len(b)) < 7 else 2
    if abs(len(a) - len(b)) > limit:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1] <= limit


@lru_cache(1 << 16)
def sounded(token: str) -> str:
    """A token with the spellings that change on the way through another script made equal."""
    for spelled, plain_ in SOUNDS:
        token = token.replace(spelled, plain_)
    return token


NORMAL = T.StructType([T.StructField(n, T.StringType()) for n in ("name_key", "local", "domain")])


def normal(name: str | None, email: str | None) -> tuple[str, str, str]:
    """(name tokens in order, account, domain). The account of a service address is its organisation, the domain.

    A relay hides the domain, which is then empty; a name that only repeats the account is none.
    """
    local, domain = address_parts(email)
    tokens = name_tokens(name)
    if tokens and "".join(tokens) == re.sub(r"[\W_]", "", local) and not re.search(r"\s", (name or "").strip()):
        tokens = []
    if "noreply" in domain.split("."):
        domain = ""
    if local in SERVICE and domain:
        local = domain
    return " ".join(sorted(tokens)), local, domain


@F.pandas_udf(NORMAL)
def _normal(name: pd.Series, email: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([normal(n, e) for n, e in zip(name, email, strict=True)], columns=["name_key", "local", "domain"])


def grams(tokens: list[str]) -> list[int]:
    """Hashed n-grams of tokens, each with its ends marked: a bounded alphabet, whatever the script."""
    out = set()
    for token in tokens:
        padded = f"^{token}$"
        out |= {xxhash.xxh32_intdigest(padded[i : i + GRAM]) % GRAM_BUCKETS for i in range(max(1, len(padded) - GRAM + 1))}
    return sorted(out)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _grams(text: pd.Series) -> pd.Series:
    return text.map(lambda t: grams([x for x in re.split(r"[\W_]+", t) if x]))


class Weights:
    """Inverse frequencies of the n-grams of names (first half) and local parts (second half), of n classes."""

    def __init__(self, counts: np.ndarray, n: int, n_named: int):
        self.idf = np.log((1 + n) / (1 + counts)) + 0.1
        self.counts = counts
        named = counts[:GRAM_BUCKETS]
        self.mean_mass = float((named * self.idf[:GRAM_BUCKETS] ** 2).sum() / max(1, n_named))


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a column of integer lists."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _unit(lists: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, weight in the row's unit vector, mass of each row)."""
    row, gram = _flat(lists)
    weight = idf[gram]
    mass = np.bincount(row, weight * weight, minlength=len(lists))
    return row, gram, weight / np.sqrt(np.maximum(mass[row], 1e-12)), mass


def account_share(mass: np.ndarray, has_account: np.ndarray, coherence: np.ndarray, everyone: np.ndarray, crowded: np.ndarray, mean_mass: float) -> np.ndarray:
    """Share of the account block in a vector: 0 without an account, 1 without a name."""
    account = ACCOUNT_WEIGHT * np.minimum(1, np.maximum(coherence, 0.02) / COHERENT) * np.minimum(1, np.maximum(everyone, 0.02) / (2 * ANYONE))
    name = np.minimum(1, mass / max(mean_mass, 1e-9))
    share = np.where(has_account, np.where(mass > 0, account / np.maximum(account + name, 1e-9), 1.0), 0.0)
    return np.where(crowded & (mass > 0), np.minimum(share, 0.2), share)


def name_bound(share: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    """Least squared name cosine of a pair with the threshold, given one side's account share.

    Accounts with different local parts have a cosine of at most 1 - LOCAL_SHARE; in crowded ones equal local parts, with
    1, are looked for by names as well. By Cauchy-Schwarz threshold^2 <= (1 - w) c^2 + w d^2, whatever the other side's share.
    """
    account = np.where(crowded, 1.0, (1 - LOCAL_SHARE) ** 2)
    return (THRESHOLD**2 - share * account) / np.maximum(1 - share, 1e-9)


VECTOR = T.StructType([T.StructField("share", T.FloatType()), T.StructField("indexed", T.ArrayType(T.IntegerType())), T.StructField("blocks", T.ArrayType(T.IntegerType()))])


def _vectors(weights: Broadcast):
    """Column function (name grams, has account, coherence, everyone, crowded) -> account share, indexed grams, blocks of their lists."""

    @F.arrow_udf(VECTOR)
    def vectors(ng: pa.Array, account: pa.Array, coherence: pa.Array, everyone: pa.Array, crowded: pa.Array) -> pa.Array:
        w = weights.value
        row, gram, weight, mass = _unit(ng, w.idf)
        number = lambda a: a.to_numpy(zero_copy_only=False)
        many = number(crowded).astype(bool)
        share = account_share(mass, number(account).astype(bool), number(coherence), number(everyone), many, w.mean_mass)
        bound = name_bound(share, many)
        order = np.lexsort((gram, w.counts[gram], row))  # from rare to common, alike in all rows
        row, gram, weight = row[order], gram[order], weight[order]
        square = weight * weight
        before = np.cumsum(square) - square
        starts = np.r_[0, np.flatnonzero(row[1:] != row[:-1]) + 1] if len(row) else np.zeros(0, int)
        before -= np.repeat(before[starts], np.diff(np.r_[starts, len(row)])) if len(row) else 0
        kept = 1 - before >= bound[row] - 1e-6
        counts = np.bincount(row[kept], minlength=len(ng))
        offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
        blocks = -(-w.counts[gram[kept]] // BLOCK)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (gram[kept].astype(np.int32), blocks.astype(np.int32))]
        return pa.StructArray.from_arrays([pa.array(share, pa.float32()), *lists], ["share", "indexed", "blocks"])

    return vectors


POSTING = "key bigint, first int, second int, side int, node string, ng array<int>, share float"


def _similar_names(weights: Broadcast):
    """Scores block pairs: (a, b) of all pairs of different rows of a block pair that can reach the threshold.

    Rows come sorted by (key, first, second), one block pair after another; a key of local parts is negative.
    """

    def pairs_of(side: np.ndarray, node: np.ndarray, ng: list, share: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
        idf = weights.value.idf
        row = np.repeat(np.arange(len(ng)), [len(g) for g in ng])
        gram = np.concatenate(ng).astype(np.int64) if len(row) else np.zeros(0, np.int64)
        weight = idf[gram]
        weight = weight / np.sqrt(np.maximum(np.bincount(row, weight * weight, minlength=len(ng))[row], 1e-12))
        _, column, count = np.unique(gram, return_inverse=True, return_counts=True)
        common = count[column] > 1  # a gram of one row adds to no product
        places, column = np.unique(column[common], return_inverse=True)
        matrix = np.zeros((len(ng), len(places)), np.float32)
        matrix[row[common], column] = weight[common]
        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side == 1).any() else (np.arange(len(ng)),) * 2
        most = 1.0 if key < 0 else 1 - LOCAL_SHARE
        names, accounts = np.sqrt(1 - share), np.sqrt(share * most)
        score = (matrix[left] * names[left, None]) @ (matrix[right] * names[right, None]).T + accounts[left, None] * accounts[right][None, :]
        i, j = np.nonzero(score >= THRESHOLD - 1e-4)
        a, b = node[left[i]], node[right[j]]
        if left is right:
            return a[i < j], b[i < j]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def done(table: pa.Table, last: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
            keys = np.stack([table.column(c).to_numpy() for c in ("key", "first", "second")], axis=1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            if not last:
                cuts = cuts[:-1]
            lists = table.column("ng").combine_chunks()
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            node, share, side = (table.column(c).to_numpy() for c in ("node", "share", "side"))
            found = [[], []]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y - x > 1:
                    part = [flat[offsets[k] : offsets[k + 1]] for k in range(x, y)]
                    for kept, more in zip(found, pairs_of(side[x:y], node[x:y], part, share[x:y].astype(np.float64), int(keys[x, 0])), strict=True):
                        kept.append(more)
            a, b = (np.concatenate(f) if f else np.zeros(0, object) for f in found)
            swap = a > b
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            rest = None if last else table.slice(cuts[-1])
            return [pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], names=["a", "b"])], rest

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            out, held = done(table, False)
            yield from out
        if held is not None and len(held):
            yield from done(held, True)[0]

    return run


def _blocks(rows: DataFrame, key: Column, n_blocks: Column) -> DataFrame:
    """Rows of posting lists, once for every pair of blocks of the list that holds the row's own block."""
    own = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), n_blocks - 1))
    placed = rows.select(key.alias("key"), own.alias("own"), other.alias("other"), "node", "ng", "share")
    return placed.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "ng", "share")


def _candidates(vectors: DataFrame, weights: Broadcast) -> DataFrame:
    """(a, b): all pairs of classes whose cosine can reach the threshold, each once."""
    named = vectors.select("node", "ng", "share", F.explode(F.arrays_zip("indexed", "blocks")).alias("i"))
    by_name = _blocks(named.withColumn("n", F.greatest(F.lit(1), F.col("i.blocks"))), F.col("i.indexed").cast("long"), F.col("n"))
    account = -1 - F.abs(F.xxhash64("local") % F.lit(1 << 62))
    used = vectors.filter("local <> '' AND NOT crowded")
    sizes = used.groupBy("local").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    by_account = _blocks(used.join(sizes, "local"), account, F.col("n"))
    postings = by_name.unionByName(by_account).repartition("key", "first", "second").sortWithinPartitions("key", "first", "second")
    return postings.mapInArrow(_similar_names(weights), "a string, b string").filter("a <> b").distinct()


@lru_cache(1 << 18)
def alike(x: str, y: str) -> bool:
    """Whether two tokens can be spellings of one: equal but for typos, an initial, a beginning, or by sound."""
    if x[0] == y[0] and (len(x) == 1 or len(y) == 1):
        return True
    if len(x) >= 3 and y.startswith(x) or len(y) >= 3 and x.startswith(y):
        return True
    return near(x, y) or near(sounded(x), sounded(y))


def unmatched(a: list[str], b: list[str]) -> tuple[list[str], list[str]]:
    """Tokens of either name that are no spelling of one of the other."""
    return [x for x in a if not any(alike(x, y) for y in b)], [y for y in b if not any(alike(x, y) for x in a)]


def is_full(tokens: list[str]) -> bool:
    return sum(len(t) > 1 for t in tokens) >= 2


def contradiction(a: dict, b: dict) -> tuple[bool, list[str], list[str]]:
    """(whether two rows can't be one person although their vectors are alike, unmatched tokens of either name).

    Rows of one coherent address contradict each other never; of a shared one if both names have something of their own.
    Over several hosts one account needs names of which one holds the other; without an account in common full names must
    agree token by token.
    """
    x, y = a["name_key"].split(), b["name_key"].split()
    left, right = unmatched(x, y)
    shared = a["shared"] or b["shared"]
    account = a["local"] != "" and a["local"] == b["local"]
    same = account and (a["domain"] == b["domain"] or not shared and not (a["domain"] and b["domain"]))
    if shared:
        return not (same and x and y) or bool(left and right), left, right
    if same:
        return False, left, right
    if not account:
        return not (is_full(x) and is_full(y)) or bool(left and right) or any(len(t) > 1 for t in left + right), left, right
    return any(len(t) > 1 for t in left) and any(len(t) > 1 for t in right), left, right


SCORED = T.StructType([
    T.StructField("cosine", T.DoubleType()), T.StructField("fits", T.BooleanType()),
    T.StructField("left", T.ArrayType(T.StringType())), T.StructField("right", T.ArrayType(T.StringType())),
])
HALVES = (("ng", 0), ("lg", GRAM_BUCKETS))


def _blocks_of(frame: dict, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, weight) of all n-grams of a batch, scaled by the shares of their blocks; features of names come first."""
    share = np.asarray(frame["share"], np.float64)
    domain = np.array([bool(d) for d in frame["domain"]])
    parts = []
    for column, shift in HALVES:
        row, gram, weight, _ = _unit(frame[column], w.idf[shift : shift + GRAM_BUCKETS])
        scale = np.sqrt(1 - share) if not shift else np.sqrt(share * (1 - LOCAL_SHARE - DOMAIN_SHARE * domain))
        parts.append((row, gram + shift, weight * scale[row]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _cosines(a: dict, b: dict, w: Weights) -> np.ndarray:
    """Cosines of pairs of rows of two batches."""
    n = len(a["local"])
    keys, values = [], []
    for side in (a, b):
        row, feature, weight = _blocks_of(side, w)
        key = row * (2 * GRAM_BUCKETS) + feature
        order = np.argsort(key)
        keys.append(key[order])
        values.append(weight[order])
    at = np.minimum(np.searchsorted(keys[1], keys[0]), max(0, len(keys[1]) - 1))
    hit = keys[1][at] == keys[0] if len(keys[1]) else np.zeros(len(keys[0]), bool)
    out = np.bincount(keys[0][hit] // (2 * GRAM_BUCKETS), values[0][hit] * values[1][at[hit]], minlength=n)
    both = np.sqrt(np.asarray(a["share"], np.float64) * np.asarray(b["share"], np.float64))
    equal = lambda c: np.array([bool(x) and x == y for x, y in zip(a[c], b[c], strict=True)])
    return out + both * (LOCAL_SHARE * equal("local") + DOMAIN_SHARE * equal("domain"))


def _columns(column: pa.StructArray) -> dict:
    held = {f.name: column.field(i) for i, f in enumerate(column.type)}
    return {k: v if k in ("ng", "lg") else v.to_pylist() for k, v in held.items()}


def _scored(weights: Broadcast):
    """Column function of two class records: exact cosine, whether the names fit, and their unmatched tokens."""

    @F.arrow_udf(SCORED)
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = _columns(a), _columns(b)
        cosine = _cosines(x, y, weights.value)
        out = []
        for i, c in enumerate(cosine.tolist()):
            if c < THRESHOLD:
                out.append({"cosine": c, "fits": False, "left": [], "right": []})
                continue
            one, other = ({k: side[k][i] for k in ("name_key", "local", "domain", "shared")} for side in (x, y))
            against, left, right = contradiction(one, other)
            out.append({"cosine": c, "fits": not against, "left": left, "right": right})
        return pa.array(out, pa.struct([("cosine", pa.float64()), ("fits", pa.bool_()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))]))

    return score


def _links(pairs: DataFrame, vectors: DataFrame, weights: Broadcast) -> DataFrame:
    """(a, b, cosine) of the pairs that reach the threshold and don't contradict each other."""
    record = F.struct("name_key", "local", "domain", "shared", "ng", "lg", "share")
    records = vectors.select("node", record.alias("x"))
    both = pairs.join(records.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").join(records.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")
    facts = [F.col(f"{x}.{c}").alias(f"{c}_{x[1]}") for x in ("xa", "xb") for c in ("local", "domain", "shared")]
    scored = both.select("a", "b", *facts, _scored(weights)("xa", "xb").alias("s")).select("a", "b", "s.*", "local_a", "domain_a", "local_b", "domain_b", (F.col("shared_a") | F.col("shared_b")).alias("shared"))
    scored = materialize(scored.filter(F.col("cosine") >= THRESHOLD), "scored")
    # short forms: tokens that replace each other at several addresses; a contradiction that is one of them is none
    one_account = "NOT shared AND local_a = local_b AND local_a <> ''"
    tokens = lambda x, y: (F.least(x, y).alias("t"), F.greatest(x, y).alias("u"))
    replaced = scored.filter(f"{one_account} AND domain_a = domain_b AND size(left) = 1 AND size(right) = 1 AND length(left[0]) > 1 AND length(right[0]) > 1")
    forms = replaced.select("local_a", "domain_a", *tokens(F.col("left")[0], F.col("right")[0])).distinct().groupBy("t", "u").agg(F.count(F.lit(1)).alias("n"))
    forms = forms.filter(F.col("n") >= LEAST_SUPPORT).select("t", "u")
    against = scored.filter(f"NOT fits AND {one_account} AND (size(left) = 1 OR size(right) = 1)")
    against = against.withColumn("x", F.explode("left")).withColumn("y", F.explode("right")).select("a", "b", "cosine", *tokens(F.col("x"), F.col("y")))
    saved = against.join(forms, ["t", "u"], "left_semi").select("a", "b", "cosine").distinct()
    return _without_doubtful(scored.filter("fits").select("a", "b", "cosine").unionByName(saved), vectors)


def _without_doubtful(links: DataFrame, vectors: DataFrame) -> DataFrame:
    """Takes a name without an address away from its accounts where it fits several of them about equally well."""
    bare = vectors.filter("local = ''").select(F.col("node").alias("x"))
    addressed = vectors.filter("local <> ''").select(F.col("node").alias("y"), "local")
    ways = links.select(F.col("a").alias("x"), F.col("b").alias("y"), "cosine").unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"), "cosine"))
    fits = ways.join(bare, "x", "left_semi").join(addressed, "y").groupBy("x", "local").agg(F.max("cosine").alias("c"))
    best = fits.withColumn("best", F.max("c").over(Window.partitionBy("x"))).filter(F.col("c") >= F.col("best") - MARGIN)
    doubtful = best.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("x")
    out = materialize(links, "fitting")
    for end, other in (("a", "b"), ("b", "a")):
        unsure = doubtful.select(F.col("x").alias(end), F.lit(True).alias("_unsure"))
        met = addressed.select(F.col("y").alias(other), F.lit(True).alias("_met"))
        out = out.join(unsure, end, "left").join(met, other, "left").filter("_unsure IS NULL OR _met IS NULL").select("a", "b", "cosine")
    return out


def _parts(row: dict, w: Weights) -> dict[int, float]:
    """A class as a sparse unit vector."""
    frame = {"ng": pa.array([row["ng"]], pa.list_(pa.int32())), "lg": pa.array([row["lg"]], pa.list_(pa.int32())), "share": [row["share"]], "domain": [row["domain"]]}
    _, feature, weight = _blocks_of(frame, w)
    out = dict(zip(feature.tolist(), weight.tolist(), strict=True))
    for name, part, bit in (("local", LOCAL_SHARE, 1 << 61), ("domain", DOMAIN_SHARE, 1 << 60)):
        if row[name]:
            out[xxhash.xxh64_intdigest(row[name]) % (1 << 59) | bit] = float(np.sqrt(row["share"] * part))
    return out


def average_linkage(vectors: list[dict[int, float]], links: list[tuple[int, int]], least: float = LINKAGE) -> list[int]:
    """Group numbers, the least member's, of agglomerative clustering by the mean cosine of linked groups, down to ``least``.

    Groups that are each other's nearest merge, all at once, again until none are left; ties go to the lesser number.
    A pair of which one side has only a name and the other only an account says nothing and isn't counted.
    """
    sums = dict(enumerate(vectors))
    bare = lambda v: (int(all(k < GRAM_BUCKETS for k in v)), int(all(k >= GRAM_BUCKETS for k in v)))
    counts = {i: (1, *bare(v)) for i, v in sums.items()}
    near_to: dict[int, set[int]] = {i: set() for i in sums}
    for i, j in links:
        near_to[i].add(j)
        near_to[j].add(i)
    group = list(range(len(vectors)))
    scores: dict[tuple[int, int], float] = {}

    def score(i: int, j: int) -> float:
        pair = (i, j) if i < j else (j, i)
        if pair not in scores:
            x, y = (sums[i], sums[j]) if len(sums[i]) < len(sums[j]) else (sums[j], sums[i])
            (n, a, b), (m, c, d) = counts[i], counts[j]
            scores[pair] = sum(v * y.get(k, 0.0) for k, v in x.items()) / max(1, n * m - a * d - b * c)
        return scores[pair]

    while True:
        best = {i: max(((round(score(i, j), 9), -j) for j in js), default=(0.0, 1)) for i, js in near_to.items()}
        merges = [(i, -b) for i, (s, b) in best.items() if s >= least and i < -b and best[-b][1] == -i]
        if not merges:
            return group
        into = {j: i for i, j in merges}
        for i, j in merges:
            for k, v in sums.pop(j).items():
                sums[i][k] = sums[i].get(k, 0.0) + v
            counts[i] = tuple(x + y for x, y in zip(counts[i], counts.pop(j), strict=True))
            near_to[i] |= near_to.pop(j)
        changed = {i for i, _ in merges} | set(into)
        scores = {p: s for p, s in scores.items() if not changed & set(p)}
        near_to = {i: {into.get(k, k) for k in js} - {i} for i, js in near_to.items()}
        group = [into.get(g, g) for g in group]


def _small_components(members: DataFrame, weights: Broadcast) -> DataFrame:
    """(node, group) of components that fit a task; ``members`` has component, node, its class record and its links."""

    def group(component: list[tuple]) -> list[tuple]:
        component = sorted(component, key=lambda row: row[0])
        number = {row[0]: i for i, row in enumerate(component)}
        links = [(i, number[b]) for i, row in enumerate(component) for b in (row[6] if row[6] is not None else ())]
        if len(component) <= 2:  # a link is above the least mean
            return [(row[0], component[0][0]) for row in component]
        rows = [{"local": r[1], "domain": r[2], "ng": list(r[3]), "lg": list(r[4]), "share": r[5]} for r in component]
        found = average_linkage([_parts(r, weights.value) for r in rows], links)
        return [(row[0], component[g][0]) for row, g in zip(component, found, strict=True)]

    return by_group(members, ["component"], ["node", "local", "domain", "ng", "lg", "share", "linked"], group, "node string, group string")


def _large_components(classes: DataFrame, links: DataFrame, weights: Broadcast, least: float = LINKAGE) -> DataFrame:
    """``average_linkage`` by joins: (node, group) for components of any size. A round joins linked groups' vector sums."""

    @F.pandas_udf("array<struct<f:bigint,w:double>>")
    def parts(local: pd.Series, domain: pd.Series, ng: pd.Series, lg: pd.Series, share: pd.Series) -> pd.Series:
        rows = zip(local, domain, ng, lg, share, strict=True)
        return pd.Series([[{"f": f, "w": w} for f, w in _parts(dict(zip(("local", "domain", "ng", "lg", "share"), map(_plain, r), strict=True)), weights.value).items()] for r in rows])

    # numbers in the order of the nodes, as the ties of the local algorithm have it, are the nodes' own names here
    groups = materialize(classes.select("node", F.col("node").alias("group")), "groups")
    features = materialize(classes.select(F.col("node").alias("g"), F.explode(parts("local", "domain", "ng", "lg", "share")).alias("p")).select("g", "p.f", "p.w"), "features")
    counts = materialize(classes.select(F.col("node").alias("g"), F.lit(1).cast("long").alias("n"), (F.col("local") == "").cast("long").alias("na"), (F.size("ng") == 0).cast("long").alias("nb")), "counts")
    near_to = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")
    while True:
        left, right = (features.select(F.col("g").alias(x), "f", F.col("w").alias(f"w{x}")) for x in "ab")
        product = near_to.join(left, "a").join(right, ["b", "f"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
        side = lambda x: counts.select(F.col("g").alias(x), F.col("n").alias(f"n{x}"), F.col("na").alias(f"na{x}"), F.col("nb").alias(f"nb{x}"))  # noqa: E731, B023
        counted = product.join(side("a"), "a").join(side("b"), "b")
        mean = F.round(F.col("dot") / F.greatest(F.lit(1), F.expr("na * nb - naa * nbb - nba * nab")), 9)
        scored = materialize(counted.select("a", "b", mean.alias("s")), "means")
        ways = scored.select(F.col("a").alias("x"), F.col("b").alias("y"), "s").unionByName(scored.select(F.col("b").alias("x"), F.col("a").alias("y"), "s"))
        nearest = ways.groupBy("x").agg(F.max("s").alias("s")).join(ways, ["x", "s"]).groupBy("x").agg(F.min("y").alias("y"), F.first("s").alias("s")).filter(F.col("s") >= least)
        back = nearest.select(F.col("x").alias("y"), F.col("y").alias("x"))
        merges = materialize(nearest.filter("x < y").join(back, ["x", "y"], "left_semi").select(F.col("y").alias("old"), F.col("x").alias("new")), "merges")
        if merges.isEmpty():
            return groups

        def renamed(df: DataFrame, column: str, merges: DataFrame = merges) -> DataFrame:
            return df.join(merges, F.col(column) == F.col("old"), "left").withColumn(column, F.coalesce("new", column)).drop("old", "new")

        groups = materialize(renamed(groups, "group"), "groups")
        features = materialize(renamed(features, "g").groupBy("g", "f").agg(F.sum("w").alias("w")), "features")
        counts = materialize(renamed(counts, "g").groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n", "na", "nb")]), "counts")
        moved = renamed(renamed(near_to, "a"), "b").filter("a <> b")
        near_to = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near")


def _plain(value):
    return value.tolist() if isinstance(value, np.ndarray) else value


def _coherence(classes: DataFrame, weights: Broadcast) -> tuple[DataFrame, DataFrame]:
    """Mean cosine of the distinct full names of a full address, and of a local part at all domains; only where there are two.

    The sum of n unit vectors has the squared length n + n (n - 1) times their mean cosine, so sums by n-gram are enough.
    """

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def unit(ng: pa.Array) -> pa.Array:
        row, _, weight, _ = _unit(ng, weights.value.idf)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(ng)))], pa.int32()), pa.array(weight, pa.float32()))

    full = classes.filter("is_full AND local <> ''").select("local", "domain", "ng")
    several = full.groupBy("local").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("local")
    full = full.join(several, "local", "left_semi")
    parts = full.select("local", "domain", F.explode(F.arrays_zip("ng", unit("ng").alias("w"))).alias("p")).select("local", "domain", F.col("p.ng").alias("g"), F.col("p.w").alias("w"))
    sums = materialize(parts.groupBy("local", "domain", "g").agg(F.sum("w").alias("w")), "sums")
    counts = materialize(full.groupBy("local", "domain").agg(F.count(F.lit(1)).alias("n")), "counts")

    def mean(keys: list[str], name: str) -> DataFrame:
        square = sums.groupBy(*keys, "g").agg(F.sum("w").alias("w")).groupBy(*keys).agg(F.sum(F.col("w") * F.col("w")).alias("s"))
        number = counts.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 1")
        return square.join(number, keys).select(*keys, ((F.col("s") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias(name))

    return mean(["local", "domain"], "coherence"), mean(["local"], "everyone")


def link_identities(identities: DataFrame, local_component: int = LOCAL_COMPONENT) -> DataFrame:
    """(identity_id, group): rows of one group stand for the same person or organisation; group is one of the group's classes.

    Takes identity_id, name, email; each may be null or empty. A row without an address belongs to the account whose name it
    fits clearly better than any other's; where none or several fit, it is linked only to rows that are equal. A row with
    neither name nor address is a group of its own, as are all rows of no known kin. Repeated rows share a group. An empty
    table gives an empty result. ``local_component`` bounds what one task clusters; it doesn't change the result.
    """
    spark = identities.sparkSession
    rows = identities.select("identity_id", _normal(F.col("name").cast("string"), F.col("email").cast("string")).alias("k")).select("identity_id", "k.*")
    nobody = F.when((F.col("local") == "") & (~F.col("name_key").contains(" ")), F.col("identity_id").cast("string"))
    rows = materialize(rows.withColumn("node", F.lower(F.hex(F.xxhash64("name_key", "local", "domain", nobody)))), "rows")
    classes = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("name_key", "local", "domain")])
    tokens = F.size(F.filter(F.split("name_key", " "), lambda t: F.length(t) > 1))
    classes = materialize(classes.select("*", (tokens >= 2).alias("is_full"), _grams("name_key").alias("ng"), _grams("local").alias("lg")), "classes")
    every = F.explode(F.concat("ng", F.transform("lg", lambda g: g + GRAM_BUCKETS)))
    counted = classes.select(every.alias("g")).groupBy("g").count().toPandas()  # at most 2 * GRAM_BUCKETS rows
    counts = np.zeros(2 * GRAM_BUCKETS, np.int64)
    counts[counted["g"].to_numpy(np.int64)] = counted["count"].to_numpy(np.int64)
    n, n_named = classes.agg(F.count(F.lit(1)), F.count_if(F.size("ng") > 0)).head()
    weights = spark.sparkContext.broadcast(Weights(counts, n, n_named))
    by_address, by_local = _coherence(classes, weights)
    known = classes.join(by_address, ["local", "domain"], "left").join(by_local, "local", "left").fillna(1.0, ["coherence", "everyone"])
    crowded = F.col("local").rlike(TEAM.pattern) | (F.col("everyone") < ANYONE)
    known = known.withColumn("crowded", crowded).withColumn("shared", F.col("crowded") | (F.col("coherence") < SHARED))
    made = _vectors(weights)("ng", F.col("local") != "", "coherence", "everyone", "crowded")
    vectors = materialize(known.withColumn("v", made).select("node", "name_key", "local", "domain", "crowded", "shared", "ng", "lg", "v.*"), "vectors")
    pairs = materialize(_candidates(vectors, weights), "pairs")
    links = materialize(_links(pairs, vectors, weights), "links")
    components = materialize(connected_components(vectors.select("node"), links), "components")
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    record = vectors.select("node", "local", "domain", "ng", "lg", "share").join(components, "node").join(sizes, "component")
    linked = links.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("linked"))
    small = record.filter(F.col("n") <= local_component)
    groups = _small_components(small.join(linked, "node", "left"), weights)
    large = record.filter(F.col("n") > local_component)
    if not sizes.filter(F.col("n") > local_component).isEmpty():
        large = materialize(large, "large")
        groups = groups.unionByName(_large_components(large, links.join(large.select(F.col("node").alias("a")), "a", "left_semi"), weights))
    named = groups.withColumnRenamed("node", "_g")
    return rows.select("identity_id", "node").join(named, F.col("node") == F.col("_g"), "left").select("identity_id", F.coalesce("group", "node").alias("group"))


def identity_pairs(identities: DataFrame) -> DataFrame:
    """(identity_id_a, identity_id_b): all pairs of rows of one group, the smaller id first."""
    grouped = materialize(link_identities(identities), "grouped")
    a, b = (grouped.select(F.col("identity_id").alias(f"identity_id_{x}"), "group") for x in "ab")
    return a.join(b, "group").filter("identity_id_a < identity_id_b").select("identity_id_a", "identity_id_b")
