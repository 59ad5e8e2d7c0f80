"""MinHash banding with exact verification, over classes of equal shingle sets.

A class is what all items with one shingle set have in common, so copies cost one entry. Classes that share a band meet in
its bucket. In a small bucket every class is compared with all others that it isn't connected with yet, in one task. A large
one is thinned out first: a leader is drawn for each bucket and band, all its classes are compared with it, and of those that
were similar to none the next leader is drawn, by joins, until few are left. These are then compared with each other and with
all classes of the bucket, block by block. No bucket is ever expanded into its pairs. Similar means an exact Jaccard index of
at least the threshold. Connected components of these links are found by contracting the forest in which each component points at
its least neighbour, again until no link is left between components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.hierarchy import resolve
from chronoweave.storage import materialize

SHINGLE, SIMILARITY, BANDS, ROWS, SMALL_BUCKET = 5, 0.8, 12, 5, 500
_RANDOM = np.random.default_rng(20_24)
#: Shingles are mixed already, so a line modulo 2^32 permutes them well enough, at a fraction of the cost of mixing again.
_FACTORS = _RANDOM.integers(1, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_PLACES = _RANDOM.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles that are permuted at once, so that they stay in a core's cache.
_AT_ONCE = 32_768


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = values.astype(np.uint64, copy=True)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x ^= x >> np.uint64(31)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(codes: np.ndarray, lengths: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of many token lists laid end to end: (owner, hash), sorted. A list shorter than the width is one shingle."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    left = np.cumsum(lengths)[owner] - np.arange(len(codes))
    scrambled = mix(codes)
    value = scrambled * _PLACES[0]
    for k in range(1, min(width, len(codes))):
        value[:-k] += np.where(left[:-k] > k, scrambled[k:] * _PLACES[k], np.uint64(0))
    whole = (left >= width) | (left == lengths[owner])
    pairs = np.sort(owner[whole].astype(np.uint64) << np.uint64(32) | mix(value[whole]) >> np.uint64(32))
    pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
    return (pairs >> np.uint64(32)).astype(np.int64), pairs & np.uint64(0xFFFFFFFF)


def class_keys(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Keys of the shingle sets of n items, zero for one without shingles."""
    classes = np.zeros(n, np.uint64)
    if len(owner):
        at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        base = mix(hashes)
        classes[owner[at]] = mix(np.add.reduceat(base, at) ^ np.add.reduceat(mix(base), at))
    return classes.view(np.int64)


def band_keys(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n x BANDS band keys, class keys) of n items; items without shingles get zeros."""
    keys = np.zeros((n, BANDS), np.uint64)
    if len(owner):
        at = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        # the sets are cut into runs of about _AT_ONCE shingles
        cuts = np.r_[0, np.flatnonzero(np.diff(at // _AT_ONCE)) + 1, len(at)]
        for first, last in zip(cuts[:-1], cuts[1:], strict=True):
            begin, end = at[first], at[last] if last < len(at) else len(owner)
            # what isn't mixed yet (tests' small numbers) would keep its order under a line
            base = (mix(hashes[begin:end]) >> np.uint64(32)).astype(np.uint32)
            moved, inner, who = np.empty_like(base), at[first:last] - begin, owner[at[first:last]]
            for b in range(BANDS):
                key = np.full(len(inner), b, np.uint64)
                for r in range(b * ROWS, (b + 1) * ROWS):
                    np.multiply(base, _FACTORS[r], out=moved)
                    np.add(moved, _SHIFTS[r], out=moved)
                    key = mix(key + np.minimum.reduceat(moved, inner))
                keys[who, b] = key
    return keys.view(np.int64), class_keys(owner, hashes, n)


def by_group(df: DataFrame, keys: list[str], columns: list[str], work: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``work`` on the rows (``columns``) of every group of ``keys``, for groups that are small and many.

    Groups come sorted through a partition, one at a time, so a task holds one group and starts nothing for each.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for frame in frames for row in zip(*(frame[c] for c in (*keys, *columns)), strict=True))
        out: list[tuple] = []
        for _, group in groupby(rows, key=lambda row: row[: len(keys)]):
            out += work([row[len(keys) :] for row in group])
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _links_within(threshold: float) -> Callable[[list[tuple]], list[tuple]]:
    """Links of one bounded group of (node, shingles, seed): the least ones that connect what is similar.

    Where some are seeds, only pairs with a seed are compared, else all. Pairs that are connected already are passed over,
    as are those whose sizes rule the threshold out.
    """

    def link(bucket: list[tuple]) -> list[tuple]:
        bucket = sorted(((node, frozenset(np.asarray(shingles).tolist()), seed) for node, shingles, seed in bucket), key=lambda x: (len(x[1]), x[0]))
        seeded = any(seed for *_, seed in bucket)
        group = list(range(len(bucket)))

        def root(i: int) -> int:
            while group[i] != i:
                group[i] = i = group[group[i]]
            return i

        out = []
        for i, (node, own, seed) in enumerate(bucket):
            for j in range(i - 1, -1, -1):
                other, theirs, other_seed = bucket[j]
                if len(theirs) < threshold * len(own):
                    break
                if seeded and not (seed or other_seed) or root(i) == root(j):
                    continue
                common = len(own & theirs)
                if common >= threshold * (len(own) + len(theirs) - common):
                    out.append((node, other))
                    group[root(i)] = root(j)
        return out

    return link


def similar_links(classes: DataFrame, threshold: float = SIMILARITY, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """(a, b) links between classes (node string, bands array<bigint>, shingles array<bigint>), each verified exactly.

    In buckets of at most ``small_bucket`` classes the links connect all similar pairs. In larger ones they connect every
    class with a leader that it is similar to, and all classes with those similar to no leader; what of two leaders'
    classes is similar only to each other meets again in its other bands, whose leaders are drawn anew.
    """
    members = crowded_members(classes.select("node", "bands"), small_bucket)
    sets = classes.select("node", "shingles").join(members.select("node").distinct(), "node", "left_semi")
    return links_of(members, sets, threshold, small_bucket)


def crowded_members(banded: DataFrame, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """(node, band, key, n) of the buckets with n > 1 nodes, of (node, bands); a node may be given several times.

    Small buckets of the same nodes would be compared with the same result, so of these the one of the least band is kept.
    """
    bucket = Window.partitionBy("band", "key")
    placed = banded.select("node", F.posexplode("bands").alias("band", "key"))
    placed = placed.select("*", F.min("node").over(bucket).alias("least"), F.max("node").over(bucket).alias("most"))
    members = materialize(placed.filter("least <> most").select("node", "band", "key").distinct(), "members")
    buckets = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("a"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("b"))
    own = F.when(F.col("n") > small_bucket, F.struct("band", "key"))
    once = buckets.groupBy("n", "a", "b", own.alias("own")).agg(F.min(F.struct("band", "key")).alias("at")).select("at.band", "at.key", "n")
    return materialize(members.join(once, ["band", "key"]), "members")


def links_of(members: DataFrame, sets: DataFrame, threshold: float = SIMILARITY, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """``similar_links`` of ``crowded_members`` and their sets (node, shingles)."""
    sets = materialize(sets, "sets")
    small = members.filter(F.col("n") <= small_bucket).select("node", "band", "key", F.lit(False).alias("seed"))
    large = members.filter(F.col("n") > small_bucket).select("node", "band", "key")
    kind = members.schema["node"].dataType.simpleString()
    schema, columns = f"node {kind}, leader {kind}", ["node", "shingles", "seed"]
    found = [materialize(by_group(small.join(sets, "node"), ["band", "key"], columns, _links_within(threshold), schema), "links")]
    waiting = large
    while not waiting.isEmpty():
        drawn = waiting.groupBy("band", "key").agg(F.min_by("node", F.xxhash64("node", "band")).alias("leader"), F.count(F.lit(1)).alias("n"))
        few = drawn.filter(F.col("n") <= small_bucket).select("band", "key")
        if not few.isEmpty():
            # what is left of a bucket is compared with all of it: block by block, each with all that is left
            left = waiting.join(few, ["band", "key"], "left_semi").withColumn("seed", F.lit(True))
            sizes = members.groupBy("band", "key").agg(F.ceil(F.count(F.lit(1)) / small_bucket).cast("int").alias("blocks"))
            rest = large.join(few, ["band", "key"], "left_semi").join(left, ["node", "band", "key"], "left_anti").join(sizes, ["band", "key"])
            placed = rest.select("node", "band", "key", F.lit(False).alias("seed"), F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"))
            seeds = left.join(sizes, ["band", "key"]).select("node", "band", "key", "seed", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
            last = by_group(placed.unionByName(seeds).join(sets, "node"), ["band", "key", "block"], columns, _links_within(threshold), schema)
            found.append(materialize(last, "links"))
        drawn = drawn.filter(F.col("n") > small_bucket).select("band", "key", "leader")
        pairs = materialize(large.join(drawn, ["band", "key"]).filter(F.col("node") != F.col("leader")), "pairs")
        distinct = pairs.select("node", "leader").distinct()
        both = distinct.join(sets, "node").join(sets.select(F.col("node").alias("leader"), F.col("shingles").alias("others")), "leader")
        common = F.size(F.array_intersect("shingles", "others"))
        alike = common >= threshold * (F.size("shingles") + F.size("others") - common)
        links = materialize(both.filter(alike).select("node", "leader"), "links")
        found.append(links)
        met = pairs.join(links, ["node", "leader"], "left_semi").select("node", "band", "key")
        leaders = drawn.select(F.col("leader").alias("node"), "band", "key")
        waiting = materialize(waiting.join(drawn, ["band", "key"], "left_semi").join(met.unionByName(leaders), ["node", "band", "key"], "left_anti"), "waiting")
    out = found[0]
    for links in found[1:]:
        out = out.unionByName(links)
    return out.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) with the least node of each connected component, of nodes (node) and links (a, b)."""
    kind = nodes.schema["node"].dataType.simpleString()
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "edges")
    # only what has links gets labels on the way
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("b"))
        # a component points at its least neighbour if that one is less than itself; the others are roots of this round
        parent = F.when(F.col("b") < F.col("a"), F.col("b")).cast("string")
        forest = least.select(F.col("a").cast("string").alias("node"), parent.alias("parent"), F.lit(None).cast("int").alias("place"))
        roots = resolve(forest).select(F.col("node").cast(kind).alias("_n"), F.col("root").cast(kind).alias("root"))
        labels = materialize(labels.join(roots, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        renamed = edges.join(roots.select(F.col("_n").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("_n").alias("b"), F.col("root").alias("rb")), "b")
        edges = materialize(renamed.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
    return nodes.select("node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
