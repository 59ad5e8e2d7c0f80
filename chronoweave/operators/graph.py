"""Reachability in commit graphs.

History is laid out in blocks of bounded size in the order of a locality hint. A block is summed up by its entries, the
nodes that links from other blocks or walks enter, and by the entries of other blocks that each of them reaches through the
block. These summaries are a graph of the same kind, but smaller; it is solved first, by the same means, so the number of
rounds follows the logarithm of the number of blocks, however many lie one behind another. Then every block is walked once
from the entries that were reached. No task ever holds more than a block, whatever share of the commits one repository has,
and every reached node is written once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.storage import materialize, new_path

BLOCK_NODES = 50_000
#: Summaries that keep more than this share of the nodes make no smaller problem: the blocks are walked round by round.
LEAST_GAIN = 0.5


def edges(commits: DataFrame) -> DataFrame:
    """(child, parent, parent_pos) of commits (oid, parents)."""
    return commits.select(F.col("oid").alias("child"), F.posexplode("parents").alias("parent_pos", "parent"))


def _walk(key: tuple, entries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """All nodes of a block reached from its entries, by walk, and the links that leave it."""
    parents = dict(zip(block["node"], block["parents"], strict=True))
    out = []
    for walk, starts in entries.groupby("walk")["node"]:
        seen, stack = set(), [n for n in starts if n in parents]
        while stack:
            node = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            for parent in parents[node] if parents[node] is not None else ():
                if parent in parents:
                    stack.append(parent)
                elif parent is not None:
                    out.append((walk, parent, False))
        out += [(walk, node, True) for node in seen]
    return pd.DataFrame(out, columns=["walk", "node", "inside"])


def _summary(key: tuple, entries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """The entries of a block with the nodes outside that each reaches through it.

    Children come after their parents in the order of a depth-first search, so one pass hands the exits on, as bits of an
    integer; further passes are only needed where the links go round.
    """
    parents = {n: [p for p in ps if p is not None] if ps is not None else [] for n, ps in zip(block["node"], block["parents"], strict=True)}
    order, seen = [], set()
    for start in entries["node"]:
        stack = [(start, iter(parents[start]))] if start in parents and start not in seen else []
        seen.update(n for n, _ in stack)
        while stack:
            node, ahead = stack[-1]
            for parent in ahead:
                if parent in parents and parent not in seen:
                    seen.add(parent)
                    stack.append((parent, iter(parents[parent])))
                    break
            else:
                order.append(node)
                stack.pop()
    exits: dict[str, int] = {}
    for node in order:
        for parent in parents[node]:
            if parent not in parents:
                exits.setdefault(parent, len(exits))
    names = list(exits)
    reached = dict.fromkeys(order, 0)
    changed = True
    while changed:
        changed = False
        for node in order:
            bits = reached[node]
            for parent in parents[node]:
                bits |= reached[parent] if parent in parents else 1 << exits[parent]
            if bits != reached[node]:
                reached[node] = bits
                changed = True
    out = []
    for start in entries["node"]:
        bits, found = reached.get(start, 0), []
        while bits:
            low = bits & -bits
            found.append(names[low.bit_length() - 1])
            bits ^= low
        out.append((start, found))
    return pd.DataFrame(out, columns=["node", "parents"])


def _follow(key: tuple, fronts: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """Each walk's line through a block: the nodes passed, and where it goes on.

    A walk that was in the block before, from its earlier fronts, ends where it meets the line it took then.
    """
    parents = dict(zip(block["node"], block["parent"], strict=True))
    earlier: dict[str, list[str]] = {}
    now = []
    for walk, node, new in zip(fronts["walk"], fronts["node"], fronts["new"], strict=True):
        if new:
            now.append((walk, node))
        else:
            earlier.setdefault(walk, []).append(node)
    out = []
    for walk, node in now:
        path, seen = [], set()
        for start in earlier.get(walk, ()):
            while start in parents and start not in seen:
                seen.add(start)
                start = parents[start]
        while node in parents and node not in seen:
            seen.add(node)
            path.append(node)
            node = parents[node]
        out.append((walk, path, None if node in seen or pd.isna(node) else node))
    return pd.DataFrame(out, columns=["walk", "path", "next"])


def _laid(nodes: DataFrame, link: str, block_nodes: int) -> tuple[DataFrame, int]:
    """(blocks, number of blocks) of nodes (node, ``link``, place), written by block: (node, ``link``, place, block)."""
    spark = nodes.sparkSession
    known = materialize(nodes.select("node", link, "place"), "nodes")
    n = known.count()
    parts = max(1, -(-n // block_nodes))
    laid = (known.coalesce(1) if parts == 1 else known.repartitionByRange(parts, "place", "node")).withColumn("block", F.spark_partition_id())
    path = new_path(spark, "blocks")
    laid.write.partitionBy("block").parquet(path)
    return spark.read.schema(laid.schema).parquet(path), n


def follow(nodes: DataFrame, queries: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(walk, piece, path): the parent lines of the queries (node) in pieces, over nodes (node, parent, place).

    A round takes every line through the block it stands at; only the fronts are carried on and remembered.
    """
    spark = nodes.sparkSession
    blocks, _ = _laid(nodes, "parent", block_nodes)
    places = blocks.select("node", "block")
    fronts = materialize(queries.select("node").distinct().join(places, "node").select(F.col("node").alias("walk"), "node", "block"), "fronts")
    passed: list[DataFrame] = []
    pieces: list[DataFrame] = []
    while not fronts.isEmpty():
        entered = [r["block"] for r in fronts.select("block").distinct().collect()]
        some = blocks.filter(F.col("block").isin(entered)).select("node", "parent", "block").groupBy("block")
        met = fronts.withColumn("new", F.lit(True))
        for before in passed:
            met = met.unionByName(before.join(fronts.select("walk", "block"), ["walk", "block"], "left_semi").withColumn("new", F.lit(False)))
        walked = materialize(met.groupBy("block").cogroup(some).applyInPandas(_follow, "walk string, path array<string>, next string"), "walked")
        pieces.append(walked.select("walk", F.lit(len(pieces)).alias("piece"), "path"))
        passed.append(fronts)
        fronts = materialize(walked.filter("next IS NOT NULL").select("walk", F.col("next").alias("node")).join(places, "node").select("walk", "node", "block"), "fronts")
    out = pieces[0] if pieces else spark.createDataFrame([], "walk string, piece int, path array<string>")
    for more in pieces[1:]:
        out = out.unionByName(more)
    return out


def reachable(commits: DataFrame, starts: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(walk, node): all known nodes that the starts (walk, node) of a walk reach, themselves included, each once.

    ``commits`` has (node, parents, place): unique nodes, ordered parents (null or empty for roots), and a sortable hint
    that puts neighbours together. Parents and starts that are no node are passed over.
    """
    blocks, n = _laid(commits.filter(F.col("node").isNotNull()), "parents", block_nodes)
    first = starts.select(F.col("walk").cast("string").alias("walk"), "node").distinct()
    return _reachable(blocks, n, materialize(first.join(blocks.select("node", "block"), "node"), "starts"), block_nodes)


def _walked(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """(walk, node, inside) of one walk through the blocks that (walk, node, block) enter."""
    entered = entries.groupBy("block").cogroup(blocks.select("node", "parents", "block").groupBy("block"))
    return materialize(entered.applyInPandas(_walk, "walk string, node string, inside boolean"), "walked")


def _reachable(blocks: DataFrame, n: int, starts: DataFrame, block_nodes: int) -> DataFrame:
    """``reachable`` over blocks (node, parents, place, block) of n nodes from starts (walk, node, block)."""
    inside = F.col("inside")
    if n <= block_nodes:
        return _walked(blocks, starts).filter(inside).select("walk", "node")
    links = blocks.select(F.col("block").alias("from"), F.explode("parents").alias("node")).distinct()
    entered = links.join(blocks.select("node", "block"), "node").filter(F.col("from") != F.col("block")).select("node", "block")
    entries = materialize(entered.unionByName(starts.select("node", "block")).distinct(), "entries")
    n_entries = entries.count()
    if n_entries > LEAST_GAIN * n:
        return _by_rounds(blocks, starts)
    summaries = entries.groupBy("block").cogroup(blocks.select("node", "parents", "block").groupBy("block")).applyInPandas(_summary, "node string, parents array<string>")
    above, _ = _laid(summaries.join(blocks.select("node", "place"), "node"), "parents", block_nodes)
    begun = materialize(starts.select("walk", "node").join(above.select("node", "block"), "node"), "starts")
    reached = _reachable(above, n_entries, begun, block_nodes)
    return _walked(blocks, reached.join(entries, "node")).filter(inside).select("walk", "node")


def _by_rounds(blocks: DataFrame, starts: DataFrame) -> DataFrame:
    """``_reachable`` where the layout brings no neighbours together: a round walks the blocks that the frontier enters.

    Rounds follow the blocks that lie one behind another then. Each writes what is new in it; parts are put together when
    one has become as large as the one before, so a node is written again a logarithmic number of times at most.
    """
    parts: list[tuple[DataFrame, int]] = []
    frontier = starts
    while not frontier.isEmpty():
        walked = _walked(blocks, frontier)
        new, leaving = walked.filter("inside").select("walk", "node"), walked.filter("NOT inside").select("walk", "node").distinct()
        for part, _ in parts:
            new = new.join(part, ["walk", "node"], "left_anti")
        new = materialize(new, "reached")
        parts.append((new, new.count()))
        while len(parts) > 1 and parts[-2][1] <= parts[-1][1]:
            (x, n), (y, m) = parts[-2:]
            parts[-2:] = [(materialize(x.unionByName(y), "reached"), n + m)]
        for part, _ in parts:
            leaving = leaving.join(part, ["walk", "node"], "left_anti")
        frontier = materialize(leaving.join(blocks.select("node", "block"), "node").select("walk", "node", "block"), "frontier")
    if not parts:
        return starts.select("walk", "node")
    out = parts[0][0]
    for part, _ in parts[1:]:
        out = out.unionByName(part)
    return out


def reachable_difference(commits: DataFrame, plans: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(ref_index, node): reach(head) - reach(exclude) of every plan (ref_index, head, exclude); a null exclude takes nothing away.

    A missing exclude that is no known commit falls back to none. Heads and excludes are walked together in one pass.
    """
    heads = plans.select(F.concat(F.lit("h"), F.col("ref_index")).alias("walk"), F.col("head").alias("node"))
    excludes = plans.filter(F.col("exclude").isNotNull()).select(F.concat(F.lit("x"), F.col("ref_index")).alias("walk"), F.col("exclude").alias("node"))
    reached = reachable(commits, heads.unionByName(excludes), block_nodes)
    index = F.substring("walk", 2, 20).cast("int").alias("ref_index")
    included, excluded = (reached.filter(F.col("walk").startswith(kind)).select(index, "node") for kind in "hx")
    return included.join(excluded, ["ref_index", "node"], "left_anti")


def first_reaching_ref(reached: DataFrame) -> DataFrame:
    """(node, ref_index): every node once, with the first ref that reaches it."""
    return reached.groupBy("node").agg(F.min("ref_index").alias("ref_index"))


def merge_bases(commits: DataFrame, tips: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(group, base): the best common ancestor of all tips (group, node) of a group, the least oid if there are several.

    A group without one has a null base. Common ancestors are closed under the parent link, so the best ones are those that are no parent of another.
    """
    numbered = tips.select("group", "node").distinct()
    walk = F.concat_ws("\u001f", F.col("group").cast("string"), "node").alias("walk")
    reached = reachable(commits, numbered.select(walk, "node"), block_nodes)
    wanted = numbered.groupBy("group").agg(F.count(F.lit(1)).alias("n_tips"))
    shared = reached.groupBy(F.split("walk", "\u001f")[0].alias("group"), "node").agg(F.count(F.lit(1)).alias("n"))
    common = materialize(shared.join(wanted.withColumn("group", F.col("group").cast("string")), "group").filter("n = n_tips").select("group", "node"), "common")
    inner = common.join(commits.select("node", F.explode("parents").alias("parent")), "node").select("group", F.col("parent").alias("node")).distinct()
    best = common.join(inner, ["group", "node"], "left_anti").groupBy("group").agg(F.min("node").alias("base"))
    return wanted.select(F.col("group").cast("string").alias("group")).join(best, "group", "left")
