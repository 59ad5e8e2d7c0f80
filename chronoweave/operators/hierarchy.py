"""Parent links to full hierarchies, by tree contraction.

Each round contracts blocks of bounded size: nodes are laid out by a locality hint (a history's neighbours lie close in
time), and inside a block every chain is compressed to one link from each node to its first ancestor outside. Nodes that
no other block points at are raked: nothing else hangs on them, so their link is only recorded. The nodes that are left
are the few that links from other blocks enter; they form the next round's forest. Where the layout doesn't bring
neighbours together, a round of random-mate splicing takes out unary links whatever the order, so the forest shrinks in
any case. Once it fits one block it is solved there: whatever then never reaches a root lies on a loop or leads into one.
The recorded rounds are undone in reverse, one join each.

All records are written to the shared folder, so a lost executor costs a retry and lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.storage import materialize

BLOCK_NODES = 50_000
LINK = "node string, top string, steps bigint, low string, kind int"
OPEN, ROOT, LOOP = 0, 1, 2


def _contract(ids: np.ndarray, parents: np.ndarray, steps: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Compresses all chains of a block: (top, steps, low, kind) of each node, by pointer doubling.

    ``parents`` is None for a root. ``top`` is the first ancestor outside the block (OPEN), the root (ROOT), or the least
    id of the loop that the line runs into (LOOP, steps -1). ``low`` is the least id among the nodes passed by the link.
    """
    n = len(ids)
    own = np.arange(n)
    names, low = np.unique(lows.astype(str), return_inverse=True)
    is_root = pd.isna(parents)
    inside = pd.Index(ids).get_indexer(pd.Index(parents))
    ends = (inside < 0) | is_root
    first = np.where(ends, own, inside)
    jump, count = first.copy(), np.where(ends, 0, steps)
    for _ in range(int(np.ceil(np.log2(n + 1))) + 1):
        count = count + np.where(jump != own, count[jump], 0)
        low = np.minimum(low, low[jump])
        jump = jump[jump]
    goes_round = ~ends[jump]
    opened = ~goes_round & ~is_root[jump]
    top = ids[jump].copy()
    top[opened] = parents[jump[opened]]
    count = np.where(opened, count + steps[jump], count)
    kind = np.where(opened, OPEN, ROOT)
    if goes_round.any():
        # after n steps or more every such walk is on its loop, and the loops' own nodes reach all of them
        members = np.unique(jump[goes_round])
        least, at = low.copy(), first.copy()
        for _ in range(int(np.ceil(np.log2(len(members) + 1))) + 1):
            least[members] = np.minimum(least[members], least[at[members]])
            at[members] = at[at[members]]
        top[goes_round] = names[least[jump[goes_round]]]
        count, kind = np.where(goes_round, -1, count), np.where(goes_round, LOOP, kind)
    return top, count, names[low], kind


def _contract_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if not (parts := [f for f in frames if len(f)]):
        return
    block = pd.concat(parts, ignore_index=True)
    ids = block["node"].to_numpy(object)
    parents = block["parent"].to_numpy(object)
    parents = np.where(pd.isna(parents), None, parents).astype(object)
    top, steps, low, kind = _contract(ids, parents, block["steps"].to_numpy(np.int64), block["low"].to_numpy(object))
    yield pd.DataFrame({"node": ids, "top": top, "steps": steps, "low": low, "kind": kind.astype(np.int32)})


def _blocks(forest: DataFrame, n: int, block_nodes: int) -> DataFrame:
    """Blocks of about ``block_nodes`` rows in the order of the locality hint."""
    parts = max(1, -(-n // block_nodes))
    laid = forest.coalesce(1) if parts == 1 else forest.repartitionByRange(parts, "place", "node")
    return laid.select("node", "parent", "steps", "low")


def _splice(forest: DataFrame, turn: int) -> DataFrame:
    """Random-mate compression of unary chains: (node, parent, steps, low, place, out) of all nodes.

    A node is taken out if it is drawn 0, isn't a root, and the only node that points at it is drawn 1. Its record is its
    own link; the node below now points past it. No two neighbours are taken out in one turn.
    """
    draw = lambda c: F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2))
    below = forest.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("child"))
    out = (F.col("n") == 1) & (draw("node") == 0) & (draw("child") == 1) & F.col("parent").isNotNull()
    marked = forest.join(below, forest.node == below.p, "left").select("node", "parent", "steps", "low", "place", F.coalesce(out, F.lit(False)).alias("out"))
    marked = materialize(marked, "mates")
    gone = marked.filter("out").select(F.col("node").alias("g"), F.col("parent").alias("g_parent"), F.col("steps").alias("g_steps"), F.col("low").alias("g_low"))
    return marked.join(gone, marked.parent == gone.g, "left").select(
        "node", F.coalesce("g_parent", "parent").alias("parent"), (F.col("steps") + F.coalesce("g_steps", F.lit(0))).alias("steps"),
        F.least("low", F.coalesce("g_low", "low")).alias("low"), "place", "out",
    )


def _closed(links: DataFrame) -> DataFrame:
    """(node, root, depth) of links that know their end."""
    return links.filter(F.col("kind") != OPEN).select("node", F.col("top").alias("root"), "steps").withColumnRenamed("steps", "depth")


def resolve(nodes: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(node, root, depth) of every node of ``nodes`` (node string, parent string, place).

    ``node`` must be unique and not null. A null ``parent``, or one that is no node, makes a root of depth 0. ``place`` is
    any sortable hint that brings neighbours together; it may be null and affects speed only. Where ``nodes`` has ``steps``,
    positive lengths of the links, depth sums them. A node whose line never
    ends gets the least node of the loop as its root and depth -1; a node that is its own parent is a loop of one. An
    empty table gives an empty result.
    """
    known = nodes.select(F.col("node").alias("_k"))
    forest = nodes.join(known, F.col("parent") == F.col("_k"), "left").select("node", F.col("_k").alias("parent"), (F.col("steps") if "steps" in nodes.columns else F.lit(1)).cast("long").alias("steps"), F.col("node").alias("low"), "place")
    forest = materialize(forest, "forest")
    n, turn, splicing = forest.count(), 0, False
    records: list[tuple[DataFrame, bool]] = []
    ends: list[DataFrame] = []
    while n > block_nodes:
        if splicing:
            turn += 1
            spliced = materialize(_splice(forest, turn), "spliced")
            records.append((spliced.filter("out").select("node", F.col("parent").alias("top"), "steps", "low", F.lit(OPEN).alias("kind")), True))
            forest = spliced.filter("NOT out").drop("out")
        else:
            links = materialize(_blocks(forest, n, block_nodes).mapInPandas(_contract_block, LINK), "links")
            records.append((links, False))
            # raking: only nodes that a link from elsewhere enters stay
            entered = links.filter(F.col("kind") == OPEN).select(F.col("top").alias("node")).distinct()
            entered = materialize(links.join(entered, "node").join(forest.select("node", "place"), "node"), "entered")
            ends.append(_closed(entered))
            forest = entered.filter(F.col("kind") == OPEN).select("node", F.col("top").alias("parent"), "steps", "low", "place")
        left = forest.count()
        splicing, n = not splicing and left > 0.75 * n, left
    core = materialize(_blocks(forest, n, block_nodes).mapInPandas(_contract_block, LINK), "core")
    return _expand([*records, (core, False)], ends)


def _expand(rounds: list[tuple[DataFrame, bool]], ends: list[DataFrame]) -> DataFrame:
    """Undoes the rounds in reverse. A link may lead to a node of the round after, or to one that had its end before."""
    settled = None
    for end in ends:
        settled = end if settled is None else settled.unionByName(end)
    solved = None
    for links, is_splice in reversed(rounds):
        above = solved if settled is None else settled if solved is None else solved.unionByName(settled)
        closed = _closed(links)
        if above is not None:
            opened = links.filter(F.col("kind") == OPEN).join(above.select(F.col("node").alias("top"), "root", F.col("depth").alias("_above")), "top")
            depth = F.when(F.col("_above") < 0, F.lit(-1)).otherwise(F.col("_above") + F.col("steps")).cast("long")
            closed = closed.unionByName(opened.select("node", "root", depth.alias("depth")))
        if is_splice:  # its record has only the nodes taken out; the others were solved in the round after
            closed = closed.unionByName(solved)
        solved = materialize(closed, "solved")
    return solved


def _subtree(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of ``weight`` over the part of each node's subtree that lies in its block."""
    if not (parts := [f for f in frames if len(f)]):
        return
    block = pd.concat(parts, ignore_index=True)
    ids = block["node"].to_numpy(object)
    parents = block["parent"].to_numpy(object)
    inside = np.where(pd.isna(parents), -1, pd.Index(ids).get_indexer(pd.Index(parents)))
    total = block["weight"].to_numpy(np.int64).copy()
    left = np.bincount(inside[inside >= 0], minlength=len(ids))
    ready = list(np.flatnonzero(left == 0))  # leaves; a loop never becomes ready and keeps what hangs on it
    while ready:
        node = ready.pop()
        above = inside[node]
        if above >= 0:
            total[above] += total[node]
            left[above] -= 1
            if left[above] == 0:
                ready.append(above)
    yield pd.DataFrame({"node": ids, "weight": total})


def descendant_counts(nodes: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(node, n_descendants) of a forest (node, parent, place) as for ``resolve``; -1 for nodes whose line never ends.

    Weights are raked towards the roots: a block hands the sum of each local tree to the node outside that its root points
    at. Those nodes form the next forest, whose subtree sums are the same problem, smaller; its answers are the weights
    that the blocks then add up once more. Where the layout brings no neighbours together, splicing takes over.
    """
    return _counted(nodes, resolve(nodes, block_nodes), block_nodes)


def _counted(nodes: DataFrame, resolved: DataFrame, block_nodes: int) -> DataFrame:
    """``descendant_counts`` with what ``resolve`` gave. Nodes whose line never ends stay out, so that sums run over trees."""
    ended, endless = (resolved.filter(c).select(F.col("node").alias("_k")) for c in ("depth >= 0", "depth < 0"))
    own = nodes.join(ended, F.col("node") == F.col("_k"), "left_semi").select("node", "parent", "place", F.lit(1).cast("long").alias("weight"))
    forest = own.join(ended, F.col("parent") == F.col("_k"), "left").select("node", F.col("_k").alias("parent"), "place", "weight")
    done = _subtree_sums(materialize(forest, "forest"), block_nodes)
    return done.select("node", (F.col("weight") - 1).alias("n_descendants")).unionByName(endless.select(F.col("_k").alias("node"), F.lit(-1).cast("long").alias("n_descendants")))


def intervals(nodes: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(node, parent, root, depth, enter, leave) of every node: all paths and descendants in one row a node.

    ``enter`` numbers the nodes of a tree in preorder from 0, ``leave`` is the number of the last descendant. The
    descendants of a node are the nodes of its root with enter < their enter <= leave; its path to the root are those with
    their enter <= enter <= their leave, by falling depth. Nodes whose line never ends have depth -1 and no interval;
    their line is told by ``parent``, which is null for roots.

    A node enters after its parent and the subtrees of its lesser siblings, so ``enter`` is the sum of these distances up
    to the root, which ``resolve`` adds up like steps.
    """
    resolved = resolve(nodes, block_nodes)
    known = nodes.select(F.col("node").alias("_k"))
    linked = nodes.join(known, F.col("parent") == F.col("_k"), "left").select("node", F.col("_k").alias("parent"), "place")
    sized = materialize(linked.join(_counted(nodes, resolved, block_nodes), "node"), "sized")
    lesser = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    inner = sized.filter("parent IS NOT NULL AND n_descendants >= 0").withColumn("steps", 1 + F.coalesce(F.sum(F.col("n_descendants") + 1).over(lesser), F.lit(0)))
    roots = sized.filter("parent IS NULL").withColumn("steps", F.lit(1).cast("long"))
    entered = resolve(inner.select("node", "parent", "place", "steps").unionByName(roots.select("node", "parent", "place", "steps")), block_nodes)
    entered = entered.select("node", F.col("depth").alias("enter"))
    joined = resolved.join(sized.select("node", "parent", "n_descendants"), "node").join(entered, "node", "left")
    return joined.select("node", "parent", "root", "depth", "enter", (F.col("enter") + F.col("n_descendants")).alias("leave"))


def descendants(nodes: DataFrame, queries: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(node, descendant, steps) for each node of ``queries``: all nodes below it, with how many links lie between.

    Lists are as long as the subtrees, so they come for a stated set of nodes; ``intervals`` has those of all nodes in one
    row each. Intervals of a tree are laid out in cells, so that a query meets only the cells that it covers, by equality.
    Nodes whose line never ends have no interval and none are listed for them; unknown nodes have none either.
    """
    placed = materialize(intervals(nodes, block_nodes).filter("depth >= 0").select("node", "root", "depth", "enter", "leave"), "intervals")
    cell = lambda c: F.floor(c / DESCENDANT_CELL)
    asked = placed.join(queries.select("node").distinct(), "node").filter("leave > enter")
    covered = F.explode(F.sequence(cell(F.col("enter") + 1), cell(F.col("leave"))))
    asked = asked.select(F.col("node").alias("q"), "root", F.col("depth").alias("q_depth"), F.col("enter").alias("q_enter"), "leave", covered.alias("cell"))
    below = placed.select(F.col("node").alias("descendant"), "root", "depth", "enter", cell(F.col("enter")).alias("cell"))
    met = asked.join(below, ["root", "cell"]).filter((F.col("enter") > F.col("q_enter")) & (F.col("enter") <= F.col("leave")))
    return met.select(F.col("q").alias("node"), "descendant", (F.col("depth") - F.col("q_depth")).alias("steps"))


DESCENDANT_CELL = 10_000


def _subtree_sums(forest: DataFrame, block_nodes: int) -> DataFrame:
    """(node, weight): sums of weights over whole subtrees."""
    n = forest.count()
    laid = forest.coalesce(1) if n <= block_nodes else forest.repartitionByRange(-(-n // block_nodes), "place", "node")
    if n <= block_nodes:
        return materialize(laid.select("node", "parent", "weight").mapInPandas(_subtree, "node string, weight bigint"), "sums")
    # the blocks are written, so that both passes see the same ones
    blocks = materialize(laid.select("node", "parent", "place", "weight", F.spark_partition_id().alias("block")), "blocks")
    links = blocks.groupBy("block").applyInPandas(_links_of_block, "node string, top string, open boolean")
    links = materialize(links, "tops")
    entering = links.filter("open").join(blocks.select("node", "weight"), "node").groupBy(F.col("top").alias("node")).agg(F.sum("weight").alias("weight"))
    entries = entering.join(links.select("node", "top", "open"), "node").join(blocks.select("node", "place"), "node")
    entries = materialize(entries.select("node", F.when(F.col("open"), F.col("top")).alias("parent"), "place", "weight"), "entries")
    if entries.count() > 0.9 * n:
        return _spliced_sums(forest, n, block_nodes)
    above = _subtree_sums(entries, block_nodes).select(F.col("node").alias("_e"), F.col("weight").alias("_w"))
    loaded = blocks.join(above, F.col("node") == F.col("_e"), "left").select("node", "parent", "block", (F.col("weight") + F.coalesce("_w", F.lit(0))).alias("weight"))
    return materialize(loaded.groupBy("block").applyInPandas(lambda block: next(_subtree(iter([block])), block[["node", "weight"]]), "node string, weight bigint"), "sums")


def _spliced_sums(forest: DataFrame, n: int, block_nodes: int) -> DataFrame:
    """``_subtree_sums`` where the layout brings no neighbours together: leaves are raked and unary chains spliced in turn.

    A leaf hands its weight to its parent and has its sum. A node taken out of a chain hands its weight up too; its sum is
    its weight and the sum of the node below. Half of the nodes of a tree at least are leaves or unary, so it shrinks.
    """
    draw = lambda turn, c: F.pmod(F.xxhash64(F.lit(turn), F.col(c)), F.lit(2))
    taken, turn = [], 0
    while n > block_nodes:
        turn += 1
        below = forest.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("child"))
        unary = (F.col("n") == 1) & (draw(turn, "node") == 0) & (draw(turn, "child") == 1) & F.col("parent").isNotNull()
        out = F.col("n").isNull() if turn % 2 else F.coalesce(unary, F.lit(False))
        marked = materialize(forest.join(below, F.col("node") == F.col("p"), "left").select("node", "parent", "place", "weight", "child", out.alias("out")), "marked")
        gone = marked.filter("out")
        taken.append(gone.select("node", "weight", "child"))
        handed = gone.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("h")).agg(F.sum("weight").alias("more"))
        past = gone.select(F.col("node").alias("g"), F.col("parent").alias("g_parent"))
        rest = marked.filter("NOT out").join(handed, F.col("node") == F.col("h"), "left").join(past, F.col("parent") == F.col("g"), "left")
        forest = materialize(rest.select("node", F.coalesce("g_parent", "parent").alias("parent"), "place", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight")), "forest")
        n = forest.count()
    sums = _subtree_sums(forest, block_nodes)
    for gone in reversed(taken):
        under = sums.select(F.col("node").alias("u"), F.col("weight").alias("under"))
        own = gone.join(under, F.col("child") == F.col("u"), "left").select("node", (F.col("weight") + F.coalesce("under", F.lit(0))).alias("weight"))
        sums = materialize(sums.unionByName(own), "sums")
    return sums


def _links_of_block(block: pd.DataFrame) -> pd.DataFrame:
    ids = block["node"].to_numpy(object)
    parents = block["parent"].to_numpy(object)
    parents = np.where(pd.isna(parents), None, parents).astype(object)
    top, _, _, kind = _contract(ids, parents, np.ones(len(ids), np.int64), ids)
    return pd.DataFrame({"node": ids, "top": top, "open": kind == OPEN})


def paths(nodes: DataFrame, queries: DataFrame, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(node, path): for each node of ``queries`` its line up to the root, itself first; a loop is listed once around.

    Paths are long, so they come for a stated set of nodes. Each walk is carried by its front: a round extends all fronts
    through their blocks at once, as in ``graph.reachable``, and keeps the pieces; they are put together by their number.
    """
    from chronoweave.operators.graph import follow

    pieces = follow(nodes, queries, block_nodes)
    ordered = F.array_sort(F.collect_list(F.struct("piece", "path")))
    return pieces.groupBy(F.col("walk").alias("node")).agg(F.flatten(F.transform(ordered, lambda p: p["path"])).alias("path"))
