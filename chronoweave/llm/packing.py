"""Filling containers of a fixed number of tokens.

Only the histogram of the lengths is ever looked at in one place: it has at most ``capacity`` entries, however many items
there are. From it a packing plan is made, a list of runs "containers c … c+r-1 hold one item of each of these lengths":

1. Lengths are grouped in windows; shallow combinations of windows that fill the capacity are enumerated.
2. Non-negative least squares finds how often to repeat each combination so that the histogram is met.
3. The counts are rounded, and each combination is given concrete lengths from its windows, largest that fit first.
   Containers that stay emptier than a small slack are not made.
4. The same is done with the lengths themselves: those that hold most of what is left are combined, few at a time but short
   ones in multiples, to sums within the slack of the capacity, again and again, on what the round before left over, until a round places next to nothing.
5. The rest is packed greedily, longest first into the least room that holds it, again by length and count.

Items are then numbered within their length by exact offset chunking and joined to the runs, so no task and no driver
ever sees the items of a frequent length in one place.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators.keyed_chunks import NUMBER, number_rows
from chronoweave.storage import materialize

WINDOWS, DEPTH, ROUNDS = 32, 4, 200
#: Lengths combined in a round, combinations of one, share of the capacity a planned container may leave, rounds at most, one of how
#: many items of a length is held back.
LENGTHS, COMBINATIONS, SLACK, LENGTH_ROUNDS, HELD_BACK = 24, 400, 4_096, 40, 16


@dataclass(frozen=True)
class Run:
    """``repeats`` containers from number ``first`` on, each with one item of every length in ``lengths``."""

    first: int
    repeats: int
    lengths: tuple[int, ...]


def shallow_combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most ``depth`` parts with sum ``units``."""
    out: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(parts)
        elif len(parts) < depth:
            for part in range(min(left, parts[-1] if parts else left), 0, -1):
                extend((*parts, part), left - part)

    extend((), units)
    return out


def nonnegative_least_squares(matrix: np.ndarray, target: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 with least ``|matrix x - target|``, by the active set method: few columns are used, no more than rows."""
    x = np.zeros(matrix.shape[1])
    used: list[int] = []
    for _ in range(rounds):
        gain = matrix.T @ (target - matrix @ x)
        gain[used] = 0.0
        new = int(np.argmax(gain))
        if gain[new] <= 1e-9 * max(1.0, float(np.abs(target).max(initial=0.0))):
            break
        used.append(new)
        while used:
            solved = np.linalg.lstsq(matrix[:, used], target, rcond=None)[0]
            if (solved > 0).all():
                x[:] = 0.0
                x[used] = solved
                break
            old = x[used]
            sunk = solved <= 0
            step = float((old[sunk] / np.maximum(old[sunk] - solved[sunk], 1e-300)).min())
            x[used] = moved = old + step * (solved - old)
            kept = [u for u, v in zip(used, moved, strict=True) if v > 1e-12]
            x[[u for u in used if u not in kept]] = 0.0
            if len(kept) == len(used):
                kept.remove(used[int(np.argmin(moved))])
            used = kept
            if new not in used:  # it goes out at once: nothing is to be gained
                return x
    return x


def _draw(wanted: tuple[int, ...], left: dict[int, int], lengths: list[int], windows: list[tuple[int, int]], capacity: int) -> tuple[int, ...] | None:
    """One concrete length for each window wanted: the longest that is left and fits."""
    room, chosen = capacity, []
    for place, window in enumerate(wanted):
        low, high = windows[window - 1]
        rest = sum(windows[w - 1][0] for w in wanted[place + 1 :])
        at = bisect_right(lengths, min(high, room - rest)) - 1
        while at >= 0 and lengths[at] >= low and left[lengths[at]] - chosen.count(lengths[at]) <= 0:
            at -= 1
        if at < 0 or lengths[at] < low:
            return None
        chosen.append(lengths[at])
        room -= lengths[at]
    return tuple(chosen)


def plan_packing(histogram: dict[int, int], capacity: int, windows: int = WINDOWS, depth: int = DEPTH) -> list[Run]:
    """Runs that hold every item of ``histogram`` {length: count}; lengths are 1 … ``capacity``.

    What a plan leaves over can be lopsided, long lengths without short ones to fill up with. So it is also tried with a
    share of every length held back for the residual; the plan of fewer containers is taken.
    """
    plans = [_plan(histogram, capacity, windows, depth, held) for held in (0, HELD_BACK)]
    return min(plans, key=lambda runs: sum(run.repeats for run in runs))


def _plan(histogram: dict[int, int], capacity: int, windows: int, depth: int, held: int) -> list[Run]:
    kept = {length: n // held for length, n in histogram.items() if held}
    left = {length: n - kept.get(length, 0) for length, n in histogram.items() if n > 0}
    runs: list[Run] = []
    first = 0

    def take(lengths: tuple[int, ...], repeats: int) -> None:
        nonlocal first
        for length in lengths:
            left[length] -= repeats
        runs.append(Run(first, repeats, lengths))
        first += repeats

    slack = capacity // SLACK
    units = min(windows, capacity)
    bounds = [(capacity * w // units + 1, capacity * (w + 1) // units) for w in range(units)]
    if left:
        combinations = shallow_combinations(units, depth)
        matrix = np.zeros((units, len(combinations)))
        for j, parts in enumerate(combinations):
            for part in parts:
                matrix[part - 1, j] += 1
        counts = np.array([sum(left.get(x, 0) for x in range(low, high + 1)) for low, high in bounds], float)
        repeats = np.rint(nonnegative_least_squares(matrix, counts / max(counts.sum(), 1)) * counts.sum()).astype(int)
        ordered = sorted(left)
        for j in np.argsort(-repeats, kind="stable"):
            todo = int(repeats[j])
            while todo > 0:
                lengths = _draw(combinations[j], left, ordered, bounds, capacity)
                if lengths is None:
                    break
                room = capacity - sum(lengths)
                while room > 0:  # fill what the windows leave with the longest that fits
                    at = bisect_right(ordered, room) - 1
                    while at >= 0 and left[ordered[at]] - lengths.count(ordered[at]) <= 0:
                        at -= 1
                    if at < 0:
                        break
                    lengths = (*lengths, ordered[at])
                    room -= ordered[at]
                if room > slack:
                    break
                most = min(left[x] // lengths.count(x) for x in lengths)
                take(lengths, min(todo, most))
                todo -= min(todo, most)
                ordered = [x for x in ordered if left[x] > 0]
    turn = 0
    for _ in range(LENGTH_ROUNDS if left else 0):
        before = sum(left.values())
        for lengths, repeats in _length_plan(left, capacity, depth, slack, turn):
            most = min(left[x] // lengths.count(x) for x in lengths)
            if min(repeats, most) > 0:
                take(lengths, min(repeats, most))
        placed = before - sum(left.values())
        # a round that places little has used up its lengths' common sums: others come first then, until none are left
        turn = 0 if placed else turn + 1
        if before == placed or turn * LENGTHS >= sum(n > 0 for n in left.values()):
            break
    rest = {x: n + kept.get(x, 0) for x, n in left.items()}
    return runs + _greedy({x: n for x, n in rest.items() if n > 0}, capacity, first)


def _multiples(most: int) -> list[int]:
    """How many at a time a length is tried: a few, half and all that fit."""
    return sorted({*range(1, min(most, 3) + 1), most // 2, most} - {0}, reverse=True)


def _length_plan(left: dict[int, int], capacity: int, depth: int, slack: int, turn: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) from the lengths that hold most of what is left, the ``turn``-th dozen of them, most repeated first."""
    chosen = sorted((x for x, n in left.items() if n > 0), key=lambda x: (-x * left[x], -x))[turn * LENGTHS : (turn + 1) * LENGTHS]
    chosen.sort(reverse=True)
    found: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], at: int, room: int, distinct: int) -> None:
        if parts and room <= slack:
            found.append(parts)
        for k in range(at, len(chosen) if distinct < depth else at):
            most = room // chosen[k]
            for times in _multiples(most):
                if len(found) >= limit:
                    return
                extend(parts + (chosen[k],) * times, k + 1, room - times * chosen[k], distinct + 1)

    for first in range(len(chosen)):  # each length begins as many combinations as the others
        limit = len(found) + COMBINATIONS // len(chosen)
        for times in _multiples(capacity // chosen[first]):
            extend((chosen[first],) * times, first + 1, capacity - times * chosen[first], 1)
    if not found:
        return []
    place = {x: i for i, x in enumerate(chosen)}
    matrix = np.zeros((len(chosen), len(found)))
    for j, parts in enumerate(found):
        for x in parts:
            matrix[place[x], j] += 1
    counts = np.array([left[x] for x in chosen], float)
    repeats = nonnegative_least_squares(matrix, counts / counts.sum()) * counts.sum()
    return [(found[j], int(repeats[j] + 0.5)) for j in np.argsort(-repeats, kind="stable") if repeats[j] >= 0.5]


def _greedy(left: dict[int, int], capacity: int, first: int) -> list[Run]:
    """Best fit, longest first, on counts: containers with the same content are one entry."""
    rooms: list[int] = []
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                for content, count in (((length,) * each, full), ((length,) * rest, 1 if rest else 0)):
                    if count:
                        room = capacity - sum(content)
                        if room not in open_:
                            open_[room] = {}
                            insort(rooms, room)
                        open_[room][content] = open_[room].get(content, 0) + count
                n = 0
                continue
            room = rooms[at]
            content, count = next(iter(open_[room].items()))
            used = min(n, count)
            if used == count:
                del open_[room][content]
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                open_[room][content] = count - used
            new = (*content, length)
            if room - length not in open_:
                open_[room - length] = {}
                insort(rooms, room - length)
            open_[room - length][new] = open_[room - length].get(new, 0) + used
            n -= used
    runs = []
    for room in rooms:
        for content, count in open_[room].items():
            runs.append(Run(first, count, content))
            first += count
    return runs


def pieces_of(items: DataFrame, capacity: int) -> DataFrame:
    """(item_id, piece, start, length): an item longer than the capacity is cut into full pieces and a rest.

    Items of length 0 or null have no piece, as there is nothing to put anywhere.
    """
    cut = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / capacity).cast("int")))
    pieces = items.filter(F.col("length") > 0).select("item_id", "length", cut.alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return pieces.select("item_id", "piece", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("length") - start).alias("length"))


def _run_table(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """One row per run and place in it: items ``low`` … ``high``-1 of the length go to containers from ``first`` on."""
    used: dict[int, int] = {}
    rows = []
    for run in runs:
        offset = 0
        for place, length in enumerate(run.lengths):
            low = used.get(length, 0)
            used[length] = low + run.repeats
            rows.append((length, low, low + run.repeats, run.first, place, offset))
            offset += length
    return spark.createDataFrame(rows, "length bigint, low bigint, high bigint, first bigint, place int, offset bigint")


RANK_CELL = 1 << 16


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """(container_id, place, offset, item_id, piece, start, length) of items (item_id, length).

    Every token of every item is in exactly one container, no container holds more than ``capacity``, and only items
    longer than that are cut. Repeated rows are separate items. Full pieces of long items fill containers of their own.
    An empty table gives an empty result.
    """
    spark = items.sparkSession
    lengths = materialize(items.select("item_id", "length"), "lengths")  # they may be costly to count: once is enough
    pieces = materialize(pieces_of(lengths, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = plan_packing(histogram, capacity)
    places = _run_table(spark, runs)
    # a length's runs are cut at cells of ranks, so the join is an equality of (length, cell)
    cells = F.explode(F.sequence(F.floor(F.col("low") / RANK_CELL), F.floor((F.col("high") - 1) / RANK_CELL)))
    places = places.withColumn("cell", cells).select(F.col("length").alias("p_length"), "cell", "low", "high", "first", "place", "offset")
    numbered = number_rows(pieces, ["length"]).withColumn("n_cell", F.floor(F.col(NUMBER) / RANK_CELL))
    found = (F.col("length") == F.col("p_length")) & (F.col("n_cell") == F.col("cell")) & (F.col(NUMBER) >= F.col("low")) & (F.col(NUMBER) < F.col("high"))
    joined = numbered.join(places, found)
    container = (F.col("first") + F.col(NUMBER) - F.col("low")).alias("container_id")
    return joined.select(container, "place", "offset", "item_id", "piece", "start", "length")
