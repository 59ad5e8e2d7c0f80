"""Per-key chunking, sessions and hierarchies against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import hierarchy, keyed_chunks, sessions


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_sessions(events, gap):
    once = {}
    for event, key, ts in events:
        if key is not None and ts is not None:
            once[event] = min(once.get(event, (ts, key)), (ts, key))
    out, by_key = [], {}
    for ts, key in once.values():
        by_key.setdefault(key, []).append(ts)
    for key, times in by_key.items():
        times.sort()
        start = last = times[0]
        n = 0
        for t in times:
            if t - last > gap:
                out.append((key, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((key, start, last, n))
    return sorted(out)


def test_numbers_are_exact_and_gapless(spark, tmp_path):
    random.seed(1)
    data = [(random.choice(["hot", "hot", "hot", "a", "b", None]), i, None if i % 7 == 0 else i) for i in range(5000)]
    spark.createDataFrame(data, "k string, i bigint, v bigint").repartition(7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    numbered = keyed_chunks.number_rows(df, ["k"], 100).collect()
    by_key = {}
    for r in numbered:
        by_key.setdefault(r.k, []).append(r)
        assert r._chunk == r._number // 100
    assert all(sorted(r._number for r in rs) == list(range(len(rs))) for rs in by_key.values())
    assert len(numbered) == 5000
    states = keyed_chunks.chunk_states(df, ["k"], ["v"], "i", 100).collect()
    assert max(s.n_rows for s in states) <= 100
    running = {}
    for s in sorted(states, key=lambda s: (str(s.k), s.chunk)):
        n, v = running.get(s.k, (0, 0))
        assert (s.n_rows_before, s.v_before) == (n, v)
        running[s.k] = (n + s.n_rows, v + s.v)
    got = {r.k: (r.n_rows, r.v, r.first_i, r.last_i) for r in keyed_chunks.per_key(df, ["k"], ["v"], "i", 100).collect()}
    for k in {d[0] for d in data}:
        own = [d for d in data if d[0] == k]
        assert got[k] == (len(own), sum(d[2] or 0 for d in own), min(d[1] for d in own), max(d[1] for d in own))


def test_per_key_of_an_empty_table_and_reserved_names(spark):
    empty = spark.createDataFrame([], "k string, v bigint")
    assert keyed_chunks.per_key(empty, ["k"], ["v"]).collect() == []
    clashing = spark.createDataFrame([("a", 1)], "k string, _chunk int")
    try:
        keyed_chunks.number_rows(clashing, ["k"])
    except ValueError:
        pass
    else:
        raise AssertionError


def test_sessions_in_any_order_of_batches(spark):
    random.seed(2)
    events = []
    for i in range(600):
        key = random.choice(["hot", "hot", "b", "c", None])
        events.append((f"e{i}", key, None if i % 97 == 0 else random.randrange(-40_000, 90_000)))
    events += events[:40] + [("x1", "edge", 0), ("x2", "edge", 100), ("x3", "edge", 201)]
    table = sessions.SessionTable(spark, gap=100)
    shuffled = events[:]
    random.shuffle(shuffled)
    for part in (shuffled[:250], shuffled[250:260], [], shuffled[200:]):
        table.apply(spark.createDataFrame(part, "event_id string, key string, ts bigint"))
    assert rows(table.read()) == brute_sessions(events, 100)


def test_spans_across_epochs_bridge(spark):
    spans = [("k", 0, 950, 3), ("k", 700, 720, 1), ("k", 880, 900, 1), ("k", 1001, 1001, 1), ("k", 1105, 5000, 7), ("k", 3000, 3001, 2), ("k", 9000, 9000, 1)]
    df = spark.createDataFrame(spans, sessions.SESSION)
    assert rows(sessions.merge_spans(df, gap=100, epoch_cells=4)) == [("k", 0, 1001, 6), ("k", 1105, 5000, 9), ("k", 9000, 9000, 1)]


def brute_forest(links):
    out = {}
    for node in links:
        path, at = [], node
        seen = {}
        while at in links and at not in seen and links[at] in links:
            seen[at] = len(path)
            path.append(at)
            at = links[at]
        if at in seen:
            out[node] = (min(path[seen[at]:]), -1)
        else:
            out[node] = (at, len(path))
    return out


def check_forest(spark, links, block, place=None):
    data = [(n, p, place(n) if place else None) for n, p in links.items()]
    df = spark.createDataFrame(data, "node string, parent string, place bigint")
    got = {r.node: (r.root, r.depth) for r in hierarchy.resolve(df, block).collect()}
    assert got == brute_forest(links)


def test_forest_with_loops_and_missing_parents(spark):
    random.seed(3)
    links = {f"{i:04d}": f"{random.randrange(max(0, i - 5), i):04d}" if i else None for i in range(800)}
    links |= {"c1": "c2", "c2": "c3", "c3": "c1", "t1": "c2", "t2": "t1", "self": "self", "s2": "self", "m": "gone"}
    check_forest(spark, links, 10_000)
    check_forest(spark, links, 150, lambda n: int(n) if n.isdigit() else 5)


def test_chain_in_an_order_that_does_not_help(spark):
    random.seed(4)
    order = list(range(400))
    random.shuffle(order)
    links = {f"{order[i]:04d}": f"{order[i - 1]:04d}" if i else None for i in range(400)}
    loop = {f"z{order[i]:04d}": f"z{order[i - 1]:04d}" for i in range(200)}
    check_forest(spark, links | loop, 120)


def test_empty_forest(spark):
    assert hierarchy.resolve(spark.createDataFrame([], "node string, parent string, place int")).collect() == []


def brute_descendants(links):
    def line(node):
        seen, at = [], node
        while at in links and at not in seen:
            seen.append(at)
            at = links[at]
        return seen, at in seen

    counts = dict.fromkeys(links, 0)
    for node in links:
        path, round_ = line(node)
        on_loop = round_ and links[path[-1]] == node
        if not on_loop:
            for above in path[1:]:
                counts[above] += 1
    return counts


def test_descendants_and_paths(spark):
    random.seed(13)
    links = {f"{i:04d}": f"{random.randrange(max(0, i - 6), i):04d}" if i else None for i in range(500)}
    links |= {"m": "gone"}
    df = spark.createDataFrame([(n, p, int(n) if n.isdigit() else -1) for n, p in links.items()], "node string, parent string, place int")
    loops = links | {"x1": "x2", "x2": "x1", "t": "x1", "u": "t"}
    looped = spark.createDataFrame([(n, p, 0) for n, p in loops.items()], "node string, parent string, place int")
    for block in (10_000, 90):
        assert {r.node: r.n_descendants for r in hierarchy.descendant_counts(df, block).collect()} == brute_descendants(links)
    got = {r.node: r.n_descendants for r in hierarchy.descendant_counts(looped).collect()}
    assert got == brute_descendants(links) | {"x1": -1, "x2": -1, "t": -1, "u": -1}
    asked = spark.createDataFrame([("0499",), ("0250",), ("m",), ("u",), ("none",)], "node string")
    for block in (10_000, 90):
        paths = {r.node: r.path for r in hierarchy.paths(looped, asked, block).collect()}
        assert set(paths) == {"0499", "0250", "m", "u"} and paths["m"] == ["m"] and paths["u"] == ["u", "t", "x1", "x2"]
        for node in ("0499", "0250"):
            path = paths[node]
            assert path[0] == node and path[-1] == "0000" and all(links[a] == b for a, b in zip(path, path[1:], strict=False))


def test_intervals_give_all_paths_and_descendants(spark):
    random.seed(14)
    links = {f"{i:04d}": f"{random.randrange(max(0, i - 6), i):04d}" if i else None for i in range(300)}
    links |= {"m": "gone", "n": "m", "x1": "x2", "x2": "x1", "t": "x1"}
    df = spark.createDataFrame([(n, p, None) for n, p in links.items()], "node string, parent string, place int")
    for block in (10_000, 90):
        got = {r.node: r for r in hierarchy.intervals(df, block).collect()}
        assert set(got) == set(links) and {n: (r.root, r.depth) for n, r in got.items()} == brute_forest(links)
        for node, r in got.items():
            if r.depth < 0:
                assert r.enter is None and r.leave is None and r.parent == links[node]
                continue
            path = sorted((a for a in got.values() if a.root == r.root and a.enter is not None and a.enter <= r.enter <= a.leave), key=lambda a: -a.depth)
            want, at = [], node
            while at in links:
                want.append(at)
                at = links[at]
            assert [a.node for a in path] == want


def test_descendants_without_a_layout(spark):
    random.seed(15)
    order = list(range(500))
    random.shuffle(order)
    links = {f"{order[i]:04d}": f"{order[max(0, i - random.choice((1, 1, 1, 4)))]:04d}" if i else None for i in range(500)}
    df = spark.createDataFrame([(n, p, None) for n, p in links.items()], "node string, parent string, place int")
    assert {r.node: r.n_descendants for r in hierarchy.descendant_counts(df, 30).collect()} == brute_descendants(links)


def test_sessions_come_in_three_batches(spark, tmp_path):
    events = spark.createDataFrame([(f"e{i}", "k", i * 60, i) for i in range(30)], "event_id string, key string, ts bigint, day int")
    events = events.withColumn("at", events.day.cast("long").cast("timestamp"))
    path = f"{tmp_path}/sessions"
    assert rows(sessions.sessions_in_batches(events, "at", gap=100, path=path)) == [("k", 0, 29 * 60, 30)]
    assert sessions.SessionTable(spark, path).version() == 3


def test_a_second_writer_is_told(spark, monkeypatch):
    """Two writers start from one version: the later commit fails and changes nothing, and can be tried again."""
    batch = lambda *rows: spark.createDataFrame(rows, "event_id string, key string, ts bigint")
    table = sessions.SessionTable(spark, gap=100)
    table.apply(batch(("a", "k", 0)))
    other = sessions.SessionTable(spark, table.path, gap=100)
    with monkeypatch.context() as m:
        m.setattr(other, "version", lambda: 1)
        table.apply(batch(("b", "k", 50)))
        with pytest.raises(RuntimeError, match="another writer"):
            other.apply(batch(("c", "k", 500)))
    assert rows(table.read()) == [("k", 0, 50, 2)] and table.version() == 2
    other.apply(batch(("c", "k", 500)))
    assert rows(table.read()) == [("k", 0, 50, 2), ("k", 500, 500, 1)]


def test_what_is_written_follows_the_batch(spark):
    """A batch in one epoch reads and writes its cells only, however many the table has; one that bridges epochs merges them."""
    table = sessions.SessionTable(spark, gap=100, buckets=2, epoch_seconds=10_000)
    events = [(f"{k}{t}", k, t) for k in "abcdef" for t in range(0, 200_000, 5_000)]
    table.apply(spark.createDataFrame(events, "event_id string, key string, ts bigint"))
    folders = lambda version: {(c["bucket"], c["epoch"]): c["folder"] for c in table._manifest(version)}
    before = folders(1)
    table.apply(spark.createDataFrame([("new", "a", 95_050), ("a95000", "a", 95_000)], "event_id string, key string, ts bigint"))
    changed = {c for c, folder in folders(2).items() if before.get(c) != folder}
    assert len(before) == 40 and len(changed) <= 2 and {e for _, e in changed} <= {9}
    late = [(f"l{t}", "a", t) for t in range(99_900, 100_100, 50)]
    table.apply(spark.createDataFrame(late, "event_id string, key string, ts bigint"))
    assert rows(table.read()) == brute_sessions(sorted({*((i, k, t) for i, k, t in events), ("new", "a", 95_050), *late}), 100)


def test_descendants_of_stated_nodes(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "DESCENDANT_CELL", 7)
    rng = random.Random(3)
    parent = {f"n{i:03d}": f"n{rng.randrange(max(0, i - 9), i):03d}" if i % 60 else None for i in range(150)} | {"x": "y", "y": "x", "z": "x"}
    df = spark.createDataFrame([(n, p, rng.randrange(150)) for n, p in parent.items()], "node string, parent string, place int")
    asked = ["n000", "n003", "n060", "n149", "x", "gone"]
    want = set()
    for n in parent:
        above, steps = parent[n], 1
        while above is not None and steps < 200:
            want |= {(above, n, steps)} if above in asked and above[0] == "n" else set()
            above, steps = parent[above], steps + 1
    assert {tuple(r) for r in hierarchy.descendants(df, spark.createDataFrame([(a,) for a in asked], "node string")).collect()} == want


def test_the_offsets_join_needs_no_broadcast(spark, tmp_path):
    """Beyond the session's broadcast threshold the offsets of long keys are joined by sorting, with the same result."""
    spark.range(5_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).repartition(7).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = rows(keyed_chunks.per_key(df, ["k"], ["v"], chunk_rows=100))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        done = keyed_chunks.per_key(df, ["k"], ["v"], chunk_rows=100)
        assert "BroadcastHashJoin" not in done._jdf.queryExecution().executedPlan().toString() and rows(done) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace as Fake

    from chronoweave import storage

    context = Fake(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(Fake(conf=Fake(get=lambda name, default: default), sparkContext=context))
