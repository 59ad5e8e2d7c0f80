"""Queries of the core data-preparation operators: per-key results, sessions, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.operators import hierarchy, keyed_chunks, sessions
from chronoweave.sources.tables import clean_email, latest, table

HEAVY_SHARE = 0.025


def _emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "commit_facts")
    return facts.select(clean_email(F.col("author.email")).alias("key_value"), F.col("author.timestamp").alias("ts"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_change_facts").select(F.col("file.path").alias("key_value"), "file.additions", "file.deletions")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with at least 2.5 % of all rows of their table."""
    parts = []
    for kind, rows in (("email", _emails(spark, sf_dir).select("key_value")), ("path", _paths(spark, sf_dir).select("key_value"))):
        heavy = keyed_chunks.heavy_keys(rows, ["key_value"], HEAVY_SHARE, rows.count())
        parts.append(heavy.filter(F.col("key_value").isNotNull()).select(F.lit(kind).alias("key_kind"), "key_value"))
    return parts[0].unionByName(parts[1])


def p2_commits_per_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, first and last author time of every e-mail."""
    done = keyed_chunks.per_key(_emails(spark, sf_dir), ["key_value"], [], order="ts")
    return done.select(F.col("key_value").alias("email"), "n_rows", "first_ts", "last_ts")


def p2_changes_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes, additions and deletions of every path."""
    done = keyed_chunks.per_key(_paths(spark, sf_dir), ["key_value"], ["additions", "deletions"])
    return done.select(F.col("key_value").alias("path"), "n_rows", "additions", "deletions")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work sessions of every author e-mail."""
    facts = table(spark, sf_dir, "commit_facts")
    events = facts.select(F.col("oid").alias("event_id"), clean_email(F.col("author.email")).alias("key"), F.col("author.timestamp").alias("ts"), "extracted_at")
    done = sessions.sessions_in_batches(events, "extracted_at")
    return done.select(F.col("key").alias("email"), "start_ts", "end_ts", F.col("n_events").alias("n_commits"))


def p3_session_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their duration."""
    return p3_found(spark, sf_dir).withColumn("duration_s", F.col("end_ts") - F.col("start_ts"))


def first_parent_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, parent, place) of the row that holds of every oid; place is the commit's repository and time."""
    facts = table(spark, sf_dir, "commit_facts").filter(F.col("oid").isNotNull())
    rows = facts.select("oid", F.get("parents", F.lit(0)).alias("parent"), F.struct(F.col("repository.name").alias("r"), F.col("committer.timestamp").alias("t")).alias("place"), "extracted_at")
    return latest(rows, ["oid"], "extracted_at").select(F.col("oid").alias("node"), "parent", "place")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every commit in its first-parent tree."""
    done = hierarchy.resolve(first_parent_forest(spark, sf_dir))
    return done.select(F.col("node").alias("oid"), F.col("root").alias("root_oid"), "depth")


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of descendants of every commit in its first-parent tree."""
    done = hierarchy.descendant_counts(first_parent_forest(spark, sf_dir))
    return done.select(F.col("node").alias("oid"), "n_descendants")


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and descendants of every commit as an interval of its tree's preorder, as ``hierarchy.intervals`` says."""
    done = hierarchy.intervals(first_parent_forest(spark, sf_dir))
    return done.select(F.col("node").alias("oid"), F.col("parent").alias("parent_oid"), F.col("root").alias("root_oid"), "depth", "enter", "leave")


QUERIES = {f.__name__: f for f in (p2_found, p2_commits_per_email, p2_changes_per_path, p3_found, p3_session_durations, p5_found, p5_descendants, p5_paths)}

_EMAIL = "nullif(lower(trim(author.email)), '')"
_SESSIONS = f"""
WITH once AS (SELECT oid, min({_EMAIL}) AS email, min(author."timestamp") AS ts FROM commit_facts GROUP BY oid),
     marked AS (SELECT email, ts, CASE WHEN ts - lag(ts) OVER w <= 7200 THEN 0 ELSE 1 END AS opens FROM once
                WHERE email IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY email ORDER BY ts)),
     numbered AS (SELECT email, ts, sum(opens) OVER (PARTITION BY email ORDER BY ts) AS run FROM marked)
SELECT email, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_commits FROM numbered GROUP BY email, run
"""

ORACLE = {
    "p2_found": f"""
SELECT 'email' AS key_kind, k AS key_value FROM (SELECT {_EMAIL} AS k, count(*) AS n FROM commit_facts GROUP BY 1)
WHERE k IS NOT NULL AND n >= 0.025 * (SELECT count(*) FROM commit_facts)
UNION ALL
SELECT 'path', k FROM (SELECT file.path AS k, count(*) AS n FROM file_change_facts GROUP BY 1)
WHERE k IS NOT NULL AND n >= 0.025 * (SELECT count(*) FROM file_change_facts)
""",
    "p2_commits_per_email": f"""
SELECT {_EMAIL} AS email, count(*) AS n_rows, min(author."timestamp") AS first_ts, max(author."timestamp") AS last_ts
FROM commit_facts GROUP BY 1
""",
    "p2_changes_per_path": """
SELECT file.path AS path, count(*) AS n_rows, CAST(coalesce(sum(file.additions), 0) AS BIGINT) AS additions,
       CAST(coalesce(sum(file.deletions), 0) AS BIGINT) AS deletions
FROM file_change_facts GROUP BY 1
""",
    "p3_found": _SESSIONS,
    "p3_session_durations": f"SELECT *, end_ts - start_ts AS duration_s FROM ({_SESSIONS})",
    "p5_found": """
WITH RECURSIVE held AS (SELECT oid, arg_max(struct_pack(p := parents[1]), extracted_at).p AS parent FROM commit_facts WHERE oid IS NOT NULL GROUP BY oid),
     links AS (SELECT a.oid, b.oid AS parent FROM held a LEFT JOIN held b ON a.parent = b.oid),
     down AS (SELECT oid, oid AS root_oid, CAST(0 AS BIGINT) AS depth FROM links WHERE parent IS NULL
              UNION ALL SELECT l.oid, d.root_oid, d.depth + 1 FROM down d JOIN links l ON l.parent = d.oid),
     lost AS (SELECT oid, parent FROM links WHERE oid NOT IN (SELECT oid FROM down)),
     walk AS (SELECT oid, parent AS place FROM lost UNION SELECT w.oid, l.parent FROM walk w JOIN lost l ON w.place = l.oid),
     loops AS (SELECT oid FROM walk WHERE oid = place)
SELECT oid, root_oid, depth FROM down
UNION ALL
SELECT w.oid, min(w.place), CAST(-1 AS BIGINT) FROM walk w JOIN loops c ON w.place = c.oid GROUP BY w.oid
""",
    "p5_paths": """
WITH RECURSIVE held AS (SELECT oid, arg_max(struct_pack(p := parents[1]), extracted_at).p AS parent FROM commit_facts WHERE oid IS NOT NULL GROUP BY oid),
     links AS MATERIALIZED (SELECT a.oid, b.oid AS parent FROM held a LEFT JOIN held b ON a.parent = b.oid),
     down AS (SELECT oid, oid AS root, CAST(0 AS BIGINT) AS depth FROM links WHERE parent IS NULL
              UNION ALL SELECT l.oid, d.root, d.depth + 1 FROM down d JOIN links l ON l.parent = d.oid),
     trees AS MATERIALIZED (SELECT d.oid, d.root, d.depth, l.parent FROM down d JOIN links l USING (oid)),
     above AS (SELECT oid, parent AS anc FROM trees WHERE parent IS NOT NULL UNION ALL SELECT a.oid, t.parent FROM above a JOIN trees t ON t.oid = a.anc WHERE t.parent IS NOT NULL),
     sizes AS MATERIALIZED (SELECT t.oid, t.root, t.depth, t.parent, coalesce(c.n, 0) AS n FROM trees t LEFT JOIN (SELECT anc, count(*) AS n FROM above GROUP BY 1) c ON c.anc = t.oid),
     steps AS MATERIALIZED (SELECT oid, parent, CAST(1 + coalesce(sum(n + 1) OVER (PARTITION BY parent ORDER BY oid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS step FROM sizes WHERE parent IS NOT NULL),
     entered AS (SELECT oid, CAST(0 AS BIGINT) AS enter FROM trees WHERE parent IS NULL UNION ALL SELECT s.oid, e.enter + s.step FROM entered e JOIN steps s ON s.parent = e.oid),
     lost AS (SELECT oid, parent FROM links WHERE oid NOT IN (SELECT oid FROM trees)),
     walk AS (SELECT oid, parent AS place FROM lost UNION SELECT w.oid, l.parent FROM walk w JOIN lost l ON w.place = l.oid),
     loops AS (SELECT oid FROM walk WHERE oid = place)
SELECT s.oid, s.parent AS parent_oid, s.root AS root_oid, s.depth, e.enter, CAST(e.enter + s.n AS BIGINT) AS leave FROM sizes s JOIN entered e USING (oid)
UNION ALL
SELECT w.oid, any_value(l.parent), min(w.place), CAST(-1 AS BIGINT), NULL, NULL FROM walk w JOIN loops c ON w.place = c.oid JOIN lost l ON l.oid = w.oid GROUP BY w.oid
""",
    "p5_descendants": """
WITH RECURSIVE held AS (SELECT oid, arg_max(struct_pack(p := parents[1]), extracted_at).p AS parent FROM commit_facts WHERE oid IS NOT NULL GROUP BY oid),
     links AS (SELECT a.oid, b.oid AS parent FROM held a LEFT JOIN held b ON a.parent = b.oid),
     walk AS (SELECT oid, parent AS above FROM links WHERE parent IS NOT NULL UNION SELECT w.oid, l.parent FROM walk w JOIN links l ON w.above = l.oid WHERE l.parent IS NOT NULL),
     loops AS (SELECT oid FROM walk WHERE oid = above),
     endless AS (SELECT oid FROM loops UNION SELECT w.oid FROM walk w JOIN loops c ON w.above = c.oid)
SELECT h.oid, CASE WHEN h.oid IN (SELECT oid FROM endless) THEN -1 ELSE count(w.oid) END AS n_descendants
FROM held h LEFT JOIN walk w ON w.above = h.oid GROUP BY h.oid
""",
}
