"""Queries of the history operators: reachability, planning, projection, file changes, enrichment, sinks, analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronoweave.enrich import file_types, plugins
from chronoweave.functions import values
from chronoweave.operators import changes, graph, planning, project, sink, summary
from chronoweave.sources.tables import clean_email, latest, table
from chronoweave.storage import materialize

SINCE_SECONDS = 1_750_800_000
USER_RULES = [("*.generated.ts", "Generated TypeScript"), ("*.pb.go", "Protocol stub"), ("CHANGELOG.md", "Changelog")]


# ---- commits, refs and plans of the tables


def held_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that holds of every oid."""
    facts = table(spark, sf_dir, "commit_facts").filter(F.col("oid").isNotNull())
    return latest(facts, ["oid"], "extracted_at")


def held_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the walks need of the commits, written once as they read it several times."""
    facts = table(spark, sf_dir, "commit_facts").filter(F.col("oid").isNotNull())
    return materialize(latest(facts.select("oid", "parents", "committer", "repository", "extracted_at"), ["oid"], "extracted_at"), "held")


def graph_nodes(commits: DataFrame) -> DataFrame:
    return commits.select(F.col("oid").alias("node"), "parents", F.struct(F.col("repository.name"), F.col("committer.timestamp")).alias("place"))


def tips(commits: DataFrame) -> DataFrame:
    """(repository_name, ref_index, head, prior, other) of every repository: its latest commit, the latest of its first half, its greatest oid."""
    c = commits.select(F.col("repository.name").alias("repository_name"), F.col("committer.timestamp").alias("ts"), "oid")
    key = F.struct("ts", "oid")
    ends = c.groupBy("repository_name").agg(F.max_by("oid", key).alias("head"), F.max("oid").alias("other"), F.floor((F.min("ts") + F.max("ts")) / 2).alias("middle"))
    prior = c.join(ends, "repository_name").filter(F.col("ts") <= F.col("middle")).groupBy("repository_name").agg(F.max_by("oid", key).alias("prior"))
    index = (F.row_number().over(Window.orderBy("repository_name")) - 1).alias("ref_index")  # one row a repository
    return ends.join(prior, "repository_name").select("repository_name", index, "head", "prior", "other")


def reachable_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = held_graph(spark, sf_dir)
    starts = tips(commits).select(F.col("repository_name").alias("walk"), F.col("head").alias("node"))
    return graph.reachable(graph_nodes(commits), starts).select(F.col("walk").alias("repository_name"), F.col("node").alias("oid"))


def _difference(spark: SparkSession, sf_dir: str, exclude: Column) -> DataFrame:
    commits = held_graph(spark, sf_dir)
    plans = tips(commits).select("ref_index", "head", exclude.alias("exclude"))
    return graph.reachable_difference(graph_nodes(commits), plans).select("ref_index", F.col("node").alias("oid"))


def reachable_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _difference(spark, sf_dir, F.col("prior"))


def missing_boundary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excludes of every other ref are unknown commits, so those refs are walked whole."""
    return _difference(spark, sf_dir, F.when(F.col("ref_index") % 2 == 0, F.lit("0" * 40)).otherwise(F.col("prior")))


def multi_ref_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = held_graph(spark, sf_dir)
    t = tips(commits)
    none = F.lit(None).cast("string").alias("exclude")
    plans = t.select((F.col("ref_index") * 2).alias("ref_index"), F.col("prior").alias("head"), none).unionByName(
        t.select((F.col("ref_index") * 2 + 1).alias("ref_index"), "head", none)
    )
    return graph.first_reaching_ref(graph.reachable_difference(graph_nodes(commits), plans)).select(F.col("node").alias("oid"), "ref_index")


def since_date_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = held_commits(spark, sf_dir)
    reached = reachable_commits(spark, sf_dir)
    return planning.after_date(commits.join(reached.select("oid").distinct(), "oid"), SINCE_SECONDS * 1000).select("oid", F.col("committer.timestamp").alias("committer_ts"))


def since_date_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boundary itself is left out: each repository's commits strictly after its prior tip's time."""
    commits = held_commits(spark, sf_dir)
    boundary = tips(commits).join(commits.select(F.col("oid").alias("prior"), F.col("committer.timestamp").alias("since")), "prior").select("repository_name", "since")
    rows = commits.select("oid", F.col("repository.name").alias("repository_name"), F.col("committer.timestamp").alias("ts"))
    return rows.join(boundary, "repository_name").filter(F.col("ts") * 1000 > F.col("since") * 1000).select("repository_name", "oid")


def merge_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = held_graph(spark, sf_dir)
    t = tips(commits)
    both = t.select(F.col("repository_name").alias("group"), F.col("head").alias("node")).unionByName(t.select(F.col("repository_name").alias("group"), F.col("other").alias("node")))
    return graph.merge_bases(graph_nodes(commits), both).select(F.col("group").alias("repository_name"), "base")


def _requested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requested refs, known refs, commits: five spellings for every repository, of which one resolves to nothing."""
    commits = held_commits(spark, sf_dir)
    t = tips(commits)
    name = F.col("repository_name")
    refs = t.select(F.concat(F.lit("refs/heads/"), name).alias("full_name"), F.col("head").alias("peeled_oid"), F.lit(False).alias("is_tag_object")).unionByName(
        t.select(F.concat(F.lit("refs/tags/v-"), name).alias("full_name"), F.col("prior").alias("peeled_oid"), (F.length(name) % 2 == 0).alias("is_tag_object"))
    )
    spellings = F.array(F.concat(F.lit("refs/heads/"), name), name, F.concat(F.lit("refs/tags/v-"), name), F.col("head"), F.concat(F.lit("gone-"), name))
    spelled = t.select("ref_index", F.posexplode(spellings).alias("pos", "name"))
    return spelled.select((F.col("ref_index") * 5 + F.col("pos")).alias("ref_index"), "name"), refs, commits


def ref_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.resolve_refs(*_requested(spark, sf_dir))


def _prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prior state with the full branch names of every second repository, each twice: the later entry counts."""
    t = tips(held_commits(spark, sf_dir)).filter("ref_index % 2 = 0")
    ref = F.concat(F.lit("refs/heads/"), "repository_name").alias("ref")
    first = t.select(ref, F.lit("branch").alias("ref_type"), F.col("other").alias("tip_oid"), F.lit(0).alias("position"))
    return first.unionByName(t.select(ref, F.lit("branch").alias("ref_type"), F.col("prior").alias("tip_oid"), F.lit(1).alias("position")))


def plan_exclude_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = ref_classification(spark, sf_dir)
    return planning.make_plans(resolved, _prior(spark, sf_dir), merge_base="f" * 40)


def incremental_new_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.new_branches(ref_classification(spark, sf_dir), _prior(spark, sf_dir)).select("ref_index", "name")


def missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.missing_refs(ref_classification(spark, sf_dir))


def checkpoint_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.last_checkpoints(_prior(spark, sf_dir))


# ---- projection


def _flat_person(side: str) -> list[Column]:
    return [F.col(f"{side}.{part}").alias(f"{side}_{part}") for part in ("name", "email", "timestamp")]


def commit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = project.commit_records(held_commits(spark, sf_dir))
    return records.select(
        "oid", "message", *_flat_person("author"), *_flat_person("committer"), F.array_join(F.coalesce("parents", F.array().cast("array<string>")), " ").alias("parents"),
        F.col("repository.name").alias("repository_name"), F.col("repository.url").alias("repository_url"),
    )


def iso_timestamp_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author times of the orders fixture with offsets of half hours on both sides of zero."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) - k % 3 * 3600
    return orders.select(k.alias("k"), values.iso_timestamp(seconds, ((k % 5 - 2) * 330).cast("int")).alias("rendered"))


def _held_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "file_change_facts").select(F.col("commit_oid").alias("oid"), F.col("file.path").alias("path"), "file", "extracted_at")
    return latest(facts, ["oid", "path"], "extracted_at").select("oid", "path", F.col("file.status").alias("status"), F.col("file.additions").alias("additions"), F.col("file.deletions").alias("deletions"))


def file_change_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = project.file_records(held_commits(spark, sf_dir), _held_changes(spark, sf_dir))
    return records.select("oid", F.col("author.timestamp").alias("author_timestamp"), *[F.col(f"file.{c}").alias(c) for c in ("path", "status", "additions", "deletions")])


def fact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held_changes(spark, sf_dir).select(values.fact_id(F.col("oid"), F.col("path")).alias("fact_id"))


def repository_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    repositories = table(spark, sf_dir, "repositories")
    path = F.concat(F.lit("/srv/git/"), "repository_name", F.lit("/"))
    supported = F.coalesce(F.lower(F.trim("object_format")), F.lit("sha1"))
    return repositories.select("repository_name", values.repository_name(F.col("url"), path).alias("derived"), supported.alias("object_format"))


def session_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", values.session_stamp(F.col("ts")).alias("stamp"))


def message_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_commits(spark, sf_dir).select("oid", F.size(values.message_lines(F.col("message"))).cast("long").alias("n_lines"))


def oid_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows have an oid, and a first parent, of the right form."""
    facts = table(spark, sf_dir, "commit_facts")
    parent = F.get("parents", F.lit(0))
    good = lambda c: F.count_if(values.is_oid(c))
    return facts.agg(F.count(F.lit(1)).alias("n_rows"), good(F.col("oid")).alias("good_oids"), good(parent).alias("good_parents"))


def blob_size_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("content").cast("long")
    return table(spark, sf_dir, "file_blobs").select("repository_name", "path", values.humanized_bytes(size).alias("size"))


# ---- file changes (trees of the orders fixture)


def fixture_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Trees of eight paths a commit, and commits k with parents k div 2 and, for some, k div 3."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(k.alias("k"))
    oid = lambda c: c.cast("string")
    k = F.col("k")
    parents = F.when(k == 0, F.array().cast("array<string>")).when((k % 5 == 0) & (k >= 10), F.array(oid(F.floor(k / 2)), oid(F.floor(k / 3)))).otherwise(F.array(oid(F.floor(k / 2))))
    commits = orders.select(oid(k).alias("oid"), parents.alias("parents"))
    j = F.col("j")
    entries = orders.select("k", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j")).filter((k + j) % 6 != 0)
    ending = F.element_at(F.array(*[F.lit(e) for e in (".ts", ".d.ts", ".PY", ".unmapped")]), j % 4 + 1)
    mode = F.when((k + j) % 13 == 0, "160000").when(((k * j) % 11 == 0) & (j > 0), "100755").otherwise("100644")
    blob = F.sha1(F.concat_ws(":", j.cast("string"), F.floor((k + j) / (j + 2)).cast("string")))
    trees = entries.select(oid(k).alias("oid"), F.concat(F.lit("src/p"), j.cast("string"), ending).alias("path"), blob.alias("blob_oid"), mode.alias("mode"))
    return trees, commits


def tree_diff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.tree_changes(*fixture_trees(spark, sf_dir)).select("oid", "path", "status")


def root_commit_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees, commits = fixture_trees(spark, sf_dir)
    return changes.tree_changes(trees, commits.filter(F.size("parents") == 0)).select("oid", "path", "status")


def first_parent_merge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees, commits = fixture_trees(spark, sf_dir)
    return changes.tree_changes(trees, commits.filter(F.size("parents") > 1)).groupBy("oid", "status").agg(F.count(F.lit(1)).alias("n_changes"))


MOST_DIFF_BYTES = 1_000


def diff_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each blob would not be diffed against an empty file."""
    guard = changes.diff_guard(F.lit(None).cast("binary"), F.col("content"), MOST_DIFF_BYTES)
    return table(spark, sf_dir, "file_blobs").select("repository_name", "path", guard.alias("skipped"))


def binary_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a NUL put in at byte doc_id * 100: only one within the first 8,000 bytes makes a file binary."""
    documents = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    raw = F.encode("text", "UTF-8")
    size = F.octet_length(raw)
    # ids of any size: what lies beyond the text is cut to its end before it is multiplied or made an int
    at = F.least(F.least(F.greatest("doc_id", F.lit(-1)), size) * 100, size).cast("int")
    with_nul = F.concat(F.substring(raw, F.lit(1), at), F.unhex(F.lit("00")), F.substring(raw, at + 1, size))
    content = F.when(at < size, with_nul).otherwise(raw)
    return documents.select("doc_id", F.when(F.col("doc_id").isNotNull(), changes.is_binary(content)).alias("is_binary"))


def line_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions and deletions between every document and the next."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    after = documents.select((F.col("doc_id") - 1).alias("doc_id"), F.col("content").alias("after_content"))
    pairs = documents.withColumnRenamed("content", "before_content").join(after, "doc_id")
    return changes.with_line_counts(pairs, 1 << 20).select("doc_id", "additions", "deletions", "skipped")


# ---- enrichment


def assay_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = plugins.assay_metrics(F.col("additions"), F.col("deletions"))
    return _held_changes(spark, sf_dir).select("oid", "path", m["delta"].alias("delta"), m["churn"].alias("churn"), m["net-change"].alias("net_change"))


def file_type_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = table(spark, sf_dir, "file_change_facts").select(F.col("file.path").alias("path")).distinct()
    kind = file_types.classify(F.col("path"), USER_RULES)
    return paths.select("path", kind["name"].alias("name"), kind["source"].alias("source"), kind["matched"].alias("matched"))


PROFILES = [
    (0, "ilka.dorvenar@tarnhub.example", None, "Ilka Dorvenar", "ilka@tarnhub.example", "core"),
    (1, "ilka.dorvenar@tarnhub.example", None, "Somebody Else", "else@tarnhub.example", "none"),
    (2, None, "Merge Train", "Merge Train Bot", "bots@tarnhub.example", "automation"),
    (3, "merge-train@bots.tarnhub.example", "", "Merge Train", "bots@tarnhub.example", None),
    (4, None, "svn import", "Import", "import@tarnhub.example", ""),
]


def identity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = spark.createDataFrame(PROFILES, "position int, match_email string, match_name string, name string, email string, team string")
    return plugins.identity_profiles(table(spark, sf_dir, "identities"), profiles).select("identity_id", "profile_name", "profile_email", "matched_by", "team")


def custom_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = plugins.custom_field({"team": "platform", "tier": 2, "ratio": 0.5, "active": True})
    rows = held_commits(spark, sf_dir).select("oid", field.alias("f"))
    return rows.select("oid", *[F.col(f"f.{c}").alias(c) for c in ("team", "tier", "ratio", "active")])


def conventional_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = plugins.conventional_header(F.col("message"))
    return held_commits(spark, sf_dir).select("oid", *[header[c].alias(c) for c in ("type", "scope", "subject")])


def conventional_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return held_commits(spark, sf_dir).select("oid", plugins.conventional_commit(F.col("message")).alias("c")).select("oid", "c.*")


def enriched_file_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records with two built-in extensions, as JSON Lines."""
    records = project.file_records(held_commits(spark, sf_dir), _held_changes(spark, sf_dir))
    extensions = [
        plugins.Extension("assay", plugins.assay_metrics(F.col("file.additions"), F.col("file.deletions"))),
        plugins.Extension("file-type", F.struct(file_types.classify(F.col("file.path"))["name"].alias("name"))),
    ]
    return project.json_lines(plugins.enrich(records, extensions))


# ---- sinks and summaries


def rotation_by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = held_commits(spark, sf_dir).select("oid")
    return sink.rotate_by_lines(lines, ["oid"], 250).groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.min("oid").alias("first_oid"))


def rotation_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = project.json_lines(project.commit_records(held_commits(spark, sf_dir))).withColumn("oid", F.get_json_object("value", "$.oid"))
    files = sink.rotate_by_bytes(lines.select("oid", sink.line_bytes().alias("n_bytes")), ["oid"], 1 << 16)
    return files.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n_bytes").alias("n_bytes"))


def span_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as spans: type is the name, value the duration, the user a counter."""
    events = table(spark, sf_dir, "events")
    spans = events.select(
        F.col("event_type").alias("name"), F.unix_micros(F.col("ts").cast("timestamp")).alias("started"), F.col("value").alias("duration_ms"),
        (F.col("user_id") % 10).cast("string").alias("attribute"), F.create_map(F.lit("users"), F.col("user_id")).alias("counters"), (F.col("value") > 100).alias("failed"),
    )
    done = summary.span_summary(spans)
    return done.select(
        "name", "first_started", "n_spans", F.round("total_ms", 2).alias("total_ms"), "max_ms", "n_errors", F.array_join("attributes", ",").alias("attributes"),
        F.col("counters")["users"].alias("users"),
    )


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, commits and skipped diffs of a per-file run."""
    rows = _held_changes(spark, sf_dir)
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("oid").alias("commits"), F.count_if(F.col("additions").isNull()).alias("skipped_diffs"))


# ---- analytics downstream of the extraction


def commit_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of each repository by UTC day of the author."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("author.timestamp") / 86_400).cast("int"))
    return held_commits(spark, sf_dir).groupBy(F.col("repository.name").alias("repository_name"), day.cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n_commits"))


def contributor_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails that first appear in each repository by 30-day period, and how many there are by then."""
    commits = held_commits(spark, sf_dir).select(F.col("repository.name").alias("repository_name"), clean_email(F.col("author.email")).alias("email"), F.col("committer.timestamp").alias("ts"))
    first = commits.filter("email IS NOT NULL").groupBy("repository_name", "email").agg(F.floor(F.min("ts") / 2_592_000).alias("period"))
    new = first.groupBy("repository_name", "period").agg(F.count(F.lit(1)).alias("n_new"))
    so_far = Window.partitionBy("repository_name").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)  # one row a period
    return new.withColumn("n_total", F.sum("n_new").over(so_far))


def commit_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, active days and span in seconds of each repository."""
    ts = F.col("committer.timestamp")
    return held_commits(spark, sf_dir).groupBy(F.col("repository.name").alias("repository_name")).agg(
        F.count(F.lit(1)).alias("n_commits"), F.count_distinct(F.floor(ts / 86_400)).alias("active_days"), (F.max(ts) - F.min(ts)).alias("span_s"),
        F.count_if(F.size("parents") > 1).alias("n_merges"),
    )


def churn_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines by repository and top folder."""
    rows = _held_changes(spark, sf_dir).join(held_commits(spark, sf_dir).select("oid", F.col("repository.name").alias("repository_name")), "oid")
    area = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise(F.lit("."))
    return rows.groupBy("repository_name", area.alias("area")).agg(
        F.count(F.lit(1)).alias("n_changes"), F.coalesce(F.sum("additions"), F.lit(0)).alias("additions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions")
    )


QUERIES = {
    f.__name__: f
    for f in (
        reachable_commits, reachable_difference, missing_boundary_fallback, multi_ref_dedupe, since_date_filter, since_date_boundary, merge_base, ref_classification,
        plan_exclude_selection, incremental_new_branch, missing_refs, checkpoint_lookup, commit_projection, iso_timestamp_offsets, file_change_projection, fact_ids,
        repository_names, session_stamps, message_line_counts, oid_guards, blob_size_labels, tree_diff_status, root_commit_added, first_parent_merge_diff, diff_guards,
        binary_documents, line_diff_counts, assay_metrics, file_type_classification, identity_profile, custom_field, conventional_headers, conventional_commits,
        enriched_file_records, rotation_by_lines, rotation_by_bytes, span_summary, run_counters, commit_frequency, contributor_growth, commit_cadence, churn_by_area,
    )
}

# ---- the same in SQL

_HELD = """held AS (SELECT oid, h.message AS message, h.author AS author, h.committer AS committer, h.parents AS parents, h.repository AS repository FROM (
  SELECT oid, arg_max(struct_pack(message := message, author := author, committer := committer, parents := parents, repository := repository), extracted_at) AS h
  FROM commit_facts WHERE oid IS NOT NULL GROUP BY oid))"""
_TIPS = _HELD + """,
c AS (SELECT repository.name AS repository_name, committer."timestamp" AS ts, oid FROM held),
ends AS (SELECT repository_name, arg_max(oid, (ts, oid)) AS head, max(oid) AS other, (min(ts) + max(ts)) // 2 AS middle FROM c GROUP BY 1),
priors AS (SELECT c.repository_name, arg_max(c.oid, (c.ts, c.oid)) AS prior FROM c JOIN ends USING (repository_name) WHERE c.ts <= ends.middle GROUP BY 1),
tips AS (SELECT repository_name, CAST(row_number() OVER (ORDER BY repository_name) - 1 AS INTEGER) AS ref_index, head, prior, other FROM ends JOIN priors USING (repository_name)),
edges AS (SELECT oid AS child, unnest(parents) AS parent FROM held)"""


def _walk(starts: str) -> str:
    return f"""starts AS ({starts}),
walk AS (SELECT w, oid FROM starts WHERE oid IN (SELECT oid FROM held) UNION SELECT walk.w, edges.parent FROM walk JOIN edges ON edges.child = walk.oid JOIN held ON held.oid = edges.parent)"""


def _difference_sql(exclude: str) -> str:
    starts = f"SELECT 'h' || ref_index AS w, head AS oid FROM tips UNION ALL SELECT 'x' || ref_index, {exclude} FROM tips"
    return f"""WITH RECURSIVE {_TIPS}, {_walk(starts)}
SELECT CAST(substr(w, 2) AS INTEGER) AS ref_index, oid FROM walk a WHERE w LIKE 'h%' AND NOT EXISTS (SELECT 1 FROM walk b WHERE b.w = 'x' || substr(a.w, 2) AND b.oid = a.oid)"""


def _iso_sql(ts: str, offset: str) -> str:
    zone = f"abs({offset})"
    return (
        f"strftime(make_timestamp(CAST(({ts} + {offset} * 60) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || CASE WHEN {offset} < 0 THEN '-' ELSE '+' END || "
        f"lpad(CAST({zone} // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({zone} % 60 AS VARCHAR), 2, '0')"
    )


_REQUESTED = _TIPS + """,
spelled AS (SELECT CAST(ref_index * 5 + pos AS INTEGER) AS ref_index, name, kind, repository_name, head, prior FROM (
  SELECT ref_index, 0 AS pos, 'refs/heads/' || repository_name AS name, 'b' AS kind, repository_name, head, prior FROM tips
  UNION ALL SELECT ref_index, 1, repository_name, 'b', repository_name, head, prior FROM tips
  UNION ALL SELECT ref_index, 2, 'refs/tags/v-' || repository_name, 't', repository_name, head, prior FROM tips
  UNION ALL SELECT ref_index, 3, head, 'o', repository_name, head, prior FROM tips
  UNION ALL SELECT ref_index, 4, 'gone-' || repository_name, 'g', repository_name, head, prior FROM tips)),
resolved AS (SELECT ref_index, name, CASE kind WHEN 'b' THEN 'branch' WHEN 't' THEN CASE WHEN length(repository_name) % 2 = 0 THEN 'tag-annotated' ELSE 'tag-lightweight' END ELSE 'commit-oid' END AS ref_type,
  CASE kind WHEN 't' THEN prior WHEN 'g' THEN NULL ELSE head END AS head FROM spelled),
checkpoints AS (SELECT 'refs/heads/' || repository_name AS ref, 'branch' AS ref_type, prior AS tip_oid FROM tips WHERE ref_index % 2 = 0)"""

_CHANGES = """changes AS (SELECT commit_oid AS oid, file.path AS path, arg_max(file, extracted_at) AS f FROM file_change_facts GROUP BY 1, 2)"""

_TREES = """n AS (SELECT o_orderkey AS k FROM orders), js AS (SELECT unnest(range(0, 8)) AS j),
trees AS MATERIALIZED (SELECT k, 'src/p' || j || CASE j % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.d.ts' WHEN 2 THEN '.PY' ELSE '.unmapped' END AS path, j || ':' || ((k + j) // (j + 2)) AS blob,
  CASE WHEN (k + j) % 13 = 0 THEN '160000' WHEN (k * j) % 11 = 0 AND j > 0 THEN '100755' ELSE '100644' END AS mode FROM n, js WHERE (k + j) % 6 <> 0),
blobs AS MATERIALIZED (SELECT * FROM trees WHERE mode <> '160000')"""


def _tree_sql(where: str) -> str:
    return f"""WITH {_TREES}, wanted AS (SELECT k FROM n WHERE {where}),
cur AS (SELECT b.* FROM blobs b JOIN wanted USING (k)), prev AS (SELECT w.k, b.path, b.blob, b.mode FROM wanted w JOIN blobs b ON b.k = w.k // 2 WHERE w.k > 0),
diff AS (SELECT CAST(coalesce(c.k, p.k) AS VARCHAR) AS oid, coalesce(c.path, p.path) AS path, CASE WHEN p.mode IS NULL THEN 'added' WHEN c.mode IS NULL THEN 'deleted' ELSE 'modified' END AS status
  FROM cur c FULL OUTER JOIN prev p ON c.k = p.k AND c.path = p.path WHERE c.blob IS DISTINCT FROM p.blob OR c.mode IS DISTINCT FROM p.mode)"""


def _file_type_sql(user: list[tuple[str, str]] = USER_RULES) -> str:
    """The rules as a table: the user's before the common, base names before suffixes, longer suffixes before shorter ones."""
    rows = []
    for rank, (source, rules) in enumerate((("user", user), ("common", file_types.parse_rules(file_types.COMMON)))):
        bases, suffixes = file_types.check_rules(rules)
        rows += [f"({2 * rank}, '{k}', '{v}', '{source}')" for k, v in bases.items()] + [f"({2 * rank + 1}, '{k}', '{v}', '{source}')" for k, v in suffixes.items()]
    return f"""WITH rules(rank, key, name, source) AS (VALUES {', '.join(rows)}),
paths AS (SELECT DISTINCT file.path AS path FROM file_change_facts),
hits AS (SELECT p.path, r.*, row_number() OVER (PARTITION BY p.path ORDER BY r.rank, length(r.key) DESC) AS place FROM paths p JOIN rules r
  ON (r.rank % 2 = 0 AND regexp_extract(p.path, '[^/]*$') = r.key) OR (r.rank % 2 = 1 AND suffix(lower(p.path), r.key)))
SELECT p.path, coalesce(h.name, CASE WHEN p.path IS NOT NULL THEN 'Unknown' END) AS name, h.source, CASE WHEN h.rank % 2 = 0 THEN h.key ELSE '*' || h.key END AS matched
FROM paths p LEFT JOIN hits h ON h.path = p.path AND h.place = 1"""


def _person_sql(side: str) -> str:
    when = _iso_sql(f'{side}."timestamp"', f"{side}.timezone_offset")
    return f"{side} := struct_pack(name := {side}.name, email := {side}.email, \"timestamp\" := {when})"


_RECORD = f"oid := oid, message := message, {_person_sql('author')}, {_person_sql('committer')}, parents := parents, repository := struct_pack(name := repository.name, url := repository.url)"

_HEADER = plugins.HEADER


def _header_part(i: int) -> str:
    return f"CASE WHEN fits THEN nullif(regexp_extract(header, '{_HEADER}', {i}), '') END"


ORACLE = {
    "reachable_commits": f"WITH RECURSIVE {_TIPS}, {_walk('SELECT repository_name AS w, head AS oid FROM tips')} SELECT w AS repository_name, oid FROM walk",
    "reachable_difference": _difference_sql("prior"),
    "missing_boundary_fallback": _difference_sql("CASE WHEN ref_index % 2 = 0 THEN repeat('0', 40) ELSE prior END"),
    "multi_ref_dedupe": f"""WITH RECURSIVE {_TIPS}, {_walk('SELECT ref_index * 2 AS w, prior AS oid FROM tips UNION ALL SELECT ref_index * 2 + 1, head FROM tips')}
SELECT oid, CAST(min(w) AS INTEGER) AS ref_index FROM walk GROUP BY oid""",
    "since_date_filter": f"""WITH RECURSIVE {_TIPS}, {_walk('SELECT repository_name AS w, head AS oid FROM tips')}
SELECT oid, committer."timestamp" AS committer_ts FROM held WHERE oid IN (SELECT oid FROM walk) AND committer."timestamp" > {SINCE_SECONDS}""",
    "since_date_boundary": f"""WITH {_TIPS} SELECT c.repository_name, c.oid FROM c JOIN tips USING (repository_name) JOIN held h ON h.oid = tips.prior WHERE c.ts > h.committer."timestamp" """,
    "merge_base": f"""WITH RECURSIVE {_TIPS}, {_walk("SELECT DISTINCT repository_name || ' ' || t AS w, t AS oid FROM (SELECT repository_name, head AS t FROM tips UNION SELECT repository_name, other FROM tips)")},
wanted AS (SELECT repository_name, CASE WHEN head = other THEN 1 ELSE 2 END AS n FROM tips),
common AS (SELECT w.repository_name, walk.oid FROM walk JOIN wanted w ON walk.w LIKE w.repository_name || ' %' GROUP BY 1, 2, w.n HAVING count(*) = w.n),
best AS (SELECT a.repository_name, min(a.oid) AS base FROM common a WHERE NOT EXISTS (SELECT 1 FROM common b JOIN edges e ON e.child = b.oid WHERE e.parent = a.oid AND b.repository_name = a.repository_name) GROUP BY 1)
SELECT repository_name, base FROM tips LEFT JOIN best USING (repository_name)""",
    "ref_classification": f"WITH {_REQUESTED} SELECT * FROM resolved",
    "plan_exclude_selection": f"""WITH {_REQUESTED} SELECT r.ref_index, r.name, r.ref_type, r.head, coalesce(k.tip_oid, CASE WHEN r.ref_type = 'branch' THEN repeat('f', 40) END) AS exclude
FROM resolved r LEFT JOIN checkpoints k ON k.ref = r.name AND k.ref_type = r.ref_type WHERE r.head IS NOT NULL""",
    "incremental_new_branch": f"WITH {_REQUESTED} SELECT ref_index, name FROM resolved r WHERE ref_type = 'branch' AND head IS NOT NULL AND NOT EXISTS (SELECT 1 FROM checkpoints k WHERE k.ref = r.name)",
    "missing_refs": f"WITH {_REQUESTED} SELECT ref_index, name FROM resolved WHERE head IS NULL",
    "checkpoint_lookup": f"WITH {_REQUESTED} SELECT * FROM checkpoints",
    "commit_projection": f"""WITH {_HELD} SELECT oid, message, author.name AS author_name, author.email AS author_email, {_iso_sql('author."timestamp"', 'author.timezone_offset')} AS author_timestamp,
committer.name AS committer_name, committer.email AS committer_email, {_iso_sql('committer."timestamp"', 'committer.timezone_offset')} AS committer_timestamp,
coalesce(array_to_string(parents, ' '), '') AS parents, repository.name AS repository_name, repository.url AS repository_url FROM held""",
    "iso_timestamp_offsets": f"""SELECT o_orderkey AS k, {_iso_sql('(CAST(epoch(o_orderdate) AS BIGINT) - o_orderkey % 3 * 3600)', '((o_orderkey % 5 - 2) * 330)')} AS rendered FROM orders""",
    "file_change_projection": f"""WITH {_HELD}, {_CHANGES} SELECT h.oid, {_iso_sql('h.author."timestamp"', 'h.author.timezone_offset')} AS author_timestamp, path, f.status AS status, f.additions AS additions, f.deletions AS deletions
FROM held h JOIN changes USING (oid)""",
    "fact_ids": f"WITH {_CHANGES} SELECT oid || '/' || path AS fact_id FROM changes",
    "repository_names": r"""SELECT repository_name, coalesce(nullif(regexp_replace(regexp_extract(url, '[^/]*$'), '\.git$', ''), ''), repository_name) AS derived, coalesce(lower(trim(object_format)), 'sha1') AS object_format FROM repositories""",
    "session_stamps": "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events",
    "message_line_counts": f"WITH {_HELD} SELECT oid, CASE WHEN message IS NULL THEN -1 ELSE length(message) - length(replace(message, chr(10), '')) + 1 END AS n_lines FROM held",
    "oid_guards": """SELECT count(*) AS n_rows, count(*) FILTER (WHERE regexp_full_match(oid, '[0-9a-f]{40}')) AS good_oids, count(*) FILTER (WHERE regexp_full_match(parents[1], '[0-9a-f]{40}')) AS good_parents FROM commit_facts""",
    "blob_size_labels": """SELECT repository_name, path, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || 'KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0) || 'MB' WHEN n IS NOT NULL THEN printf('%.1f', n / 1073741824.0) || 'GB' END AS size
FROM (SELECT repository_name, path, octet_length(content) AS n FROM file_blobs)""",
    "tree_diff_status": _tree_sql("true") + " SELECT * FROM diff",
    "root_commit_added": _tree_sql("k = 0") + " SELECT * FROM diff",
    "first_parent_merge_diff": _tree_sql("k % 5 = 0 AND k >= 10") + " SELECT oid, status, count(*) AS n_changes FROM diff GROUP BY 1, 2",
    "diff_guards": f"""SELECT repository_name, path, CASE WHEN octet_length(content) > {MOST_DIFF_BYTES} THEN 'size' WHEN regexp_matches(hex(content), '^(..)*00') THEN 'binary' END AS skipped FROM file_blobs""",
    "binary_documents": "SELECT doc_id, doc_id * 100 < 8000 AND doc_id * 100 < strlen(text) AS is_binary FROM documents WHERE text IS NOT NULL",
    "assay_metrics": f"WITH {_CHANGES} SELECT oid, path, f.additions - f.deletions AS delta, f.additions + f.deletions AS churn, CASE WHEN f.additions IS NOT NULL AND f.deletions IS NOT NULL THEN greatest(f.additions, f.deletions) END AS net_change FROM changes",
    "file_type_classification": _file_type_sql(),
    "identity_profile": """SELECT identity_id, CASE WHEN email = 'ilka.dorvenar@tarnhub.example' THEN 'Ilka Dorvenar' WHEN email = 'merge-train@bots.tarnhub.example' THEN 'Merge Train' WHEN name = 'Merge Train' THEN 'Merge Train Bot' WHEN name = 'svn import' THEN 'Import' ELSE name END AS profile_name,
CASE WHEN email = 'ilka.dorvenar@tarnhub.example' THEN 'ilka@tarnhub.example' WHEN email = 'merge-train@bots.tarnhub.example' OR name = 'Merge Train' THEN 'bots@tarnhub.example' WHEN name = 'svn import' THEN 'import@tarnhub.example' ELSE email END AS profile_email,
CASE WHEN email IN ('ilka.dorvenar@tarnhub.example', 'merge-train@bots.tarnhub.example') THEN 'email' WHEN name IN ('Merge Train', 'svn import') THEN 'name' END AS matched_by,
CASE WHEN email = 'ilka.dorvenar@tarnhub.example' THEN 'core' WHEN email = 'merge-train@bots.tarnhub.example' THEN NULL WHEN name = 'Merge Train' THEN 'automation' WHEN name = 'svn import' THEN '' END AS team FROM identities""",
    "custom_field": f"WITH {_HELD} SELECT oid, 'platform' AS team, 2 AS tier, CAST(0.5 AS DOUBLE) AS ratio, true AS active FROM held",
    "conventional_headers": f"""WITH {_HELD}, h AS (SELECT oid, replace(split_part(message, chr(10), 1), chr(13), '') AS header FROM held), f AS (SELECT oid, header, regexp_matches(header, '{_HEADER}') AS fits FROM h)
SELECT oid, {_header_part(1)} AS type, {_header_part(2)} AS scope, {_header_part(3)} AS subject FROM f""",
    "rotation_by_lines": f"WITH {_HELD}, r AS (SELECT oid, (row_number() OVER (ORDER BY oid) - 1) // 250 + 1 AS file FROM held) SELECT file, count(*) AS n_lines, min(oid) AS first_oid FROM r GROUP BY 1",
    "rotation_by_bytes": f"""WITH RECURSIVE {_HELD}, l AS MATERIALIZED (SELECT row_number() OVER (ORDER BY oid) AS i, strlen(CAST(to_json(struct_pack({_RECORD})) AS VARCHAR)) + 1 AS n FROM held),
r AS (SELECT CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS file, CAST(n AS BIGINT) AS b, CAST(n AS BIGINT) AS n FROM l WHERE i = 1
      UNION ALL SELECT l.i, CASE WHEN r.b >= 65536 THEN r.file + 1 ELSE r.file END, CASE WHEN r.b >= 65536 THEN l.n ELSE r.b + l.n END, l.n FROM r JOIN l ON l.i = r.i + 1)
SELECT file, count(*) AS n_lines, CAST(sum(n) AS BIGINT) AS n_bytes FROM r GROUP BY file""",
    "enriched_file_records": f"""WITH {_HELD}, {_CHANGES}, types AS ({_file_type_sql([])}), found AS (SELECT h.*, c.path AS path, c.f AS f, t.name AS type FROM held h JOIN changes c USING (oid) JOIN types t ON t.path IS NOT DISTINCT FROM c.path)
SELECT CAST(to_json(struct_pack({_RECORD}, file := struct_pack(path := path, status := f.status, additions := f.additions, deletions := f.deletions),
  extensions := struct_pack(assay := struct_pack(delta := f.additions - f.deletions, churn := f.additions + f.deletions, "net-change" := CASE WHEN f.additions IS NOT NULL AND f.deletions IS NOT NULL THEN greatest(f.additions, f.deletions) END),
    "file-type" := struct_pack(name := type)))) AS VARCHAR) AS value FROM found""",
    "span_summary": """SELECT event_type AS name, CAST(epoch_us(min(ts)) AS BIGINT) AS first_started, count(*) AS n_spans, round(sum(value), 2) AS total_ms, max(value) AS max_ms, CAST(count(*) FILTER (WHERE value > 100) AS BIGINT) AS n_errors,
array_to_string(list_sort(list(DISTINCT CAST(user_id % 10 AS VARCHAR))), ',') AS attributes, CAST(sum(user_id) AS BIGINT) AS users FROM events GROUP BY 1""",
    "run_counters": f"WITH {_CHANGES} SELECT count(*) AS records, count(DISTINCT oid) AS commits, count(*) FILTER (WHERE f.additions IS NULL) AS skipped_diffs FROM changes",
    "commit_frequency": f"""WITH {_HELD} SELECT repository.name AS repository_name, strftime(make_timestamp(CAST(author."timestamp" * 1000000 AS BIGINT)), '%Y-%m-%d') AS day, count(*) AS n_commits FROM held GROUP BY 1, 2""",
    "contributor_growth": f"""WITH {_HELD}, firsts AS (SELECT repository.name AS repository_name, nullif(lower(trim(author.email)), '') AS email, min(committer."timestamp") // 2592000 AS period FROM held GROUP BY 1, 2),
new AS (SELECT repository_name, period, count(*) AS n_new FROM firsts WHERE email IS NOT NULL GROUP BY 1, 2) SELECT *, CAST(sum(n_new) OVER (PARTITION BY repository_name ORDER BY period) AS BIGINT) AS n_total FROM new""",
    "commit_cadence": f"""WITH {_HELD} SELECT repository.name AS repository_name, count(*) AS n_commits, count(DISTINCT committer."timestamp" // 86400) AS active_days, max(committer."timestamp") - min(committer."timestamp") AS span_s,
count(*) FILTER (WHERE len(parents) > 1) AS n_merges FROM held GROUP BY 1""",
    "churn_by_area": f"""WITH {_HELD}, {_CHANGES} SELECT h.repository.name AS repository_name, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS area, count(*) AS n_changes,
CAST(coalesce(sum(f.additions), 0) AS BIGINT) AS additions, CAST(coalesce(sum(f.deletions), 0) AS BIGINT) AS deletions FROM changes JOIN held h USING (oid) GROUP BY 1, 2""",
}
