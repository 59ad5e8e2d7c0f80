"""From requested refs and prior state to traversal plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def classify_ref(name: Column, is_tag_object: Column, resolved: Column, pattern: str = "^[0-9a-f]{40}$") -> Column:
    """Type of a requested ref, by full name first, then as an oid, then as any other name that resolves."""
    return (
        F.when(name.startswith("refs/heads/"), "branch").when(name.startswith("refs/tags/") & F.coalesce(is_tag_object, F.lit(False)), "tag-annotated")
        .when(name.startswith("refs/tags/"), "tag-lightweight").when(name.rlike(pattern), "commit-oid").when(resolved.isNotNull(), "branch").otherwise("commit-oid")
    )


def resolve_refs(requested: DataFrame, refs: DataFrame, commits: DataFrame) -> DataFrame:
    """(ref_index, name, ref_type, head) of requested (ref_index, name); head is null where nothing resolves.

    ``refs`` has (full_name, peeled_oid, is_tag_object); short names are tried as branch, then as tag, then as oid of a
    known commit (oid).
    """
    heads = refs.select(F.col("full_name").alias("_f0"), F.col("peeled_oid").alias("_o0"), F.col("is_tag_object").alias("_t0"))
    branch = refs.select(F.col("full_name").alias("_f1"), F.col("peeled_oid").alias("_o1"))
    tag = refs.select(F.col("full_name").alias("_f2"), F.col("peeled_oid").alias("_o2"), F.col("is_tag_object").alias("_t2"))
    known = commits.select(F.col("oid").alias("_o3"))
    joined = (
        requested.join(heads, F.col("name") == F.col("_f0"), "left").join(branch, F.concat(F.lit("refs/heads/"), "name") == F.col("_f1"), "left")
        .join(tag, F.concat(F.lit("refs/tags/"), "name") == F.col("_f2"), "left").join(known, F.col("name") == F.col("_o3"), "left")
    )
    head = F.coalesce("_o0", "_o1", "_o2", "_o3")
    full = F.coalesce("_f0", "_f1", "_f2", "name")
    tag_object = F.coalesce("_t0", F.when(F.col("_f1").isNull(), F.col("_t2")))
    return joined.select("ref_index", "name", classify_ref(full, tag_object, head).alias("ref_type"), head.alias("head"))


def last_checkpoints(prior: DataFrame) -> DataFrame:
    """(ref, ref_type, tip_oid) with one row for each key: the last in the order of the document (``position``)."""
    return prior.groupBy("ref", "ref_type").agg(F.max_by("tip_oid", "position").alias("tip_oid"))


def make_plans(resolved: DataFrame, prior: DataFrame, merge_base: str | None = None, since: str | None = None, since_date: bool = False) -> DataFrame:
    """(ref_index, name, ref_type, head, exclude) in declaration order; refs that resolve to nothing are left out.

    Without a range the exclude is the checkpoint's tip, or for a branch without one the merge base of the prior branches;
    with a ``since`` commit it is that commit; with a date there is none, as dates are a filter behind the walk.
    """
    last = last_checkpoints(prior).select(F.col("ref").alias("name"), "ref_type", "tip_oid")
    joined = resolved.filter(F.col("head").isNotNull()).join(last, ["name", "ref_type"], "left")
    if since_date:
        exclude = F.lit(None).cast("string")
    elif since is not None:
        exclude = F.lit(since)
    else:
        exclude = F.coalesce("tip_oid", F.when(F.col("ref_type") == "branch", F.lit(merge_base).cast("string")))
    return joined.select("ref_index", "name", "ref_type", "head", exclude.alias("exclude"))


def missing_refs(resolved: DataFrame) -> DataFrame:
    """Requested refs to warn about."""
    return resolved.filter(F.col("head").isNull()).select("ref_index", "name")


def new_branches(resolved: DataFrame, prior: DataFrame) -> DataFrame:
    """Requested branches that the prior state does not know."""
    known = prior.select(F.col("ref").alias("name"), "ref_type").distinct()
    return resolved.filter(F.col("head").isNotNull() & (F.col("ref_type") == "branch")).join(known, ["name", "ref_type"], "left_anti")


def drop_unknown_excludes(plans: DataFrame, commits: DataFrame) -> DataFrame:
    """Plans whose exclude is no known commit walk everything; ``fell_back`` says so."""
    known = commits.select(F.col("oid").alias("_known"))
    joined = plans.join(known, F.col("exclude") == F.col("_known"), "left")
    return joined.select("ref_index", "name", "ref_type", "head", F.col("_known").alias("exclude"), (F.col("exclude").isNotNull() & F.col("_known").isNull()).alias("fell_back"))


def after_date(commits: DataFrame, since_ms: int, seconds: str = "committer.timestamp") -> DataFrame:
    """Commits strictly later than a moment; to be applied behind the walk, never inside it."""
    return commits.filter(F.col(seconds) * 1000 > F.lit(since_ms))
