"""python -m chronoweave.cli REPOSITORY -r REF… -o DIRECTORY: extracts a history to rotated JSON Lines.

Exit codes: 0 done, 1 the user's mistake, 2 a failure of the run.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave import config as configuration
from chronoweave.enrich import plugins
from chronoweave.functions.values import ROTATE_SIZE, format_count, format_elapsed, format_size, parse_byte_size, parse_positive
from chronoweave.operators import graph, planning, project, sink, state, summary
from chronoweave.sources import git
from chronoweave.storage import materialize


class UserError(ValueError):
    """A mistake in the options or the surroundings."""


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UserError(message)


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="chronoweave", description="Extract a commit history to JSON Lines")
    p.add_argument("repository")
    p.add_argument("-r", "--ref", action="append", default=[])
    p.add_argument("--since-ref")
    p.add_argument("--since-date")
    p.add_argument("--incremental", action="store_true")
    p.add_argument("-s", "--state")
    p.add_argument("--missing-state", choices=("error", "snapshot"))
    p.add_argument("-o", "--output-dir")
    p.add_argument("--output-prefix")
    p.add_argument("--per-file", action="store_true")
    p.add_argument("--max-diff-size", type=lambda v: parse_byte_size(v, 1))
    p.add_argument("--repo-name")
    p.add_argument("--repo-url")
    p.add_argument("--rotate-lines", type=parse_positive)
    p.add_argument("--rotate-size", type=lambda v: parse_byte_size(v, *ROTATE_SIZE))
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--profile", action="store_true")
    p.add_argument("-c", "--config")
    return p


def options(argv: list[str]) -> argparse.Namespace:
    """Options from the command line and the configuration; the command line wins, a range as a whole."""
    o = parser().parse_args(argv)
    if o.since_ref and o.since_date:
        raise UserError("--since-ref and --since-date exclude each other")
    if o.incremental and (o.since_ref or o.since_date):
        raise UserError("--incremental takes no range")
    if o.incremental and not o.state:
        raise UserError("--incremental needs --state")
    if o.missing_state and not o.incremental:
        raise UserError("--missing-state needs --incremental")
    if o.max_diff_size and not o.per_file:
        raise UserError("--max-diff-size needs --per-file")
    loaded = configuration.load_config(o.config) if o.config else {"runtime": {}, "extensions": {}}
    extraction, output, repository = (loaded.get(k, {}) for k in ("extraction", "output", "repository"))
    limits = extraction.get("range", {})
    if o.incremental and limits:
        raise UserError("--incremental takes no range, but the configuration has one")
    o.ref = o.ref or extraction.get("refs", [])
    if not o.since_ref and not o.since_date:
        o.since_ref, o.since_date = limits.get("sinceRef"), limits.get("sinceDate")
    o.output_dir, o.output_prefix = o.output_dir or output.get("directory"), o.output_prefix or output.get("prefix")
    rotation = output.get("rotation", {})
    o.rotate_lines = o.rotate_lines or rotation.get("lines")
    o.rotate_size = o.rotate_size or (parse_byte_size(rotation["size"], *ROTATE_SIZE) if "size" in rotation else None)
    o.repo_name, o.repo_url = o.repo_name or repository.get("name"), o.repo_url or repository.get("url")
    o.profile = o.profile or loaded["runtime"].get("profile", False)
    o.extensions = loaded["extensions"]
    if not o.ref:
        raise UserError("at least one --ref is needed")
    if not o.output_dir:
        raise UserError("--output-dir is needed")
    if not os.path.isdir(o.repository):
        raise UserError(f"no folder {o.repository}")
    if not os.path.isdir(o.output_dir):
        raise UserError(f"no folder {o.output_dir}")
    if not os.path.exists(os.path.join(o.repository, ".git")) and not os.path.isdir(os.path.join(o.repository, "objects")):
        raise UserError(f"{o.repository} is no repository")
    if o.state and not os.path.isdir(os.path.dirname(os.path.abspath(o.state))):
        raise UserError(f"no folder for {o.state}")
    if o.since_date:
        try:
            at = datetime.fromisoformat(o.since_date)
        except ValueError:
            raise UserError(f"not a time: {o.since_date}") from None
        o.since_ms = int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * 1000)
    return o


def _name(o: argparse.Namespace, url: str | None) -> str:
    segment = (url or "").rsplit("/", 1)[-1].removesuffix(".git")
    return segment or os.path.basename(os.path.abspath(o.repository))


def _source(spark: SparkSession, path: str, table: str, **extra: str) -> DataFrame:
    return spark.read.format("git").options(path=path, table=table, **extra).load()


class Spans:
    """Stages of a run with their times and counters, for the profile."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    @contextmanager
    def stage(self, name: str, **counters: int) -> Iterator[dict[str, int]]:
        began, failed = time.time(), True
        try:
            yield counters
            failed = False
        finally:
            self.rows.append((name, int(began * 1e6), round((time.time() - began) * 1000, 3), None, dict(counters), failed))

    def report(self, spark: SparkSession) -> list[str]:
        """A line a stage in order of start: time, share, counters."""
        spans = spark.createDataFrame(self.rows, "name string, started bigint, duration_ms double, attribute string, counters map<string,bigint>, failed boolean")
        rows = summary.span_summary(spans).collect()
        total = sum(r["total_ms"] for r in rows) or 1.0
        said = lambda r: "".join(f" {k}={format_count(v)}" for k, v in sorted((r["counters"] or {}).items()))
        return [f"{r['name']:<12} {format_elapsed(r['total_ms']):>10} {100 * r['total_ms'] / total:5.1f} %{said(r)}" for r in rows]


def extract(spark: SparkSession, o: argparse.Namespace, now: datetime) -> dict[str, Any]:
    """One run: plan, walk, project, enrich, write, and only then move the checkpoint."""
    spark.dataSource.register(git.GitDataSource)
    url = o.repo_url or git.remote_url(o.repository)
    if (form := git.object_format(o.repository)) != "sha1":
        raise UserError(f"object format {form} is not supported")
    path, stamp = os.path.abspath(o.repository), now.strftime("%Y-%m-%dT%H:%M:%S.000Z")
    extensions = []
    for n, e in o.extensions.items():
        try:
            extensions.append(plugins.Extension(n, plugins.load_plugin(e["entrypoint"], e.get("config")), e["failurePolicy"]))
        except (ValueError, TypeError, ImportError, AttributeError, FileNotFoundError) as error:
            raise UserError(f"extension {n}: {error}") from error
    prior, fell_back = state.empty_state(path, stamp), False
    if o.incremental:
        prior, fell_back = state.load_state(o.state, path, o.missing_state or "error", stamp)
    warnings = ["no state: everything is extracted"] if fell_back else []
    spans = Spans()
    wanted = git.resolve_names(path, [*o.ref, *(r["tipOid"] for r in prior["refs"]), *([o.since_ref] if o.since_ref else [])])
    with spans.stage("commits") as counters:
        # only what the heads and boundaries reach is read; the object database isn't looked through
        heads = " ".join(sorted(set(wanted.values())))
        commits = materialize(_source(spark, path, "commits", head=heads) if heads else _source(spark, path, "commits").limit(0), "commits")
        counters["commits"] = commits.count()
    requested = spark.createDataFrame(list(enumerate(o.ref)), "ref_index int, name string")
    listed = [(name, peeled, tag) for name, _, _, peeled, tag in git.list_refs(path)]  # two git processes, a row a ref
    known = {name for name, *_ in listed}
    # other names that git resolves: HEAD, remote branches, short oids
    others = [(n, wanted[n], False) for n in dict.fromkeys(o.ref) if n in wanted and not {n, f"refs/heads/{n}", f"refs/tags/{n}"} & known and n != wanted[n]]
    refs = spark.createDataFrame(listed + others, "full_name string, peeled_oid string, is_tag_object boolean")
    resolved = materialize(planning.resolve_refs(requested, refs, commits), "resolved")
    warnings += [f"ref {r['name']} was not found and is skipped" for r in planning.missing_refs(resolved).collect()]
    checkpoints = state.checkpoints(spark, prior)
    nodes = commits.select(F.col("oid").alias("node"), "parents", F.col("committer.timestamp").alias("place"))
    base, since = None, None
    if o.since_ref:
        if (since := wanted.get(o.since_ref)) is None:
            raise git.GitError("REF_NOT_FOUND", f"--since-ref {o.since_ref} was not found")
    elif prior["refs"] and not planning.new_branches(resolved, checkpoints).isEmpty():
        tips = checkpoints.filter("ref_type = 'branch'").select(F.lit("prior").alias("group"), F.col("tip_oid").alias("node"))
        found = graph.merge_bases(nodes, tips).collect()
        base = found[0]["base"] if found else None
    plans = planning.make_plans(resolved, checkpoints, base, since, bool(o.since_date))
    plans = materialize(planning.drop_unknown_excludes(plans, commits), "plans")
    rows = plans.orderBy("ref_index").collect()
    warnings += [f"the boundary of {r['name']} is gone: it is walked whole" for r in rows if r["fell_back"]]
    warnings += [f"{r['name']} is no branch and will not move" for r in rows if r["ref_type"] != "branch"]
    with spans.stage("reachability") as counters:
        reached = graph.first_reaching_ref(graph.reachable_difference(nodes, plans)).withColumnRenamed("node", "oid")
        chosen = commits.join(reached, "oid")
        if o.since_date:
            chosen = planning.after_date(chosen, o.since_ms)
        chosen = materialize(chosen, "chosen")
        counters["commits"] = n_commits = chosen.count()
    chosen = chosen.withColumn("repository", F.struct(F.lit(o.repo_name or _name(o, url)).alias("name"), F.lit(url).cast("string").alias("url")))
    keys = ["ref_index", "oid"]
    skipped = 0
    if o.per_file:
        with spans.stage("changes") as counters:
            limits = {"most_bytes": str(o.max_diff_size)} if o.max_diff_size else {}
            limits |= {"since": str(o.since_ms // 1000)} if o.since_date else {}
            heads = " ".join(sorted({r["head"] for r in rows}))
            excludes = {r["exclude"] for r in rows}
            limits |= {"exclude": excludes.pop()} if len(excludes) == 1 and None not in excludes else {}  # the one all share
            found = _source(spark, path, "line_changes", head=heads, **limits) if heads else _source(spark, path, "line_changes").limit(0)
            files = materialize(found.join(chosen.select("oid"), "oid", "left_semi"), "files")
            skipped = files.filter("skipped IS NOT NULL").count()
            counters |= {"skipped": skipped}
        records = project.file_records(chosen, files)
        keys.append("path")
    else:
        records = project.commit_records(chosen)
    plugins.init_all(extensions)
    records = plugins.enrich(records, extensions).join(reached, "oid")
    columns = [c for c in records.columns if c != "ref_index"]
    lines = records.select("ref_index", "oid", *([F.col("file.path").alias("path")] if o.per_file else []), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
    with spans.stage("records"):
        lines = materialize(lines, "lines")
    if o.rotate_size or o.rotate_lines:
        sized = lines.withColumn("n_bytes", sink.line_bytes())
        numbered = sink.rotate_by_bytes(sized, keys, o.rotate_size or 1 << 62, o.rotate_lines).drop("n_bytes")
        lines = lines.join(numbered, keys)
    else:
        lines = lines.withColumn("file", F.lit(1).cast("long"))
    prefix = o.output_prefix or _name(o, url)
    with spans.stage("output") as counters:
        written = sink.write_json_lines(lines, os.path.abspath(o.output_dir), prefix, now.strftime("%Y%m%dT%H%M%SZ"))
        counters |= {"records": written["records"], "bytes": written["bytes"]}
    if o.state:
        state.write_state(o.state, state.next_state([r.asDict() for r in rows], path, stamp))
    return written | {"commits": n_commits, "skipped": skipped, "warnings": warnings, "profile": spans.report(spark) if o.profile else []}


def main(argv: list[str] | None = None) -> int:
    try:
        o = options(sys.argv[1:] if argv is None else argv)
        began = datetime.now(timezone.utc)
        done = extract(SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate(), o, began)
    except (UserError, configuration.ConfigError, state.StateError, git.GitError) as error:
        print(error, file=sys.stderr)
        return 1
    except Exception as error:  # noqa: BLE001
        print(f"failed: {error}", file=sys.stderr)
        return 2
    if not o.quiet:
        for warning in done["warnings"]:
            print(f"warning: {warning}", file=sys.stderr)
        elapsed = (datetime.now(timezone.utc) - began).total_seconds() * 1000
        for line in done["profile"]:
            print(line, file=sys.stderr)
        print(f"{format_count(done['records'])} records of {format_count(done['commits'])} commits in {done['files']} files, {format_size(done['bytes'])}, {format_count(done['skipped'])} diffs skipped, {format_elapsed(elapsed)}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
