"""Enrichment of records: built-in columns, and a runner for plugins of the user."""

from __future__ import annotations

import importlib
import importlib.util
import json
import logging
import math
import re
import sys
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)
NAMESPACE = re.compile(r"[a-z0-9-]+\Z")
FIELD_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*\Z")


def assay_metrics(additions: Column, deletions: Column) -> Column:
    """struct<delta, churn, net-change>, each null if either count is."""
    both = additions.isNotNull() & deletions.isNotNull()
    return F.struct((additions - deletions).alias("delta"), (additions + deletions).alias("churn"), F.when(both, F.greatest(additions, deletions)).alias("net-change"))


def custom_field(value: Any) -> Column:
    """A constant: a scalar, or a flat object of scalars and nulls. Raises ValueError for anything else."""
    if isinstance(value, Mapping):
        if not value:
            raise ValueError("a field needs at least one entry")
        for name, entry in value.items():
            if not FIELD_NAME.match(name):
                raise ValueError(f"invalid field name {name!r}")
            if entry is not None:
                _check_scalar(entry)
        return F.struct(*[F.lit(entry).alias(name) for name, entry in value.items()])
    _check_scalar(value)
    return F.lit(value)


def _check_scalar(value: Any) -> None:
    if not isinstance(value, (str, bool, int, float)) or isinstance(value, float) and not math.isfinite(value):
        raise ValueError(f"not a scalar: {value!r}")


# Fields of a profile that attributes can't have.
RESERVED_ATTRIBUTES = frozenset({"name", "email", "attributes", "_debug"})


def check_profiles(rows: list[dict[str, Any]], attribute_fields: list[str]) -> list[str]:
    """Validates identity rows and returns warnings: rows whose matcher an earlier row already has, and ignored fields."""
    if not rows:
        raise ValueError("at least one identity row is needed")
    if reserved := RESERVED_ATTRIBUTES & set(attribute_fields):
        raise ValueError(f"reserved attribute names: {sorted(reserved)}")
    warnings, seen = [], set()
    for i, row in enumerate(rows):
        if not row.get("match_email") and not row.get("match_name"):
            raise ValueError(f"row {i} matches nothing")
        if not row.get("name") or not row.get("email"):
            raise ValueError(f"row {i} needs a name and an email")
        for kind in ("match_email", "match_name"):
            if value := row.get(kind):
                if (kind, value) in seen:
                    warnings.append(f"row {i}: {kind} {value!r} is already taken by an earlier row")
                seen.add((kind, value))
        if extra := set(row) - {"match_email", "match_name", "name", "email"} - set(attribute_fields):
            warnings.append(f"row {i}: ignored fields {sorted(extra)}")
        for name in attribute_fields:
            if row.get(name) is not None:
                _check_scalar(row[name])
    return warnings


def identity_profiles(people: DataFrame, profiles: DataFrame, name: str = "name", email: str = "email") -> DataFrame:
    """Adds profile_name, profile_email, matched_by and the profile's attributes to rows with a name and an email.

    ``profiles`` has position, match_email, match_name, name, email and attribute columns. The first row that has exactly
    the email decides, else the first that has exactly the name, else the input passes through. Rules are deduplicated
    before they are joined, so rows never multiply.
    """
    attributes = [c for c in profiles.columns if c not in ("position", "match_email", "match_name", "name", "email")]
    payload = F.struct(F.col("name").alias("name"), F.col("email").alias("email"), *attributes)

    def table(kind: str) -> DataFrame:
        given = profiles.filter(F.col(kind).isNotNull() & (F.col(kind) != ""))
        return given.groupBy(F.col(kind).alias(f"_{kind}")).agg(F.min_by(payload, "position").alias(f"_hit_{kind}"))

    joined = people.join(table("match_email"), F.col(email) == F.col("_match_email"), "left").join(table("match_name"), F.col(name) == F.col("_match_name"), "left")
    hit = F.coalesce("_hit_match_email", "_hit_match_name")
    by = F.when(F.col("_hit_match_email").isNotNull(), "email").when(F.col("_hit_match_name").isNotNull(), "name")
    return joined.select(
        *people.columns, F.coalesce(hit["name"], F.col(name)).alias("profile_name"), F.coalesce(hit["email"], F.col(email)).alias("profile_email"),
        by.alias("matched_by"), *[hit[a].alias(a) for a in attributes],
    )


# Fixed value: the form of a conventional header.
HEADER = r"^(\w*)(?:\(([\w$.\-*/ ]*)\))?!?: (.*)$"


def conventional_header(message: Column) -> Column:
    """struct<header, type, scope, subject> of a message's first line; the parts are null if it is of another form."""
    header = F.element_at(F.split(F.regexp_replace(message, r"^\s*\n", ""), r"\r?\n"), 1)
    fits = header.rlike(HEADER)
    part = lambda i: F.when(fits, F.nullif(F.regexp_extract(header, HEADER, i), F.lit("")))
    return F.struct(header.alias("header"), part(1).alias("type"), part(2).alias("scope"), part(3).alias("subject"))


REFERENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("raw", "action", "owner", "repository", "prefix", "issue")])
NOTE = T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])
CONVENTIONAL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("merge", "revert_header", "revert_hash", "header", "body", "footer")]
    + [T.StructField("notes", T.ArrayType(NOTE)), T.StructField("mentions", T.ArrayType(T.StringType())), T.StructField("references", T.ArrayType(REFERENCE))]
    + [T.StructField(n, T.StringType()) for n in ("type", "scope", "subject")]
)
# Words that close an issue.
ACTIONS = ("close", "closes", "closed", "fix", "fixes", "fixed", "resolve", "resolves", "resolved")
ISSUE = re.compile(r"(?:([\w.-]+)/)?([\w.-]+)?(#)([\w-]*\d+)")
NOTES = re.compile(r"(BREAKING[ -]CHANGE)[:\s]+(.*)", re.I)


def parse_conventional(message: str | None) -> dict[str, Any] | None:
    """A commit message by the conventional grammar; null for an empty message.

    Lines after the header are body until a note, or a line that refers to an issue, begins the footer. Comment-like and
    blank lines around the parts are trimmed.
    """
    if message is None or not message.strip():
        return None
    lines = message.strip("\r\n").replace("\r\n", "\n").split("\n")
    header, rest = lines[0], lines[1:]
    out: dict[str, Any] = dict.fromkeys(f.name for f in CONVENTIONAL.fields)
    out |= {"header": header, "notes": [], "references": [], "mentions": re.findall(r"@([\w-]+)", message)}
    if m := re.match(HEADER, header):
        out["type"], out["scope"], out["subject"] = (g or None for g in m.groups())
    body: list[str] = []
    footer: list[str] = []
    note: dict[str, str] | None = None
    for line in rest:
        references = _references(line)
        if m := NOTES.match(line):
            note = {"title": m.group(1), "text": m.group(2)}
            out["notes"].append(note)
            footer.append(line)
        elif references:
            out["references"] += references
            footer.append(line)
            note = None
        elif footer:
            footer.append(line)
            if note is not None:
                note["text"] += "\n" + line
        else:
            body.append(line)
    out["references"] = _references(header) + out["references"]
    for n in out["notes"]:
        n["text"] = n["text"].strip()
    out["body"], out["footer"] = "\n".join(body).strip() or None, "\n".join(footer).strip() or None
    if m := re.match(r'^Revert\s"([\s\S]*)"\s*This reverts commit (\w*)\.?', message):
        out["revert_header"], out["revert_hash"] = m.groups()
    return out


def _references(line: str) -> list[dict[str, str | None]]:
    found = []
    action = re.match(rf"\s*({'|'.join(ACTIONS)})\b[:\s]", line, re.I)
    start = 0
    for m in ISSUE.finditer(line):
        found.append({"raw": line[start : m.end()], "action": action.group(1) if action else None, "owner": m.group(1), "repository": m.group(2), "prefix": m.group(3), "issue": m.group(4)})
        start = m.end()
    return found


@F.pandas_udf(CONVENTIONAL)
def conventional_commit(message: pd.Series) -> pd.DataFrame:
    """The full structure of a conventional commit message; all null for an empty one."""
    names = [f.name for f in CONVENTIONAL.fields]
    return pd.DataFrame([parse_conventional(m) or dict.fromkeys(names) for m in message], columns=names)


@dataclass(frozen=True)
class Outcome:
    """What a plugin says about one fact: ``success`` with a value, ``skip``, or ``fatal``."""

    status: str
    value: Any = None


class Plugin(Protocol):
    """A row-level plugin. ``init`` may raise to refuse its configuration."""

    def init(self, runtime: Mapping[str, Callable[[str], None]]) -> None: ...

    def project(self, fact: dict[str, Any]) -> Outcome: ...


@dataclass
class Extension:
    """A plugin under its namespace.

    ``plugin`` is a Catalyst expression, a function from the records' columns to one, or a plugin that runs row by row in
    Arrow batches.
    """

    namespace: str
    plugin: Plugin | Column | Callable[[list[str]], Column]
    failure_policy: str = "skip-fact"
    config: Any = field(default=None)

    @property
    def by_row(self) -> bool:
        return not isinstance(self.plugin, Column) and hasattr(self.plugin, "project")

    def __post_init__(self) -> None:
        if not NAMESPACE.match(self.namespace):
            raise ValueError(f"invalid namespace {self.namespace!r}")
        if self.failure_policy not in ("skip-fact", "fatal"):
            raise ValueError(f"invalid failure policy {self.failure_policy!r}")


#: Major version of the interface that plugins are written for.
PLUGIN_API = 1


def load_plugin(specifier: str, config: Any) -> Plugin | Callable[[list[str]], Column]:
    """Calls a factory with the configuration: ``chronoweave:NAME``, ``module:function``, or ``/a/file.py:function``.

    Without a function it is ``create_plugin``. A module that says in ``PLUGIN_API`` that it was written for another version
    is used with a warning.
    """
    module_name, _, name = specifier.partition(":")
    if module_name == "chronoweave":
        from chronoweave.enrich.builtin import BUILTIN

        if name not in BUILTIN:
            raise ValueError(f"no built-in extension {name!r}: there are {', '.join(BUILTIN)}")
        return BUILTIN[name](config)
    if module_name.endswith(".py"):
        found = importlib.util.spec_from_file_location(re.sub(r"\W", "_", module_name), module_name)
        module = importlib.util.module_from_spec(found)
        found.loader.exec_module(module)
        from pyspark import cloudpickle  # the file is not on the workers' paths, so its code travels with the plugin

        sys.modules[module.__name__] = module
        cloudpickle.register_pickle_by_value(module)
    else:
        module = importlib.import_module(module_name)
    if getattr(module, "PLUGIN_API", PLUGIN_API) != PLUGIN_API:
        log.warning("%s was written for version %s of the plugin interface, this is %s", specifier, module.PLUGIN_API, PLUGIN_API)
    made = getattr(module, name or "create_plugin")(config)
    if not callable(getattr(made, "project", None)):
        raise TypeError(f"{specifier} makes no plugin")
    return made


def init_all(extensions: list[Extension]) -> None:
    """Initialises all plugins and reports every failure before giving up."""
    failures = []
    for extension in extensions:
        if extension.by_row:
            try:
                extension.plugin.init({"warn": log.warning, "error": log.error})
            except Exception as error:  # noqa: BLE001
                failures.append(f"{extension.namespace}: {error}")
    if failures:
        raise RuntimeError("; ".join(failures))


def run_plugin(extension: Extension, fact: Column) -> Column:
    """JSON of the plugin's value for a fact struct; null where it skips.

    A plugin that raises counts as fatal. Under the policy ``fatal`` that ends the job; else the fact's value is null, and
    the worker's log has a warning.
    """
    plugin, fatal = extension.plugin, extension.failure_policy == "fatal"

    @F.pandas_udf("string")
    def run(facts: pd.Series) -> pd.Series:
        out = []
        for row in facts:
            try:
                outcome = plugin.project(json.loads(row))
            except Exception as error:  # noqa: BLE001
                outcome = Outcome("fatal", str(error))
            if outcome.status == "fatal" and fatal:
                raise RuntimeError(f"{extension.namespace} failed: {outcome.value}")
            if outcome.status == "fatal":
                logging.getLogger("chronoweave").warning("%s failed and is left out of a fact: %s", extension.namespace, outcome.value)
            out.append(json.dumps(outcome.value) if outcome.status == "success" else None)
        return pd.Series(out, dtype=object)

    return run(F.to_json(fact, {"ignoreNullFields": "false"}))


def enrich(records: DataFrame, extensions: list[Extension]) -> DataFrame:
    """Appends ``extensions`` with one field for each plugin in declaration order; without plugins there is no such column."""
    if not extensions:
        return records
    fact = F.struct(*records.columns)
    made = lambda e: F.parse_json(run_plugin(e, fact)) if e.by_row else e.plugin if isinstance(e.plugin, Column) else e.plugin(records.columns)
    fields = [made(e).alias(e.namespace) for e in extensions]
    return records.withColumn("extensions", F.struct(*fields))
