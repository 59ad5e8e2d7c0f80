"""The built-in extensions as a configuration names them: ``chronoweave:NAME`` with NAME from ``BUILTIN``.

A factory takes the extension's configuration, refuses a wrong one with ValueError, and gives a function from the columns
of the records to the extension's column. Extensions of file changes are null on commit records.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.enrich import file_types, plugins

ColumnFactory = Callable[[list[str]], Column]


def _only(config: Any, *allowed: str) -> Mapping[str, Any]:
    config = {} if config is None else config
    if not isinstance(config, Mapping):
        raise ValueError("the configuration must be an object")
    if unknown := set(config) - set(allowed):
        raise ValueError(f"unknown keys {sorted(unknown)}")
    return config


def _flag(config: Mapping[str, Any], key: str) -> bool:
    if not isinstance(config.get(key, False), bool):
        raise ValueError(f"{key} must be a boolean")
    return config.get(key, False)


def assay_metrics(config: Any = None) -> ColumnFactory:
    return lambda columns: plugins.assay_metrics(F.col("file.additions"), F.col("file.deletions")) if "file" in columns else F.lit(None).cast("string")


def custom_field(config: Any) -> ColumnFactory:
    column = plugins.custom_field(config["value"] if isinstance(config, Mapping) and set(config) == {"value"} else config)
    return lambda columns: column


def conventional_commits(config: Any = None) -> ColumnFactory:
    return lambda columns: plugins.conventional_commit(F.col("message"))


def file_type(config: Any = None) -> ColumnFactory:
    """``mappings`` {signature: type}, ``ruleSets`` (at most "common", the default), ``unknownPolicy`` emit or skip, ``debug``."""
    config = _only(config, "debug", "ruleSets", "mappings", "unknownPolicy")
    debug, sets, mappings, policy = _flag(config, "debug"), config.get("ruleSets", ["common"]), config.get("mappings", {}), config.get("unknownPolicy", "emit")
    if not isinstance(sets, list) or any(s != "common" for s in sets) or len(sets) > 1:
        raise ValueError("ruleSets must be a list of different rule sets, of which there is common")
    if not isinstance(mappings, Mapping) or not all(isinstance(v, str) and v for v in mappings.values()):
        raise ValueError("mappings must be an object of non-empty strings")
    if policy not in ("emit", "skip"):
        raise ValueError("unknownPolicy must be emit or skip")
    rules = list(mappings.items())
    file_types.check_rules(rules)

    def column(columns: list[str]) -> Column:
        if "file" not in columns:
            return F.lit(None).cast("string")
        found = file_types.classify(F.col("file.path"), rules, bool(sets), policy == "emit")
        more = [F.struct(F.coalesce(found["source"], F.lit("unknown")).alias("source"), found["matched"].alias("matched")).alias("_debug")] if debug else []
        return F.when(found.isNotNull(), F.struct(found["name"].alias("name"), *more))

    return column


def identity_profile(config: Any) -> ColumnFactory:
    """``profileMappings`` [{matchEmail, matchName, name, email, …}], ``attributeFields`` [name], ``debug``.

    The first row that has a person's e-mail exactly decides, else the first that has the name exactly; rows are literal
    maps in the plan, so no join is needed. A person whom no row knows passes through.
    """
    config = _only(config, "debug", "attributeFields", "profileMappings")
    debug, fields, given = _flag(config, "debug"), config.get("attributeFields", []), config.get("profileMappings")
    if not isinstance(fields, list) or not all(isinstance(f, str) for f in fields):
        raise ValueError("attributeFields must be a list of strings")
    if not isinstance(given, list) or not all(isinstance(r, Mapping) for r in given):
        raise ValueError("profileMappings must be a list of objects")
    renamed = [{{"matchEmail": "match_email", "matchName": "match_name"}.get(k, k): v for k, v in row.items()} for row in given]
    for warning in plugins.check_profiles(renamed, fields):
        plugins.log.warning(warning)
    tables: dict[str, dict[str, str]] = {"match_email": {}, "match_name": {}}
    for row in renamed:
        attributes = {f: row[f] for f in dict.fromkeys(fields) if f in row}
        for kind, by in (("match_email", "email"), ("match_name", "name")):
            if row.get(kind):
                output = {"name": row["name"], "email": row["email"]} | ({"attributes": attributes} if attributes else {}) | ({"_debug": {"source": "master", "matchedBy": by}} if debug else {})
                tables[kind].setdefault(row[kind], json.dumps(output))

    def person(column: str) -> Column:
        hit = lambda kind, key: F.try_element_at(file_types._literal_map(tables[kind]), F.coalesce(F.col(key), F.lit("")))
        own = [F.col(f"{column}.{n}").alias(n) for n in ("name", "email")] + ([F.struct(F.lit("input").alias("source")).alias("_debug")] if debug else [])
        return F.parse_json(F.coalesce(hit("match_email", f"{column}.email"), hit("match_name", f"{column}.name"), F.to_json(F.struct(*own), {"ignoreNullFields": "false"})))

    return lambda columns: F.struct(person("author").alias("author"), person("committer").alias("committer"))


BUILTIN: dict[str, Callable[[Any], ColumnFactory]] = {
    "assay-metrics": assay_metrics, "conventional-commits": conventional_commits, "custom-field": custom_field, "file-type": file_type, "identity-profile": identity_profile,
}
