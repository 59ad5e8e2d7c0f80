"""Project configuration, version 1: strict JSON, checked before anything runs."""

from __future__ import annotations

import json
import os
import re
from datetime import datetime
from typing import Any

from chronoweave.functions.values import ROTATE_SIZE, parse_byte_size

NAMESPACE = re.compile(r"[a-z0-9-]+\Z")


class ConfigError(ValueError):
    """All problems of a configuration, one a line."""


def _text(value: Any) -> str | None:
    return None if isinstance(value, str) and value else "must be a non-empty string"


def _texts(value: Any) -> str | None:
    return None if isinstance(value, list) and value and all(isinstance(v, str) and v for v in value) else "must be a non-empty list of non-empty strings"


def _flag(value: Any) -> str | None:
    return None if isinstance(value, bool) else "must be a boolean"


def _lines(value: Any) -> str | None:
    return None if isinstance(value, int) and not isinstance(value, bool) and value >= 1 else "must be an integer of at least 1"


def _size(value: Any) -> str | None:
    try:
        parse_byte_size(value, *ROTATE_SIZE)
    except (TypeError, ValueError) as error:
        return str(error)
    return None


def _moment(value: Any) -> str | None:
    try:
        at = datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return "must be an ISO 8601 time"
    return None if at.tzinfo else "must have an offset"


def _one_of(*allowed: str):
    return lambda value: None if value in allowed else f"must be one of {', '.join(allowed)}"


#: The sections: a dict is an object without other keys, a function names what is wrong with a value.
SHAPE: dict[str, Any] = {
    "version": lambda v: None if v == 1 and not isinstance(v, bool) else "must be 1",
    "extraction": {"refs": _texts, "range": {"sinceRef": _text, "sinceDate": _moment}},
    "output": {"directory": _text, "prefix": _text, "rotation": {"lines": _lines, "size": _size}},
    "repository": {"name": _text, "url": _text},
    "runtime": {"profile": _flag, "gitAdapter": _one_of("isomorphic-git", "git-cli")},
    "extensions": lambda v: None if isinstance(v, dict) else "must be an object",
}
EXTENSION = {"entrypoint": _text, "config": lambda v: None, "failurePolicy": _one_of("skip-fact", "fatal")}


def json_schema() -> dict[str, Any]:
    """The form of a configuration as JSON Schema, for editors; what it can't say, ``check_config`` still refuses."""
    text = {"type": "string", "minLength": 1}
    special: dict[str, dict[str, Any]] = {"version": {"const": 1}, "gitAdapter": {"enum": ["isomorphic-git", "git-cli"]}}
    size = {"type": "string", "pattern": "^[0-9]+[KMGkmg]?$"}
    leaves: dict[Any, dict[str, Any]] = {_text: text, _texts: {"type": "array", "items": text, "minItems": 1}, _flag: {"type": "boolean"}, _lines: {"type": "integer", "minimum": 1}, _size: size, _moment: {"type": "string", "format": "date-time"}}

    def of(shape: Any, at: str) -> dict[str, Any]:
        if isinstance(shape, dict):
            return {"type": "object", "additionalProperties": False, "properties": {key: of(entry, key) for key, entry in shape.items()}}
        return special[at] if at in special else leaves[shape]

    extension = {"type": "object", "additionalProperties": False, "required": ["entrypoint"], "properties": {"entrypoint": text, "config": {}, "failurePolicy": {"enum": ["skip-fact", "fatal"]}}}
    special |= {"extensions": {"type": "object", "propertyNames": {"pattern": "^[a-z0-9-]+$"}, "additionalProperties": extension}}
    schema = of(SHAPE, "")
    schema["properties"]["extraction"]["properties"]["range"] |= {"minProperties": 1, "maxProperties": 1}
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "required": ["version"], **schema}


def _check(value: Any, shape: Any, path: str, problems: list[str]) -> None:
    if callable(shape):
        if said := shape(value):
            problems.append(f"{path}: {said}")
    elif not isinstance(value, dict):
        problems.append(f"{path or 'config'}: must be an object")
    else:
        for key, entry in value.items():
            at = f"{path}.{key}".lstrip(".")
            if key not in shape:
                problems.append(f"{at}: unknown key")
            else:
                _check(entry, shape[key], at, problems)


def check_config(config: Any) -> dict[str, Any]:
    """Returns the configuration with defaults filled in; raises ConfigError with all problems."""
    problems: list[str] = []
    _check(config, SHAPE, "", problems)
    if isinstance(config, dict):
        if "version" not in config:
            problems.append("version: is missing")
        extraction = config.get("extraction")
        limits = extraction.get("range") if isinstance(extraction, dict) else None
        if isinstance(limits, dict) and len(limits) != 1:
            problems.append("extraction.range: takes either sinceRef or sinceDate")
        for namespace, entry in (config["extensions"].items() if isinstance(config.get("extensions"), dict) else ()):
            if not NAMESPACE.match(namespace):
                problems.append(f"extensions.{namespace}: must match [a-z0-9-]+")
            _check(entry, EXTENSION, f"extensions.{namespace}", problems)
            if isinstance(entry, dict) and "entrypoint" not in entry:
                problems.append(f"extensions.{namespace}.entrypoint: is missing")
    if problems:
        raise ConfigError("\n".join(problems))
    runtime = {"gitAdapter": "isomorphic-git"} | config.get("runtime", {})
    extensions = {k: {"failurePolicy": "skip-fact"} | v for k, v in config.get("extensions", {}).items()}
    return config | {"runtime": runtime, "extensions": extensions}


def load_config(path: str) -> dict[str, Any]:
    """Reads a configuration; relative paths in it are relative to its folder, those of plugins with or without a function."""
    try:
        with open(path, encoding="utf-8") as file:
            config = check_config(json.load(file))
    except FileNotFoundError:
        raise ConfigError(f"no configuration at {path}") from None
    except json.JSONDecodeError as error:
        raise ConfigError(f"not JSON: {error}") from None
    folder = os.path.dirname(os.path.abspath(path))
    if directory := config.get("output", {}).get("directory"):
        config = config | {"output": config["output"] | {"directory": os.path.normpath(os.path.join(folder, directory))}}
    rebase = lambda e: os.path.normpath(os.path.join(folder, e)) if e.startswith((".", "/")) else e
    return config | {"extensions": {k: v | {"entrypoint": rebase(v["entrypoint"])} for k, v in config["extensions"].items()}}
