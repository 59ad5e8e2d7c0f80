"""Checkpoints of incremental runs."""

from __future__ import annotations

import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from chronoweave.schemas import CHECKPOINT, OID_PATTERNS, REF_TYPES, STATE_VERSION


class StateError(ValueError):
    """A checkpoint that must not be used."""


def empty_state(repository_path: str, at: str) -> dict[str, Any]:
    return {"version": STATE_VERSION, "generatedAt": at, "repositoryPath": repository_path, "refs": []}


def check_state(state: dict[str, Any], repository_path: str, object_format: str = "sha1") -> None:
    """Raises StateError for another version or repository, an unknown ref type, or a malformed oid."""
    if state.get("version") != STATE_VERSION:
        raise StateError(f"version {state.get('version')!r} is not {STATE_VERSION}")
    if state.get("repositoryPath") != repository_path:
        raise StateError("the state is of another repository")
    for entry in state.get("refs") or []:
        if entry.get("refType") not in REF_TYPES:
            raise StateError(f"unknown ref type {entry.get('refType')!r}")
        if not re.match(OID_PATTERNS[object_format], str(entry.get("tipOid"))):
            raise StateError(f"malformed oid {entry.get('tipOid')!r}")


def read_state(path: str) -> dict[str, Any] | None:
    try:
        with open(path, encoding="utf-8") as file:
            return json.load(file)
    except FileNotFoundError:
        return None


def load_state(path: str, repository_path: str, missing: str = "error", at: str = "", object_format: str = "sha1") -> tuple[dict[str, Any], bool]:
    """(state, whether it was missing); a missing file is an error, or an empty state under ``missing="snapshot"``."""
    state = read_state(path)
    if state is None:
        if missing != "snapshot":
            raise StateError(f"no state at {path}")
        return empty_state(repository_path, at), True
    check_state(state, repository_path, object_format)
    return state, False


def next_state(plans: list[dict[str, Any]], repository_path: str, at: str) -> dict[str, Any]:
    """The state after a run: only the refs that this run planned, in their order, repeats included."""
    refs = [{"ref": p["name"], "refType": p["ref_type"], "tipOid": p["head"], "updatedAt": at} for p in plans]
    return empty_state(repository_path, at) | {"refs": refs}


def write_state(path: str, state: dict[str, Any]) -> bool:
    """Writes a state with refs by one rename; to be called after all output is in place. Without refs nothing is written."""
    if not state["refs"]:
        return False
    with open(path + ".tmp", "w", encoding="utf-8") as file:
        json.dump(state, file, indent=2, ensure_ascii=False)
        file.write("\n")
    os.replace(path + ".tmp", path)
    return True


def checkpoints(spark: SparkSession, state: dict[str, Any]) -> DataFrame:
    """(ref, ref_type, tip_oid, updated_at, position) of a state's refs."""
    rows = [(e["ref"], e["refType"], e["tipOid"], e.get("updatedAt"), i) for i, e in enumerate(state["refs"])]
    return spark.createDataFrame(rows, CHECKPOINT + ", position int")
