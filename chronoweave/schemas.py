"""Schemas of the entities an extraction works on."""

from __future__ import annotations

PERSON = "struct<name:string,email:string,timestamp:bigint,timezone_offset:int>"
REPOSITORY = "struct<name:string,url:string>"
COMMIT = f"oid string, message string, author {PERSON}, committer {PERSON}, parents array<string>, repository {REPOSITORY}"
FILE_CHANGE = "path string, status string, additions bigint, deletions bigint"
BLOB = "path string, oid string, mode string, content binary"
REF = "name string, ref_type string, oid string, peeled_oid string"
CHECKPOINT = "ref string, ref_type string, tip_oid string, updated_at string"
PLAN = "ref_index int, name string, ref_type string, head string, exclude string"

#: Modes of file blobs; others are trees and gitlinks.
BLOB_MODES = ("100644", "100755", "120000")
REF_TYPES = ("branch", "tag-lightweight", "tag-annotated", "commit-oid")
OID_PATTERNS = {"sha1": "^[0-9a-f]{40}$", "sha256": "^[0-9a-f]{64}$"}
STATE_VERSION = 2
