"""Git repositories as Spark data sources.

``spark.dataSource.register(GitDataSource)`` and ``spark.read.format("git").option("path", …).option("table", "commits")``.
Tables: ``commits`` (optional ``head`` and ``exclude``, pushed down to git), ``refs``, ``trees`` (entries of each commit),
``changes`` (against the first parent), ``line_changes`` (these with line counts, optional ``most_bytes``), ``blobs``
(contents, optional ``oids``). A partition runs a fixed number of git processes and streams their output; nothing starts a
process for each commit. ``line_changes`` asks for the sizes of a pair first and reads contents only of those that pass, in
the task that counts them, so no content is read twice or shuffled. ``readStream`` delivers the commits that are new since
the last offset, which is the map of branch tips, in partitions.
"""

from __future__ import annotations

import json
import re
import subprocess
from collections import OrderedDict
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from chronoweave.operators.changes import BINARY_PREFIX, changed_lines
from chronoweave.schemas import BLOB_MODES

PERSON_LINE = re.compile(r"(.*) <([^<>]*)> (\d+) ([+-]\d{4})\Z", re.DOTALL)
PERSON = "struct<name:string,email:string,timestamp:bigint,timezone_offset:int>"
SCHEMAS = {
    "commits": f"oid string, message string, author {PERSON}, committer {PERSON}, parents array<string>",
    "refs": "full_name string, ref_type string, oid string, peeled_oid string, is_tag_object boolean",
    "trees": "oid string, path string, blob_oid string, mode string",
    "changes": "oid string, path string, status string, before_oid string, after_oid string, before_mode string, after_mode string",
    "line_changes": "oid string, path string, status string, additions bigint, deletions bigint, skipped string",
    "blobs": "blob_oid string, content binary",
    "repositories": "repository_name string, url string, object_format string",
}


#: Trees and bytes of blobs that a task remembers.
KEPT_TREES, KEPT_BYTES = 2_000, 64 << 20


class GitError(RuntimeError):
    """A failure of git, with a code: NOT_A_REPOSITORY, REF_NOT_FOUND, COMMIT_NOT_FOUND or UNKNOWN."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def git(path: str, *args: str, ok: tuple[int, ...] = (0,)) -> bytes:
    done = subprocess.run(["git", "-C", path, *args], capture_output=True)
    if done.returncode not in ok:
        said = done.stderr.decode("utf-8", "replace").strip()
        code = "NOT_A_REPOSITORY" if "not a git repository" in said.lower() else "COMMIT_NOT_FOUND" if "bad object" in said or "bad revision" in said else "UNKNOWN"
        raise GitError(code, said)
    return done.stdout


def parse_offset(text: str) -> int:
    """±HHMM in minutes, east positive."""
    minutes = int(text[1:3]) * 60 + int(text[3:5])
    return -minutes if text[0] == "-" else minutes


def parse_person(line: str) -> tuple[str, str, int, int]:
    if not (m := PERSON_LINE.match(line)):
        raise GitError("UNKNOWN", f"malformed person: {line!r}")
    return m.group(1), m.group(2), int(m.group(3)), parse_offset(m.group(4))


def parse_commit(oid: str, raw: bytes) -> tuple:
    """A raw commit object as a row of ``commits``; the message is what follows the first blank line, unchanged."""
    head, _, message = raw.partition(b"\n\n")
    people: dict[str, tuple] = {}
    parents = []
    for line in head.decode("utf-8", "replace").split("\n"):
        key, _, value = line.partition(" ")
        if key == "parent":
            parents.append(value)
        elif key in ("author", "committer") and key not in people:
            people[key] = parse_person(value)
    if len(people) < 2:
        raise GitError("UNKNOWN", f"commit {oid} lacks a person")
    return oid, message.decode("utf-8", "replace"), people["author"], people["committer"], parents


def batch_objects(stream: BinaryIO) -> Iterator[tuple[str, str, bytes]]:
    """(oid, type, content) of the output of ``cat-file --batch``; checks the framing."""
    while line := stream.readline():
        parts = line.decode().split()
        if len(parts) == 2 and parts[1] == "missing":
            raise GitError("COMMIT_NOT_FOUND", parts[0])
        if len(parts) != 3:
            raise GitError("UNKNOWN", f"unexpected header {line!r}")
        content = stream.read(int(parts[2]))
        if len(content) != int(parts[2]) or stream.read(1) != b"\n":
            raise GitError("UNKNOWN", f"truncated object {parts[0]}")
        yield parts[0], parts[1], content


def parse_tree(raw: bytes) -> Iterator[tuple[str, str, str]]:
    """(name, mode, oid) of a raw tree object."""
    at = 0
    while at < len(raw):
        nul = raw.index(b"\0", at)
        mode, _, name = raw[at:nul].partition(b" ")
        yield name.decode("utf-8", "replace"), mode.decode().zfill(6), raw[nul + 1 : nul + 21].hex()
        at = nul + 21


def parse_raw_diff(raw: bytes) -> Iterator[tuple[str, str | None, str | None, str | None, str | None, str]]:
    """(path, before_oid, after_oid, before_mode, after_mode, status) of NUL-framed raw differences, file blobs only."""
    fields = raw.split(b"\0")
    for head, path in zip(fields[0::2], fields[1::2], strict=False):
        if not head.startswith(b":"):
            raise GitError("UNKNOWN", f"unexpected entry {head!r}")
        before_mode, after_mode, before, after, letter = head[1:].decode().split(" ")
        if letter[0] not in "AMDT":
            raise GitError("UNKNOWN", f"unexpected status {letter}")
        was, now = before_mode in BLOB_MODES, after_mode in BLOB_MODES
        if was or now:
            status = "modified" if was and now else "added" if now else "deleted"
            yield path.decode("utf-8", "replace"), before if was else None, after if now else None, before_mode if was else None, after_mode if now else None, status


class Objects:
    """One ``cat-file`` process that answers requests one at a time, so neither side can fill a pipe."""

    def __init__(self, path: str, check: bool = False):
        self.run = subprocess.Popen(["git", "-C", path, "cat-file", "--batch-check" if check else "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def __enter__(self) -> Objects:
        return self

    def __exit__(self, *_) -> None:
        self.run.stdin.close()
        self.run.wait()

    def _ask(self, name: str) -> None:
        self.run.stdin.write(name.encode() + b"\n")
        self.run.stdin.flush()

    def head(self, name: str) -> tuple[str, str, int] | None:
        """(oid, type, size) of what a name stands for, of a process for checks; None where it is missing or ambiguous."""
        self._ask(name)
        parts = self.run.stdout.readline().decode("utf-8", "replace").rsplit(" ", 2)
        return (parts[0], parts[1], int(parts[2])) if len(parts) == 3 and parts[2].strip().isdigit() else None

    def content(self, name: str) -> tuple[str, str, bytes]:
        self._ask(name)
        return next(batch_objects(self.run.stdout))


def list_refs(path: str) -> list[tuple[str, str, str, str, bool]]:
    out = git(path, "for-each-ref", "--format=%(refname)%00%(objecttype)%00%(objectname)", "refs/heads", "refs/tags").decode()
    rows = []
    with Objects(path, check=True) as objects:
        for line in out.splitlines():
            name, kind, oid = line.split("\0")
            tag = kind == "tag"
            found = objects.head(f"{oid}^{{commit}}") if tag else (oid, kind, 0)  # follows tags of tags
            ref_type = "branch" if name.startswith("refs/heads/") else "tag-annotated" if tag else "tag-lightweight"
            if found:  # a tag of something else than a commit has none
                rows.append((name, ref_type, oid, found[0], tag))
    return rows


def resolve_names(path: str, names: list[str]) -> dict[str, str]:
    """{name: commit} of the names that git resolves: HEAD, remote branches, short oids, expressions."""
    with Objects(path, check=True) as objects:
        found = {name: objects.head(f"{name}^{{commit}}") for name in names if name and not re.search(r"[\s\0]", name) and not name.startswith("-")}
    return {name: head[0] for name, head in found.items() if head and head[1] == "commit"}


def remote_url(path: str) -> str | None:
    return git(path, "config", "--get", "remote.origin.url", ok=(0, 1)).decode().strip() or None


def object_format(path: str) -> str:
    return git(path, "config", "--get", "extensions.objectformat", ok=(0, 1)).decode().strip().lower() or "sha1"


class Slice(InputPartition):
    def __init__(self, oids: list[str] | None):
        self.oids = oids


def _rev_list(options: dict[str, str]) -> list[str]:
    args = ["rev-list", "--topo-order", *(options.get("head") or "--all").split()]
    if options.get("since"):  # seconds; only leaves commits out, so that a filter behind the walk is still right
        args.append(f"--since-as-filter={options['since']}")
    return [*args, "--not", *options["exclude"].split()] if options.get("exclude") else args


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options, self.path, self.table = options, options["path"], options.get("table", "commits")

    def partitions(self) -> list[InputPartition]:
        if self.table in ("refs", "repositories"):
            return [Slice(None)]
        if self.table == "blobs":
            oids = self.options["oids"].split() if "oids" in self.options else self._all_blobs()
        else:
            oids = git(self.path, *_rev_list(self.options)).decode().split()
        size = int(self.options.get("rows_per_partition", 20_000))
        return [Slice(oids[i : i + size]) for i in range(0, len(oids), size)] or [Slice([])]

    def _all_blobs(self) -> list[str]:
        listed = git(self.path, "cat-file", "--batch-all-objects", "--batch-check=%(objecttype) %(objectname)").decode()
        return [line[5:] for line in listed.splitlines() if line.startswith("blob ")]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if self.table == "refs":
            yield from list_refs(self.path)
        elif self.table == "repositories":
            yield self.path.rstrip("/").rsplit("/", 1)[-1], remote_url(self.path), object_format(self.path)
        elif self.table == "trees":
            yield from self._trees(partition.oids)
        elif self.table == "changes":
            yield from self._changes(partition.oids)
        elif self.table == "line_changes":
            yield from self._line_changes(partition.oids)
        else:
            yield from self._objects(partition.oids)

    def _objects(self, oids: list[str]) -> Iterator[tuple]:
        with Objects(self.path) as objects:
            for oid in oids:
                found, kind, content = objects.content(oid)
                if self.table == "blobs":
                    yield found, content
                elif kind == "commit":
                    yield parse_commit(found, content)
                else:
                    raise GitError("COMMIT_NOT_FOUND", oid)

    def _trees(self, oids: list[str]) -> Iterator[tuple]:
        """Entries of each commit's tree, subtrees opened; those that commits share are read once while they are remembered."""
        kept: OrderedDict[str, list[tuple[str, str, str]]] = OrderedDict()
        with Objects(self.path) as objects:
            for oid in oids:
                open_ = [("", f"{oid}^{{tree}}")]
                while open_:
                    prefix, tree = open_.pop()
                    if tree not in kept:
                        kept[tree] = list(parse_tree(objects.content(tree)[2]))
                        if len(kept) > KEPT_TREES:
                            kept.popitem(last=False)
                    for name, mode, entry in kept[tree]:
                        if mode == "040000":
                            open_.append((f"{prefix}{name}/", entry))
                        else:
                            yield oid, prefix + name, entry, mode

    def _line_changes(self, oids: list[str]) -> Iterator[tuple]:
        most = int(self.options["most_bytes"]) if self.options.get("most_bytes") else None
        kept: OrderedDict[str, bytes] = OrderedDict()
        held = 0
        with Objects(self.path) as objects, Objects(self.path, check=True) as sizes:

            def content(blob: str | None) -> bytes:
                nonlocal held
                if blob is None:
                    return b""
                if blob not in kept:  # what a commit leaves is mostly what the next one starts from
                    kept[blob] = objects.content(blob)[2]
                    held += len(kept[blob])
                    while held > KEPT_BYTES and len(kept) > 2:
                        held -= len(kept.popitem(last=False)[1])
                kept.move_to_end(blob)
                return kept[blob]

            for oid, path, status, before, after, _, _ in self._changes(oids):
                if most is not None and any((head := sizes.head(blob)) is None or head[2] > most for blob in (before, after) if blob):
                    yield oid, path, status, None, None, "size"
                    continue
                was, now = content(before), content(after)
                if b"\0" in was[:BINARY_PREFIX] or b"\0" in now[:BINARY_PREFIX]:
                    yield oid, path, status, None, None, "binary"
                    continue
                additions, deletions = changed_lines(was, now)
                if additions > now.count(b"\n") + 1 or deletions > was.count(b"\n") + 1:
                    raise GitError("UNKNOWN", f"impossible line counts of {path} in {oid}")
                yield oid, path, status, additions, deletions, None

    def _changes(self, oids: list[str]) -> Iterator[tuple]:
        """All differences of a partition from one process; merges against their first parent only, roots against nothing."""
        asked = "".join(o + "\n" for o in oids).encode()
        listed = subprocess.run(["git", "-C", self.path, "rev-list", "--no-walk=unsorted", "--parents", "--stdin"], input=asked, capture_output=True)
        first_parents = b"".join(b" ".join(line.split()[:2]) + b"\n" for line in listed.stdout.splitlines())
        args = ["git", "-C", self.path, "diff-tree", "--stdin", "-r", "--root", "--no-renames", "--raw", "-z", "--no-abbrev"]
        done = subprocess.run(args, input=first_parents, capture_output=True)
        if listed.returncode or done.returncode:
            raise GitError("UNKNOWN", (listed.stderr + done.stderr).decode("utf-8", "replace"))
        oid, entry = "", None
        for field in done.stdout.split(b"\0"):
            if entry is not None:
                for path, before, after, before_mode, after_mode, status in parse_raw_diff(entry + b"\0" + field):
                    yield oid, path, status, before, after, before_mode, after_mode
                entry = None
            elif field.startswith(b":"):
                entry = field
            elif field.strip():
                oid = field.decode().split()[0].strip()


class GitStreamReader(DataSourceStreamReader):
    """Commits that are new since the tips of the offset, in partitions as a batch read has them."""

    def __init__(self, options: dict[str, str]):
        self.options = options | {"table": "commits"}

    def initialOffset(self) -> dict:
        return {"tips": "{}"}

    def latestOffset(self) -> dict:
        tips = {name: peeled for name, _, _, peeled, _ in list_refs(self.options["path"]) if name.startswith("refs/heads/")}
        return {"tips": json.dumps(tips, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        heads, known = (sorted(set(json.loads(offset["tips"]).values())) for offset in (end, start))
        return GitReader(self.options | {"head": " ".join(heads), "exclude": " ".join(known)}).partitions() if heads else []

    def read(self, partition: Slice) -> Iterator[tuple]:
        return GitReader(self.options).read(partition)

    def commit(self, end: dict) -> None:
        pass


class GitDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "commits")]

    def reader(self, schema) -> GitReader:
        return GitReader(dict(self.options))

    def streamReader(self, schema) -> GitStreamReader:
        return GitStreamReader(dict(self.options))
