"""The git source, its stream, the configuration and whole runs, on a small repository made here."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from chronoweave import cli, config
from chronoweave.sources import git


def run(path, *args, **env):
    settings = os.environ | {"GIT_AUTHOR_NAME": "A U", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "C O", "GIT_COMMITTER_EMAIL": "c@x", "GIT_CONFIG_GLOBAL": "/dev/null"} | env
    return subprocess.run(["git", "-C", str(path), *args], check=True, capture_output=True, env=settings).stdout.decode().strip()


def commit(path, message, at, **files):
    for name, content in files.items():
        file = path / name.replace("__", ".")
        if content is None:
            file.unlink()
        else:
            file.write_bytes(content)
    run(path, "add", "-A")
    run(path, "commit", "-q", "--allow-empty", "-m", message, GIT_AUTHOR_DATE=f"{at} +0530", GIT_COMMITTER_DATE=f"{at} -0300")
    return run(path, "rev-parse", "HEAD")


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    path = tmp_path_factory.mktemp("work") / "demo"
    path.mkdir()
    run(path, "init", "-q", "-b", "main")
    oids = [commit(path, "feat: one\n\nbody", 1_700_000_000, a__txt=b"one\ntwo\n", b__bin=b"\x00\x01")]
    oids.append(commit(path, "two", 1_700_000_100, a__txt=b"one\nthree\nfour\n", c__ts=b"x\n"))
    run(path, "tag", "v1")
    run(path, "tag", "-a", "v2", "-m", "annotated")
    run(path, "checkout", "-q", "-b", "side", oids[0])
    oids.append(commit(path, "side", 1_700_000_150, d__md=b"d\n"))
    run(path, "checkout", "-q", "main")
    run(path, "merge", "-q", "--no-ff", "-m", "merge", "side", GIT_AUTHOR_DATE="1700000200 +0000", GIT_COMMITTER_DATE="1700000200 +0000")
    oids.append(run(path, "rev-parse", "HEAD"))
    oids.append(commit(path, "empty", 1_700_000_300))
    oids.append(commit(path, "gone", 1_700_000_400, a__txt=None))
    run(path, "remote", "add", "origin", "https://h/team/demo-url.git")
    return path, oids


def test_tables(spark, repository):
    path, oids = repository
    spark.dataSource.register(git.GitDataSource)
    read = lambda table, **o: spark.read.format("git").options(path=str(path), table=table, rows_per_partition="2", **o).load()
    commits = {r.oid: r for r in read("commits").collect()}
    assert set(commits) == set(oids) and commits[oids[3]].parents == [oids[1], oids[2]]
    first = commits[oids[0]]
    assert first.message == "feat: one\n\nbody\n" and tuple(first.author) == ("A U", "a@x", 1_700_000_000, 330) and first.committer.timezone_offset == -180
    assert {r.oid for r in read("commits", head="main", exclude="v1").collect()} == set(oids[2:])
    refs = {r.full_name: (r.ref_type, r.peeled_oid) for r in read("refs").collect()}
    assert refs["refs/tags/v2"] == ("tag-annotated", oids[1]) and refs["refs/tags/v1"] == ("tag-lightweight", oids[1]) and refs["refs/heads/side"] == ("branch", oids[2])
    changes = {(oids.index(r.oid), r.path, r.status) for r in read("changes").collect()}
    assert changes == {(0, "a.txt", "added"), (0, "b.bin", "added"), (1, "a.txt", "modified"), (1, "c.ts", "added"), (2, "d.md", "added"), (3, "d.md", "added"), (5, "a.txt", "deleted")}
    assert read("trees").filter(F.col("oid") == oids[3]).count() == 4
    assert {bytes(r.content) for r in read("blobs").collect()} >= {b"one\ntwo\n", b"\x00\x01"}
    assert tuple(read("repositories").head()) == ("demo", "https://h/team/demo-url.git", "sha1")


def test_parsers():
    assert git.parse_offset("-0330") == -210 and git.parse_person("A <b> 5 +0100") == ("A", "b", 5, 60)
    for bad in (b"tree x\n\nm", b"author A <b> x +0000\n\n"):
        with pytest.raises(git.GitError):
            git.parse_commit("o", bad)
    raw = b":100644 160000 aa bb M\0sub\0:000000 100755 00 cc A\0new\0:040000 040000 dd ee M\0tree\0"
    assert [(p, s) for p, *_, s in git.parse_raw_diff(raw)] == [("sub", "deleted"), ("new", "added")]


def test_stream_delivers_what_is_new(spark, repository, tmp_path):
    path, oids = repository
    spark.dataSource.register(git.GitDataSource)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.format("git").options(path=str(path)).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()
        query.stop()
        assert spark.read.parquet(str(tmp_path / "out")).count() == len(oids)


def records(folder):
    return [json.loads(line) for file in sorted(folder.glob("*.jsonl")) for line in file.read_text().splitlines()]


def test_runs(spark, repository, tmp_path):
    path, oids = repository
    out = tmp_path / "out"
    out.mkdir()
    state = str(tmp_path / "state.json")
    assert cli.main([str(path), "-r", "v1", "-r", "main", "-r", "nope", "-o", str(out), "-s", state, "-q"]) == 0
    got = records(out)
    assert sorted(r["oid"] for r in got) == sorted(oids) and [r["oid"] for r in got[:2]] == sorted(oids[:2])
    one = next(r for r in got if r["oid"] == oids[0])
    assert one["author"]["timestamp"] == "2023-11-15T03:43:20+05:30" and one["repository"] == {"name": "demo-url", "url": "https://h/team/demo-url.git"} and "extensions" not in one
    saved = json.loads(open(state).read())
    assert [(r["ref"], r["refType"], r["tipOid"]) for r in saved["refs"]] == [("v1", "tag-lightweight", oids[1]), ("main", "branch", oids[5])]
    again = tmp_path / "again"
    again.mkdir()
    assert cli.main([str(path), "-r", "main", "-o", str(again), "--incremental", "-s", state, "-q"]) == 0 and records(again) == []
    files = tmp_path / "files"
    files.mkdir()
    settings = tmp_path / "c.json"
    settings.write_text(json.dumps({"version": 1, "extraction": {"refs": ["main"], "range": {"sinceDate": "2023-11-14T22:14:59Z"}}, "output": {"directory": "files", "prefix": "x", "rotation": {"lines": 2}}}))
    assert cli.main([str(path), "--per-file", "-c", str(settings), "-q"]) == 0
    changed = {(r["oid"], r["file"]["path"]): r["file"] for r in records(files)}
    assert changed == {
        (oids[1], "a.txt"): {"path": "a.txt", "status": "modified", "additions": 2, "deletions": 1}, (oids[1], "c.ts"): {"path": "c.ts", "status": "added", "additions": 1, "deletions": 0},
        (oids[2], "d.md"): {"path": "d.md", "status": "added", "additions": 1, "deletions": 0}, (oids[3], "d.md"): {"path": "d.md", "status": "added", "additions": 1, "deletions": 0},
        (oids[5], "a.txt"): {"path": "a.txt", "status": "deleted", "additions": 0, "deletions": 3},
    }
    assert len(list(files.glob("x-*-00000?.jsonl"))) == 3


def test_mistakes(repository, tmp_path, capsys):
    path, _ = repository
    base = [str(path), "-o", str(tmp_path)]
    for wrong in ([], ["-r", "m", "--since-ref", "a", "--since-date", "2020-01-01"], ["-r", "m", "--incremental"], ["-r", "m", "--missing-state", "error"], ["-r", "m", "--max-diff-size", "1K"],
                  ["-r", "m", "--rotate-lines", "0"], ["-r", "m", "--rotate-size", "1K"], ["-r", "m", "--since-date", "soon"], ["-r", "m", "--nope"]):
        assert cli.main([*base, *wrong]) == 1
    assert cli.main(["/no/where", "-r", "m", "-o", str(tmp_path)]) == 1
    capsys.readouterr()


@pytest.mark.parametrize("bad", [
    {}, {"version": 2}, {"version": 1, "x": 1}, {"version": 1, "extraction": {"refs": []}}, {"version": 1, "extraction": {"range": {"sinceRef": "a", "sinceDate": "2020-01-01T00:00:00Z"}}},
    {"version": 1, "extraction": {"range": {"sinceDate": "2020-01-01T00:00:00"}}}, {"version": 1, "output": {"rotation": {"size": "1K"}}}, {"version": 1, "extensions": {"A": {"entrypoint": "m"}}},
    {"version": 1, "extensions": {"a": {}}}, {"version": 1, "runtime": {"gitAdapter": "x"}}, [],
])
def test_configurations_are_strict(bad):
    with pytest.raises(config.ConfigError):
        config.check_config(bad)


def test_paths_are_relative_to_the_configuration(tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"version": 1, "output": {"directory": "out"}, "extensions": {"a": {"entrypoint": "./p.py"}, "b": {"entrypoint": "pkg:make"}}}))
    got = config.load_config(str(file))
    assert got["output"]["directory"] == str(tmp_path / "out") and got["extensions"]["a"]["entrypoint"] == str(tmp_path / "p.py") and got["extensions"]["b"]["entrypoint"] == "pkg:make"
    assert got["extensions"]["b"]["failurePolicy"] == "skip-fact" and got["runtime"]["gitAdapter"] == "isomorphic-git"


def test_names_that_only_git_resolves(repository, tmp_path, capsys):
    path, oids = repository
    run(path, "update-ref", "refs/remotes/origin/side", oids[2])
    for name, n in (("HEAD", 6), ("origin/side", 2), (oids[1][:12], 2), ("main~2", 4)):
        out = tmp_path / name.replace("/", "_")
        out.mkdir()
        assert cli.main([str(path), "-r", name, "-o", str(out), "-q"]) == 0 and len(records(out)) == n, name
    assert cli.main([str(path), "-r", "main", "--since-ref", "no-such", "-o", str(tmp_path)]) == 1 and "REF_NOT_FOUND" in capsys.readouterr().err
    assert cli.main([str(tmp_path), "-r", "main", "-o", str(tmp_path)]) == 1


def test_all_extensions_from_one_configuration(spark, repository, tmp_path, capsys):
    path, oids = repository
    (tmp_path / "out").mkdir()
    (tmp_path / "p.py").write_text(
        "class Own:\n    def __init__(self, config):\n        self.config = config\n    def init(self, runtime):\n        pass\n"
        "    def project(self, fact):\n        from chronoweave.enrich.plugins import Outcome\n        return Outcome('success', {'n': len(fact['message']) + self.config['more']})\n"
        "def create_plugin(config):\n    return Own(config)\n"
    )
    profiles = [{"matchEmail": "a@x", "name": "Ann", "email": "ann@x", "team": "t1"}, {"matchName": "C O", "name": "Cor", "email": "cor@x"}]
    extensions = {
        "own": {"entrypoint": "./p.py", "config": {"more": 100}}, "assay": {"entrypoint": "chronoweave:assay-metrics"}, "team": {"entrypoint": "chronoweave:custom-field", "config": {"value": "core"}},
        "type": {"entrypoint": "chronoweave:file-type", "config": {"mappings": {"*.md": "Notes"}, "unknownPolicy": "skip", "debug": True}},
        "who": {"entrypoint": "chronoweave:identity-profile", "config": {"attributeFields": ["team"], "profileMappings": profiles}}, "cc": {"entrypoint": "chronoweave:conventional-commits"},
    }
    settings = tmp_path / "c.json"
    settings.write_text(json.dumps({"version": 1, "output": {"directory": "out"}, "runtime": {"profile": True}, "extensions": extensions}))
    assert cli.main([str(path), "-r", "main", "--per-file", "-c", str(settings)]) == 0
    said = capsys.readouterr().err
    assert all(stage in said for stage in ("commits", "reachability", "changes", "records", "output", "records=7", "1 diffs skipped"))
    got = {(r["oid"], r["file"]["path"]): r["extensions"] for r in records(tmp_path / "out")}
    one = got[oids[0], "a.txt"]
    assert one["own"] == {"n": 116} and one["assay"] == {"delta": 2, "churn": 2, "net-change": 2} and one["team"] == "core" and one["cc"]["type"] == "feat"
    assert one["who"] == {"author": {"name": "Ann", "email": "ann@x", "attributes": {"team": "t1"}}, "committer": {"name": "Cor", "email": "cor@x"}}
    assert got[oids[2], "d.md"]["type"] == {"name": "Notes", "_debug": {"source": "user", "matched": "*.md"}} and got[oids[0], "b.bin"]["assay"]["delta"] is None
    for wrong in ({"unknownPolicy": "x"}, {"ruleSets": ["a"]}, {"extra": 1}, {"debug": 1}, {"mappings": {"*": ""}}):
        settings.write_text(json.dumps({"version": 1, "output": {"directory": "out"}, "extensions": {"type": {"entrypoint": "chronoweave:file-type", "config": wrong}}}))
        assert cli.main([str(path), "-r", "main", "-c", str(settings), "-q"]) == 1


def test_line_counts_come_with_the_changes(spark, repository):
    path, oids = repository
    spark.dataSource.register(git.GitDataSource)
    read = lambda **o: {(oids.index(r.oid), r.path): (r.status, r.additions, r.deletions, r.skipped) for r in spark.read.format("git").options(path=str(path), table="line_changes", **o).load().collect()}
    assert read() == {
        (0, "a.txt"): ("added", 2, 0, None), (0, "b.bin"): ("added", None, None, "binary"), (1, "a.txt"): ("modified", 2, 1, None), (1, "c.ts"): ("added", 1, 0, None), (2, "d.md"): ("added", 1, 0, None),
        (3, "d.md"): ("added", 1, 0, None), (5, "a.txt"): ("deleted", 0, 3, None),
    }
    assert read(most_bytes="2", head="main", exclude="side")[1, "a.txt"] == ("modified", None, None, "size") and set(read(since="1700000250")) == {(5, "a.txt")}


def test_the_schema_has_what_the_check_has():
    schema = config.json_schema()
    json.dumps(schema)
    assert set(schema["properties"]) == set(config.SHAPE) and schema["properties"]["output"]["properties"]["rotation"]["properties"]["lines"] == {"type": "integer", "minimum": 1}
    assert schema["properties"]["extensions"]["additionalProperties"]["required"] == ["entrypoint"] and schema["properties"]["runtime"]["properties"]["gitAdapter"]["enum"][0] == "isomorphic-git"
