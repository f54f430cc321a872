"""Sources and the command line: walks, ignore files, repositories, standard input, hooks."""

import io
import json
import os
import subprocess
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from keysift.cli import run
from keysift.operators import history
from keysift.sources import files, repository

KEY, OTHER = ("AKIA" + w for w in ("QWERTYUIOPLKJHGF", "ZXCVBNMASDFGHJKL"))


@pytest.fixture
def tree(tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    for name in (".env", ".env.local", ".npmrc", ".dull", ".hide/x", "a.go", "out/y.go", "out/keep.go", "sub/z.log", "sub/z.go", "sub/deep/z.log", "named.tmp", "node/x.go", ".git/x"):
        put(name, KEY)
    put(".gitignore", "out/\n!out/keep.go\n# note\n*.tmp\n/node\n")
    put("sub/.gitignore", "*.log\n!deep/z.log\n")
    put(".git/info/exclude", "a.go\n")
    (tmp_path / "link.go").symlink_to(tmp_path / "sub/z.go")
    return tmp_path


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


def test_walk_sees_dot_files_and_ignore_files(spark, tree):
    usual = [".env", ".env.local", ".npmrc", "sub/deep/z.log", "sub/z.go"]
    assert paths(files.tree(spark, str(tree))) == usual
    every = paths(files.tree(spark, str(tree), hidden=True, respect_ignore=False))
    assert every == sorted([*usual, ".gitignore", ".dull", ".hide/x", "a.go", "out/y.go", "out/keep.go", "sub/.gitignore", "sub/z.log", "named.tmp", "node/x.go"])
    named = spark.createDataFrame([("a.go",), ("out/y.go",), ("none",), ("link.go",)], "path string")
    assert paths(files.tree(spark, f"file://{tree}", paths=named)) == ["a.go", "out/y.go"]
    assert paths(files.tree(spark, str(tree), skip=F.col("path").startswith(".env"))) == usual[2:]
    assert paths(files.tree(spark, str(tree), max_size=3)) == [] and paths(files.tree(spark, str(tree / "none"))) == []


@pytest.fixture
def repo(tmp_path):
    at = tmp_path / "r"
    repository.git(str(tmp_path), "init", "-q", "-b", "main", "r")

    def commit(day, **changed):
        for name, text in changed.items():
            (at / name).write_text(text) if text is not None else (at / name).unlink()
        repository.git(str(at), "add", "-A")
        when = f"2020-01-{day:02d}T00:00:00Z"
        own = {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@d"}
        subprocess.run(["git", "-C", str(at), "commit", "-q", "--allow-empty", "-m", "m"], check=True, env={**os.environ, **own})
        return repository.git(str(at), "rev-parse", "HEAD").decode().strip()

    return str(at), commit


def test_history_of_a_repository(spark, repo):
    root, commit = repo
    assert repository.tables(spark, root).commits.count() == 0
    first = commit(1, a=f"x {KEY}", gone=f"x {OTHER}")
    second = commit(2, b=f"x {KEY}", gone=None, bin="\0" + OTHER)
    repository.git(root, "branch", "side", first)
    third = commit(3, c="nothing")
    t = repository.tables(spark, root)
    found = history.scan(t.commits, t.changes, t.blobs, t.head).collect()
    assert {(r["secret"], r["commit"], r["path"], r["in_head"], r["date"], r["author"]) for r in found} == {(KEY, first, "a", True, "2020-01-01T00:00:00Z", "A"), (OTHER, first, "gone", False, "2020-01-01T00:00:00Z", "A")}
    assert repository.stats(t) == {"commits": 3, "blobs": 4, "refs": 2}
    order = lambda **k: [r["hash"] for r in repository.tables(spark, root, **k).commits.orderBy("visit").collect()]
    assert order() == [third, second, first] and order(since="2020-01-02") == [third, second] and order(since=second, all_refs=False) == [third] and order(most=1, all_refs=False) == [third]
    with pytest.raises(ValueError):
        repository.tables(spark, root, since="no-such-revision")
    with pytest.raises(ValueError):
        repository.top("/")


def test_since():
    now = datetime(2024, 5, 1, tzinfo=timezone.utc)
    for raw in ("2020-01-02T03:04:05Z", "2020-01-02T03:04:05", "2020-01-02 03:04:05"):
        assert repository.parse_since(raw, now) == datetime(2020, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    assert repository.parse_since("2020-01-02", now) == repository.parse_since("2020/01/02", now) == datetime(2020, 1, 2, tzinfo=timezone.utc)
    assert repository.parse_since("1h30m", now) == now - timedelta(minutes=90) and repository.parse_since("24h", now) == now - timedelta(days=1)
    assert [repository.parse_since(x, now) for x in ("main", "HEAD~3", "0s", "3 days", "")] == [None] * 5


def test_command_line(spark, repo, tmp_path, capsys):
    root, commit = repo
    commit(1, a=f"x {KEY}", old=f"x {OTHER}")
    commit(2, old=None)
    assert run(["scan", root, "--format", "jsonl"], spark) == 1
    assert json.loads(capsys.readouterr().out)["path"] == "a"
    assert run(["scan", root, "--fail-on", "none"], spark) == 0 and "1 finding" in capsys.readouterr().out
    assert run(["scan", root, "--staged"], spark) == 0 and "No findings" in capsys.readouterr().out
    (tmp_path / "r" / "new").write_text(OTHER)
    repository.git(root, "add", "new")
    assert repository.staged(root) == (str(tmp_path / "r"), ["new"])
    assert run(["scan", root, "--staged", "--color", "--verbose"], spark) == 1 and "new" in capsys.readouterr().out
    assert run(["scan", "-"], spark, io.BytesIO(f"a\n{KEY}".encode())) == 1 and "<stdin>" in capsys.readouterr().out
    assert run(["scan", "-"], spark, io.BytesIO(b"x" * (1 << 20))) == 2
    capsys.readouterr()
    assert run(["history", root], spark) == 1
    out = capsys.readouterr().out
    assert "2 findings" in out and "2 commits" in out and "gone from the head" in out and "still in the head" in out
    assert run(["history", root, "--only-in-head", "--format", "sarif", "--out", str(tmp_path / "s.json")], spark) == 1
    assert len(json.load(open(tmp_path / "s.json"))["runs"][0]["results"]) == 1
    at = tmp_path / "r" / ".keysift-baseline.json"
    assert run(["baseline", root, "--with-history"], spark) == 0
    assert len(json.loads(at.read_text())["secret_hashes"]) == 2 and KEY not in at.read_text()
    assert run(["scan", root, "--baseline", str(at)], spark) == 0
    assert run(["scan", root, "--baseline", str(tmp_path / "none")], spark) == 2 and run(["scan", root, "--format", "x"], spark) == 2 and run(["scan", root, "--include-rule", "x"], spark) == 2
    capsys.readouterr()
    assert run(["rules", root], None) == 0 and "65 rules" in capsys.readouterr().out
    assert run(["rules", root, "--markdown", "--tag", "AI"], None) == 0 and "## ai" in capsys.readouterr().out
    assert run(["version"], None) == 0
    hook = tmp_path / "r" / ".git" / "hooks" / "pre-commit"
    hook.parent.mkdir(exist_ok=True)
    hook.write_text("#!/bin/sh\n")
    assert run(["install-hook", root], None) == 2 and run(["install-hook", root, "--force", "--fail-on", "high"], None) == 0 and run(["install-hook", root], None) == 0
    assert "--staged --fail-on medium" in hook.read_text() and hook.stat().st_mode & 0o100


def test_ignored_folders_stay_so(spark):
    rules = files.ignore_rules([("", "out/\n!out/keep.go\n*.tmp\n!good.tmp")])
    rows = [("out/keep.go", True), ("out", False), ("a/out/x/y", True), ("b.tmp", True), ("c/good.tmp", False), ("x.tmp/good.tmp", True), ("a.go", False)]
    got = spark.createDataFrame(rows, "path string, want boolean").select("path", "want", files.is_ignored(F.col("path"), rules).alias("got")).collect()
    assert [(r["path"], r["got"]) for r in got] == rows


def test_configuration(tmp_path):
    from keysift.plans import config

    assert config.load(str(tmp_path)) == config.Config()
    (tmp_path / ".keysift.yml").write_text("max_file_size: 2KB\nfail_on: high\nentropy: {min_length: 30}\nallowlist: {paths: ['a/**'], rules: [jwt]}\nbaseline: b.json\n")
    c = config.load(str(tmp_path))
    assert (c.max_file_size, c.fail_on, c.entropy.min_length, c.allowlist.paths, c.allowlist.rules, c.baseline) == (2048, "high", 30, ("a/**",), ("jwt",), "b.json")
    for bad in ("nope: 1", "entropy: {nope: 1}", "max_file_size: 3XB"):
        (tmp_path / "bad.yml").write_text(bad)
        with pytest.raises(ValueError):
            config.load(str(tmp_path), str(tmp_path / "bad.yml"))
    with pytest.raises(OSError):
        config.load(str(tmp_path), str(tmp_path / "none.yml"))
