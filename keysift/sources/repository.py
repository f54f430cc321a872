"""A Git repository as tables: its plumbing writes commits, changes and the head's tree; tasks read the blobs."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keysift.operators import history

#: Blobs that one task asks for.
BLOBS_PER_TASK = 2000
STAGED = frozenset("AMRCU")
_LAYOUTS = ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%Y/%m/%d")
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


class RepositoryError(ValueError):
    pass


def git(folder: str, *args: str, text: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", folder, *args], input=text, capture_output=True)
    if done.returncode:
        raise RepositoryError(f"git {args[0]} in {folder}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def top(folder: str) -> str:
    """The working tree's root, looked for in the parents too."""
    return git(folder, "rev-parse", "--show-toplevel").decode().strip()


def parse_since(raw: str, now: datetime | None = None) -> datetime | None:
    """A date of one of five layouts (UTC where it names no zone) or a positive duration before now; None: a revision."""
    for layout in _LAYOUTS:
        try:
            at = datetime.strptime(raw, layout)
        except ValueError:
            continue
        return at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", raw)
    if parts and "".join(a + b for a, b in parts) == raw.removeprefix("+"):
        seconds = sum(float(a) * _UNITS[b] for a, b in parts)
        if seconds > 0:
            return (now or datetime.now(timezone.utc)) - timedelta(seconds=seconds)
    return None


def starts(folder: str, all_refs: bool = True) -> list[str]:
    """Commits that a walk starts from: the head, or those of all branches, remotes and tags, each once."""
    if all_refs:
        rows = git(folder, "for-each-ref", "--format=%(objectname) %(objecttype) %(*objectname) %(*objecttype)", "refs/heads", "refs/remotes", "refs/tags").decode().splitlines()
        found = [r.split(" ") for r in rows]
        commits = [r[0] if r[1] == "commit" else r[2] for r in found if r[1] == "commit" or r[3:] == ["commit"]]
        if commits:
            return list(dict.fromkeys(commits))
    return [git(folder, "rev-parse", "--verify", "HEAD^{commit}").decode().strip()]


@dataclass(frozen=True)
class Tables:
    """``commits`` (hash, committed, author, author_email, authored, visit), ``changes`` (commit, path, blob_hash), ``head`` (path, blob_hash), ``blobs`` (blob_hash, content), and the number of refs."""

    commits: DataFrame
    changes: DataFrame
    head: DataFrame
    blobs: DataFrame
    refs: int


_COMMITS = "hash string, committed timestamp, author string, author_email string, authored timestamp, visit int"


def tables(spark: SparkSession, folder: str, all_refs: bool = True, since: str = "", most: int = 0, max_size: int = 1 << 20) -> Tables:
    """The part of a history that a scan reads, newest first by committer time.

    ``since``: a date, a duration, or a revision at which each start's walk ends. ``most``: the most commits.
    Changes are against the first parent, added and changed files alone. No commit at all gives empty tables.
    """
    try:
        from_ = starts(folder, all_refs)
    except RepositoryError:
        from_ = []
    when = parse_since(since) if since else None
    stop = git(folder, "rev-parse", "--verify", f"{since}^{{commit}}").decode().strip() if since and when is None else None
    seen: dict[str, tuple] = {}
    for start in from_:
        raw = git(folder, "log", "--date-order", "-z", "--format=%H%x1f%ct%x1f%an%x1f%ae%x1f%at", start).decode(errors="replace")
        for record in filter(None, raw.split("\0")):
            h, committed, name, mail, authored = record.split("\x1f")
            if h == stop:
                break
            at = datetime.fromtimestamp(int(committed), timezone.utc)
            if h in seen or when and at < when:
                continue
            seen[h] = (h, at, name, mail, datetime.fromtimestamp(int(authored), timezone.utc))
            if most > 0 and len(seen) >= most:
                break
    order = sorted(seen.values(), key=lambda r: -r[1].timestamp())
    commits = spark.createDataFrame([(*r, i) for i, r in enumerate(order)], _COMMITS)
    changes = []
    if order:
        raw = git(folder, "diff-tree", "--stdin", "-r", "-z", "--root", "--no-renames", "--diff-filter=AMT", "-m", "--first-parent", text="".join(f"{r[0]}\n" for r in order).encode())
        changes = list(_changes(raw))
    head = []
    try:
        for row in filter(None, git(folder, "ls-tree", "-r", "-z", "HEAD").split(b"\0")):
            meta, _, path = row.partition(b"\t")
            mode, kind, h = meta.decode().split(" ")
            if kind == "blob" and mode != "120000":
                head.append((path.decode(errors="replace"), h))
    except RepositoryError:
        pass
    hashes = sorted({c[2] for c in changes} | {h for _, h in head})
    return Tables(commits, spark.createDataFrame(changes, "commit string, path string, blob_hash string"), spark.createDataFrame(head, "path string, blob_hash string"), blobs(spark, folder, hashes, max_size), len(from_))


def _changes(raw: bytes) -> Iterator[tuple[str, str, str]]:
    """Commit, path and blob of the lines that diff-tree prints, commits between them."""
    commit, fields = "", iter(raw.split(b"\0"))
    for f in fields:
        if f.startswith(b":"):
            _, mode, _, h, _ = f.decode().split(" ")
            path = next(fields).decode(errors="replace")
            if mode in ("100644", "100755", "100664"):
                yield commit, path, h
        elif f:
            commit = f.decode().split(" ")[0].strip()


def blobs(spark: SparkSession, folder: str, hashes: list[str], max_size: int) -> DataFrame:
    """``blob_hash``, ``content`` of blobs up to a size, in order of hash; the repository must be where executors see it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            sizes = _batch(folder, "--batch-check=%(objectsize)", names).split(b"\n")
            small = [n for n, s in zip(names, sizes) if s.isdigit() and int(s) <= max_size]
            data, at, found = _batch(folder, "--batch=%(objectsize)", small), 0, []
            for _ in small:
                end = data.index(b"\n", at)
                n = int(data[at:end])
                found.append(data[end + 1 : end + 1 + n])
                at = end + n + 2
            yield pa.RecordBatch.from_arrays([pa.array(small, pa.string()), pa.array(found, pa.binary())], ["blob_hash", "content"])

    rows = spark.createDataFrame([(h,) for h in hashes], "blob_hash string")
    return rows.repartition(max(1, -(-len(hashes) // BLOBS_PER_TASK))).mapInArrow(read, "blob_hash string, content binary")


def _batch(folder: str, how: str, names: list[str]) -> bytes:
    return subprocess.run(["git", "-C", folder, "cat-file", how], input="".join(f"{n}\n" for n in names).encode(), capture_output=True, check=True).stdout


def staged(folder: str) -> tuple[str, list[str]]:
    """The working tree's root, and the files in the index that differ from the head; their contents are those of the working tree."""
    root = top(folder)
    fields, out = iter(git(root, "status", "--porcelain=v1", "-z", "--untracked-files=no").decode(errors="replace").split("\0")), []
    for f in fields:
        if not f:
            continue
        if f[0] in "RC":
            next(fields, None)
        if f[0] in STAGED:
            out.append(f[3:])
    return root, sorted(out)


def stats(t: Tables) -> dict[str, int]:
    """Commits, distinct blobs introduced, and refs of a history."""
    return {**history.counts(t.commits, t.changes).first().asDict(), "refs": t.refs}
