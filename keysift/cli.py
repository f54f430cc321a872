"""Command line: scan a tree, standard input, staged files or a history; write a baseline or a hook; list rules.

Exit 0: clean, 1: findings as severe as asked, 2: an error.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.operators import allow, history, report
from keysift.operators.detect import Options, detect
from keysift.plans import catalogue, config
from keysift.sources import files, repository

HOOK_MARK = "# written by keysift install-hook"
HOOK = f"""#!/bin/sh
{HOOK_MARK}
command -v keysift >/dev/null 2>&1 || exit 0
exec keysift scan --staged --fail-on {{}}
"""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("keysift")
    p.add_argument("command", choices=["scan", "history", "baseline", "rules", "install-hook", "version"])
    p.add_argument("path", nargs="?", default=".", help="a folder; for scan also - for standard input")
    p.add_argument("--config")
    p.add_argument("--format", default="text")
    p.add_argument("--out", "--output")
    p.add_argument("--fail-on")
    p.add_argument("--min-confidence")
    p.add_argument("--baseline")
    p.add_argument("--max-file-size")
    p.add_argument("--include-rule", action="append", default=[])
    p.add_argument("--exclude-rule", action="append", default=[])
    p.add_argument("--tag")
    p.add_argument("--no-entropy", action="store_true")
    p.add_argument("--show-secrets", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--color", action="store_true")
    p.add_argument("--staged", action="store_true", help="scan: only what the next commit would hold")
    p.add_argument("--hidden", action="store_true", help="scan: dot files and folders too")
    p.add_argument("--no-gitignore", action="store_true", help="scan: ignored files too")
    p.add_argument("--since", default="", help="history: a date, a duration before now, or a revision")
    p.add_argument("--all-refs", action=argparse.BooleanOptionalAction, default=True, help="history: all branches, remotes and tags, not the head alone")
    p.add_argument("--max-commits", type=int, default=0)
    p.add_argument("--only-in-head", action="store_true", help="history: only secrets that the head still holds")
    p.add_argument("--with-history", action="store_true", help="baseline: findings of the history too")
    p.add_argument("--markdown", action="store_true", help="rules: as a document")
    p.add_argument("--force", action="store_true", help="install-hook: replace a hook that isn't ours")
    return p


def install_hook(folder: str, fail_on: str = "medium", force: bool = False) -> str:
    """Writes the pre-commit hook; one that another tool wrote stays unless ``force``."""
    hooks = Path(repository.top(folder), ".git", "hooks")
    hooks.mkdir(parents=True, exist_ok=True)
    at = hooks / "pre-commit"
    if at.exists() and not force and HOOK_MARK not in at.read_text(errors="replace"):
        raise ValueError(f"{at} is there and was written by another; --force replaces it")
    at.write_text(HOOK.format(fail_on))
    at.chmod(0o700)
    return str(at)


def scan_tree(spark: SparkSession, root: str, c: config.Config, a: argparse.Namespace, rules: list, options: Options, paths: list[str] | None = None) -> DataFrame:
    chosen = None if paths is None else spark.createDataFrame([(p,) for p in paths], "path string")
    return detect(files.tree(spark, root, c.max_file_size, a.hidden, skip=c.allowlist.skips(F.col("path")), paths=chosen, respect_ignore=not a.no_gitignore), rules, options)


def scan_history(spark: SparkSession, root: str, c: config.Config, rules: list, options: Options, all_refs: bool = True, since: str = "", most: int = 0) -> tuple[DataFrame, repository.Tables]:
    t = repository.tables(spark, root, all_refs, since, most, c.max_file_size)
    changes = t.changes.where(~c.allowlist.skips(F.col("path")))
    return history.scan(t.commits, changes, t.blobs, t.head, rules, options, c.max_file_size), t


def run(argv: list[str], spark: SparkSession | None = None, stdin=None) -> int:
    a = parser().parse_args(argv)
    began = time.time()
    try:
        if a.command == "version":
            print("keysift 0.2")
            return 0
        if a.command == "install-hook":
            print(f"hook written: {install_hook(a.path, a.fail_on or 'medium', a.force)}")
            return 0
        root, paths = ("." if a.path == "-" else a.path), None
        if a.staged:
            root, paths = repository.staged(a.path)
        c = config.load(root, a.config)
        if a.max_file_size:
            c = config.replace_size(c, a.max_file_size)
        rules = catalogue.select(catalogue.merge(catalogue.RULES, c.extra_rules), a.include_rule, [*a.exclude_rule, *c.allowlist.rules] if a.command != "rules" else a.exclude_rule, a.tag)
        if a.command == "rules":
            print((catalogue.as_markdown if a.markdown else catalogue.as_table)(rules), end="")
            return 0
        make, name = report.formatter(a.format), a.format.strip().lower()
        spark = spark or SparkSession.builder.appName("keysift").getOrCreate()
        options = c.entropy if not a.no_entropy else Options(entropy=False)
        read = report.Scanned()
        if a.command == "history":
            found, t = scan_history(spark, root, c, rules, options, a.all_refs, a.since, a.max_commits)
            found = history.live(found) if a.only_in_head else found
            read = report.Scanned(commits=t.commits.count())
        elif a.path == "-":
            found, read = detect(files.stdin(spark, (stdin or sys.stdin.buffer).read()), rules, options), report.Scanned(files=1)
        else:
            found = scan_tree(spark, root, c, a, rules, options, paths)
        if a.command == "baseline":
            if a.with_history:
                past, _ = scan_history(spark, root, c, rules, options)
                found = found.unionByName(past.select(found.columns))
            at = a.out or ".keysift-baseline.json"
            allow.write_baseline(allow.apply(found, c.allowlist), os.path.join(root, at), datetime.now(timezone.utc).isoformat(timespec="seconds"))
            return 0
        known = a.baseline or (os.path.join(root, c.baseline) if c.baseline else None)
        base = allow.read_baseline(spark, known) if known else None
        if a.baseline and base is None:
            raise ValueError(f"there is no baseline {a.baseline}")
        found = report.confident(allow.apply(found, c.allowlist, base), a.min_confidence or c.min_confidence).persist()
        try:
            if name == "text":
                shown = make(found, a.show_secrets, a.color, a.verbose, report.Scanned(read.files, read.commits, time.time() - began))
            else:
                shown = make(found, show_secrets=a.show_secrets) if name == "jsonl" else make(found)
            if a.out and a.out != "-":
                with open(a.out, "w") as f:
                    f.write(shown)
            else:
                print(shown, end="")
            return report.fails(found, a.fail_on or c.fail_on).first()["status"]
        finally:
            found.unpersist()
    except (ValueError, OSError) as e:
        print(f"keysift: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
