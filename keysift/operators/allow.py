"""Allowlists and baselines: path globs and patterns as literal predicates, known findings as anti-joins."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions.text import java

def segment_pattern(glob: str) -> str:
    """A shell pattern without ``**`` as a pattern for Java: ``*`` and ``?`` stop at slashes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] == "^" else body).replace("[", r"\[") + "]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append("\\" + glob[i])
        else:
            out.append("\\" + c if c in r".()+|^$@%{}" else c)
        i += 1
    return "".join(out)


def literal(text: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/" else c for c in text)


def glob_pattern(glob: str) -> str:
    """Exact; ``X/**`` below X; ``**/X`` at any depth; a shell pattern; a bare folder's contents."""
    glob = glob.replace("\\", "/")
    ways = [literal(glob)]
    if glob.endswith("/**"):
        head = glob[:-3]
        ways += [literal(head) + "(?:/.*)?", segment_pattern(head) + "(?:/.*)?"]
    elif glob.startswith("**/"):
        ways.append("(?:.*/)?" + segment_pattern(glob[3:]))
    else:
        ways += [segment_pattern(glob), literal(glob.removesuffix("/")) + "/.*"]
    return r"(?s)\A(?:" + "|".join(ways) + r")\z"


@dataclass(frozen=True)
class Allowlist:
    paths: tuple[str, ...] = ()
    path_regexes: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    regexes: tuple[str, ...] = ()
    fingerprints: tuple[str, ...] = ()

    def skips(self, path: Column) -> Column:
        """Paths that need not be read."""
        slashed = F.translate(path, "\\", "/")
        tests = [slashed.rlike(glob_pattern(g)) for g in self.paths] + [slashed.rlike(java(p)) for p in self.path_regexes]
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    def allows(self) -> Column:
        """Findings that are accepted."""
        out = self.skips(F.col("path")) | F.col("rule_id").isin(*self.rules) | F.col("fingerprint").isin(*self.fingerprints)
        for p in self.regexes:
            out = out | F.col("secret").rlike(java(p))
        return out


def without(findings: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Anti-join on a digest. Adaptive execution broadcasts the known side if it turns out small; nothing is counted before."""
    known = known.select(column).where(F.col(column).isNotNull()).distinct()
    return findings.join(known, column, "left_anti").select(findings.columns)


def apply(findings: DataFrame, allow: Allowlist = Allowlist(), baseline: DataFrame | None = None) -> DataFrame:
    """Findings that neither the allowlist nor the baseline (``fingerprint``, ``secret_hash``) accepts. A baseline made from
    the same findings reads them again: give both from ``plans.once``."""
    left = findings.where(~allow.allows())
    if baseline is not None:
        left = without(without(left, baseline, "fingerprint"), baseline, "secret_hash")
    return left


def baseline_rows(findings: DataFrame) -> DataFrame:
    """A row per fingerprint, its first finding by path and line, redacted."""
    columns = ("path", "line", "start_column", "rule_id", "redacted", "confidence", "secret_hash")
    return findings.groupBy("fingerprint").agg(F.min(F.struct(*columns)).alias("f")).select("fingerprint", "f.*").drop("start_column")


def secret_hashes(findings: DataFrame) -> DataFrame:
    """The digests of all secrets found, each once."""
    return findings.select("secret_hash").distinct()


def write_baseline(findings: DataFrame, path: str, generated_at: str, tool: str = "keysift") -> None:
    """One JSON document on the driver: a baseline is what people have reviewed, and never holds a secret."""
    rows = [r.asDict() for r in baseline_rows(findings).orderBy("path", "line", "fingerprint").toLocalIterator()]
    seen = dict.fromkeys(r["secret_hash"] for r in rows)
    entries = [{k: r[k] for k in ("fingerprint", "rule_id", "path", "line", "redacted", "confidence")} for r in rows]
    with open(path, "w") as f:
        json.dump({"version": 1, "generated_at": generated_at, "tool": tool, "fingerprints": sorted(r["fingerprint"] for r in rows), "secret_hashes": list(seen), "entries": entries}, f, indent=2)


def read_baseline(spark, path: str) -> DataFrame | None:
    """``fingerprint`` and ``secret_hash`` rows; None if there is no such file."""
    try:
        with open(path) as f:
            found = json.load(f)
    except FileNotFoundError:
        return None
    if found.get("version", 0) > 1:
        raise ValueError(f"{path}: version {found['version']} is newer than this reader")
    return known(spark, found.get("fingerprints", ()), found.get("secret_hashes", ()))


def known(spark, fingerprints: Iterable[str] = (), secret_hashes: Iterable[str] = ()) -> DataFrame:
    rows = [(f, None) for f in fingerprints] + [(None, h) for h in secret_hashes]
    return spark.createDataFrame(rows, "fingerprint string, secret_hash string")
