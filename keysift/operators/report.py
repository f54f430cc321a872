"""Summaries and sinks: grouping sets, JSON Lines, SARIF, JUnit, text. Secrets leave only where asked for."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysift.functions.text import CONFIDENCE, SEVERITY

TOOL = "keysift"
SCHEMA = "keysift.finding/v1"


def rank(column: str, labels: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, labels)), F.col(column)).cast("int")


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity and by confidence, highest first, in one pass."""
    sets = findings.groupingSets([[F.col("severity")], [F.col("confidence")]], "severity", "confidence").agg(F.count("*").alias("n"))
    kind = F.when(F.col("severity").isNotNull(), "severity").otherwise("confidence")
    order = F.coalesce(rank("severity", SEVERITY), rank("confidence", CONFIDENCE))
    return sets.select(kind.alias("kind"), F.coalesce("severity", "confidence").alias("label"), order.alias("rank"), "n")


def by_file(findings: DataFrame) -> DataFrame:
    return findings.groupBy("path").agg(F.count("*").alias("n"), F.max(rank("severity", SEVERITY)).alias("worst"))


def totals(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("findings"), F.countDistinct("path").alias("files"))


def confident(findings: DataFrame, least: str = "low") -> DataFrame:
    return findings.where(rank("confidence", CONFIDENCE) >= CONFIDENCE.index(least) + 1)


def fails(findings: DataFrame, fail_on: str | None) -> DataFrame:
    """One row: exit status 1 if a finding is as severe as ``fail_on``, else 0."""
    worst = F.coalesce(F.max(rank("severity", SEVERITY)), F.lit(0))
    bound = SEVERITY.index(fail_on) + 1 if fail_on and fail_on != "none" else 99
    return findings.agg(F.when(worst >= bound, 1).otherwise(0).alias("status"))


def jsonl(findings: DataFrame, show_secrets: bool = False) -> DataFrame:
    """``value``: an object per finding, without empty fields. Every secret of the line is redacted in the sample."""
    columns = [c for c in findings.columns if c not in ("secret", "redacted", "line_sample", "engines", "tags", "notes", "entropy", "validator")]
    blank = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    rows = findings
    sample = F.col("line_sample")
    if not show_secrets:
        line = Window.partitionBy("path", "line")
        rows = rows.withColumn("pairs", F.collect_set(F.struct(F.length("secret").alias("n"), F.col("secret"), F.col("redacted"))).over(line))
        sample = F.aggregate(F.sort_array("pairs", False), sample, lambda s, p: F.replace(s, p["secret"], p["redacted"]))
    shown = F.col("secret" if show_secrets else "redacted").alias("secret")
    body = F.struct(F.lit(SCHEMA).alias("schema"), F.lit(TOOL).alias("tool"), *columns, blank("engines"), blank("tags"), blank("notes"), F.when(F.col("entropy") != 0, F.col("entropy")).alias("entropy"), F.when(F.col("validator") != "", F.col("validator")).alias("validator"), sample.alias("line_sample"), shown)
    text = F.to_json(body)
    for c, code in (("<", "003c"), (">", "003e"), ("&", "0026")):
        text = F.replace(text, F.lit(c), F.lit(f"\\u{code}"))
    return rows.orderBy("path", "line", "start_column", "rule_id").select(text.alias("value"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity == "medium", "warning").otherwise("note")


def sarif_rules(findings: DataFrame) -> DataFrame:
    """Rules that have findings, in order of id, with their index."""
    first = findings.groupBy("rule_id").agg(F.min_by("description", F.struct("path", "line", "start_column")).alias("description"), F.min_by("severity", F.struct("path", "line", "start_column")).alias("severity"))
    # One row per rule of the catalogue at most.
    return first.withColumn("rule_index", F.row_number().over(Window.orderBy("rule_id")) - 1)


def sarif_results(findings: DataFrame) -> DataFrame:
    """A row per finding with its rule's index. Findings are read twice, so give them persisted or from ``plans.once``."""
    least = lambda c: F.greatest(F.col(c), F.lit(1))
    return findings.join(F.broadcast(sarif_rules(findings).select("rule_id", "rule_index")), "rule_id").select(
        "rule_id", "rule_index", sarif_level(F.col("severity")).alias("level"), "path", least("line").alias("line"), least("start_column").alias("start_column"), least("end_column").alias("end_column"), "redacted", "fingerprint", "description"
    )


def sarif(findings: DataFrame, version: str = "0") -> str:
    """A SARIF 2.1.0 document, made on the driver: it is one JSON object."""
    rules = [{"id": r["rule_id"], "shortDescription": {"text": r["description"]}, "defaultConfiguration": {"level": json_level(r["severity"])}} for r in sarif_rules(findings).orderBy("rule_id").collect()]
    results = [
        {
            "ruleId": r["rule_id"], "ruleIndex": r["rule_index"], "level": r["level"], "message": {"text": f"{r['description']}: {r['redacted']}"}, "partialFingerprints": {TOOL: r["fingerprint"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["path"]}, "region": {"startLine": r["line"], "startColumn": r["start_column"], "endColumn": r["end_column"]}}}],
        }
        for r in sarif_results(findings).orderBy("path", "line", "start_column", "rule_id").toLocalIterator()
    ]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": TOOL, "version": version, "rules": rules}}, "results": results}]}, indent=2)


def json_level(severity: str) -> str:
    return {"critical": "error", "high": "error", "medium": "warning"}.get(severity, "note")


def junit_suites(findings: DataFrame) -> DataFrame:
    """Per path its number of failures and the cases in order."""
    case = F.struct("line", "start_column", "rule_id", "severity", "redacted", "description")
    return findings.groupBy("path").agg(F.count("*").alias("failures"), F.sort_array(F.collect_list(case)).alias("cases"))


def junit(findings: DataFrame) -> str:
    from xml.sax.saxutils import escape
    from xml.sax.saxutils import quoteattr as q

    out = []
    for s in junit_suites(findings).orderBy("path").toLocalIterator():
        cases = "".join(f"<testcase name={q(c['rule_id'])} classname={q(s['path'])}><failure message={q(c['description'])} type={q(c['severity'])}>line {c['line']}: {escape(c['redacted'])}</failure></testcase>" for c in s["cases"])
        out.append(f'<testsuite name={q(s["path"])} tests="{s["failures"]}" failures="{s["failures"]}">{cases}</testsuite>')
    return "<testsuites>" + ("".join(out) or f'<testsuite name="{TOOL}" tests="1" failures="0"><testcase name="no findings" classname="{TOOL}"/></testsuite>') + "</testsuites>"


@dataclass(frozen=True)
class Scanned:
    """What a scan read, for the summary of the text format."""

    files: int | None = None
    commits: int | None = None
    seconds: float | None = None


COLORS = {"critical": "1;31", "high": "31", "medium": "33", "low": "2", "path": "1;36", "dim": "2", "rule": "34", "secret": "1", "good": "32", "bad": "1;31"}


def paint(label: str, kind: str, color: bool) -> str:
    return f"\x1b[{COLORS[kind]}m{label}\x1b[0m" if color else label


def visible(label: str) -> int:
    """The length of a text without its colours."""
    return len(re.sub(r"\x1b\[[0-9;]*m", "", label))


def pad(label: str, width: int) -> str:
    return label + " " * max(0, width - visible(label))


def plural(n: int, one: str) -> str:
    return f"{n:d} {one}{'s' * (n != 1)}"


def text(findings: DataFrame, show_secrets: bool = False, color: bool = False, verbose: bool = False, scanned: Scanned = Scanned()) -> str:
    """By file: where, what, how sure; then counts by severity and confidence, and what was read."""
    scope = ", ".join([*([plural(scanned.commits, "commit")] if scanned.commits else [plural(scanned.files, "file")] if scanned.files is not None else []), *([f"{scanned.seconds:.2f} s"] if scanned.seconds is not None else [])])
    lines, path, n, files = [], None, 0, 0
    levels, sure = dict.fromkeys(reversed(SEVERITY), 0), dict.fromkeys(reversed(CONFIDENCE), 0)
    for r in findings.orderBy("path", "line", "start_column", "rule_id").toLocalIterator():
        if not files or r["path"] != path:
            path = r["path"]
            files += 1
            lines += ["", paint(str(path), "path", color)]
        n += 1
        levels[r["severity"]] += 1
        sure[r["confidence"]] += 1
        at = paint(f"{r['line']}:{r['start_column']}", "dim", color)
        lines.append(f"  {pad(at, 9)}  {pad(paint(r['severity'], r['severity'], color), 8)}  {pad(paint(r['rule_id'], 'rule', color), 32)}  {paint(r['secret'] if show_secrets else r['redacted'], 'secret', color)}")
        detail = f"{r['description']}; confidence {r['confidence']}, by {'+'.join(r['engines'])}" + ", checksum right" * bool(r["validated"]) + (f", entropy {r['entropy']:.2f}" if r["entropy"] else "")
        lines.append(" " * 13 + paint(detail, "dim", color))
        if "commit" in findings.columns and r["commit"]:
            lines.append(" " * 13 + paint(f"commit {r['commit'][:8]} by {r['author']} on {r['date']}: {'still in the head' if r['in_head'] else 'gone from the head'}", "dim", color))
        if verbose and r["notes"]:
            lines.append(" " * 13 + paint("; ".join(r["notes"]), "dim", color))
    if not n:
        return paint("No findings", "good", color) + (f" ({scope})" if scope else "") + ".\n"
    counts = ", ".join(f"{k} {paint(s, s, color)}" for s, k in levels.items() if k)
    lines += ["", f"{paint(plural(n, 'finding'), 'bad', color)} in {plural(files, 'file')}: {counts}; confidence: {', '.join(f'{k} {c}' for c, k in sure.items() if k)}"]
    if scope:
        lines.append(paint(f"Scanned: {scope}", "dim", color))
    if show_secrets:
        lines.append(paint("Warning: secrets are shown in full; keep this out of logs.", "medium", color))
    return "\n".join(lines) + "\n"


FORMATTERS: dict[str, Callable[..., str]] = {"text": text, "sarif": sarif, "junit": junit, "jsonl": lambda f, **k: "".join(r["value"] + "\n" for r in jsonl(f, **k).toLocalIterator())}


def formatter(name: str) -> Callable[..., str]:
    name = name.strip().lower()
    if name not in FORMATTERS:
        raise ValueError(f"format {name!r} is unknown; there are {', '.join(sorted(FORMATTERS))}")
    return FORMATTERS[name]
