"""Detection as one narrow transform: lines, gated patterns with byte spans, confidence, overlap fold, continuation, entropy.

Input is a row per text (``path``, ``content``). A line's neighbours come from the array it is in, so nothing is
shuffled until the findings, few and small, are put in order per file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.functions import text as T
from keysift.plans.catalogue import RULES, Rule, catalogue

LINE_BYTES, FILE_LINE_BYTES, PER_LINE = 16384, 1 << 20, 16
CONTEXT_WORDS = sorted("cert auth signature bearer session secret token password passwd pwd private credential apikey api_key api-key access_key accesskey".split(), key=len)
HIT = "struct<rule:int,start:bigint,end:bigint,secret:string,entropy:double,rank:int,score:int,validated:boolean,engines:array<string>,notes:array<string>,deferred:boolean>"


@dataclass(frozen=True)
class Options:
    entropy: bool = True
    contextual: bool = True
    min_length: int = 20
    base64_floor: float = 4.5
    hex_floor: float = 3.0
    marker: str = T.MARKER
    #: From a rule's id, a line and the line before to whether the finding is dropped; None: directives with ``marker``.
    suppressor: Callable[[Column, Column, Column], Column] | None = None

    def settled(self) -> Options:
        """A minimal length that isn't positive resets all entropy settings."""
        return self if self.min_length > 0 else Options(marker=self.marker, suppressor=self.suppressor)

    def suppressed(self, rule: Column, line: Column, prev: Column) -> Column:
        return self.suppressor(rule, line, prev) if self.suppressor else T.suppressed(rule, line, prev, self.marker)


def explode_lines(files: DataFrame) -> DataFrame:
    """``line_no`` from 1, ``line``, ``prev`` (first: empty) and ``next`` (last: null) of each text, and
    ``low``, the line with A-Z lowered; other columns stay.

    A text with a line of 1 MiB or more gives none. A null text is empty.
    """
    rest = [c for c in files.columns if c != "content"]
    split = F.split(F.coalesce("content", F.lit("")), "\n", -1)
    whole = T.bind(split, lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))
    bare = F.transform(whole, lambda x: F.when(x.endswith("\r"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))
    rows = T.bind(
        bare,
        lambda a: F.when(F.exists(a, lambda x: F.octet_length(x) >= FILE_LINE_BYTES), F.array().cast("array<struct<line:string,prev:string,next:string,low:string>>")).otherwise(
            F.transform(a, lambda x, i: F.struct(x.alias("line"), F.coalesce(F.get(a, i - 1), F.lit("")).alias("prev"), F.get(a, i + 1).alias("next"), T.ascii_lower(x).alias("low")))
        ),
    )
    return files.select(*rest, F.posexplode(rows).alias("at", "row")).select(*rest, (F.col("at") + 1).alias("line_no"), "row.line", "row.prev", "row.next", "row.low")


def scannable(lines: DataFrame) -> DataFrame:
    return lines.where(F.octet_length("line").between(1, LINE_BYTES))


def minimal(words: Iterable[str]) -> list[str]:
    """Without strings that hold another: they add nothing to a gate."""
    words = sorted(set(words))
    return [w for w in words if not any(v != w and v in w for v in words)]


def candidates(rules: list[Rule]) -> Column:
    """Ids of the rules of which a keyword is in the ASCII-lowered line ``low``."""
    return F.array_compact(F.array(*[F.when(T.holds_any("low", list(r.keywords)), F.lit(r.id)) for r in rules]))


def raw_matches(rules: list[Rule]) -> Column:
    """Per rule with a match in ``line``, its number and, match by match (at most 16), the whole, the gap, what precedes, and
    the secret. A rule's pattern is tried only where one of its keywords is in ``low``."""
    found = []
    for i, r in enumerate(rules):
        words = " OR ".join(f"contains(low, {T.quote(k)})" for k in r.keywords)
        groups = ", ".join(f"'g{k}', slice(regexp_extract_all(line, {T.quote(r.gapped())}, {k}), 1, {PER_LINE})" for k in range(4))
        found.append(f"CASE WHEN ({words}) AND line RLIKE {T.quote(T.java(r.before + r.secret + r.after, r.fold))} THEN named_struct('rule', {i}, {groups}) END")
    return F.expr(f"array_compact(array({', '.join(found)}))")


def spans(raw: Column) -> Column:
    """Rule, start, end (bytes, from 0) and text of each secret of the raw matches, in order."""

    def of(g: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(g["g0"], F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + F.octet_length(y))
            start = before + F.octet_length(F.get(g["g1"], i)) + F.octet_length(F.get(g["g2"], i))
            return F.struct(g["rule"].alias("rule"), start.cast("long").alias("start"), (start + F.octet_length(x)).cast("long").alias("end"), x.alias("secret"))

        return F.transform(g["g3"], one)

    return F.flatten(F.transform(raw, of))


def rule_facts(rules: list[Rule]) -> Column:
    """What the judgement needs of each rule, by its number: one literal for all."""
    rows = ", ".join(
        f"named_struct('id', {T.quote(r.id)}, 'description', {T.quote(r.description)}, 'severity', {T.quote(r.severity)}, 'tags', cast(array({', '.join(map(T.quote, r.tags))}) as array<string>), "
        f"'base', {T.CONFIDENCE.index(r.confidence) + 1}, 'floor', {float(r.entropy)}D, 'validator', {T.quote(r.validator)}, "
        f"'weight', {10 * (T.SEVERITY.index(r.severity) + 1) + (0 if r.id.startswith('generic-') else 100)}, 'deferred', {str(bool(r.continuation)).lower()})"
        for r in rules
    )
    return F.expr(f"array({rows})")


def judge(found: DataFrame) -> DataFrame:
    """From rows with ``fact`` and ``secret`` to ``entropy``, ``rank``, ``score``, ``validated``, ``engines``, ``notes``:
    entropy against the rule's floor, then its validator, then the path's discount."""
    checks = F.lit(False)
    for name, check in T.VALIDATORS.items():
        checks = F.when(F.col("fact.validator") == name, check(F.col("secret"))).otherwise(checks)
    found = found.withColumns({"entropy": F.when((F.col("rule") < 0) | (F.col("fact.floor") > 0), T.shannon(F.col("secret"))).otherwise(F.lit(0.0)), "validated": F.coalesce(checks, F.lit(False))})
    measured, high, checked, valid = F.col("fact.floor") > 0, F.col("entropy") >= F.col("fact.floor"), F.col("fact.validator") != "", F.col("validated")
    rank = F.col("fact.base") + F.when(measured & high, 1).when(measured, -1).otherwise(0)
    rank = F.when(valid, 3).when(checked, rank - 1).otherwise(rank)
    rank = F.greatest(F.lit(1), F.least(F.lit(3), rank - F.when(F.col("discounted"), 1).otherwise(0))).cast("int")
    engines = F.array(F.lit("pattern"), F.when(measured & high, "entropy"), F.when(valid, "validator"))
    notes = F.array(
        F.when(measured & ~high, F.format_string("entropy %.2f is under the rule's %.2f", F.col("entropy"), F.col("fact.floor"))),
        F.when(checked & ~valid, "its checksum or structure is wrong"),
        F.when(F.col("discounted"), F.col("reason")),
    )
    found = found.withColumns({"rank": F.when(F.col("rule") < 0, F.lit(1)).otherwise(rank), "engines": F.when(F.col("rule") < 0, F.array(F.lit("entropy"))).otherwise(F.array_compact(engines)), "notes": F.array_compact(notes)})
    return found.withColumn("score", (F.col("fact.weight") + F.col("rank") + F.when(valid, 1000).otherwise(0)).cast("int"))


def keep_best(hits: Column) -> Column:
    """Overlapping findings, in order: one meets the first kept that it overlaps, and replaces it if its score is higher."""

    def step(kept: Column, f: Column) -> Column:
        meets = F.transform(kept, lambda k: (k["start"] < f["end"]) & (f["start"] < k["end"]))
        at = F.array_position(meets, True)

        def place(i: Column) -> Column:
            swapped = F.transform(kept, lambda k, j: F.when((j + 1 == i) & (f["score"] > k["score"]), f).otherwise(k))
            return F.when(i == 0, F.concat(kept, F.array(f))).otherwise(swapped)

        return T.bind(at, place)

    return F.when(F.size(hits) < 2, hits).otherwise(F.aggregate(hits, F.array().cast(f"array<{HIT}>"), step))


def entropy_candidates(line: Column, least: int = 20) -> Column:
    """Maximal runs of base64 characters of at least ``least`` bytes, with offsets."""
    pattern = F.lit(rf"\G([\s\S]*?)([0-9A-Za-z+/=_-]{{{least},}})")
    gaps, runs = F.regexp_extract_all(line, pattern, 1), F.regexp_extract_all(line, pattern, 2)

    def of(g: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            seen = F.aggregate(F.slice(g["runs"], F.lit(1), i), F.lit(0).cast("long"), lambda a, y: a + F.octet_length(y))
            start = F.aggregate(F.slice(g["gaps"], F.lit(1), i + 1), seen, lambda a, y: a + F.octet_length(y))
            return F.struct(start.alias("start"), (start + F.octet_length(x)).alias("end"), x.alias("secret"))

        return F.transform(g["runs"], one)

    # Most lines have no such run, and ask no more than that.
    none = F.array().cast("array<struct<start:bigint,end:bigint,secret:string>>")
    return F.when(line.rlike(rf"[0-9A-Za-z+/=_-]{{{least}}}"), T.bind(F.struct(gaps.alias("gaps"), runs.alias("runs")), of)).otherwise(none)


def file_context(files: DataFrame, header_lines: int | None = 3, head_bytes: int = 8192) -> DataFrame:
    """Adds ``discounted`` and ``reason`` from the path and a generated-code banner in the head."""
    head = T.valid(F.substring(F.encode(F.coalesce("content", F.lit("")), "UTF-8"), 1, head_bytes))
    if header_lines:
        head = F.substring_index(head, "\n", header_lines)
    flags = T.path_context(F.col("path"), T.looks_generated(head))
    return files.withColumns({"discounted": flags["discounted"], "reason": flags["reason"]})


def matches(files: DataFrame, rules: Iterable[Rule] = RULES, options: Options = Options(), extra: Iterable[str] = ()) -> DataFrame:
    """A row per match of a rule (``rule``: its number) and per run of high entropy (-1) that no filter drops, judged."""
    rules, o = catalogue(rules), options.settled()
    keep = ["path", *extra]
    files = files if TEXT_ID in files.columns else files.withColumn(TEXT_ID, F.xxhash64("content"))
    keep.append(TEXT_ID)
    lines = scannable(explode_lines(files.select(*keep, "content", "discounted", "reason")))
    low = lines
    words = sorted({k for r in rules for k in r.keywords} | set(CONTEXT_WORDS if o.entropy else ()))
    if not o.entropy or o.contextual:
        low = low.where(T.gate("low", minimal(words)))
    line, prev = F.col("line"), F.col("prev")
    item = "array<struct<rule:int,start:bigint,end:bigint,secret:string>>"
    # Explode is a generator: what it reads is evaluated once.
    tried = low.withColumn("raw", F.explode(F.array(F.struct(raw_matches(rules).alias("m")))))
    found = spans(F.col("raw.m")).cast(item)
    if o.entropy:
        runs = F.transform(entropy_candidates(line, o.min_length), lambda c: F.struct(F.lit(-1), c["start"], c["end"], c["secret"])).cast(item)
        gate = T.holds_any("low", CONTEXT_WORDS) if o.contextual else F.lit(True)
        found = F.concat(found, F.when(gate, runs).otherwise(F.array().cast(item)))
    rows = tried.select(*keep, "discounted", "reason", "line_no", "line", "prev", T.pem_body(F.col("next")).alias("pem"), F.explode(found).alias("m")).select("*", "m.*").drop("m")
    rows = rows.withColumn("kind", T.alphabet(F.col("secret"))).where((F.col("rule") >= 0) | (F.col("kind") != "other"))
    rows = rows.withColumn("fact", F.get(rule_facts(rules), F.col("rule")))
    rows = rows.where(~o.suppressed(F.coalesce("fact.id", F.lit(T.ENTROPY_RULE)), line, prev) & ~T.is_placeholder(F.col("secret")))
    judged = judge(rows).where((F.col("rule") >= 0) | (F.col("entropy") >= T.entropy_floor(F.col("kind"), o.base64_floor, o.hex_floor)))
    return judged.withColumn("line_sample", T.sample(line)).drop("line", "prev")


#: Tells texts that share a path (or have none) apart; rows equal in both are one text.
TEXT_ID = "__text_id"
HIT_COLUMNS = ("rule", "start", "end", "secret", "entropy", "rank", "score", "validated", "engines", "notes")


def detect(files: DataFrame, rules: Iterable[Rule] = RULES, options: Options = Options(), extra: Iterable[str] = ()) -> DataFrame:
    """All findings of ``path``, ``content`` (and ``discounted``, ``reason``, else derived)."""
    rules, extra = catalogue(rules), list(extra)
    if "discounted" not in files.columns:
        files = file_context(files)
    found = matches(files, rules, options, extra).withColumn("deferred", F.coalesce("fact.deferred", F.lit(False)))
    # Findings alone are shuffled, once: a text's lines lie together, and both groupings below keep that partitioning.
    text = ["path", *extra, TEXT_ID]
    found = found.repartition(*text)
    by_line = found.groupBy(*text, "line_no").agg(F.sort_array(F.collect_set(F.struct(*HIT_COLUMNS, "deferred"))).alias("all"), F.first("pem").alias("pem"), F.first("line_sample").alias("line_sample"), F.first("discounted").alias("discounted"), F.first("reason").alias("reason"))
    hits = T.bind(F.filter("all", lambda f: f["rule"] >= 0), lambda h: F.when(F.size(h) <= PER_LINE, h).otherwise(F.filter(h, lambda f: F.size(F.filter(h, lambda g: g["rule"] < f["rule"])) < PER_LINE)))
    by_line = by_line.withColumn("hits", keep_best(hits.cast(f"array<{HIT}>")))
    free = F.filter("all", lambda c: (c["rule"] < 0) & ~F.exists("hits", lambda k: (c["start"] < k["end"]) & (k["start"] < c["end"])))
    by_line = by_line.withColumn("runs", free)
    lasting = F.filter("hits", lambda h: ~h["deferred"] | F.col("pem"))
    by_line = by_line.withColumn("resolved", F.size(F.filter("hits", lambda h: h["deferred"] & F.col("pem")))).withColumn("hits", lasting).drop("all", "pem")
    # The entropy engine stops a line where the file's findings so far come to a multiple of 16.
    row = F.struct("line_no", "hits", "runs", "resolved", "line_sample")
    per_file = by_line.groupBy(*text).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def step(acc: Column, r: Column) -> Column:
        now = acc["t"] + F.size(r["hits"]) - r["resolved"]
        taken = F.least(F.size(r["runs"]), PER_LINE - F.pmod(now, F.lit(PER_LINE)))
        return F.struct((now + taken + r["resolved"]).cast("int").alias("t"), F.concat(acc["taken"], F.array(taken.cast("int"))).alias("taken"))

    start = F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("taken"))
    taken = F.aggregate("rows", start, step)["taken"]
    rows = per_file.select("path", *extra, F.explode(F.arrays_zip("rows", taken.alias("taken"))).alias("z")).select("path", *extra, "z.rows.*", "z.taken")
    flat = rows.select("path", *extra, "line_no", "line_sample", F.explode(F.concat("hits", F.slice("runs", F.lit(1), F.col("taken")).cast(f"array<{HIT}>"))).alias("f")).select("path", *extra, "line_no", "line_sample", "f.*")
    return finish(flat.withColumn("fact", F.get(rule_facts(rules), F.col("rule"))), extra)


def finish(found: DataFrame, extra: Iterable[str] = (), at: Column | None = None) -> DataFrame:
    """The columns of a finding; ``at`` stands for the path in the fingerprint."""
    run, secret = F.col("rule") < 0, F.col("secret")
    rule_id = F.when(run, T.ENTROPY_RULE).otherwise(F.col("fact.id"))
    what = F.format_string("String of high entropy, %s (%.2f bits per byte)", T.alphabet(secret), F.col("entropy"))
    return found.select(
        rule_id.alias("rule_id"), F.when(run, what).otherwise(F.col("fact.description")).alias("description"), F.when(run, "low").otherwise(F.col("fact.severity")).alias("severity"),
        T.rank_label(F.col("rank"), T.CONFIDENCE).alias("confidence"), "engines", F.when(run, F.array(F.lit("generic"), F.lit("entropy"))).otherwise(F.col("fact.tags")).alias("tags"), "path", F.col("line_no").alias("line"),
        (F.col("start") + 1).cast("int").alias("start_column"), (F.col("end") + 1).cast("int").alias("end_column"), "line_sample", "secret", T.redact(secret).alias("redacted"), "entropy",
        F.coalesce("fact.validator", F.lit("")).alias("validator"), "validated", T.fingerprint(rule_id, F.col("path") if at is None else at, secret).alias("fingerprint"), T.secret_hash(secret).alias("secret_hash"), "notes", *extra,
    )


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", "start_column", "rule_id")
