"""The same detection over a stream of whole texts: state stays within a row, so only the dedupe needs a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keysift.operators import allow
from keysift.operators.detect import Options, detect, file_context, finish, matches
from keysift.plans.catalogue import RULES, Rule


def detect_stream(texts: DataFrame, event_time: str = "ts", delay: str = "1 hour", rules: Iterable[Rule] = RULES, options: Options = Options(), baseline: DataFrame | None = None) -> DataFrame:
    """Matches of a stream of ``path``, ``content`` and an event time, each fingerprint once within the watermark.

    One pass without state but the dedupe's: each match of overlapping rules is reported. ``scan_stream`` settles overlaps.
    """
    rules = list(rules)
    timed = texts.withWatermark(event_time, delay)
    found = finish(matches(file_context(timed), rules, options, extra=[event_time]), [event_time]).dropDuplicatesWithinWatermark(["fingerprint"])
    if baseline is not None:
        for column in ("fingerprint", "secret_hash"):
            found = found.join(baseline.select(column).where(f"{column} is not null").distinct(), column, "left_anti")
    return found


def scan_stream(
    texts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, rules: Iterable[Rule] = RULES, options: Options = Options(), allowlist: allow.Allowlist = allow.Allowlist(), baseline: DataFrame | None = None, **trigger: object,
) -> StreamingQuery:
    """The findings that a batch scan has, micro-batch by micro-batch: overlaps settled, allowlist and baseline applied.

    A text is a row, so no state goes from batch to batch. ``sink`` gets findings and the batch's number; a batch that is
    run again after a failure has the same number, by which the sink can replace what it wrote.
    """
    rules = list(rules)

    def batch(rows: DataFrame, number: int) -> None:
        sink(allow.apply(detect(rows, rules, options), allowlist, baseline), number)

    return texts.select("path", "content").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
