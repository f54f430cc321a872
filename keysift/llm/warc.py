"""WARC archives written per partition, and read back in parallel by boundary-chain verification.

Writing: equal payloads are found by digest (a grouped table of digests, no payloads), then each task writes
one archive, record by record. Reading: the archives are cut into ranges. Tasks emit every candidate record
start in their range (the magic bytes, wherever they are) with its successor, already followed to the first
start beyond the range; pointer jumping from the start of each file keeps what is reachable, in as many
rounds as the logarithm of the ranges of a file. Magic inside payloads is never reached. Records then are
parsed from each range's verified entry. A chain that doesn't reach the end of its file is an error.

Plain archives have the magic ``WARC/1.`` and successors by Content-Length; compressed ones have a gzip
member per record and successors by inflating it.

Defined results: null payloads are empty; a null URL is written as ``about:blank``; a null page id reads back
as null and is never referred to while another id has the payload; of rows with the same largest id and
payload all are responses; an empty table writes no file and reads as no row; payloads of any length are whole, heads are
up to ``HEAD`` bytes; other columns don't matter. Payloads aren't shuffled but where more than ``BROADCAST_ROWS`` of them repeat.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import open_fs, shared_dir, written

MAGIC, GZIP = b"WARC/1.", b"\x1f\x8b\x08"
RANGE = 8 << 20
BLOCK = 1 << 20
HEAD = 16 << 20
#: Digests of repeated payloads of at most this many are broadcast (about 60 bytes each).
BROADCAST_ROWS = 1_000_000
#: Rows of one payload from which on its digest is joined apart: there are at most as many such digests as rows over this.
HOT = 100_000


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One record; a revisit has no payload (None)."""
    name = "null" if page_id is None else str(page_id)
    target = re.sub(r"[\r\n]+", "%0A", url or "about:blank")
    head = [f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"Page-ID: {name}", f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {size}"]
    if payload is None:
        head += [f"Refers-To-Page: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(payload or b'')}"]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode("utf-8", "surrogatepass") + (payload or b"") + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, payload: str = "html", compress: bool = True) -> DataFrame:
    """Writes ``page_id``, ``url`` and the payload column as archives below ``folder``; returns (path, size) per file."""
    system, inner = open_fs(folder)
    system.create_dir(inner, recursive=True)
    rows = pages.select("page_id", "url", F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("body")).withColumn("sha", F.sha1("body"))
    shared = written(rows.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), f"{folder}-plan", "shared")
    if shared.count() <= BROADCAST_ROWS:
        plan = rows.join(F.broadcast(shared.drop("n")), "sha", "left")
    else:
        hot = shared.where(F.col("n") >= HOT).select("sha", F.col("first").alias("top"))
        marked = rows.join(F.broadcast(hot), "sha", "left")
        # Rows of a hot payload are spread: they have their answer and match no key.
        cold = marked.withColumn("key", F.when(F.col("top").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.hex(F.xxhash64("page_id", "url")))))
        plan = cold.join(shared.where(F.col("n") < HOT).select(F.col("sha").alias("key"), "first"), "key", "left").withColumn("first", F.coalesce("top", "first"))
    plan = plan.withColumn("revisit", F.coalesce(F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("first"))), F.lit(False)))
    plan = plan.select("page_id", "url", "sha", F.octet_length("body").alias("size"), F.when(~F.col("revisit"), F.col("body")).alias("body"), F.when(F.col("revisit"), F.col("first")).alias("refers"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}.warc{'.gz' * compress}"
        files, path = open_fs(name)
        out, size = None, 0
        for batch in batches:
            for page, url, sha, n, body, refers in zip(*(x.to_pylist() for x in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                data = record(page, url, body, digest, n, refers)
                if compress:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                out = out or files.open_output_stream(path, compression=None)
                out.write(data)
                size += len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "size": [size]}, pa.schema([("path", pa.string()), ("size", pa.int64())]))

    # Only files of tasks that ended are listed: a lost attempt leaves a file that nothing names.
    return plan.mapInArrow(work, "path string, size long")


class Reader:
    """Bytes of one file by position, a block at a time."""

    def __init__(self, uri: str) -> None:
        system, path = open_fs(uri)
        self.file = system.open_input_file(path)
        self.size, self.at, self.data = self.file.size(), 0, b""

    def read(self, start: int, n: int) -> bytes:
        if not (self.at <= start and start + n <= self.at + len(self.data)):
            self.at, self.data = start, self.file.read_at(max(n, BLOCK), start)
        return self.data[start - self.at : start - self.at + n]


def find(reader: Reader, magic: bytes, start: int, end: int) -> Iterator[int]:
    """Positions in [start, end) at which ``magic`` begins."""
    while start < end:
        n = min(BLOCK, end - start)
        data = reader.file.read_at(n + len(magic) - 1, start)
        at = data.find(magic)
        while at >= 0:
            yield start + at
            at = data.find(magic, at + 1)
        start += n


def parse_head(head: bytes) -> dict[str, str] | None:
    first, *lines = head.decode("utf-8", "surrogatepass").split("\r\n") if head.startswith(MAGIC) else ("", "")
    fields = dict(x.split(": ", 1) for x in lines if ": " in x)
    return fields if first.startswith("WARC/1.") and fields.get("Content-Length", "").isdigit() else None


def record_at(reader: Reader, at: int, compress: bool, body: bool) -> tuple[dict[str, str], bytes, int] | None:
    """The record at a position, and the position after it; None if there is none."""
    if compress:
        z, data, pos = zlib.decompressobj(31), b"", at
        try:
            while not z.eof:
                raw = reader.read(pos, min(1 << 16, reader.size - pos))
                text = z.decompress(raw)
                if body or b"\r\n\r\n" not in data:
                    data += text
                if not raw or data and not data.startswith(MAGIC[: len(data)]):
                    return None
                pos += len(raw)
            return _split(data, pos - len(z.unused_data), body)
        except zlib.error:
            return None
    head = b""
    while b"\r\n\r\n" not in head:
        more = reader.read(at + len(head), min(1 << 12, reader.size - at - len(head)))
        if not more or not head and not more.startswith(MAGIC) or len(head) > HEAD:
            return None
        head += more
    head = head[: head.index(b"\r\n\r\n")]
    try:
        fields = parse_head(head)
    except (UnicodeDecodeError, ValueError):
        return None
    if fields is None:
        return None
    start, n = at + len(head) + 4, int(fields["Content-Length"])
    if start + n + 4 > reader.size or reader.read(start + n, 4) != b"\r\n\r\n":
        return None
    return fields, reader.read(start, n) if body else b"", start + n + 4


def _split(data: bytes, end: int, body: bool) -> tuple[dict[str, str], bytes, int] | None:
    head, mark, rest = data.partition(b"\r\n\r\n")
    try:
        fields = parse_head(head) if mark else None
    except (UnicodeDecodeError, ValueError):
        return None
    return fields and (fields, rest[: int(fields["Content-Length"])] if body else b"", end)


def ranges_of(files: DataFrame, size: int = RANGE) -> DataFrame:
    return files.select("path", F.posexplode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size))).alias("part", "start"), F.col("size").alias("whole")).withColumn("end", F.least(F.col("start") + size, "whole"))


def candidates(ranges: DataFrame, compress: bool) -> DataFrame:
    """Every candidate start with the first start of its chain beyond its range (-1: the chain breaks)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(x.to_pylist() for x in batch.select(["path", "start", "end"]).columns)):
                reader = Reader(path)
                starts = list(find(reader, GZIP if compress else MAGIC, start, end))
                after = {at: (r[2] if (r := record_at(reader, at, compress, False)) else -1) for at in starts}
                for at in reversed(starts):
                    if after[at] < end and after[at] >= 0:
                        after[at] = after.get(after[at], -1)
                yield pa.RecordBatch.from_pydict({"path": [path] * len(starts), "at": starts, "next": [after[x] for x in starts]}, pa.schema([("path", pa.string()), ("at", pa.int64()), ("next", pa.int64())]))

    # A number keeps adaptive execution from merging these few rows, each of which stands for a range of a file.
    return ranges.repartition(max(1, ranges.count())).mapInArrow(work, "path string, at long, next long")


def reachable(links: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Pointer jumping: the range entries (path, at) that lie on the chain from the start of each file."""
    links = written(links.where("next >= 0"), folder, "links-0")
    seen = written(files.select("path", F.lit(0).cast("long").alias("at")), folder, "seen-0")
    # Only entries matter: starts that some chain enters a range by.
    hop = links.join(links.select("path", F.col("next").alias("at")).unionByName(seen).distinct(), ["path", "at"], "left_semi")
    turn, before = 0, seen.count()
    while True:
        turn += 1
        hop = written(hop, folder, f"hop-{turn}")
        more = seen.join(hop, ["path", "at"]).select("path", F.col("next").alias("at"))
        seen = written(seen.unionByName(more).distinct(), folder, f"seen-{turn}")
        now = seen.count()
        if now == before:
            return seen
        before = now
        far = hop.select("path", F.col("at").alias("next"), F.col("next").alias("far"))
        hop = hop.join(far, ["path", "next"]).select("path", "at", F.col("far").alias("next"))


RECORDS = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def read_archives(files: DataFrame, folder: str, compress: bool = True, size: int = RANGE) -> DataFrame:
    """The records of archives (path, size): verified boundaries, parsed in parallel. A revisit's payload is null."""
    files = written(files, folder, "files")
    ranges = written(ranges_of(files, size), folder, "ranges")
    seen = reachable(candidates(ranges, compress), files, folder)
    broken = files.where("size > 0").join(seen.select("path", F.col("at").alias("size")), ["path", "size"], "left_anti")
    if lost := broken.select("path").limit(5).collect():
        raise ValueError(f"records don't reach the end of {', '.join(r['path'] for r in lost)}")
    entries = written(ranges.join(seen.withColumn("part", F.floor(F.col("at") / size).cast("int")), ["path", "part"]).where("at < end").select("path", "at", "end"), folder, "entries")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path, at, end in zip(*(x.to_pylist() for x in batch.columns)):
                reader, rows, held = Reader(path), [], 0
                while at < end:
                    found = record_at(reader, at, compress, True)
                    if found is None:
                        raise ValueError(f"{path}: there is no record at {at}")
                    fields, payload, at = found
                    kind = fields["WARC-Type"]
                    page = fields["Page-ID"]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{path}: the payload before {at} does not have its digest")
                    refers = fields.get("Refers-To-Page")
                    rows.append((None if page == "null" else int(page), fields["WARC-Target-URI"], kind, digest, int(fields["Payload-Length"]) if kind == "revisit" else len(payload), refers and int(refers), payload if kind == "response" else None))
                    held += len(payload)
                    if held > 4 * BLOCK or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return entries.repartition(max(1, entries.count())).mapInArrow(work, RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    files = write_archives(pages, f"{folder}/warc")
    return read_archives(files, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = r"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT hex, max(page_id) AS top FROM p GROUP BY hex
)
SELECT page_id, octet_length(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 10 * (i // 8)::INT + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p JOIN g USING (hex)
"""
