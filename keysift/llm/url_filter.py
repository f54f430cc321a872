"""URL rules in a sorted digest array: memory-mapped xxhash keys, vectorised binary search, stored strings against collisions.

A rule is a host and a path prefix. It fits its host and all subdomains where the URL's path starts with the
rule's; among those that fit the longest wins (by the whole rule, then by its host, then block before allow).
The array has one key per rule, so its size is the rule list's; probes per URL are (suffixes of the host) x
(distinct path lengths among the rules). The table is read once, narrow, without any shuffle.

Defined results: a null or empty URL, or one without ``://``, has empty host and path and gets the default
verdict; repeated rows are judged each by itself; further columns pass through unless they clash with a result
column, which then takes the name; URLs of any length are judged whole; ties of length go by host, then to the block; an
empty table gives an empty result; an empty rule list the default.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from keysift.llm.common import open_fs, put, shared_dir

Rule = tuple[str, str, str]
RULES: list[Rule] = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
DEFAULT = "allow"
Digest = Callable[[bytes], int]


def xx64(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as the contract cuts them; user names and ports stay in the host."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), slash + path


def build_digest(rules: Iterable[Rule], folder: str, digest: Digest = xx64) -> str:
    """Writes the digest array: sorted keys, offsets into the stored rules, the rules, their verdicts."""
    best: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        host = host.encode().lower().decode()
        if best.get((host, path)) != "block":
            best[host, path] = verdict
    rows = sorted((digest(f"{h}{p}".encode()), h, p, v) for (h, p), v in best.items())
    stored = [f"{h}\0{p}".encode() for _, h, p, _ in rows]
    parts = {
        "keys": np.array([r[0] for r in rows], "<u8"),
        "ends": np.cumsum([0, *map(len, stored)]).astype("<u8"),
        "text": np.frombuffer(b"".join(stored), "u1"),
        "block": np.array([r[3] == "block" for r in rows], "u1"),
        "lengths": np.array(sorted({len(r[2]) for r in rows}), "<u4"),
    }
    for name, values in parts.items():
        put(f"{folder}/{name}.bin", values.tobytes())
    return folder


class DigestRules:
    """The array as tasks see it: maps of the files where they are local, else one read of each."""

    def __init__(self, folder: str, default: str = DEFAULT, digest: Digest = xx64) -> None:
        self.default, self.digest = default, digest
        self.keys, self.ends, self.text = (self._map(folder, n, k) for n, k in (("keys", "<u8"), ("ends", "<u8"), ("text", "u1")))
        self.block, self.lengths = self._map(folder, "block", "u1"), self._map(folder, "lengths", "<u4").tolist()

    @staticmethod
    def _map(folder: str, name: str, kind: str) -> np.ndarray:
        system, path = open_fs(f"{folder}/{name}.bin")
        if not system.get_file_info(path).size:
            return np.zeros(0, kind)
        if system.type_name == "local":
            return np.memmap(path, kind, "r")
        return np.frombuffer(system.open_input_file(path).read(), kind)

    def probes(self, host: str, path: str) -> Iterator[tuple[str, str]]:
        labels = host
        while labels:
            for n in self.lengths:
                if n <= len(path):
                    yield labels, path[:n]
            labels = labels.partition(".")[2]

    def judge(self, urls: list[str | None]) -> tuple[list[str], list[str], list[str | None], list[str]]:
        hosts, paths, owner, asked, keys = [], [], [], [], []
        for i, url in enumerate(urls):
            host, path = split_url(url)
            hosts.append(host)
            paths.append(path)
            for probe in self.probes(host, path):
                owner.append(i)
                asked.append(probe)
                keys.append(self.digest("".join(probe).encode("utf-8", "surrogatepass")))
        found: list[tuple[int, int, bool, str] | None] = [None] * len(urls)
        wanted = np.array(keys, "<u8")
        low, high = np.searchsorted(self.keys, wanted, "left"), np.searchsorted(self.keys, wanted, "right")
        for k in np.flatnonzero(high > low):
            host, path = asked[k]
            full = f"{host}\0{path}".encode("utf-8", "surrogatepass")
            for at in range(low[k], high[k]):
                if self.text[self.ends[at] : self.ends[at + 1]].tobytes() == full:
                    mine = (len(host) + len(path), len(host), bool(self.block[at]), host + path)
                    if found[owner[k]] is None or mine > found[owner[k]]:
                        found[owner[k]] = mine
        return hosts, paths, [f and f[3] for f in found], [self.default if f is None else "block" if f[2] else "allow" for f in found]


def judge_urls(df: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = DEFAULT, digest: Digest = xx64) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to the rows of ``df``."""
    spark = df.sparkSession
    folder = build_digest(rules, shared_dir(spark), digest)
    keep = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    asked = "".join(keep) + "_url"  # a name that no column has
    source = df.select(*[df[c] for c in keep], df[url].alias(asked))
    schema = source.drop(asked).schema
    for c in ("host", "path", "rule", "verdict"):
        schema = schema.add(c, "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = DigestRules(folder, default, digest)
        for batch in batches:
            at = batch.num_columns - 1
            new = table.judge(batch.column(at).to_pylist())
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.string()) for x in new)], [*names, "host", "path", "rule", "verdict"])

    return source.mapInArrow(work, schema)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM u
), r(h, pre, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), hits AS (
  SELECT page_id, max_by(h || pre, length(h || pre) * 1000 + length(h)) AS rule, max_by(verdict, length(h || pre) * 1000 + length(h)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id
)
SELECT p.page_id, host, coalesce(path, '') AS path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN hits USING (page_id)
"""
