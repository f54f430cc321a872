"""Fuzzy line dedup by MinHash, in DataFrame functions only: one line stays of each component of similar lines.

1. Signature of a line, made where it is read: the 64-bit hashes of the character shingles (``SHINGLE`` characters)
   that start at a word. Where words are rare (under one start in ``SPARSE`` characters) all shingles make a second
   signature. A band is the ``ROWS`` next hashes from one of ``BANDS`` fixed points of the hash ring on: lines share
   it if their joint next hashes are shared, at Jaccard J with probability J^ROWS. A pair at 0.8 shares one of the
   bands with probability above 0.996.
2. Equal lines are one class (by MD5); its first line stands for it. Digests and bands are shuffled, never the text.
3. In each bucket every line is compared with the bucket's first. Where that leaves a bucket in several components,
   every line outside its largest component is compared with all lines of other components there, one pair for each
   component before the others. Two lines left uncompared are thus in one component already: no link that matters is lost.
4. Before texts are fetched, each pair passes an exact bound: a line of n distinct shingles has a parity bitmap of
   64 * ``WORDS`` bits, and the bits in which two bitmaps differ are at most the shingles that they don't share.
   Jaccard J asks for at most (1 - J) / (1 + J) of the sum of both n. The bound drops no pair that is similar.
5. Exact Jaccard over all shingles, then distributed union-find; the smallest (doc_id, line_no) stays.

Lines without a word are never touched. A line shorter than a shingle is one shingle.

Defined results: null texts have no lines and stay null; a null doc_id sorts first and is a document like another; rows
that share a doc_id with different texts are documents of their own, rows equal in both are one document and lose the
same lines; ties of doc_id and line_no go by a digest of the text; lines of any length are compared whole; an empty
table gives no row; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.llm.common import components, let, shared_dir, written

SHINGLE = 10
BANDS, ROWS = 8, 3
SPARSE = 16
WORDS = 16
SIMILAR = 0.8
#: Keys of at most this many lines (about 50 bytes each) are broadcast; more are shuffled.
BROADCAST_ROWS = 1_000_000
SPACES = " \t\n\x0b\x0c\r"
AT = ("doc_id", "line_no", "row")


def _has_word(line: Column) -> Column:
    return F.ltrim(line, F.lit(SPACES)) != ""


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``row`` (a digest of the text), ``line_no`` (from 0) and ``line`` of every line with a word."""
    # The digest is made below the generator, once a text: beside it, each line would carry the text and hash it again.
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")
    return texts.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(_has_word(F.col("line")))


#: The fixed points of the hash ring, ascending.
POINTS = [-(1 << 63) + 0x5851F42D4C957F + b * ((1 << 64) // BANDS) for b in range(BANDS)]
#: A dot for each character, and runs that aren't possessive: both are the faster form in Java. Nothing follows a run, so none is ever given back.
EVERY = rf"(?s)(?=({'.' * SHINGLE}))."
STARTS = rf"(?s)(?=({'.' * SHINGLE}))\S*\s*"


def _hashed(cut: Column) -> Column:
    return F.transform(cut, lambda x: F.xxhash64(x))


def _shingles(line: str) -> Column:
    """The digests of all shingles of a line, in order, repeats included: cut from four bytes for each character."""
    cut = lambda wide: F.transform(F.sequence(F.lit(1), F.octet_length(wide) - (4 * SHINGLE - 1), F.lit(4)), lambda at: F.xxhash64(F.substring(wide, at, F.lit(4 * SHINGLE))))
    return let(F.encode(line, "UTF-32"), lambda wide: F.when(F.octet_length(wide) <= 4 * SHINGLE, F.array(F.xxhash64(wide))).otherwise(cut(wide)))


def signed(rows: DataFrame) -> DataFrame:
    """Replaces ``line`` by ``keys``: a digest per band, of one or two signatures."""
    rest = [c for c in rows.columns if c != "line"]
    cut = lambda how: _hashed(F.regexp_extract_all("line", F.lit(how), F.lit(1)))
    distinct = lambda x: F.sort_array(F.array_distinct(x))
    made = rows.select(*rest, "line", cut(STARTS).alias("s"))
    # Bytes first: where even they aren't too many for the words, the characters need no count.
    sparse = (F.size("s") * SPARSE < F.octet_length("line") - SHINGLE) & (F.size("s") * SPARSE < F.length("line") - SHINGLE)
    made = made.select(*rest, distinct(F.when(F.size("s") == 0, F.array(F.xxhash64("line"))).otherwise(F.col("s"))).alias("s"), F.when(sparse, cut(EVERY)).alias("e"))
    made = made.select(*rest, "s", F.when(F.size("e") > 0, distinct("e")).alias("e"))
    points = F.array(*map(F.lit, POINTS))
    again = lambda c: F.when(F.size(c) >= ROWS, F.slice(c, 1, ROWS)).otherwise(F.slice(F.concat(*[c] * ROWS), 1, ROWS))
    made = made.select(*rest, *[x for c in ("s", "e") for x in (F.concat(c, again(c)).alias(f"{c}_ring"), F.sort_array(F.concat(c, points)).alias(f"{c}_marked"))])
    # The place of a point among the hashes, less the points before it, is where its band starts on the ring.
    # The digest of a band's hashes one by one is that of their array, which isn't made.
    made = made.select(*rest, "e_ring", "e_marked", "s_ring", *[(F.array_position("s_marked", F.lit(p)).cast("int") - 1 - b).alias(f"at_{b}") for b, p in enumerate(POINTS)])
    s = F.array(*[F.xxhash64(F.lit(b), *[F.get("s_ring", F.col(f"at_{b}") + k) for k in range(ROWS)]) for b in range(BANDS)])
    made = made.select(*rest, "e_ring", "e_marked", s.alias("keys"))
    e = F.transform(points, lambda p, b: F.xxhash64(b + BANDS, F.slice("e_ring", F.array_position("e_marked", p).cast("int") - b, F.lit(ROWS))))
    return made.select(*rest, F.when(F.col("e_ring").isNull(), F.col("keys")).otherwise(F.concat("keys", e)).alias("keys"))


def _sketches(texts: DataFrame) -> DataFrame:
    """``lid``, ``n`` (distinct shingles) and ``bits`` (their parity bitmap) of each line."""
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    word = F.expr(f"(h >> 6) & {WORDS - 1}")
    rows = texts.select("lid", _shingles("line").alias("h")).select("lid", F.explode(F.array_distinct("h")).alias("h"))
    made = rows.groupBy("lid").agg(F.count("*").alias("n"), *[F.bit_xor(F.when(word == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(WORDS)])
    return made.select("lid", "n", F.array(*[f"w{w}" for w in range(WORDS)]).alias("bits"))


def _may_be_similar(a: str, b: str) -> Column:
    """False only for pairs under ``SIMILAR``: too many bits of the bitmaps, or too large a part of the sizes, differ."""
    differ = f"cast({' + '.join(f'bit_count(get({a}.bits, {w}) ^ get({b}.bits, {w}))' for w in range(WORDS))} as bigint)"
    return F.expr(f"greatest({differ}, abs({a}.n - {b}.n)) * {1 + SIMILAR}D <= ({a}.n + {b}.n) * {1 - SIMILAR}D + 1e-6D")


def _verified(pairs: DataFrame, texts: DataFrame, folder: str, name: str) -> DataFrame:
    """Of the pairs (a, b) of line ids, with the sum ``n`` of their distinct shingles, those at exact Jaccard similarity of ``SIMILAR`` or more."""
    both = pairs.select("a", "b", "n").join(texts.select(F.col("lid").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("lid").alias("b"), F.col("line").alias("y")), "b")
    # Explode is a generator: what it reads is evaluated once, and no filter moves below it.
    both = both.select("a", "b", "n", F.explode(F.array(F.struct(_shingles("x").alias("s"), _shingles("y").alias("t")))).alias("p"))
    percent = round(100 * SIMILAR)
    similar = f"{100 + percent} * size(array_intersect(p.s, p.t)) >= {percent} * n"
    return written(both.where(similar).select("a", "b"), folder, f"links-{name}")


def _small(rows: DataFrame, n: Column | None = None) -> bool:
    """Whether a written table has at most ``BROADCAST_ROWS`` rows (or of what ``n`` counts)."""
    return (rows.agg(F.count("*") if n is None else F.sum(n)).first()[0] or 0) <= BROADCAST_ROWS


def _pick(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``lid`` and ``line`` at the places of ``wanted``, by document; the places are broadcast if their checked number allows."""
    places = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("line_no", "lid")).alias("places"))
    places = F.broadcast(places) if _small(wanted) else places
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("row"), "text")
    found = texts.alias("l").join(places.alias("w"), F.expr("l.doc_id <=> w.doc_id and l.row = w.row")).select("places", F.split("text", "\n", -1).alias("cut"))
    return found.select(F.explode(F.transform("places", lambda p: F.struct(p["lid"].alias("lid"), F.get("cut", p["line_no"]).alias("line")))).alias("x")).select("x.lid", "x.line")


def similar_lines(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """All lines (``doc_id``, ``line_no``, ``row``, ``class``), and of each class that loses a line its ``class`` and the place
    ``keep`` of the line that stays for it."""
    every = written(signed(lines(docs).select(*AT, F.unhex(F.md5("line")).alias("class"), "line")), folder, "lines")
    classes = every.groupBy("class").agg(F.min(F.struct(*AT)).alias("head"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    ids = written(classes.withColumn("lid", F.monotonically_increasing_id()), folder, "classes")

    # No order within a bucket: rows are sorted by one long then, which Spark does by radix.
    rows = ids.select("lid", F.explode("keys").alias("key")).withColumn("first", F.expr("min(lid) over (partition by key)"))
    followers = written(rows.where("lid != first"), folder, "followers")
    wanted = followers.select(F.explode(F.array("first", "lid")).alias("lid")).distinct()
    wanted = written(ids.join(wanted, "lid").select("lid", "head.*"), folder, "wanted")
    texts = written(_pick(docs, wanted).dropDuplicates(["lid"]), folder, "texts")
    sketches = written(_sketches(texts), folder, "sketches")

    pairs = followers.select(F.col("first").alias("a"), F.col("lid").alias("b")).distinct()
    named = pairs.join(sketches.select(F.col("lid").alias("a"), F.struct("n", "bits").alias("p")), "a").join(sketches.select(F.col("lid").alias("b"), F.struct("n", "bits").alias("q")), "b")
    first = _verified(written(named.where(_may_be_similar("p", "q")).select("a", "b", F.expr("p.n + q.n").alias("n")), folder, "pairs-first"), texts, folder, "first")

    stars = written(components(first, folder, "cc-first"), folder, "stars-first")

    members = followers.select("key", "lid").unionByName(followers.select("key", F.col("first").alias("lid"))).distinct()
    named = written(members.join(stars.withColumnRenamed("id", "lid"), "lid", "left").select("key", "lid", F.coalesce("component", "lid").alias("component")), folder, "named")
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("top.component").alias("top"))
    left = written(named.join(largest, "key").join(sketches, "lid"), folder, "open")
    minor, others = left.where("component != top").alias("p"), left.alias("q")
    again = minor.join(others, F.expr("p.key = q.key and p.component != q.component and (q.component = q.top or p.lid < q.lid)") & _may_be_similar("p", "q"))
    low, high = (F.expr(f"{f}(struct(p.lid, p.component), struct(q.lid, q.component))") for f in ("least", "greatest"))
    again = again.select(low.alias("x"), high.alias("y"), F.expr("p.n + q.n").alias("n")).distinct()
    again = again.select(F.col("x.lid").alias("a"), F.col("y.lid").alias("b"), "n", F.col("x.component").alias("ca"), F.col("y.component").alias("cb")).join(pairs, ["a", "b"], "left_anti")
    again = written(again, folder, "pairs-again")
    # Each component first tries one pair, with the least other component; what that joins needs no further pair.
    ways = again.select("ca", "cb", "a", "b", "n").unionByName(again.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "a", "b", "n"))
    tried = written(ways.groupBy("ca").agg(F.min(F.struct("cb", "a", "b", "n")).alias("w")).select("w.a", "w.b", "w.n").distinct(), folder, "pairs-second")
    second = _verified(tried, texts, folder, "second")
    found = again.join(second, ["a", "b"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    joined = written(components(found, folder, "cc-second"), folder, "stars-second")
    rest = again.join(tried, ["a", "b"], "left_anti")
    for c in ("ca", "cb"):
        rest = rest.join(joined.select(F.col("id").alias(c), F.col("component").alias(f"{c}_now")), c, "left")
    rest = rest.where("coalesce(ca_now, ca) != coalesce(cb_now, cb)").select("a", "b", "n")
    third = _verified(written(rest, folder, "pairs-third"), texts, folder, "third")
    stars = components(first.unionByName(second).unionByName(third), folder, "cc")

    merged = written(stars.withColumnRenamed("id", "lid").join(ids.select("class", "lid", "head"), "lid"), folder, "merged")
    keep = merged.groupBy("component").agg(F.min("head").alias("keep"))
    alone = ids.where("n > 1").join(merged.select("lid"), "lid", "left_anti").select("class", F.col("head").alias("keep"))
    return every.select(*AT, "class"), written(merged.join(keep, "component").select("class", "keep").unionByName(alone), folder, "fate")


def _lost(docs: DataFrame, folder: str) -> DataFrame:
    """The lines to remove, with ``keep``, the place of the line that stays; a line of rows equal in both comes once for each of them."""
    every, fate = similar_lines(docs.select("doc_id", "text"), folder)
    return every.join(F.broadcast(fate) if _small(fate) else fate, "class").where(~F.struct(*AT).eqNullSafe(F.col("keep")))


def duplicate_lines(docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``line_no``, ``row`` of every line to remove, with ``keep_doc``, ``keep_line``: the line that stays for it."""
    return _lost(docs, folder).select(*AT, F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line_no").alias("keep_line")).distinct()


def removals(docs: DataFrame, folder: str) -> DataFrame:
    """``doc_id``, ``row`` and the sorted ``removed`` line numbers of documents that lose lines."""
    return _lost(docs, folder).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("line_no")).alias("removed"))


def _with_removals(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Each row of ``docs`` as a struct ``d`` with its ``removed`` lines (null: none)."""
    rows = docs.select(F.struct(*docs.columns).alias("d"))
    gone = F.broadcast(gone) if _small(gone, F.size("removed") + 1) else gone
    return rows.join(gone, F.expr("d.doc_id <=> doc_id and xxhash64(d.text) = row"), "left").select("d", "removed")


def drop_lines(docs: DataFrame, folder: str) -> DataFrame:
    """The documents with duplicate lines removed from ``text`` (and ``n_chars``, if there, counted anew).

    A document that loses every line with a word goes.
    """
    both = _with_removals(docs, written(removals(docs, folder), folder, "removals"))
    left = F.expr("""CASE WHEN removed IS NULL THEN d.text ELSE transform(array(map_from_arrays(removed, removed)), m ->
        array_join(filter(split(d.text, '\n', -1), (x, i) -> NOT map_contains_key(m, i)), '\n'))[0] END""")
    both = both.withColumn("left", left).where(F.col("removed").isNull() | _has_word(F.col("left")))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("removed").isNull(), F.col("d.n_chars")).otherwise(F.length("left")).cast(docs.schema["n_chars"].dataType)
    return both.select(*[new.get(c, F.col("d").getField(c)).alias(c) for c in docs.columns])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines with a word, and the numbers of the lines that go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Only lines that go are grouped; the others are counted where the texts are read again.
    folder = shared_dir(spark)
    gone = written(removals(docs, folder), folder, "removals")
    with_word = F.size(F.filter(F.split("d.text", "\n", -1), _has_word))
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return _with_removals(docs, gone).select("d.doc_id", F.when(F.col("d.text").isNull(), 0).otherwise(with_word).cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), F.array_join(removed, ",").alias("removed"))
