"""Queries over the driver's tables, and the SQL that gives the same rows.

The tables hold few secrets, so most queries read ``documents`` and a planted corpus: a text per rule of the
catalogue and path, made from the rule's own pattern, the same on every run.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysift import oracle as O
from keysift.functions import text as T
from keysift.operators import allow, detect, history, report
from keysift.plans.catalogue import RULES, catalogue, example, merge, select, to_frame
from keysift.plans.once import once, shared
from keysift.sources import files
from keysift.streaming.stream import scan_stream

PATHS = ("src/app.go", "docs/guide.md", "tests/unit_test.py", "node_modules/x/index.js", "config.example", "dist/app.min.js", "api/v1.pb.go", "yarn.lock", "latest/config", "myvendor/x.c")
BODY = "MIIEpAIBAAKCAQEAq8Zr" + "Zk3v9Qp1" * 5


@cache
def planted_rows() -> tuple[tuple[str, str], ...]:
    rows = []
    for i, r in enumerate(catalogue()):
        for seed in range(3):
            line = example(r, seed)
            after = f"\n{BODY}" if r.continuation and seed != 1 else "\nplain words" if r.continuation else ""
            note = {0: "", 1: "", 2: f"  # {T.MARKER}" if i % 3 == 0 else f"  # {T.MARKER}-rule={r.id}" if i % 3 == 1 else ""}[seed]
            rows.append((f"{i}-{seed}/{PATHS[(i + seed) % len(PATHS)]}", f"first line\r\nö {line}{note}{after}\nlast\n" if not r.before.startswith(r"\A") else f"{line}{note}\nlast"))
    words = ("changeme", "${TOKEN}", "os.environ['X']", "xxxxxxxxxxxx", "SERVICE_API_TOKEN", "discovery-token", "var.db_password", "hunter2", "aB3dE6gH9jK2mN5pQ8sT", "0123456789abcdef0123", "ñandú-llave", "")
    return (*rows, *((f"values/{i}.txt", w) for i, w in enumerate(words)))


def planted(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(planted_rows()), "path string, content string")


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def planted_sql() -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({sql_text(p)}, {sql_text(c)})" for p, c in planted_rows()) + ") AS t(path, content)"


DOCS_SQL = "SELECT source || '/' || doc_id || '.txt' AS path, text AS content FROM documents"


def everything(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    return files.documents(spark, sf_dir, dealt).unionByName(planted(spark))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect(everything(spark, sf_dir))


def shown(found: DataFrame) -> DataFrame:
    """Findings with their lists as texts."""
    return found.withColumns({c: F.array_join(c, ";" if c == "notes" else ",") for c in ("engines", "tags", "notes")})


def found_sql(select: str, files: str | None = None) -> str:
    return f"WITH {O.findings(files or f'{DOCS_SQL} UNION ALL {planted_sql()}')} {select}"


FINDING_SQL = "SELECT * EXCLUDE (id) FROM finding"


FILES_SQL = f"files AS ({DOCS_SQL} UNION ALL {planted_sql()})"
LINES_SQL = r"""arr AS (SELECT path, string_split(coalesce(content, ''), chr(10)) AS a FROM files),
cut AS (SELECT path, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a FROM arr),
lines AS (SELECT path, unnest(range(1, len(a) + 1)) AS line_no, a, len(a) AS n FROM cut),
l AS (SELECT path, line_no, regexp_replace(a[line_no], '\r\z', '') AS line, CASE WHEN line_no > 1 THEN regexp_replace(a[line_no - 1], '\r\z', '') ELSE '' END AS prev,
      CASE WHEN line_no < n THEN regexp_replace(a[line_no + 1], '\r\z', '') END AS next FROM lines)"""
LOW_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.explode_lines(everything(spark, sf_dir))
    return rows.select("path", F.col("line_no").cast("long").alias("line_no"), F.sha2("line", 256).alias("line"), F.octet_length("prev").cast("long").alias("prev_bytes"), F.coalesce(F.octet_length("next"), F.lit(-1)).cast("long").alias("next_bytes"))


def prefilter_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.scannable(detect.explode_lines(everything(spark, sf_dir)))
    rows = rows.where(T.gate("low", detect.minimal(k for r in catalogue() for k in r.keywords)))
    return rows.select("path", F.col("line_no").cast("long").alias("line_no"), F.explode(detect.candidates(catalogue())).alias("rule_id"))


def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.scannable(detect.explode_lines(everything(spark, sf_dir))).withColumn("raw", F.explode(F.array(F.struct(detect.raw_matches(catalogue()).alias("m")))))
    ids = F.array(*[F.lit(r.id) for r in catalogue()])
    found = rows.select("path", "line_no", F.explode(detect.spans(F.col("raw.m"))).alias("s"))
    return found.select("path", F.col("line_no").cast("long").alias("line_no"), F.get(ids, F.col("s.rule")).alias("rule_id"), F.col("s.start").alias("start"), F.col("s.secret").alias("secret"))


def _rule_sql(r) -> str:
    words = " OR ".join(f"contains({LOW_SQL.format('line')}, {sql_text(k)})" for k in r.keywords)
    g = [f"regexp_extract_all(line, {sql_text(r.gapped_re2())}, {k})" for k in range(4)]
    return f"SELECT path, line_no, {sql_text(r.id)} AS rule_id, {g[0]} AS g0, {g[1]} AS g1, {g[2]} AS g2, {g[3]} AS g3 FROM ok WHERE {words}"


def rule_matches_sql() -> str:
    return f"""WITH {FILES_SQL}, {LINES_SQL}, ok AS (SELECT * FROM l WHERE strlen(line) BETWEEN 1 AND 16384), m AS ({' UNION ALL '.join(map(_rule_sql, catalogue()))}),
    e AS (SELECT *, unnest(range(1, least(16, len(g3)) + 1)) AS i FROM m)
    SELECT path, line_no, rule_id, (coalesce(list_sum(list_transform(g0[:i - 1], lambda x: strlen(x))), 0) + strlen(g1[i]) + strlen(g2[i]))::BIGINT AS start, g3[i] AS secret FROM e"""


def words_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", r"[ \n]+")).alias("value")).where("value != ''").distinct()


WORDS_SQL = r"words AS (SELECT DISTINCT value FROM (SELECT unnest(regexp_split_to_array(text, '[ \n]+')) AS value FROM documents) WHERE value <> '')"


def shannon_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(spark, sf_dir).select("value", F.round(T.shannon(F.col("value")), 6).alias("entropy"))


SHANNON_SQL = f"""WITH {WORDS_SQL}, b AS (SELECT value, unnest(regexp_extract_all(hex(encode(value)), '..')) AS x FROM words), c AS (SELECT value, x, count(*) AS n FROM b GROUP BY ALL)
SELECT value, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY value"""


def alphabet_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words_of(spark, sf_dir).select("value", T.alphabet(F.col("value")).alias("alphabet"))


def entropy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.scannable(detect.explode_lines(everything(spark, sf_dir)))
    found = rows.select("path", F.col("line_no").cast("long").alias("line_no"), F.explode(detect.entropy_candidates(F.col("line"))).alias("c"))
    return found.select("path", "line_no", F.col("c.start").alias("start"), F.col("c.secret").alias("secret"))


CANDIDATES_SQL = f"""WITH {FILES_SQL}, {LINES_SQL}, m AS (SELECT path, line_no, regexp_extract_all(line, '((?s:.)*?)([0-9A-Za-z+/=_-]{{20,}})', 1) AS g, regexp_extract_all(line, '((?s:.)*?)([0-9A-Za-z+/=_-]{{20,}})', 2) AS r FROM l WHERE strlen(line) BETWEEN 1 AND 16384),
e AS (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM m)
SELECT path, line_no, (list_sum(list_transform(g[:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(r[:i - 1], lambda x: strlen(x))), 0))::BIGINT AS start, r[i] AS secret FROM e"""


def placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = words_of(spark, sf_dir).unionByName(planted(spark).select(F.col("content").alias("value"))).distinct()
    return values.select("value", T.is_placeholder(F.col("value")).alias("placeholder"))


def placeholder_sql() -> str:
    tests = [f"low IN ({', '.join(map(sql_text, T.WEAK))})", "s = ''", f"list_bool_or(list_transform([{', '.join(map(sql_text, T.FILLERS))}], lambda w: contains(low, w)))"]
    tests += [f"regexp_matches(s, {sql_text(('(?i)' if fold else '') + p)})" for p, fold in T.PLACEHOLDER_PATTERNS]
    tests += ["(len(b) >= 8 AND len(list_distinct(b)) = 1)", "(len(b) >= 12 AND len(list_distinct(b)) < 5)"]
    tests.append("list_bool_or(list_transform(range(1, greatest(len(b) - 6, 1)), lambda i: len(list_distinct(b[i:i + 7])) = 1 AND len(b) >= i + 7))")
    return f"""WITH {WORDS_SQL}, v AS (SELECT value FROM words UNION SELECT content FROM ({planted_sql()})), t AS (SELECT value, trim(value, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM v),
    u AS (SELECT *, lower(s) AS low, regexp_extract_all(hex(encode(s)), '..') AS b FROM t)
    SELECT value, coalesce({' OR '.join(tests)}, false) AS placeholder FROM u"""


def path_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = planted(spark).select("path").unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path")))
    flags = T.path_context(F.col("path"))
    return paths.select("path", *[v.alias(k) for k, v in flags.items()])


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words_of(spark, sf_dir)
    return w.select("value", T.redact(F.col("value")).alias("redacted"), T.fingerprint(F.lit("rule"), F.lit("a/b"), F.col("value")).alias("fingerprint"), T.secret_hash(F.col("value")).alias("secret_hash"))


DIGESTS_SQL = f"""WITH {WORDS_SQL} SELECT value, CASE WHEN contains(value, '-----BEGIN') THEN trim(value) WHEN length(value) <= 8 THEN repeat('*', length(value)) ELSE left(value, 4) || '...' || right(value, 4) END AS redacted,
left(sha256('rule' || chr(0) || 'a/b' || chr(0) || value), 24) AS fingerprint, left(sha256(value), 32) AS secret_hash FROM words"""


def directive_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.explode_lines(planted(spark))
    return rows.select("path", F.col("line_no").cast("long").alias("line_no"), T.suppressed("jwt", F.col("line"), F.col("prev")).alias("suppressed"))


def directive_sql() -> str:
    one = lambda c: (
        f"CASE WHEN NOT contains({c}, '{T.MARKER}') THEN false WHEN starts_with(substr({c}, strpos({c}, '{T.MARKER}') + {len(T.MARKER)}), '-rule=') THEN "
        f"list_contains(list_transform(string_split(regexp_extract(substr({c}, strpos({c}, '{T.MARKER}') + {len(T.MARKER) + 6}), '^[^ \t*/#\"'']*'), ','), lambda x: trim(x)), 'jwt') "
        f"ELSE regexp_matches(substr({c}, strpos({c}, '{T.MARKER}') + {len(T.MARKER)}), '^($|[ \t\r\n*/#\"'')\\]}}])') END"
    )
    return f"WITH files AS ({planted_sql()}), {LINES_SQL} SELECT path, line_no, {one('line')} OR {one('prev')} AS suppressed FROM l"


def pem_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.explode_lines(planted(spark))
    return rows.select("path", F.col("line_no").cast("long").alias("line_no"), T.pem_body(F.col("next")).alias("pem"))


PEM_SQL = r"coalesce(regexp_matches(trim(next, ' ' || chr(9) || chr(13)), '^(Version|Comment|DEK-Info|Proc-Type):') OR regexp_matches(trim(next, ' ' || chr(9) || chr(13)), '^[+/=0-9A-Za-z]{32,}\z'), false)"


def validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_matches(spark, sf_dir).select("secret").distinct()
    return rows.select("secret", *[F.coalesce(check(F.col("secret")), F.lit(False)).alias(name.replace("-", "_")) for name, check in T.VALIDATORS.items()])


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(findings(spark, sf_dir))


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = files.spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path"), F.col("html").alias("content")))
    return shown(detect.detect(pages))


def allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = allow.Allowlist(paths=("docs/**", "**/*.min.js", "values"), path_regexes=(r"yarn\.lock$",), rules=("jwt",))
    return allow.apply(findings(spark, sf_dir), listed).select("path", "line", "rule_id", "fingerprint")


def allow_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = allow.Allowlist(paths=("1-*/**", "**/*.min.js", "values", "2-0/src/app.go"), path_regexes=(r"yarn\.lock$",))
    return planted(spark).select("path", listed.skips(F.col("path")).alias("skipped"))


ALLOW_GLOBS_SQL = rf"""SELECT path, regexp_matches(path, '^1-[^/]*(/.*)?$') OR regexp_matches(path, '(^|/)[^/]*\.min\.js$') OR starts_with(path, 'values/') OR path = '2-0/src/app.go' OR regexp_matches(path, 'yarn\.lock$') AS skipped
FROM ({planted_sql()})"""


def baseline_new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = once(findings(spark, sf_dir))
    old = found.where("crc32(path) % 2 = 0")
    return allow.apply(found, baseline=old).select("path", "line", "rule_id", "fingerprint", "secret_hash")


def baseline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allow.baseline_rows(findings(spark, sf_dir))


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as branches: a turn is a commit, its text a blob at a path per role."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    commits = c.select(F.concat_ws("-", "conv_id", "turn").alias("hash"), F.col("turn").alias("committed"))
    return commits, c.select(F.concat_ws("-", "conv_id", "turn").alias("commit"), F.col("role").alias("path"), F.sha2("text", 256).alias("blob_hash"))


def history_first_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.blob_sites(*_history(spark, sf_dir)).select("blob_hash", "hash", "path", "committed")


HISTORY_SQL = """WITH s AS (SELECT sha256(text) AS blob_hash, conv_id || '-' || turn AS hash, role AS path, turn AS committed FROM conversations)
SELECT blob_hash, hash, path, committed FROM s QUALIFY row_number() OVER (PARTITION BY blob_hash ORDER BY committed, hash DESC, path) = 1"""


def history_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.visited(_history(spark, sf_dir)[0], since=F.lit(2), most=25)


def history_in_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversation texts as blobs of their history, with the planted texts as commits of their own; even ones are in the head."""
    blob = F.sha2("text", 256)
    turns, sites = _history(spark, sf_dir)
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = planted(spark).select("path", "content", F.sha2(F.concat("path", F.lit("\0"), "content"), 256).alias("blob_hash"))
    commits = turns.distinct().select("hash", F.col("committed").cast("long").alias("committed")).unionByName(rows.select(F.col("blob_hash").alias("hash"), F.crc32("path").alias("committed")))
    commits = commits.select("*", F.lit("A").alias("author"), F.lit("a@b").alias("author_email"), F.timestamp_seconds("committed").alias("authored"))
    changes = sites.unionByName(rows.select(F.col("blob_hash").alias("commit"), "path", "blob_hash"))
    blobs = c.select(blob.alias("blob_hash"), F.col("text").alias("content")).unionByName(rows.select("blob_hash", "content")).dropDuplicates(["blob_hash"])
    head = c.where("crc32(cast(conv_id as string)) % 2 = 0").select(F.concat_ws("/", "conv_id", "turn", "role").alias("path"), blob.alias("blob_hash")).unionByName(rows.where("crc32(path) % 2 = 0").select("path", "blob_hash")).dropDuplicates(["blob_hash"])
    return shown(history.scan(commits, changes, blobs, head))


def history_in_head_sql() -> str:
    """Conversation texts and planted texts as blobs; findings of each at its first site, marked by the head's secrets."""
    p = f"({planted_sql()})"
    even = O.crc32("path")
    sites = f"""SELECT sha256(text) AS blob, conv_id || '-' || turn AS hash, role AS path, turn::BIGINT AS committed, text AS content FROM conversations
    UNION ALL SELECT sha256(path || chr(0) || content), sha256(path || chr(0) || content), path, {even}, content FROM {p}"""
    first = f"SELECT * FROM ({sites}) QUALIFY row_number() OVER (PARTITION BY blob ORDER BY committed, hash DESC, path) = 1"
    now = f"""SELECT path, content FROM (SELECT conv_id || '/' || turn || '/' || role AS path, text AS content FROM conversations WHERE {O.crc32("conv_id::VARCHAR")} % 2 = 0 UNION ALL SELECT path, content FROM {p} WHERE {even} % 2 = 0)"""
    found = O.findings(f"SELECT path, content FROM ({first})", header_lines=None, head=history.SNIFF)
    return f"""WITH site AS ({first}), still AS (WITH {O.findings(now, header_lines=None, head=history.SNIFF)} SELECT DISTINCT secret_hash FROM finding),
    past AS (WITH {found} SELECT finding.*, named.content FROM finding JOIN named ON finding.id = named.id)
    SELECT past.* EXCLUDE (id, content, fingerprint), {O.fingerprint("rule_id", "past.path || '@' || left(hash, 12)", "secret")} AS fingerprint, hash AS "commit", 'A' AS author, 'a@b' AS author_email,
    strftime(to_timestamp(committed) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS date, past.secret_hash IN (SELECT secret_hash FROM still) AS in_head
    FROM past JOIN site ON site.path = past.path AND site.content = past.content"""


def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(findings(spark, sf_dir))


def by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_file(findings(spark, sf_dir))


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_results(once(findings(spark, sf_dir)))


def jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.jsonl(findings(spark, sf_dir))


def junit_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.junit_suites(findings(spark, sf_dir)).select("path", "failures", F.to_json("cases").alias("cases"))


def fail_on_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.fails(findings(spark, sf_dir), "critical")


def rules_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_frame(spark).groupBy(F.coalesce(F.get("tags", F.lit(0)), F.lit("other")).alias("tag")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


def rules_by_tag_sql() -> str:
    rows = ", ".join(f"({sql_text(r.id)}, {sql_text((r.tags or ('other',))[0])})" for r in RULES)
    return f"SELECT tag, count(*) AS n, min(id) AS first FROM (VALUES {rows}) AS t(id, tag) GROUP BY tag"


def catalogue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dataclasses import replace

    return to_frame(spark, merge(RULES, [replace(RULES[0], severity="low")])).select("id", "severity", "confidence")


def catalogue_merge_sql() -> str:
    rows = ", ".join(f"({sql_text(r.id)}, {sql_text('low' if r is RULES[0] else r.severity)}, {sql_text(r.confidence)})" for r in RULES)
    return f"SELECT * FROM (VALUES {rows}) AS t(id, severity, confidence)"


def scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.dispositions(files.documents(spark, sf_dir), 20_000, F.col("path").startswith("src3/"))


STATS_SQL = """WITH f AS (SELECT strlen(text) AS size, CASE WHEN source = 'src3' THEN 'ignored' WHEN strlen(text) > 20000 THEN 'too_big' WHEN contains(text, chr(0)) THEN 'binary' ELSE 'scanned' END AS s FROM documents)
SELECT count(*) AS walked, count(*) FILTER (s = 'scanned') AS scanned, count(*) FILTER (s <> 'scanned') AS skipped, count(*) FILTER (s = 'binary') AS "binary", count(*) FILTER (s = 'too_big') AS too_big,
count(*) FILTER (s = 'ignored') AS ignored, coalesce(sum(size) FILTER (s = 'scanned'), 0)::BIGINT AS bytes FROM f"""

#: Paths of a tree, and what its ignore files say.
TREE_PATHS = (".env", ".env.local", "a/.npmrc", ".dull", "a/.hide/x.go", ".git/config", "a/.svn/x", "out/y.go", "out/keep.go", "sub/z.log", "sub/deep/z.log", "z.log", "x.tmp", "node/x.go", "a/node/x.go", "doc/a/b.txt", "doc/b.txt")
TREE_IGNORES = (("", "out/*\n!out/keep.go\n# note\n*.tmp\n/node\ndoc/**/b.txt"), ("sub", "*.log\n!deep/z.log"))


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk shows and what ignore files hide, of a tree's paths and of all pages' addresses."""
    paths = spark.createDataFrame([(p,) for p in TREE_PATHS], "path string").unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path")))
    return paths.select("path", files.shown(F.col("path")).alias("shown"), files.shown(F.col("path"), hidden=True).alias("shown_hidden"), files.is_ignored(F.col("path"), files.ignore_rules(TREE_IGNORES)).alias("ignored"))


def tree_paths_sql() -> str:
    rows = ", ".join(f"({sql_text(p)})" for p in TREE_PATHS)
    control = r"regexp_matches(path, '(^|/)\.(git|hg|svn|bzr)/')"
    base = r"regexp_extract(path, '[^/]*$')"
    dull = rf"(starts_with({base}, '.') AND NOT (starts_with({base}, '.env') OR {base} IN ('.npmrc', '.pypirc', '.netrc', '.dockercfg', '.htpasswd', '.pgpass', '.my.cnf')))"
    marks = [(r"^out/[^/]*(/.*)?$", 1), (r"^out/keep\.go(/.*)?$", 0), (r"(^|/)[^/]*\.tmp(/.*)?$", 1), (r"^node(/.*)?$", 1), (r"^doc/(.*/)?b\.txt(/.*)?$", 1), (r"^sub/(.*/)?[^/]*\.log(/.*)?$", 1), (r"^sub/deep/z\.log(/.*)?$", 0)]
    ignored = "CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN {str(bool(v)).lower()}" for p, v in reversed(marks)) + " ELSE false END"
    return rf"WITH p AS (SELECT * FROM (VALUES {rows}) AS t(path) UNION ALL SELECT url FROM pages) SELECT path, NOT {control} AND NOT regexp_matches(path, '(^|/)\.[^/]+/') AND NOT {dull} AS shown, NOT {control} AS shown_hidden, {ignored} AS ignored FROM p"


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs in the head of a text: a generated-code banner in its first three lines or 512 bytes, a NUL in 8 KiB or 512 bytes."""
    odd = [("h1", "// Code generated by x. DO NOT EDIT.\n"), ("h2", "a\nb\nc\n@generated"), ("h3", "a\nb\n# AUTOGENERATED\n"), ("n1", "a\0b"), ("n2", "x" * 600 + "\0"), ("n3", "x" * 9000 + "\0"), ("n4", "")]
    rows = everything(spark, sf_dir).unionByName(spark.createDataFrame(odd, "path string, content string"))
    raw = F.encode(F.coalesce("content", F.lit("")), "UTF-8")
    tree, blob = (detect.file_context(rows.select("path", "content"), n, size) for n, size in ((3, 8192), (None, history.SNIFF)))
    both = tree.select("path", F.xxhash64("content").alias("k"), (F.col("reason") == "generated file").alias("tree_generated"), files.is_binary(raw).alias("tree_binary"), files.is_binary(raw, history.SNIFF).alias("blob_binary"))
    blob = blob.select(F.col("path").alias("p"), F.xxhash64("content").alias("q"), (F.col("reason") == "generated file").alias("blob_generated"))
    return both.join(blob.distinct(), (F.col("path") == F.col("p")) & F.col("k").eqNullSafe(F.col("q"))).select("path", "tree_generated", "blob_generated", "tree_binary", "blob_binary")


def headers_sql() -> str:
    odd = """SELECT * FROM (VALUES ('h1', '// Code generated by x. DO NOT EDIT.' || chr(10)), ('h2', 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || '@generated'), ('h3', 'a' || chr(10) || 'b' || chr(10) || '# AUTOGENERATED' || chr(10)),
    ('n1', 'a' || chr(0) || 'b'), ('n2', repeat('x', 600) || chr(0)), ('n3', repeat('x', 9000) || chr(0)), ('n4', '')) AS t(path, content)"""
    banner = f"regexp_matches(lower({{}}), '{T.BANNERS}')"
    flags = O.path_flags("path")
    three = "list_aggregate(string_split(left(coalesce(content, ''), 8192), chr(10))[1:3], 'string_agg', chr(10))"
    sign = lambda head: O.reason(flags | {"is_generated": f"({flags['is_generated']} OR {banner.format(head)})"}) + " = 'generated file'"
    return f"""SELECT path, {sign(three)} AS tree_generated, {sign("left(coalesce(content, ''), 512)")} AS blob_generated, contains(left(coalesce(content, ''), 8192), chr(0)) AS tree_binary, contains(left(coalesce(content, ''), 512), chr(0)) AS blob_binary
    FROM ({DOCS_SQL} UNION ALL {planted_sql()} UNION ALL {odd})"""


def explicit_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose path is in a list, here that of the pages' and the planted texts'."""
    wanted = planted(spark).select("path").unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("path")))
    return everything(spark, sf_dir).join(wanted.distinct(), "path", "left_semi").select("path", F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("bytes"))


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left after the two bounds: a line of 1 MiB ends its text, one over 16 KiB or empty is passed by."""
    sizes = [("l1", 16384), ("l2", 16385), ("l3", (1 << 20) - 1), ("l4", 1 << 20), ("l5", 0)]
    odd = spark.createDataFrame(sizes, "path string, n int").select("path", F.concat(F.lit("first\n"), F.expr("repeat('x', n)"), F.lit("\nlast")).alias("content"))
    rows = detect.scannable(detect.explode_lines(everything(spark, sf_dir).unionByName(odd)))
    return rows.groupBy("path").agg(F.count("*").alias("lines"), F.max(F.octet_length("line")).cast("long").alias("longest"))


LONG_LINES_SQL = f"""WITH files AS ({DOCS_SQL} UNION ALL {planted_sql()} UNION ALL SELECT path, 'first' || chr(10) || repeat('x', n) || chr(10) || 'last' FROM (VALUES ('l1', 16384), ('l2', 16385), ('l3', 1048575), ('l4', 1048576), ('l5', 0)) AS t(path, n)),
{O.lines_sql()} SELECT path, count(*) AS lines, max(strlen(line))::BIGINT AS longest FROM l WHERE strlen(line) BETWEEN 1 AND 16384 GROUP BY path"""


def confident_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.confident(findings(spark, sf_dir), "medium").select("path", "line", "rule_id", "confidence")


def finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their place in the order of reports."""
    place = Window.orderBy("path", "line", "start_column", "rule_id")
    return findings(spark, sf_dir).select("path", "line", "start_column", "rule_id", F.row_number().over(place).alias("place"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(findings(spark, sf_dir))


def secret_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allow.secret_hashes(findings(spark, sf_dir))


def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif_rules(findings(spark, sf_dir)).select("rule_id", "description", "severity", "rule_index")


def chosen_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the rules that a selection leaves: by id, by tag, by a predicate."""
    rules = select(RULES, exclude=("jwt",), tag="CLOUD", keep=lambda r: r.confidence == "high")
    return detect.detect(everything(spark, sf_dir), rules, detect.Options(entropy=False)).select("path", "line", "rule_id", "secret")


def chosen_rules_sql() -> str:
    ids = ", ".join(sql_text(r.id) for r in RULES if r.id != "jwt" and "cloud" in r.tags and r.confidence == "high")
    return found_sql(f"SELECT path, line, rule_id, secret FROM finding WHERE rule_id IN ({ids})")


def entropy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with the threshold of their alphabet, and whether they reach it at 20 bytes or more."""
    w = words_of(spark, sf_dir).unionByName(planted(spark).select(F.explode(F.split("content", r"[\s=:\"']+")).alias("value")).where("value != ''")).distinct()
    kind, value = T.alphabet(F.col("value")), F.col("value")
    floor = T.entropy_floor(kind)
    return w.select("value", floor.alias("floor"), F.coalesce((F.octet_length(value) >= 20) & (T.shannon(value) >= floor), F.lit(False)).alias("high"))


def entropy_scores_sql() -> str:
    kind = "CASE WHEN regexp_full_match(value, '[0-9A-Fa-f]+') THEN 3.0::DOUBLE WHEN regexp_full_match(value, '[0-9A-Za-z+/=_-]+') THEN 4.5::DOUBLE END"
    return rf"""WITH {WORDS_SQL}, v AS (SELECT value FROM words UNION SELECT value FROM (SELECT unnest(regexp_split_to_array(content, '[\s\x0B=:"'']+')) AS value FROM ({planted_sql()})) WHERE value <> ''),
    b AS (SELECT value, {kind} AS floor, {O.bytes_of('value')} AS b FROM v)
    SELECT value, floor, coalesce(strlen(value) >= 20 AND {O.shannon('b')} >= floor, false) AS high FROM b"""


def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of plain words, and its six digits to the base 62."""
    w = words_of(spark, sf_dir).where(F.col("value").rlike(r"\A[ -~]+\z"))
    return w.select("value", F.crc32("value").alias("crc"), T.base62(F.crc32("value")).alias("digits"))


def checksums_sql() -> str:
    digits = " || ".join(f"substr('{O.BASE62}', ((crc // {62**k}) % 62 + 1)::INTEGER, 1)" for k in range(5, -1, -1))
    return f"WITH {WORDS_SQL}, c AS (SELECT value, {O.crc32('value')} AS crc FROM words WHERE regexp_full_match(value, '[ -~]+')) SELECT value, crc, {digits} AS digits FROM c"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.explode_lines(everything(spark, sf_dir))
    return rows.select("path", F.col("line_no").cast("long").alias("line_no"), F.sha2(T.sample(F.col("line")), 256).alias("sample"), T.ascii_lower(F.substring("line", 1, 30)).alias("low"))


def history_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, distinct blobs that they bring, and branches (a conversation each)."""
    commits, changes = _history(spark, sf_dir)
    refs = spark.read.parquet(f"{sf_dir}/conversations.parquet").agg(F.count_distinct("conv_id").alias("refs"))
    return history.counts(commits, changes).join(F.broadcast(refs))


def history_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits newer than a revision, here the least of those at turn 1."""
    commits = _history(spark, sf_dir)[0]
    stop = commits.where("committed = 1").agg(F.min("hash")).first()[0]
    return history.visited(commits, stop=stop).select("hash", "committed")


def history_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.live(history_in_head(spark, sf_dir)).select("path", "line", "rule_id", "fingerprint", "date")


def tree_and_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct fingerprints and secrets by rule of a tree's findings and its history's, as a baseline with history has them."""
    both = findings(spark, sf_dir).select("rule_id", "fingerprint", "secret_hash").unionByName(history_in_head(spark, sf_dir).select("rule_id", "fingerprint", "secret_hash"))
    return both.groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("fingerprint").alias("fingerprints"), F.count_distinct("secret_hash").alias("secrets"))


def stream_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and planted texts as a stream of files, scanned batch by batch: the findings of a batch scan."""
    out = shared(spark, "stream")
    everything(spark, sf_dir, dealt=False).write.parquet(f"{out}/in")  # dealt out where it is read
    texts = files.spread(spark.readStream.schema("path string, content string").parquet(f"{out}/in"), like=files.documents(spark, sf_dir, dealt=False))
    scan_stream(texts, lambda found, n: found.write.mode("overwrite").parquet(f"{out}/found/batch={n}"), f"{out}/offsets").awaitTermination()
    return shown(spark.read.parquet(f"{out}/found").drop("batch"))


def directives_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all texts on which a directive silences a rule, or all."""
    rows = detect.explode_lines(everything(spark, sf_dir))
    return rows.select("path", F.col("line_no").cast("long").alias("line_no"), T.suppressed("jwt", F.col("line"), F.col("prev")).alias("jwt"), T.suppressed("npm-access-token", F.col("line"), F.col("prev")).alias("npm"))


def pem_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.explode_lines(everything(spark, sf_dir))
    return rows.where(T.pem_body(F.col("next"))).select("path", F.col("line_no").cast("long").alias("line_no"))


def globs_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = allow.Allowlist(paths=("src1/**", "**/1*.txt", "src2", "src3/?.txt", "1-[01]/src/*"), path_regexes=(r"9\.txt$",))
    return everything(spark, sf_dir).select("path", listed.skips(F.col("path")).alias("skipped"))


GLOBS_SQL = rf"""SELECT path, regexp_matches(path, '^src1(/.*)?$') OR regexp_matches(path, '(^|/)1[^/]*\.txt$') OR starts_with(path, 'src2/') OR path = 'src2' OR regexp_matches(path, '^src3/[^/]\.txt$')
OR regexp_matches(path, '^1-[01]/src/[^/]*$') OR starts_with(path, 'src3/?.txt/') OR regexp_matches(path, '9\.txt$') AS skipped FROM ({DOCS_SQL} UNION ALL {planted_sql()})"""


def history_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All commits from a time on, without a bound on their number."""
    return history.visited(_history(spark, sf_dir)[0], since=F.lit(2)).select("hash", "committed")


MORE = (
    directives_everywhere, pem_everywhere, globs_everywhere, history_after,
    tree_paths, headers, explicit_paths, long_lines, confident_findings, finding_order, totals, secret_hashes, sarif_rules, chosen_rules, entropy_scores, checksums, samples, history_counts, history_until, history_live,
    tree_and_history, stream_findings,
)


def more_sql() -> dict[str, str]:
    past, now = history_in_head_sql(), found_sql("SELECT rule_id, fingerprint, secret_hash FROM finding")
    return {
        "directives_everywhere": f"WITH {FILES_SQL}, {LINES_SQL} SELECT path, line_no, " + ", ".join(f"""({O.directive('line', f"'{r}'")} OR {O.directive('prev', f"'{r}'")}) AS {c}""" for r, c in (("jwt", "jwt"), ("npm-access-token", "npm"))) + " FROM l",
        "pem_everywhere": f"WITH {FILES_SQL}, {LINES_SQL} SELECT path, line_no FROM l WHERE {O.pem('next')}",
        "globs_everywhere": GLOBS_SQL,
        "history_after": "SELECT DISTINCT conv_id || '-' || turn AS hash, turn AS committed FROM conversations WHERE turn >= 2",
        "tree_paths": tree_paths_sql(),
        "headers": headers_sql(),
        "explicit_paths": f"SELECT path, strlen(coalesce(content, '')) AS bytes FROM ({DOCS_SQL} UNION ALL {planted_sql()}) WHERE path IN (SELECT path FROM ({planted_sql()})) OR path IN (SELECT url FROM pages WHERE url IS NOT NULL)",
        "long_lines": LONG_LINES_SQL,
        "confident_findings": found_sql("SELECT path, line, rule_id, confidence FROM finding WHERE confidence <> 'low'"),
        "finding_order": found_sql("SELECT path, line, start_column, rule_id, (row_number() OVER (ORDER BY path, line, start_column, rule_id))::INTEGER AS place FROM finding"),
        "totals": found_sql("SELECT count(*) AS findings, count(DISTINCT path) AS files FROM finding"),
        "secret_hashes": found_sql("SELECT DISTINCT secret_hash FROM finding"),
        "sarif_rules": found_sql("SELECT rule_id, arg_min(description, (path, line, start_column)) AS description, arg_min(severity, (path, line, start_column)) AS severity, (row_number() OVER (ORDER BY rule_id) - 1)::INTEGER AS rule_index FROM finding GROUP BY rule_id"),
        "chosen_rules": chosen_rules_sql(),
        "entropy_scores": entropy_scores_sql(),
        "checksums": checksums_sql(),
        "samples": f"WITH {FILES_SQL}, {LINES_SQL} SELECT path, line_no, sha256({O._sample('line')}) AS sample, {LOW_SQL.format('left(line, 30)')} AS low FROM l",
        "history_counts": "SELECT count(DISTINCT conv_id || '-' || turn) AS commits, count(DISTINCT sha256(text)) AS blobs, count(DISTINCT conv_id) AS refs FROM conversations",
        "history_until": "SELECT DISTINCT conv_id || '-' || turn AS hash, turn AS committed FROM conversations WHERE turn > 1",
        "history_live": f"SELECT path, line, rule_id, fingerprint, date FROM ({past}) WHERE in_head",
        "tree_and_history": f"SELECT rule_id, count(*) AS n, count(DISTINCT fingerprint) AS fingerprints, count(DISTINCT secret_hash) AS secrets FROM (SELECT * FROM ({now}) UNION ALL SELECT rule_id, fingerprint, secret_hash FROM ({past})) GROUP BY rule_id",
        "stream_findings": found_sql(FINDING_SQL),
    }


QUERIES = {f.__name__: f for f in (
    scan_documents, scan_pages, lines_explode, prefilter_candidates, rule_matches, shannon_entropy, alphabet_class, entropy_candidates, placeholder_filter, path_context, digests, directive_suppression,
    pem_continuation, validators, allowlist, allow_globs, baseline_new_findings, baseline_rows, history_first_commit, history_since, history_in_head, summary_grouping_sets, by_file, sarif_results, jsonl,
    junit_suites, fail_on_status, rules_by_tag, catalogue_merge, scan_stats, *MORE,
)}


ALLOWED_SQL = r"regexp_matches(path, '^docs(/.*)?$') OR regexp_matches(path, '(^|/)[^/]*\.min\.js$') OR regexp_matches(path, '^values(/.*)?$') OR regexp_matches(path, 'yarn\.lock$') OR rule_id = 'jwt'"
LEVEL_SQL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END"
SEVERITY_SQL = "(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END)"
SUMMARY_SQL = f"""SELECT 'severity' AS kind, severity AS label, {SEVERITY_SQL} AS rank, count(*) AS n FROM finding GROUP BY severity
UNION ALL SELECT 'confidence', confidence, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END, count(*) FROM finding GROUP BY confidence"""
BASELINE_ROWS_SQL = """SELECT fingerprint, path, line, rule_id, redacted, confidence, secret_hash FROM finding
QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY path, line, start_column, rule_id, redacted, confidence, secret_hash) = 1"""
JUNIT_SQL = """SELECT path, count(*) AS failures, to_json(list({'line': line, 'start_column': start_column, 'rule_id': rule_id, 'severity': severity, 'redacted': redacted, 'description': description}
ORDER BY line, start_column, rule_id, severity, redacted, description))::VARCHAR AS cases FROM finding GROUP BY path"""


def baseline_new_sql() -> str:
    old = f"SELECT * FROM finding WHERE {O.crc32('path')} % 2 = 0"
    return found_sql(f", old AS ({old}) SELECT path, line, rule_id, fingerprint, secret_hash FROM finding WHERE fingerprint NOT IN (SELECT fingerprint FROM old) AND secret_hash NOT IN (SELECT secret_hash FROM old)")


def jsonl_sql() -> str:
    """Objects built field by field: what is empty is left out."""
    field = lambda c, x=None, when="true": f"CASE WHEN {when} THEN ',\"{c}\":' || to_json({x or c}) ELSE '' END"
    array = lambda c, sep: field(c, f"string_split({c}, '{sep}')", f"{c} <> ''")
    plain = ("rule_id", "description", "severity", "confidence", "path", "line", "start_column", "end_column", "validated", "fingerprint", "secret_hash")
    swapped = "list_reduce(list_concat([{'secret': line_sample, 'redacted': ''}], pairs), lambda a, p: {'secret': replace(a.secret, p.secret, p.redacted), 'redacted': ''}).secret"
    parts = [f"'{{\"schema\":\"{report.SCHEMA}\",\"tool\":\"{report.TOOL}\"'", *map(field, plain), array("engines", ","), array("tags", ","), array("notes", ";"), field("entropy", None, "entropy <> 0"), field("validator", None, "validator <> ''"), field("line_sample", swapped), field("secret", "redacted"), "'}'"]
    text = " || ".join(parts)
    for c, code in (("<", "003c"), (">", "003e"), ("&", "0026")):
        text = f"replace({text}, '{c}', '\\u{code}')"
    lists = "list_transform(list_distinct(list({'n': length(secret), 'secret': secret, 'redacted': redacted}) OVER (PARTITION BY path, line)), lambda x: x)"
    return found_sql(f", paired AS (SELECT *, list_transform(list_reverse_sort({lists}), lambda x: {{'secret': x.secret, 'redacted': x.redacted}}) AS pairs FROM finding) SELECT {text} AS value FROM paired")


def validators_sql() -> str:
    columns = ", ".join(f"{f('secret')} AS {k.replace('-', '_')}" for k, f in O.VALIDATORS.items())
    return found_sql(f", given AS (SELECT DISTINCT g3[i] AS secret FROM pat) SELECT secret, {columns} FROM given")


def path_context_sql() -> str:
    flags = O.path_flags("path")
    why = O.reason(flags)
    columns = ", ".join(f"{v} AS {k}" for k, v in flags.items())
    return f"WITH p AS (SELECT path FROM ({planted_sql()}) UNION ALL SELECT url FROM pages) SELECT path, {columns}, ({why}) <> '' AS discounted, {why} AS reason FROM p"


def sql() -> dict[str, str]:
    return {
        **more_sql(),
        "scan_documents": found_sql(FINDING_SQL),
        "scan_pages": found_sql(FINDING_SQL, "SELECT url AS path, html AS content FROM pages"),
        "allowlist": found_sql(f"SELECT path, line, rule_id, fingerprint FROM finding WHERE NOT ({ALLOWED_SQL})"),
        "baseline_new_findings": baseline_new_sql(),
        "baseline_rows": found_sql(BASELINE_ROWS_SQL),
        "history_in_head": history_in_head_sql(),
        "summary_grouping_sets": found_sql(SUMMARY_SQL),
        "by_file": found_sql(f"SELECT path, count(*) AS n, max({SEVERITY_SQL})::INTEGER AS worst FROM finding GROUP BY path"),
        "sarif_results": found_sql(f"SELECT rule_id, (dense_rank() OVER (ORDER BY rule_id) - 1)::INTEGER AS rule_index, {LEVEL_SQL} AS level, path, greatest(line, 1) AS line, greatest(start_column, 1) AS start_column, greatest(end_column, 1) AS end_column, redacted, fingerprint, description FROM finding"),
        "jsonl": jsonl_sql(),
        "junit_suites": found_sql(JUNIT_SQL),
        "fail_on_status": found_sql(f"SELECT CASE WHEN coalesce(max({SEVERITY_SQL}), 0) >= 4 THEN 1 ELSE 0 END AS status FROM finding"),
        "validators": validators_sql(),
        "path_context": path_context_sql(),
        "lines_explode": f"WITH {FILES_SQL}, {LINES_SQL} SELECT path, line_no, sha256(line) AS line, strlen(prev) AS prev_bytes, coalesce(strlen(next), -1) AS next_bytes FROM l",
        "prefilter_candidates": f"WITH {FILES_SQL}, {LINES_SQL}, k(rule_id, ks) AS (VALUES " + ", ".join(f"({sql_text(r.id)}, [{', '.join(map(sql_text, r.keywords))}])" for r in catalogue())
        + f") SELECT path, line_no, rule_id FROM l, k WHERE strlen(line) BETWEEN 1 AND 16384 AND list_bool_or(list_transform(ks, lambda w: contains({LOW_SQL.format('line')}, w)))",
        "rule_matches": rule_matches_sql(),
        "shannon_entropy": SHANNON_SQL,
        "alphabet_class": rf"WITH {WORDS_SQL} SELECT value, CASE WHEN regexp_full_match(value, '[0-9A-Fa-f]+') THEN 'hex' WHEN regexp_full_match(value, '[0-9A-Za-z+/=_-]+') THEN 'base64' ELSE 'other' END AS alphabet FROM words",
        "entropy_candidates": CANDIDATES_SQL,
        "placeholder_filter": placeholder_sql(),
        "digests": DIGESTS_SQL,
        "directive_suppression": directive_sql(),
        "pem_continuation": f"WITH files AS ({planted_sql()}), {LINES_SQL} SELECT path, line_no, {PEM_SQL} AS pem FROM l",
        "allow_globs": ALLOW_GLOBS_SQL,
        "history_first_commit": HISTORY_SQL,
        "history_since": "SELECT DISTINCT conv_id || '-' || turn AS hash, turn AS committed FROM conversations WHERE turn >= 2 ORDER BY committed DESC, hash LIMIT 25",
        "rules_by_tag": rules_by_tag_sql(),
        "catalogue_merge": catalogue_merge_sql(),
        "scan_stats": STATS_SQL,
    }
