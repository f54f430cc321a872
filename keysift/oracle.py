"""The detection as DuckDB SQL, written from the rules' data alone: common table expressions up to ``finding``.

It shares no code with the DataFrame form but the patterns themselves: RE2 instead of Java's regular expressions,
list functions instead of higher-order ones, and a bitwise CRC instead of the built-in one.
"""

from __future__ import annotations

from collections.abc import Iterable

from keysift.functions import text as T
from keysift.operators.detect import CONTEXT_WORDS
from keysift.plans.catalogue import Rule, catalogue

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BLANK = r"[\s\x0B\x85\p{Z}]+"
LINE_BYTES, FILE_LINE_BYTES, PER_LINE = 16384, 1 << 20, 16


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: Iterable[str]) -> str:
    return f"[{', '.join(map(quoted, values))}]"


def lines_sql(max_line: int = FILE_LINE_BYTES) -> str:
    """``l``: ``id``, ``path``, ``line_no``, ``line``, ``prev``, ``next`` of the rows of ``files``."""
    return rf"""named AS (SELECT row_number() OVER () AS id, path, content FROM (SELECT DISTINCT path, content FROM files)),
arr AS (SELECT id, path, string_split(coalesce(content, ''), chr(10)) AS a FROM named),
cut AS (SELECT id, path, list_transform(CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END, lambda x: regexp_replace(x, '\r\z', '')) AS a FROM arr),
short AS (SELECT *, len(a) AS n FROM cut WHERE NOT coalesce(list_bool_or(list_transform(a, lambda x: strlen(x) >= {max_line})), false)),
spot AS (SELECT id, path, a, n, unnest(range(1, n + 1)) AS line_no FROM short),
l AS (SELECT id, path, line_no, a[line_no] AS line, CASE WHEN line_no > 1 THEN a[line_no - 1] ELSE '' END AS prev, CASE WHEN line_no < n THEN a[line_no + 1] END AS next FROM spot)"""


def holds(column: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def _one_rule(k: int, r: Rule) -> str:
    g = ", ".join(f"regexp_extract_all(line, {quoted(r.gapped_re2())}, {i}) AS g{i}" for i in range(4))
    return f"SELECT id, path, line_no, line, prev, next, {k} AS rule, {g} FROM ok WHERE {holds('low', r.keywords)}"


def facts(rules: list[Rule]) -> str:
    rows = ", ".join(
        f"({k}, {quoted(r.id)}, {quoted(r.description)}, {quoted(r.severity)}, {quoted(','.join(r.tags))}, {T.CONFIDENCE.index(r.confidence) + 1}, {float(r.entropy)}::DOUBLE, {quoted(r.validator)}, "
        f"{10 * (T.SEVERITY.index(r.severity) + 1) + (0 if r.id.startswith('generic-') else 100)}, {str(bool(r.continuation)).lower()})"
        for k, r in enumerate(rules)
    )
    tail = f", (-1, {quoted(T.ENTROPY_RULE)}, '', 'low', 'generic,entropy', 1, 0::DOUBLE, '', 0, false)"
    return f"facts(rule, rule_id, description, severity, tags, base, floor, validator, weight, deferred) AS (VALUES {rows}{tail})"


def bytes_of(x: str) -> str:
    return f"regexp_extract_all(hex(encode({x})), '..')"


def shannon(b: str) -> str:
    """Bits per byte of a list of bytes."""
    terms = f"list_transform(list_distinct({b}), lambda x: len(list_filter({b}, lambda y: y = x)) * log2(len(list_filter({b}, lambda y: y = x))))"
    return f"CASE WHEN len({b}) = 0 THEN 0 ELSE round(log2(len({b})) - list_sum({terms}) / len({b}), 9) END"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}|{BLANK}$', '', 'g')"


def directive(c: str, rule: str) -> str:
    rest = f"substr({c}, strpos({c}, '{T.MARKER}') + {len(T.MARKER)})"
    listed = f"string_split(regexp_extract(substr({c}, strpos({c}, '{T.MARKER}') + {len(T.MARKER) + 6}), '^[^ \t*/#\"'']*'), ',')"
    return (
        f"CASE WHEN NOT contains({c}, '{T.MARKER}') THEN false WHEN starts_with({rest}, '-rule=') THEN list_contains(list_transform({listed}, lambda x: {trimmed('x')}), {rule}) "
        f"ELSE regexp_matches({rest}, '^($|[ \t\r\n*/#\"'')\\]}}])') END"
    )


def placeholder(s: str, b: str) -> str:
    """Whether the trimmed text ``s``, with its bytes ``b``, is a placeholder."""
    tests = [f"lower({s}) IN ({', '.join(map(quoted, T.WEAK))})", f"{s} = ''", f"list_bool_or(list_transform({_list(T.FILLERS)}, lambda w: contains(lower({s}), w)))"]
    tests += [f"regexp_matches({s}, {quoted(('(?i)' if fold else '') + p)})" for p, fold in T.PLACEHOLDER_PATTERNS]
    tests += [f"(len({b}) >= 8 AND len(list_distinct({b})) = 1)", f"(len({b}) >= 12 AND len(list_distinct({b})) < 5)"]
    tests.append(f"coalesce(list_bool_or(list_transform(range(1, greatest(len({b}) - 6, 1)), lambda i: len({b}) >= i + 7 AND len(list_distinct({b}[i:i + 7])) = 1)), false)")
    return f"coalesce({' OR '.join(tests)}, false)"


def pem(following: str) -> str:
    t = trimmed(following)
    return rf"coalesce(regexp_matches({t}, '^(Version|Comment|DEK-Info|Proc-Type):') OR regexp_matches({t}, '^[+/=0-9A-Za-z]{{32,}}\z'), false)"


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ 0xEDB88320 if n & 1 else n >> 1
        out.append(n)
    return out


def crc32(x: str) -> str:
    """CRC-32 of an ASCII text."""
    table = f"[{', '.join(map(str, _crc_table()))}]::BIGINT[]"
    return f"xor(list_reduce(list_transform(string_split({x}, ''), lambda ch: ascii(ch)::BIGINT), lambda c, d: xor(c >> 8, ({table})[(xor(c, d) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def github_checksum(secret: str) -> str:
    body = rf"regexp_extract({secret}, '^[^_]*_((?s:.)*)$', 1)"
    digits = " || ".join(f"substr('{BASE62}', (({crc32(f'{body}[1:30]')} // {62**k}) % 62 + 1)::INTEGER, 1)" for k in range(5, -1, -1))
    return f"CASE WHEN strlen({body}) = 36 THEN {body}[31:36] = ({digits}) ELSE false END"


def github_pat(secret: str) -> str:
    return f"regexp_full_match({secret}, 'github_pat_[0-9A-Za-z]{{22}}_[0-9A-Za-z]{{59}}')"


def jwt(secret: str) -> str:
    head = f"string_split({secret}, '.')[1]"
    text = f"TRY(decode(from_base64(translate({head}, '-_', '+/') || repeat('=', (4 - length({head}) % 4) % 4))))"
    plain = f"regexp_full_match({head}, '[0-9A-Za-z_-]+') AND length({head}) % 4 <> 1"
    good = f"CASE WHEN json_valid({text}) THEN json_type({text}) = 'OBJECT' AND coalesce(json_type({text}, '$.alg') = 'VARCHAR', false) AND coalesce(({text}::JSON ->> 'alg') <> '', false) ELSE false END"
    return f"CASE WHEN len(string_split({secret}, '.')) = 3 AND {plain} THEN coalesce({good}, false) ELSE false END"


VALIDATORS = {"github-crc32": github_checksum, "github-pat-structure": github_pat, "jwt": jwt}


def path_flags(path: str) -> dict[str, str]:
    """The seven flags of a path, by name."""
    low = f"lower(replace({path}, chr(92), '/'))"
    base = rf"regexp_extract(rtrim({low}, '/'), '[^/]*\z')"
    folder = rf"('/' || regexp_extract({low}, '^((?s:.)*/)?[^/]*\z', 1))"
    inside = lambda names: f"regexp_matches({folder}, '/(?:{names})/')"
    return {
        "is_example": rf"regexp_matches({base}, '\.(?:example|sample|template|dist)') OR {inside('|'.join(('demo', 'demos', 'sample', 'samples', 'example', 'examples')))}",
        "is_doc": rf"regexp_matches({base}, '\.(?:md|mdx|markdown|rst|adoc|txt)\z') OR {inside('doc|docs|documentation')}",
        "is_test": rf"regexp_matches({base}, '_test\.|\.test\.|_spec\.|\.spec\.|test_') OR {inside('|'.join(T.TEST_DIRS))}",
        "is_lockfile": f"{base} IN ({', '.join(map(quoted, T.LOCKFILES))})",
        "is_vendored": holds(low, T.VENDOR),
        "is_generated": rf"regexp_matches({base}, '(?:\.pb|_generated|\.generated|_gen)\.go\z|\.designer\.cs\z')",
        "is_minified": rf"regexp_matches({base}, '\.min\.|\.map\z') OR {inside('dist|build')}",
    }


def reason(flags: dict[str, str]) -> str:
    """The first of the flags that holds, in words; empty if none does."""
    return "CASE " + " ".join(f"WHEN {flags[f]} THEN {quoted(why)}" for f, why in zip(T.CONTEXT_FLAGS, T.REASONS)) + " ELSE '' END"


def _sample(line: str, most: int = 200) -> str:
    s = trimmed(line)
    return f"CASE WHEN strlen({s}) <= {most} THEN {s} ELSE left({s}, list_max(list_filter(range(0, {most} + 1), lambda n: strlen(left({s}, n)) <= {most}))) || '...' END"


def redacted(s: str) -> str:
    return f"CASE WHEN contains({s}, '-----BEGIN') THEN {trimmed(s)} WHEN length({s}) <= 8 THEN repeat('*', length({s})) ELSE left({s}, 4) || '...' || right({s}, 4) END"


def fingerprint(rule_id: str, path: str, secret: str) -> str:
    return f"left(sha256({rule_id} || chr(0) || {path} || chr(0) || {secret}), 24)"


def _label(rank: str, labels: tuple[str, ...]) -> str:
    return f"(CASE {rank} " + " ".join(f"WHEN {k + 1} THEN {quoted(x)}" for k, x in enumerate(labels)) + " END)"


def findings(files: str, header_lines: int | None = 3, head: int = 8192) -> str:
    """From ``files AS (path, content)`` to ``finding``, all as common table expressions without WITH."""
    rules = catalogue()
    banner = f"left(coalesce(content, ''), {head})"
    if header_lines:
        banner = f"list_aggregate(string_split({banner}, chr(10))[1:{header_lines}], 'string_agg', chr(10))"
    flags = path_flags("path")
    flags["is_generated"] = f"({flags['is_generated']} OR regexp_matches(lower({banner}), {quoted(T.BANNERS)}))"
    checks = "CASE validator " + " ".join(f"WHEN '{k}' THEN {f('secret')}" for k, f in VALIDATORS.items()) + " ELSE false END"
    overlap = "k.s < x[1].s + x[1].n AND x[1].s < k.s + k.n"
    place = f"coalesce(list_position(list_transform(acc, lambda k: {overlap}), true), 0)"
    fold = f"lambda acc, x: CASE WHEN {place} = 0 THEN list_concat(acc, x) WHEN x[1].score > acc[{place}].score THEN list_concat(list_concat(acc[:{place} - 1], x), acc[{place} + 1:]) ELSE acc END"
    hit = "{'rule': rule, 's': s, 'n': n, 'secret': secret, 'entropy': entropy, 'rank': rank, 'score': score, 'validated': validated, 'engines': engines, 'notes': notes, 'deferred': deferred}"
    now = "(a.t + x.hits - x.resolved)"
    take = f"least(x.runs, {PER_LINE} - {now} % {PER_LINE})"
    return rf"""files AS ({files}), {lines_sql()},
{facts(rules)},
ctx AS (SELECT id, ({reason(flags)}) AS reason FROM named),
ok AS (SELECT *, {LOW.format('line')} AS low FROM l WHERE strlen(line) BETWEEN 1 AND {LINE_BYTES}),
m AS ({' UNION ALL '.join(_one_rule(k, r) for k, r in enumerate(rules))}),
pat AS (SELECT *, unnest(range(1, least({PER_LINE}, len(g3)) + 1)) AS i FROM m),
runs AS (SELECT *, regexp_extract_all(line, '((?s:.)*?)([0-9A-Za-z+/=_-]{{20,}})', 1) AS g, regexp_extract_all(line, '((?s:.)*?)([0-9A-Za-z+/=_-]{{20,}})', 2) AS r FROM ok WHERE {holds('low', CONTEXT_WORDS)}),
run AS (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM runs),
found AS (
  SELECT id, path, line_no, line, prev, next, rule, (coalesce(list_sum(list_transform(g0[:i - 1], lambda x: strlen(x))), 0) + strlen(g1[i]) + strlen(g2[i]))::BIGINT AS s, g3[i] AS secret FROM pat
  UNION ALL SELECT id, path, line_no, line, prev, next, -1, (list_sum(list_transform(g[:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(r[:i - 1], lambda x: strlen(x))), 0))::BIGINT, r[i] FROM run),
sized AS (SELECT f.*, strlen(secret) AS n, {bytes_of('secret')} AS b, {trimmed('secret')} AS bare, {bytes_of(trimmed('secret'))} AS bare_b, facts.* EXCLUDE (rule), reason,
  CASE WHEN regexp_full_match(secret, '[0-9A-Fa-f]+') THEN 'hex' WHEN regexp_full_match(secret, '[0-9A-Za-z+/=_-]+') THEN 'base64' ELSE 'other' END AS kind
  FROM found f JOIN facts ON f.rule = facts.rule JOIN ctx ON f.id = ctx.id),
real AS (SELECT * FROM sized WHERE (rule >= 0 OR kind <> 'other') AND NOT ({directive('line', 'rule_id')} OR {directive('prev', 'rule_id')}) AND NOT {placeholder('bare', 'bare_b')}),
checked AS (SELECT *, CASE WHEN rule < 0 OR floor > 0 THEN {shannon('b')} ELSE 0 END AS entropy, {checks} AS validated FROM real),
judged AS (SELECT *, entropy >= floor AS high, CASE WHEN rule < 0 THEN 1 ELSE greatest(1, least(3, (CASE WHEN validated THEN 3 ELSE base + (CASE WHEN floor > 0 THEN CASE WHEN entropy >= floor THEN 1 ELSE -1 END ELSE 0 END) - (CASE WHEN validator <> '' THEN 1 ELSE 0 END) END) - (CASE WHEN reason <> '' THEN 1 ELSE 0 END))) END AS rank
  FROM checked WHERE rule >= 0 OR entropy >= CASE kind WHEN 'hex' THEN 3.0 ELSE 4.5 END),
scored AS (SELECT *, weight + rank + CASE WHEN validated THEN 1000 ELSE 0 END AS score,
  CASE WHEN rule < 0 THEN 'entropy' ELSE concat_ws(',', 'pattern', CASE WHEN floor > 0 AND high THEN 'entropy' END, CASE WHEN validated THEN 'validator' END) END AS engines,
  concat_ws(';', CASE WHEN floor > 0 AND NOT high THEN printf('entropy %.2f is under the rule''s %.2f', entropy + 1e-10, floor) END, CASE WHEN validator <> '' AND NOT validated THEN 'its checksum or structure is wrong' END, CASE WHEN reason <> '' THEN reason END) AS notes FROM judged),
by_line AS (SELECT id, path, line_no, any_value(line) AS line, any_value({pem('next')}) AS pem, list({hit} ORDER BY rule, s, n, secret) AS every FROM scored GROUP BY id, path, line_no),
capped AS (SELECT *, list_filter(every, lambda f: f.rule >= 0 AND len(list_filter(every, lambda g: g.rule >= 0 AND g.rule < f.rule)) < {PER_LINE}) AS h FROM by_line),
kept AS (SELECT *, CASE WHEN len(h) < 2 THEN h ELSE list_reduce(list_transform(h, lambda f: [f]), {fold}) END AS best FROM capped),
lasting AS (SELECT id, path, line_no, line, list_filter(best, lambda k: NOT k.deferred OR pem) AS hits, len(list_filter(best, lambda k: k.deferred AND pem)) AS resolved,
  list_filter(every, lambda c: c.rule < 0 AND NOT coalesce(list_bool_or(list_transform(best, lambda k: c.s < k.s + k.n AND k.s < c.s + c.n)), false)) AS free FROM kept),
per_file AS (SELECT id, list({{'hits': len(hits), 'runs': len(free), 'resolved': resolved, 't': 0::BIGINT, 'taken': []::BIGINT[]}} ORDER BY line_no) AS rows, list(line_no ORDER BY line_no) AS nos FROM lasting GROUP BY id),
walked AS (SELECT id, nos, list_reduce(list_concat([{{'hits': 0::BIGINT, 'runs': 0::BIGINT, 'resolved': 0::BIGINT, 't': 0::BIGINT, 'taken': []::BIGINT[]}}], rows),
  lambda a, x: {{'hits': 0::BIGINT, 'runs': 0::BIGINT, 'resolved': 0::BIGINT, 't': {now} + {take} + x.resolved, 'taken': list_append(a.taken, {take})}}).taken AS taken FROM per_file),
taken AS (SELECT id, unnest(nos) AS line_no, unnest(taken) AS taken FROM walked),
flat AS (SELECT l.id, l.path, l.line_no, l.line, unnest(list_concat(l.hits, l.free[:t.taken])) AS f FROM lasting l JOIN taken t ON l.id = t.id AND l.line_no = t.line_no),
finding AS (SELECT rule_id, CASE WHEN f.rule < 0 THEN printf('String of high entropy, %s (%.2f bits per byte)', CASE WHEN regexp_full_match(f.secret, '[0-9A-Fa-f]+') THEN 'hex' ELSE 'base64' END, f.entropy + 1e-10) ELSE description END AS description,
  severity, {_label('f.rank', T.CONFIDENCE)} AS confidence, f.engines AS engines, tags, f.notes AS notes, path, line_no::INTEGER AS line, (f.s + 1)::INTEGER AS start_column, (f.s + f.n + 1)::INTEGER AS end_column,
  {_sample('line')} AS line_sample, f.secret AS secret, {redacted('f.secret')} AS redacted, f.entropy AS entropy, validator, f.validated AS validated, {fingerprint('rule_id', 'path', 'f.secret')} AS fingerprint, left(sha256(f.secret), 32) AS secret_hash, id
  FROM flat JOIN facts ON f.rule = facts.rule)"""
