"""The training-data operators against brute force, round trips, and odd input."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from keysift.llm import chat, common, decontaminate, line_dedup, lm_score, near_copies, packing, quality, repeats, simhash, url_filter, warc
from keysift.llm.elias_fano import EliasFano

SYL = "an the of er re tion ing con ment est ar li qua for ist und ver".split()


def word(rng):
    return "".join(rng.choice(SYL) for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="module")
def corpus():
    """Texts with nulls, blanks, copies, near-copies, repeated lines and a long one."""
    rng = random.Random(5)
    line = lambda n: " ".join(word(rng) for _ in range(n))
    texts = ["\n".join(line(rng.randint(5, 25)) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    for k in range(20):
        w = texts[k].split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    shared = line(45)
    texts += [texts[0], texts[0], None, "", " \n\t ", "one", "two words", f"{line(9)}\n{shared}", f"{shared}\n{line(9)}", line(3000), "ÄÖ é\r\nx", texts[3] + "\n" + texts[3]]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, f"s{i % 3}", "clash") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, fp string").repartition(5)


@pytest.fixture
def folder(spark):
    return common.shared_dir(spark)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((0, 10), (1, 1), (500, 600), (400, 10**9), (300, 1 << 50)):
        x = np.sort(rng.integers(0, u, n))
        ef = EliasFano.build(x, u)
        if n:
            assert (ef.get(np.arange(n)) == x).all()
        probe = np.concatenate([x, rng.integers(0, u, 200)])
        got = ef.find(probe)
        assert all((g >= 0 and x[g] == p) if p in set(x.tolist()) else g == -1 for g, p in zip(got.tolist(), probe.tolist()))


def test_components(spark, folder):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None)]
    s = Sets()
    for a, b in links:
        if b is not None and a != b:
            s.link(a, b)
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long"), folder).collect()}
    assert got == {x: s.find(x) for x in s.up}
    assert common.components(spark.createDataFrame([], "a long, b long"), folder).count() == 0


def test_lm_score_is_a_model(spark, docs, corpus, folder):
    train = [low(t) for i, t in corpus if zlib.crc32(str(i).encode()) % 5 != 1]
    got = {r["doc_id"]: r for r in lm_score.score(docs, folder, *lm_score.train(docs.where(~lm_score.held_out(F.col("doc_id"))), folder)).collect()}
    toks = [words(t) + ["\n"] for t in train]
    u = Counter(w for t in toks for w in t)
    n, v = sum(u.values()), len(u)
    for i, t in corpus:
        w = words(low(t)) + ["\n"]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(u[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((u[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    empty = docs.where("false")
    assert lm_score.score(docs, f"{folder}/e", *lm_score.train(empty, f"{folder}/e")).where("n_known > 0").count() == 0
    assert lm_score.score(empty, folder, *lm_score.train(docs, f"{folder}/f")).count() == 0


def test_lm_scores_match_brute_force(spark, docs, corpus, folder):
    train = [[*words(low(t)), "\n"] for i, t in corpus if zlib.crc32(str(i).encode()) % 5 != 1]
    one, two, three = (Counter(tuple(t[k : k + n]) for t in train for k in range(len(t) - n + 1)) for n in (1, 2, 3))
    follow = {n: Counter(g[:-1] for g in c) for n, c in ((2, two), (3, three))}
    followed = Counter()
    for g, n in three.items():
        followed[g[:-1]] += n
    total, size, d = sum(one.values()), len(one), lm_score.D

    def p(g):
        if len(g) == 1:
            return (one[g] + 0.5) / (total + 0.5 * (size + 1))
        seen, context = (two, one[g[:1]]) if len(g) == 2 else (three, followed[g[:2]])
        kinds = follow[len(g)][g[:-1]]
        return (max(seen[g] - d, 0) + d * kinds * p(g[1:])) / context if kinds else p(g[1:])

    got = {r["doc_id"]: r["score"] for r in lm_score.score(docs, folder, *lm_score.train(docs.where(~lm_score.held_out(F.col("doc_id"))), folder)).collect()}
    once = 0
    for i, t in corpus:
        w = [*words(low(t)), "\n"]
        want = sum(math.log10(p(tuple(w[max(0, k - 2) : k + 1]))) for k in range(len(w)))
        assert got[i] == pytest.approx(want, abs=1e-3 * len(w)), i
        once += zlib.crc32(str(i).encode()) % 5 == 1 and any(three[tuple(w[k : k + 3])] == 1 for k in range(len(w) - 2))
    assert once  # held-out texts with trigrams that training has just once


@pytest.mark.parametrize("compress", [True, False])
def test_warc_round_trip_rejects_magic_in_payloads(spark, folder, compress):
    fake = warc.record(99, "http://x", b"trap", "A" * 32, 4, None).decode()
    bodies = ["<p>a</p>", None, "", fake, fake * 3, "x" * 300_000, "<p>a</p>", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"] + [f"page {i} {fake}" for i in range(40)]
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i % 5 else None, b) for i, b in enumerate(bodies)], "page_id long, url string, html string").repartition(2)
    common.open_fs(f"{folder}/w")[0].create_dir(common.open_fs(f"{folder}/w")[1])
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages, f"{folder}/w", compress=compress), folder, compress, size=4096).collect()}
    assert sorted(got) == list(range(len(bodies)))
    for i, b in enumerate(bodies):
        raw = (b or "").encode()
        last = max(k for k, x in enumerate(bodies) if (x or "") == (b or ""))
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if last == i else ("revisit", last))
        assert r["payload"] is None or bytes(r["payload"]) == raw


def test_repeats_match_brute_force(spark, docs, corpus, folder, monkeypatch):
    data = [(i, (t or "").encode()) for i, t in corpus]
    seen = Counter(b[k : k + 200] for _, b in data for k in range(len(b) - 199))
    for size in (1 << 20, 1500):
        monkeypatch.setattr(repeats, "BUFFER", size)
        got = {r["doc_id"]: r for r in repeats.find_repeats(docs, f"{folder}/{size}").collect()}
        for i, b in data:
            mask = bytearray(len(b))
            for k in range(len(b) - 199):
                if seen[b[k : k + 200]] > 1:
                    mask[k : k + 200] = b"\1" * 200
            assert bytes(got[i]["kept"]) == bytes(x for x, m in zip(b, mask) if not m), i
            assert len(got[i]["spans"]) == sum(1 for k, g in itertools.groupby(mask) if k)
    assert repeats.find_repeats(docs.where("false"), f"{folder}/none").count() == 0


def test_decontamination(spark, folder):
    rng = random.Random(9)
    items = [(k, f"{' '.join(word(rng) for _ in range(12))}. {' '.join(word(rng) for _ in range(10 + 20 * k))}.") for k in range(8)] + [(20, None), (21, " ")]
    fill = lambda n: " ".join(word(rng) for _ in range(n))
    rows = [(k, f"{fill(rng.randrange(200))} {t.upper() if k % 2 else t} {fill(90)}") for k, t in items if t and t.strip()]
    rows += [(100 + k, fill(400)) for k in range(10)] + [(200, None), (201, ""), (202, items[3][1][: len(items[3][1]) // 2]), (None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench, folder).collect()}
    assert got == {(k, k) for k in range(8)} | {(None, 0)}
    assert decontaminate.drop_contaminated(docs, bench, folder).count() == len(rows) - 8
    assert decontaminate.contaminated(docs, bench.where("false"), folder).count() == 0


def test_wand_finds_what_full_scores_find():
    rng = np.random.default_rng(2)
    items = [(k, rng.integers(0, 60, rng.integers(1, 30)), rng.integers(0, 60, 5)) for k in range(90)]
    index = decontaminate.Index(items)
    for _ in range(20):
        terms = np.unique(rng.integers(0, len(index.terms), 25))
        p, s, score = index.search(np.zeros(len(terms), np.int64), terms, 0.4)
        full = Counter()
        for t in terms:
            for b in range(index.term_start[t], index.term_end[t]):
                for k in range(index.block_start[b], index.block_end[b]):
                    full[int(index.segment[k])] += index.impact[k]
        assert {k: round(v, 9) for k, v in full.items() if v >= 0.4 - 1e-9} == {k: round(v, 9) for k, v in zip(s.tolist(), score.tolist())}


def test_simhash_matches_all_pairs(spark, docs, corpus, folder):
    def fp(t):
        w = words(low(t))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps, s = {i: fp(t) for i, t in corpus}, Sets()
    for a, b in itertools.combinations(fps, 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            s.link(a, b)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs, folder).collect()}
    assert got == {i: (f"{f:016x}", s.find(i)) for i, f in fps.items()}
    assert simhash.simhash_components(docs.where("false"), folder).count() == 0


def test_anchors_meet_every_pair(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base]
    rows = [(x - (1 << 64) if x >> 63 else x,) for x in {*base, *near}]
    links = simhash.link_fingerprints(spark.createDataFrame(rows, "fp long"), homes=1).collect()
    want = {frozenset((a, b)) for (a,), (b,) in itertools.combinations(rows, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert {frozenset((r["a"], r["b"])) for r in links} == want


def test_near_copies_match_all_pairs(spark, docs, corpus, folder):
    rng = random.Random(6)
    base = [[word(rng) for _ in range(120)] for _ in range(12)]
    edited = []
    for k, w in enumerate(base):
        for n in range(3):  # one to three words changed: Jaccard about 0.92 to 0.77
            v = list(w)
            for at in rng.sample(range(5, 115), n + 1):
                v[at] = "changed"
            edited.append((1000 + 10 * k + n, " ".join(v)))
        edited.append((900 + k, " ".join(w)))
    rows = [*corpus, *edited, (None, edited[0][1].upper()), (1000, edited[0][1])]
    cut = lambda t: frozenset(tuple(w[i : i + 5]) for w in [words(low(t))] for i in range(max(1, len(w) - 4)))
    sets, s = [cut(t) for _, t in rows], Sets()
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    place = {k: n for n, k in enumerate(order)}
    for a, b in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            s.link(place[a], place[b])
    want = sorted(rows[k][0] for k in order if s.find(place[k]) == place[k])
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    got = near_copies.drop_near_copies(df, folder)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == want
    assert near_copies.drop_near_copies(df.where("false"), f"{folder}/none").count() == 0


def test_quality_numbers(docs, corpus):
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t in corpus:
        w, t = words(t), t or ""
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = len({k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)})
        ls = [x for x in t.split("\n") if words(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), rep, len(ls) - len(set(ls))), i
        assert r["base_failed"] == (len(w) < 10 or 100 * rep > 20 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert quality.judge(docs.where("false")).count() == 0


def test_bad_hosts_fall_and_good_ones_stay(spark):
    fine = " ".join(f"w{k}" for k in range(30))
    rows = [(i, fine if i % 20 else "x", "good") for i in range(200)] + [(1000 + i, fine if i % 25 == 0 else "x y", "bad") for i in range(200)] + [(5000, fine, None)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[1] and not got[0] and not got[1000] and got[5000]


def test_every_row_is_kept_on_its_own_verdict(spark):
    fine = " ".join(f"w{k}" for k in range(30))
    rows = [(None, fine, "good"), (None, "x", "good"), (7, fine, "good"), (7, "x", "good"), (None, fine, None)] + [(k, fine, "good") for k in range(100, 140)] + [(1000 + k, fine if k % 25 == 0 else "x y", "bad") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality.keep_good(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in got.collect()), key=str) == sorted((r for r in rows if r[1] == fine and r[2] != "bad"), key=str)
    assert quality.keep_good(df.where("false")).count() == 0


def test_line_dedup_matches_all_pairs(spark, docs, corpus, folder):
    cut = lambda t: frozenset(t[k : k + 10] for k in range(max(1, len(t) - 9)))
    ls = [(i, k, x) for i, t in corpus for k, x in enumerate((t or "").split("\n")) if words(x)]
    first, s = {}, Sets()
    for i, k, x in ls:
        first.setdefault(x, (i, k))
    for a, b in itertools.combinations(first, 2):
        p, q = cut(a), cut(b)
        if len(p & q) >= 0.8 * len(p | q):
            s.link(first[a], first[b])
    want = {(i, k) for i, k, x in ls if s.find(first[x]) != (i, k)}
    assert {(r["doc_id"], r["line_no"]) for r in line_dedup.duplicate_lines(docs, folder).collect()} == want
    kept = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs, f"{folder}/2").collect()}
    for i, t in corpus:
        lost = {k for d, k in want if d == i}
        left = "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in lost)
        assert kept.get(i, "gone") == ((t if not lost else left) if not lost or words(left) else "gone")


def test_chat_folds_events_and_reads_back(spark):
    said = "</s>[INST] ok \\ [/INST]\n<s>"
    for role, text in (("user", said), ("assistant", said), ("a\nb[INST]", ""), ("", "\\l")):
        piece, a, z = chat.render(role, text)
        assert list(chat.parse(piece * 2)) == [(role, text)] * 2 and (role != "assistant" or chat.unescape(piece[a:z]) == text)
    log = [(1, 0, "message", "user", "hi", None), (1, 1, "message", "assistant", "he", None), (1, 2, "delta", None, "llo", None), (1, 3, "edit", None, "hey", 0), (1, 4, "regenerate", None, "", None), (1, 5, "delta", None, "yes", None), (None, 1, None, None, None, None)]
    rows = chat.format_chats(spark.createDataFrame(log, "conv_id long, turn long, kind string, role string, text string, target int"), kind="kind", target="target").collect()
    assert {r["conv_id"]: r["formatted"] for r in rows} == {1: "[INST]user\nhey[/INST]<s>yes</s>", None: "[INST]\n[/INST]"}
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_packing_is_exact_and_as_few_as_can_be(spark, docs, corpus, folder):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, folder, path, 512).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text in corpus:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in sorted(by[i], key=lambda r: r["piece"])] == [(a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes())) for a in range(0, len(ids), 512)]
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 512


def test_bin_completion_reaches_the_optimum():
    def optimum(items, cap):
        best = [len(items)]

        def go(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + items[k] <= cap:
                    bins[j] += items[k]
                    go(k + 1, bins)
                    bins[j] -= items[k]
            go(k + 1, [*bins, items[k]])

        go(0, [])
        return best[0]

    rng = random.Random(8)
    for _ in range(40):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        plan = packing.pack(dict(Counter(items)), 20)
        assert sorted((k for n, b in plan for k in b * n), reverse=True) == items and all(sum(b) <= 20 for _, b in plan)
        assert sum(n for n, _ in plan) == optimum(items, 20) >= packing.lower_bound(dict(Counter(items)), 20)
    assert packing.pack({}) == []


def test_urls_and_colliding_digests(spark):
    urls = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "x://org", "http://notexample.org/es/", None, "", "no scheme/", "http://com/de/?", "http://a.com/fr/#x", "http://example.org?x/es/"]
    want = [("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", None), ("allow", "org/"), ("allow", None), ("allow", None), ("allow", None), ("block", "com/de/"), ("allow", "com/fr/"), ("allow", None)]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for digest in (url_filter.xx64, lambda b: len(b) % 3):
        got = sorted(url_filter.judge_urls(df, url_filter.RULES, digest=digest).collect(), key=lambda r: r["page_id"])
        assert [(r["verdict"], r["rule"]) for r in got] == want
    assert got[0]["host"] == "a.example.org" and got[0]["path"] == "/es/x"
    assert url_filter.judge_urls(df, []).where("verdict != 'allow'").count() == 0
