"""The ten operators against brute force on small rows: nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

from __future__ import annotations

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

from quillstone.llm import bpe, decontam, elias_fano, html_cut, langid, license_scan, line_dedup, lm_trie, quality_crf, simhash, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(11)
VOCAB = ["ba", "ce", "di", "fo", "gu", "ha", "ki", "lo", "mu", "ne", "Pa", "Ré", "ñu", "sol", "Tin", "um9", "vex", "wix"]


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


PASSAGE = prose(60)
ROWS = [
    (1, PASSAGE + "\n" + prose(30)), (2, prose(12) + "\n" + PASSAGE), (3, prose(9) + "\n" + PASSAGE + "\nend"), (4, None), (5, ""), (6, " \t\n"),
    (7, "one"), (8, "one two"), (9, prose(4000)), (10, prose(40)), (10, prose(41)), (11, "same text here again and again"), (11, "same text here again and again"), (12, "same text here again and again"),
    (None, prose(20)), (None, None), (13, "%%% ### $$$ 123 !!!"), (14, "x" * 5000), (15, "línea única — ¿qué?\r\n🙂🙂"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "es" if (i or 0) % 2 else "en", "s", len(t or "")) for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def rows(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


# --- 1 -----------------------------------------------------------------------------------------------------------


def test_elias_fano_round_trip(tmp_path):
    rng = np.random.default_rng(2)
    for n, top in ((0, 9), (1, 0), (7, 3), (900, 10**5), (3000, 2**63), (50, 2**64 - 1)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        (tmp_path / "f").write_bytes(elias_fano.packed(elias_fano.EliasFano.build(v).arrays("a")))
        e = elias_fano.EliasFano.of(elias_fano.mapped(str(tmp_path / "f")), "a")
        assert (e.at(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, top, 300, dtype=np.uint64, endpoint=True)])
        held = set(v.tolist())
        for x, k in zip(q.tolist(), e.find(q).tolist()):
            assert (k >= 0) == (x in held) and (k < 0 or int(v[k]) == x)


def brute_lm(train, texts):
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [" "]
    one, two, three = Counter(), Counter(), Counter()
    for t in train:
        w = tok(t)
        one.update(w)
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    n, v, d = sum(one.values()), len(one), 0.5
    kept1, kept2 = Counter(), Counter()
    for (a, _), c in two.items():
        kept1[a] += c - d
    for (a, b, _), c in three.items():
        kept2[a, b] += c - d
    p1 = lambda w: max(one[w] - d, 0) / max(n, 1) + (d * v / n if v else 1.0) / (v + 1)
    p2 = lambda a, b: p1(b) if a not in one else max(two.get((a, b), d) - d, 0) / one[a] + max(1e-9, 1 - kept1[a] / one[a]) * p1(b)
    p3 = lambda a, b, c: p2(b, c) if (a, b) not in two else max(three.get((a, b, c), d) - d, 0) / two[a, b] + max(1e-9, 1 - kept2[a, b] / two[a, b]) * p2(b, c)
    out = []
    for t in texts:
        w = tok(t)
        s = math.log10(p1(w[0])) + sum(math.log10(p2(*x)) for x in zip(w[:1], w[1:2])) + sum(math.log10(p3(*x)) for x in zip(w, w[1:], w[2:]))
        out.append((len(w), sum(one[x] > 0 for x in w), n, sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), s))
    return out


def test_lm_scores(docs, none, spark):
    got = lm_trie.result(docs).collect()
    assert len(got) == len(ROWS)
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    want = brute_lm([t for i, t in ROWS if not held(i)], [t for _, t in ROWS])
    mine = Counter((i, held(i), *w[:3], round(w[3], 6)) for (i, _), w in zip(ROWS, want))
    assert mine == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    by_base = {(i, round(w[3], 6)): w for (i, _), w in zip(ROWS, want)}
    for r in got:
        assert abs(by_base[r.doc_id, round(r.base_score, 6)][4] - r.score) <= 0.034 * r.n_tokens  # half a step of a probability and half a step of a back-off weight
    assert lm_trie.result(none).collect() == []


def test_lm_with_frequent_words_over_several_shards(docs, spark):
    """The successors of one word, and the trigrams of its bigrams, lie in many shards."""
    meta = lm_trie.trained(docs, limit=40)
    assert len(meta.bounds) > 30 and len(meta.firsts) > 60 and any(meta.leads)
    want = brute_lm([t for _, t in ROWS], [t for _, t in ROWS])
    got = lm_trie.scored(docs, meta, ["doc_id"]).collect()
    left = Counter((i, w[0], w[1], w[2]) for (i, _), w in zip(ROWS, want))
    assert left == Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got)
    for r in got:
        assert any(i == r.doc_id and abs(w[3] - r.base_score) < 1e-6 and abs(w[4] - r.score) <= 0.034 * r.n_tokens for (i, _), w in zip(ROWS, want))


def test_lm_without_training_rows(spark, none):
    meta = lm_trie.trained(none)
    r = lm_trie.scored(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), meta, ["doc_id"]).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


# --- 2 -----------------------------------------------------------------------------------------------------------

LANGS = {"en": ["the", "and", "of", "that", "with", "which", "this", "there"], "es": ["que", "los", "para", "una", "con", "ción", "año", "más"], "de": ["und", "der", "nicht", "eine", "mit", "für", "auch", "über"]}


def test_language_id_held_out_accuracy(spark):
    rng = random.Random(4)
    data = [(i, " ".join(rng.choice(LANGS[k]) for _ in range(rng.randint(3, 40))), k) for i in range(600) for k in [rng.choice(list(LANGS))]]
    df = spark.createDataFrame([*data, (9001, None, "en"), (9002, "123 !!", "en"), (9003, "the and of", None)], "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in langid.result(df).collect()}
    assert out[9001].lang_pred == out[9002].lang_pred == "und" and out[9001].score == 0 and not out[9002].accepted
    assert out[9003].lang_pred == "en"
    held = [(i, k) for i, _, k in data if out[i].held_out]
    assert sum(out[i].lang_pred == k for i, k in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())


def test_language_id_edges(docs, none):
    assert langid.result(none).collect() == []
    assert langid.result(docs).count() == len(ROWS)
    odd = docs.withColumn("score", F.lit("own")).withColumn("accepted", F.lit(3))
    kept = langid.accepted(odd)
    assert kept.columns == odd.columns and kept.where("score <> 'own' or accepted <> 3").count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.result(unlabelled).collect()} == {"und"}


# --- 3 -----------------------------------------------------------------------------------------------------------


def test_min_cut_is_optimal():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(1, 7)
        s, t = [rng.random() * 2 for _ in range(n)], [rng.random() * 2 for _ in range(n)]
        e = {(i, j): rng.random() for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(n)) + sum(w for (i, j), w in e.items() if x[i] != x[j])  # noqa: B023, E731
        assert cost(html_cut.min_cut(s, t, e)) == pytest.approx(min(map(cost, itertools.product([True, False], repeat=n))))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>if (a<b) x("</p>")</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>Title &amp; more</h1>
<p>First   <b>bold</b> words of the text, &eacute;t&#233;.</p><div class="ad">Buy now!</div><p>Second paragraph with enough words to be text.<br>And a line.
<form><label>Mail</label><input></form></article><aside>Related</aside><section id="comments"><p>A reader says something long and nice here, really.</p></section><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert html_cut.main_text(PAGE) == "Title & more\nFirst bold words of the text, été.\nSecond paragraph with enough words to be text. And a line."
    plain = "<body><div class=menu><a href=x>One</a> <a href=y>Two</a></div><div><p>" + "Some longer words of a text. " * 8 + "</p><p>" + "More of it follows here. " * 8 + "</p></div></body>"
    assert html_cut.main_text(plain).startswith("Some longer") and "One" not in html_cut.main_text(plain)
    assert html_cut.main_text(None) == html_cut.main_text("") == html_cut.main_text("<p") == ""
    assert html_cut.main_text("<article>" + "<p>Word after word.</p>" * 5000 + "</article>").count("\n") == 4999


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    got = html_cut.result(df).collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got)
    assert html_cut.result(df.limit(0)).collect() == []


# --- 4 -----------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    urls = [
        ("http://A.Example.com/en/712?x", "a.example.com", "/en/712", "example.com/en/7", "allow"), ("https://b.example.com/en/81", "b.example.com", "/en/81", "com/en/", "block"),
        ("http://example.net/de/88", "example.net", "/de/88", "example.net/de/8", "block"), ("http://other.net/de/88#f", "other.net", "/de/88", "net/de/", "allow"), ("http://x.org/es/", "x.org", "/es/", "org/es/", "block"),
        ("http://notcom/en/", "notcom", "/en/", None, "allow"), ("ftp://com/en/1", "com", "/en/1", "com/en/", "block"), (None, "", "", None, "allow"), ("no scheme.com/en/", "", "", None, "allow"), ("http://", "", "", None, "allow"),
        ("http://m.spam-farm.example.org/fr/1", "m.spam-farm.example.org", "/fr/1", None, "block"), ("http://h.com?q=/en/", "h.com", "", None, "allow"), ("x://é.com/en/ñ", "é.com", "/en/ñ", "com/en/", "block"),
    ]
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls * 2)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.result(df).collect()}
    assert got == {i: u[1:] for i, u in enumerate(urls * 2)}
    assert url_filter.result(df.limit(0)).collect() == []


def test_url_filter_large_and_empty_lists(spark):
    pages = spark.createDataFrame([(i, f"http://h{i}.example.com/p/{i}") for i in range(2000)], "page_id long, url string")
    listed = url_filter.listed_keys(spark, pages.where("page_id % 3 = 0"))
    none = spark.createDataFrame([], "host string, path string, verdict string")
    for size in (16 << 20, 64):  # a filter of one block lets much pass; the exact join removes it
        out = url_filter.judged(pages, none, listed, max_filter_bytes=size)
        assert {r.page_id for r in out.where("verdict = 'block'").collect()} == {i for i in range(2000) if i % 3 == 0}
    assert url_filter.judged(pages, none, listed.limit(0)).where("verdict <> 'allow'").count() == 0


# --- 5 -----------------------------------------------------------------------------------------------------------


def brute_licenses(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for name, text in license_scan.TEMPLATES:
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        k = min(5, len(x))
        s, d = ({tuple(y[i : i + k]) for i in range(len(y) - k + 1)} for y in (x, w))
        if len(s & d) >= 0.8 * len(s):
            out.append(name)
    return ",".join(sorted(out))


def test_license_scan(spark, docs, tmp_path):
    rng = random.Random(9)
    made = []
    for i in range(120):
        t = rng.choice(license_scan.TEMPLATES)[1].split()
        if i % 3 == 0 and len(t) > 8:
            t[rng.randrange(len(t))] = "other"
        made.append((i, prose(rng.randint(0, 90)) + " " + " ".join(t).upper() + ("\n" + prose(20)) * (i % 2)))
    df = spark.createDataFrame([*made, *ROWS, (500, PASSAGE * 40 + " All rights reserved. " + PASSAGE * 40)], "doc_id long, text string")
    want = Counter((i, brute_licenses(t)) for i, t in [(r.doc_id, r.text) for r in df.collect()])
    assert rows(license_scan.result(df), "doc_id", "licenses") == want
    duckdb = pytest.importorskip("duckdb")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    flat = lambda r: (*r[:3], r[3] and round(r[3], 9))
    mine = [tuple(r) for r in license_scan.result(df).select("doc_id", "n_licenses", "licenses", "containment").collect()]
    assert Counter(map(flat, mine)) == Counter(map(flat, con.execute(license_scan.ORACLE_SQL).fetchall()))
    assert license_scan.result(df.limit(0)).collect() == []
    empty = spark.createDataFrame([(None, None), ("e", "...")], "license_id string, text string")
    assert license_scan.scanned(df, empty).where("size(licenses) > 0").count() == 0
    assert license_scan.retrieval_probability(1 / 8, 48) > 0.998


# --- 6 -----------------------------------------------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    m = [0] * len(w)
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            m[i : i + 5] = [1] * 5
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(m), len(w) < 10 or 100 * sum(m) > 20 * len(w)


def test_quality_base_figures(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (13, 0, 0), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    extra = [(50, "a b c d e f\n" * 3), (51, " ".join(str(i) for i in range(6000)) + " " + " ".join(str(i) for i in range(40)))]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = quality_crf.result(df, labels)
    assert rows(got, *names) == Counter((i, *brute_quality(t)) for i, t in [*ROWS, *extra])
    assert got.where("base_failed and kept").count() == 0
    assert quality_crf.result(df.limit(0), labels.limit(0)).collect() == []


def test_crf_decodes_and_learns():
    rng = random.Random(1)
    good = lambda: ". ".join(prose(8) for _ in range(3)) + "."
    bad = lambda: " ".join(w + "###" for w in prose(15).split())
    samples = [(quality_crf.lines_of("\n".join(f() for _ in range(rng.randint(1, 6))))[1], f is good) for f in [good, bad] * 60]
    field = quality_crf.train(samples)
    mixed = [bad(), good(), good(), bad(), good()]
    labels = field.viterbi(quality_crf.lines_of("\n".join(mixed))[1])
    assert labels == ["#" not in m for m in mixed]
    f = quality_crf.lines_of("\n".join(mixed))[1]
    value = lambda ls: sum(sum(a * b for a, b in zip(field.weights, x)) * y for x, y in zip(f, ls)) + sum(field.moves[a][b] for a, b in zip(ls, ls[1:]))
    assert value([int(x) for x in labels]) == pytest.approx(max(value(ls) for ls in itertools.product([0, 1], repeat=5)))
    assert quality_crf.train([]) is quality_crf.PRIOR and field.viterbi([]) == []


# --- 7 -----------------------------------------------------------------------------------------------------------


def brute_contamination(ds, bench, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = {}
    for item, t in bench:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for i, t in ds:
        w = words(t)
        hit, items = set(), set()
        for n in {len(k) for k in wins}:
            for p in range(len(w) - n + 1):
                if found := wins.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    items |= found
        ids = ",".join(sorted(str(x) for x in items if x is not None))
        out.append((i, len(w), len(hit), len([x for x in items if x is not None]), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("most", [decontam.BROADCAST_WINDOWS, 0])
def test_decontamination(spark, docs, none, most):
    text = ROWS[8][1].split()
    bench = [(1, " ".join(text[100:125]).upper()), (2, PASSAGE), (3, PASSAGE[:150]), (10, "same text"), (4, None), (5, "!!"), (6, "one"), (None, " ".join(text[300:310])), (7, " ".join(text[120:129]))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    out = decontam.contamination(docs, b, broadcast_windows=most)
    got = out.select("doc_id", "n_words", "n_hit", F.size("item_ids").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
    assert rows(got, *names) == brute_contamination(ROWS, bench)
    assert decontam.result(docs, b.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.result(none, b).collect() == []
    kept = decontam.decontaminated(docs, b)
    bad = {r[0] for r in brute_contamination(ROWS, bench) if r[-1]}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in ROWS} - bad and {1, 9, 12} < bad


# --- 8 -----------------------------------------------------------------------------------------------------------


def test_bpe_equals_library(docs, none):
    tokenizers, tiktoken = pytest.importorskip("public_tokenizers"), pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for i, t in ROWS:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want[i, len(ids), digest(ids.tobytes()), digest((t or "").encode())] += 1
    assert rows(bpe.result(docs, path, tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    ids = bpe.encoded(docs, path, tokenizers.PATTERN)
    assert rows(bpe.decoded(ids, path, tokenizers.PATTERN), "doc_id", "bytes") == Counter((i, (t or "").encode()) for i, t in ROWS)
    assert bpe.result(none, path, tokenizers.PATTERN).collect() == []
    c = bpe.Codec(path, tokenizers.PATTERN)
    for w in ["a" * 399, "ab" * 300, "nationalisation" * 20, "éè" * 90]:  # the query and the heap follow the same rule
        ids = c._merge([w.encode()])[0]
        assert ids == enc.encode_ordinary(w) == c._by_heap(w.encode())


# --- 9 -----------------------------------------------------------------------------------------------------------


def test_line_dedup(spark, docs, none):
    got = {(r.doc_id, r.n_lines, r.n_dropped): r.text for r in line_dedup.result(docs).collect()}
    by_id = {i: t for i, t in ROWS}
    assert got[1, 2, 0] == by_id[1]
    assert got[2, 2, 1] == by_id[2].split("\n")[0] and got[3, 3, 1] == by_id[3].replace("\n" + PASSAGE, "")
    assert got[4, 0, 0] is None and got[5, 1, 0] == "" and (9, 1, 0) in got
    assert sum(n for (_, _, n), _ in got.items()) == 2
    assert line_dedup.result(none).collect() == []
    odd = docs.withColumn("dropped_lines", F.lit("own")).withColumn("tid", F.lit(1)).withColumn("line", F.lit(2))
    assert line_dedup.deduplicated(odd).count() == len(ROWS)


def test_line_templates_generalise(spark):
    body = prose(40)
    word = lambda i: f"name{chr(97 + i)}"
    data = [(i, f"Posted on {i}/1/2020 by user {i * 7} in the general forum about things and more things here\nUnique {prose(20)}") for i in range(12)]
    data += [(100 + i, f"Start of the text {body} signed {word(i)} today") for i in range(4)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    out = {r.doc_id: r.n_dropped for r in line_dedup.result(df).collect()}
    assert [out[i] for i in range(12)] == [0] + [1] * 11  # digits are variable fields
    assert [out[100 + i] for i in range(4)] == [0, 1, 1, 1]  # and so is one segment


def test_line_dedup_equals_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    data = [(i, t) for i, t in ROWS if i is not None] + [(i, "\n".join([PASSAGE if i % 3 else prose(9), prose(7), f"item {i} of the long list of many items number {i * i}"])) for i in range(200, 260)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert rows(line_dedup.result(df), "doc_id", "n_lines", "n_dropped", "text") == Counter(con.execute(line_dedup.ORACLE_SQL).fetchall())


# --- 10 ----------------------------------------------------------------------------------------------------------


def brute_simhash(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    c = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in sh) for b in range(64)]
    return sum(1 << b for b in range(64) if c[b] * 2 > len(sh))


def brute_components(ds):
    fps = [(i, brute_simhash(t)) for i, t in ds]
    label = list(range(len(fps)))
    find = lambda x: x if label[x] == x else find(label[x])
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    low = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    brute_components.groups = len({find(k) for k in range(len(fps))})
    return Counter((i, f"{fp:016x}", low.get(find(k))) for k, (i, fp) in enumerate(fps))


def test_simhash(spark, none):
    near = [(300 + i, " ".join([*ROWS[8][1].split()[: 3000 + i], "x", *prose(i).split()])) for i in range(25)]
    data = [*ROWS, *near]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    want = brute_components(data)
    assert rows(simhash.result(df), "doc_id", "fingerprint", "component_id") == want
    kept = simhash.deduplicated(df.withColumn("fp", F.lit(0)))
    assert kept.columns == ["doc_id", "text", "fp"]
    assert kept.count() == brute_components.groups
    assert simhash.result(none).collect() == []


def test_bit_sliced_comparison_and_hot_blocks(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (12, 2))]]))
    for radius in (0, 1, 2, 3, 5, 7):
        i, j = simhash.near(fps, fps, radius)
        want = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
        got = np.zeros_like(want)
        got[i, j] = True
        assert (got == want).all()
    df = spark.createDataFrame([(int(x),) for x in fps.astype(np.int64)], "fp long")
    for chunk in (4096, 3):  # the second splits every block value
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, 3, tile=64, chunk=chunk)).collect()}
        lab = np.arange(len(fps))
        close = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
        signed = fps.astype(np.int64)
        while True:
            new = np.where(close, signed[lab][None], np.iinfo(np.int64).max).min(axis=1)
            nxt = np.array([np.flatnonzero(signed == x)[0] for x in new])
            if (nxt == lab).all():
                break
            lab = nxt
        assert all(roots.get(int(s), int(s)) == int(signed[k]) for s, k in zip(signed, lab))
