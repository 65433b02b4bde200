"""Edge cases and brute-force comparisons of the training-data operators."""

import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from nullgauge.llm import ann, html_crf, minhash, mixing, packing, pii, quality, repeats, tokens, warc
from nullgauge.llm.suffix_array import reaches, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id long"
LONG = " ".join(f"word{k % 97} and other{k % 89} things" for k in range(3000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 0, 7),
    (2, "the quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 0, 7),
    (3, "the quick brown fox jumps over the lazy dog near the river bank Tonight", None, None, 0, None),
    (4, None, "en", "b", None, 1),
    (5, "", "fr", "b", 0, 1),
    (6, LONG, "en", "c", 0, 1),
    (7, LONG + " end", "en", "c", 0, 1),
    (None, "mail me at a.b@c.example or +1 (555) 555-0100, card 4111111111111111, ip 10.0.0.1", "en", "c", 0, 1),
    (8, 'token = "0641917ea4e9feb9cda83477b57ac2654884f485" é😀 x@y.z', "en", "c", 0, 1),
    (8, "one two", "en", "c", 0, 1),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 0, 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_base(docs):
    got = sorted((r.n_words, r.word_chars, r.base_failed) for r in quality.quality(docs).collect())
    want = sorted((len(w), sum(map(len, w)), len(w) < 20) for r in ROWS for w in [words(r[1])])
    assert got == want
    assert quality.good_documents(docs).columns == docs.columns


def test_lack_of_common_words_is_rejected(spark):
    rng = np.random.default_rng(4)

    def text(lang, n, share=0.25):
        rare = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]
        return " ".join(f"{lang}{rng.choice(list('klmnopqrstuv'))}" if rng.random() < share else w for w in rare)

    rows = [(k, text("abcd"[k % 4], 60 + 3 * k), "abcd"[k % 4], "s") for k in range(120)]
    rows += [(1000, text("a", 200, 0), "a", "s"), (1001, text("b", 200), "a", "s"), (1002, text("a", 60, 0), "a", "s"), (1003, text("a", 40, 0), "a", "s")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [k for k, kept in got.items() if not kept] == [1000, 1001, 1002] and len(got) == 124


def test_near_duplicates(docs):
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False), (None, None, True)} <= got
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns and left.filter("doc_id = 1").count() == 1


@pytest.mark.parametrize("make", [quality.quality, minhash.near_duplicates, mixing.mix, pii.personal_data, repeats.without_repeats])
def test_empty_tables(spark, make):
    assert make(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tokens_and_packing(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = sorted(len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS)
    assert sorted(r.n_tokens for r in tokens.token_counts(docs, path).collect()) == want
    placed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas().sort_values(["sequence_id", "offset"])
    before = placed.groupby("sequence_id").length.cumsum() - placed.length
    assert (before == placed.offset).all() and placed.groupby("sequence_id").length.sum().max() <= 4096


@pytest.mark.parametrize("lengths", [{60: 3, 40: 3}, {51: 4, 30: 5, 20: 7}, {100: 2, 1: 5}, {}, {34: 3, 33: 3, 35: 2, 10: 1}])
def test_plan_is_whole(lengths):
    rows = packing.plan(lengths, 100)
    for length, n in lengths.items():
        assert sum(high - low for x, low, high, *_ in rows if x == length) == n
    fill = {}
    for length, low, high, sequence, _, copies in rows:
        for k in range(high - low):
            fill[sequence + k // copies] = fill.get(sequence + k // copies, 0) + length
    assert not fill or max(fill.values()) <= 100
    assert len(fill) <= math.ceil(sum(a * b for a, b in lengths.items()) / 100) + 1


def test_archives(spark):
    rows = [(3, "http://a", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "http://b\nc", None), (5, "u", ""), (4, "v", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n")]
    got = {r.page_id: r for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r.refers_to for k, r in got.items()} == {1: None, 2: None, 3: 1, 4: None, 5: 2}
    for k, _, html in rows:
        raw = (html or "").encode()
        assert got[k].payload_bytes == len(raw)
        import base64

        assert got[k].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_personal_data(docs):
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}[None]
    assert (got.n_email, got.n_ip, got.n_card, got.n_phone) == (1, 1, 1, 1)
    clean = [r.text for r in pii.redacted(docs).filter("doc_id IS NULL").collect()]
    assert clean == ["mail me at <EMAIL> or <PHONE>, card <CARD>, ip <IP>"]


def test_main_text():
    model = html_crf.train([])
    page = '<body><nav><a href="/">Home</a></nav><article><h1>A&amp;B</h1><p>One <b>two</b><br>three four five six.</p></article><footer>&copy; x</footer>'
    blocks = html_crf.leaf_blocks(page)
    assert " ".join(b.text for b, keep in zip(blocks, model.content(blocks), strict=True) if keep) == "A&B One two three four five six."
    assert model.content(html_crf.leaf_blocks("")) == []


def test_mix_is_near_its_targets(spark):
    rows = [(k, "w " * (k % 11 + 1), "abc"[min(k % 10, 2)]) for k in range(500)]
    p = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    g = p.groupby("source_size").agg({"taken": "sum", "target": "first"})
    assert (abs(g.taken - g.target) <= 1).all() and (p.taken <= 3 * p["size"]).all()
    assert abs(p.groupby("source_size").target.first().sum() - p["size"].sum()) < 1e-6


def test_repeats_against_brute_force(spark):
    base = "".join(chr(97 + k * k % 26) for k in range(400))
    texts = [base, "x" + base[50:300] + "y" * 10, "a" * 450, None, "", base[:199], "q" * 30 + base[100:380]]
    got = {r.doc_id: r for r in repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    raw = [(t or "").encode() for t in texts]
    every = {}
    for b in raw:
        for k in range(len(b) - 199):
            every[b[k : k + 200]] = every.get(b[k : k + 200], 0) + 1
    for i, b in enumerate(raw):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if every[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (gone.sum(), hashlib.sha256(left).hexdigest())


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 60):
        s = rng.integers(1, 4, n)
        order = suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda i: s[i:].tolist())
        assert reaches(s, order, 3).sum() == sum(any(i != j and s[i : i + 3].tolist() == s[j : j + 3].tolist() for j in range(n - 2)) for i in range(n - 2))


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0]), (1020, [float(v) for v in x[0]])]
    p = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert set(p.query_id) == {*range(0, 300, 20), 1020}
    hits = sum(len(set(np.argsort(-(x @ x[q]))[:21].tolist()) & set(p[p.query_id == q].vec_id)) for q in range(20, 300, 20))
    assert hits >= 0.9 * 20 * 14
    assert 1020 in p[p.query_id == 0].vec_id.tolist() and 0 in p[p.query_id == 1020].vec_id.tolist()


def test_nearest_of_unequal_norms(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 64)) * np.exp(rng.normal(size=1200) * 0.5)[:, None]
    x[7] *= 100
    p = ann.nearest(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).toPandas()
    assert (p.groupby("query_id").size() == 20).all() and set(p.query_id) == {*range(0, 1200, 20)}
    hits = 0
    for q in range(0, 1200, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & set(p[p.query_id == q].vec_id))
    assert hits >= 0.9 * 20 * 60


def test_nearest_ties_go_to_smaller_ids(spark):
    x = np.stack(np.meshgrid(*[[-1.0, 0.0, 1.0]] * 6), -1).reshape(-1, 6)  # so few components that every bucket is probed
    x = np.random.default_rng(3).permutation(x[(x != 0).any(1)])
    ids = np.arange(len(x)) // 2 * 3  # two vectors each
    p = ann.nearest(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>"), every=60).toPandas()
    for q in range(0, int(ids[-1]) + 1, 60):
        score = (x @ x[ids == q].T).max(1)
        want = sorted({int(i): s for i, s in sorted(zip(ids, score, strict=True), key=lambda r: r[1]) if i != q}.items(), key=lambda r: (-r[1], r[0]))[:20]
        got = p[p.query_id == q].sort_values("rank")
        assert list(zip(got.vec_id, got.score, strict=True)) == want


def test_utf8_views():
    from nullgauge.llm.shared import utf8

    data, at, valid = utf8(pa.array(["é", None, "", "ab"]).slice(1))
    assert data.tobytes() == b"ab" and at.tolist() == [0, 0, 0, 2] and valid.tolist() == [False, True, True]


def test_pipeline_runs(spark, docs):
    import corpus_pipeline

    out = docs.drop("component_id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
    assert out.columns == docs.drop("component_id").columns
