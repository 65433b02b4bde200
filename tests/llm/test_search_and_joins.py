"""Ball-tree search, fill-in-the-middle and the pigeonhole join against brute force, with nulls, ties and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nullgauge.llm import ball_tree, fim, pigeonhole

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_ranking(documents, items, k=10):
    bags = [(d, Counter(TERM.findall(folded(t)))) for d, t in documents]
    bags = [(d, b) for d, b in bags if b]
    length, df = sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 25 + (75 * sum(b.values()) * len(bags)) // length
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in TERM.findall(folded(text)) if t in b)
            if score > 0:
                scores.append((-score, d))
        out += [(item, rank + 1, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["Straße", "ÄRA", "x1", "日本"]
    texts = [" ".join(r.choices(words, weights=[1 / (1 + k) for k in range(64)], k=r.randint(1, 80))) for _ in range(700)]
    texts += ["", None, "... !!", texts[3], texts[3], "W1 w1-W1_w1", "w5 " * 50_000]
    items = [(k, " ".join(r.choices(words, k=r.randint(1, 12)))) for k in range(25)] + [(100, None), (101, ""), (102, "unheard of"), (103, "w1 W1 w1")]
    return list(enumerate(texts)), items


@pytest.mark.parametrize("sizes", [(4096, 32), (64, 4)])
def test_search_against_all_scores(spark, corpus, monkeypatch, sizes):
    monkeypatch.setattr(ball_tree, "TREE_ROWS", sizes[0])
    monkeypatch.setattr(ball_tree, "LEAF", sizes[1])
    documents, items = corpus
    rows = spark.createDataFrame([(d, t, "a", 1) for d, t in documents], "doc_id long, text string, item_id string, score int").repartition(3)
    got = ball_tree.ranked(rows, spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int"))
    assert sorted(tuple(r) for r in got.collect()) == plain_ranking(documents, items)


def test_search_in_blocks_of_items_and_of_repeated_ids(spark, corpus, monkeypatch):
    documents, items = corpus
    rows, asked = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in ball_tree.ranked(rows, asked).collect())
    monkeypatch.setattr(ball_tree, "ITEM_BYTES", 400)
    assert sorted(tuple(r) for r in ball_tree.ranked(rows, asked.union(asked)).collect()) == whole
    two = spark.createDataFrame([(1, "w1"), (1, "w2 w2"), (None, "w3")], "item_id long, text string")
    found = ball_tree.ranked(rows, two).collect()
    assert len(found) == 20 and all(len({r.doc_id for r in found if r.item_id == k}) == 10 for k in (1, None))
    assert ball_tree.ranked(rows.limit(0), asked).count() == ball_tree.ranked(rows, asked.limit(0)).count() == 0


def test_bounds_hold_and_prune():
    r = np.random.default_rng(2)
    # groups of like rows: nodes of other groups are under the k-th score
    values = np.concatenate([r.integers(1, 20, (300, 40)) * 1000 * (np.arange(40) // 10 == g) for g in range(4)])
    values[:, 0] += 1
    flat = values > 0
    rows = ball_tree.Rows(np.concatenate(([0], np.cumsum(flat.sum(1)))), np.nonzero(flat)[1], values[flat])
    tree = ball_tree.Tree(rows, 40)
    assert sorted(k for leaf in tree.leaf if leaf is not None for k in leaf.tolist()) == list(range(1200))
    query = np.zeros(40, np.int64)
    query[[11, 13, 17]] = [5, 7, 900]
    bounds = tree.bounds(np.array([0, 3]), np.array([11, 13, 17]), query[[11, 13, 17]])[:, 0]
    scores, below = values @ query, {}
    for k in reversed(range(len(tree.left))):
        below[k] = tree.leaf[k] if tree.leaf[k] is not None else np.concatenate((below[tree.left[k]], below[tree.right[k]]))
        assert scores[below[k]].max() <= bounds[k]
    seen, best = [], []
    take = rows.take
    tree.rows = type("Counted", (), {"take": staticmethod(lambda members: (seen.append(len(members)), take(members))[1])})
    tree.search(bounds, query, best, list(range(1200)), 10)
    assert sorted(best, reverse=True) == sorted(((int(s), -k) for k, s in enumerate(scores)), reverse=True)[:10]
    assert sum(seen) <= 800


# fill-in-the-middle


def plain_transformation(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_transformation_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK", 16)
    r = random.Random(6)
    texts = ["", None, "\n", "\n\n\n", "one", "one\n", "a <P> b\nc", "x<S>", "<M", "ende<\nS>\n<\nP>", "é\nß日本\n\U0001f600\n" * 40, "line\n" * 20_000 + "last"]
    texts += ["".join(r.choices("ab\n\r é<SPM>", k=r.randint(0, 300))) for _ in range(200)] + ["one"] * 3
    rows = list(enumerate(texts)) + [(None, "no\nname\n"), (7, "same\nid\n")]
    frame = spark.createDataFrame([(*x, "f", 1) for x in rows], "doc_id long, text string, form string, n int")
    got = fim.fill_in_middle(frame).withColumn("back", fim.restored()).collect()
    key = lambda x: (x[0] is not None, *map(str, x))
    assert sorted(((g.doc_id, g.n, g.form, g.prefix_chars, g.middle_chars, g.output) for g in got), key=key) == sorted(((d, *plain_transformation(d, t)) for d, t in rows), key=key)
    assert sorted((g.back for g in got)) == sorted(t or "" for _, t in rows)
    assert fim.fill_in_middle(frame.limit(0)).count() == 0
    assert {x.form for x in fim.fill_in_middle(frame, rate=0).collect()} == {"plain"}


def test_descent_finds_each_line_end():
    r = np.random.default_rng(3)
    data = r.choice(np.frombuffer(b"ab\n\xc3\xa9", np.uint8), 5000)
    lines, ends = fim.Lines(data), np.flatnonzero(data == 10) + 1
    for k in range(1, len(ends) + 1):
        assert lines.cut(k) == (ends[k - 1], int(((data[: ends[k - 1]] & 0xC0) != 0x80).sum()))
    assert lines.cut(0) == (0, 0) and fim.Lines(data[:0]).cut(0) == (0, 0)


# pigeonhole join


def plain_links(rows, cosine=0.93):
    def usable(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    live = [k for k, (i, label, v) in enumerate(rows) if i is not None and label is not None and usable(v)]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x, i in enumerate(live):
        for j in live[:x]:
            if rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = (np.array(rows[k][2]) / max(map(abs, rows[k][2])) for k in (i, j))
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= cosine:
                    links[i] += 1
                    links[j] += 1
                    parent[find(i)] = find(j)
    least = {}
    for k in live:
        least[find(k)] = min(least.get(find(k), rows[k][0]), rows[k][0])
    return sorted(((r[0], links[k], least[find(k)] if k in live else r[0]) for k, r in enumerate(rows)), key=str)


def vectors_of(n, seed=1):
    r = np.random.default_rng(seed)
    centres, rows = r.normal(size=(6, 20)), []
    for k in range(n):
        spread = (0.05, 0.15, 0.25, 0.3, 3.0, 3.0)[k % 6]
        rows.append((k, (0, 1, 1)[k % 3], (centres[k % 6] + spread * r.normal(size=20)).tolist()))
    return rows


@pytest.mark.parametrize(("part", "axes_from"), [(2048, 200_000), (16, 1)])
def test_links_against_all_pairs(spark, monkeypatch, part, axes_from):
    monkeypatch.setattr(pigeonhole, "PART", part)
    monkeypatch.setattr(pigeonhole, "CELL_ROWS", axes_from)
    monkeypatch.setattr(pigeonhole, "MOST_AXES", 2)
    rows = vectors_of(420)
    rows += [(500, 0, rows[0][2]), (501, 0, rows[0][2]), (0, 0, rows[6][2]), (502, 0, [0.0] * 20), (503, 0, None), (504, 0, []), (505, None, rows[0][2]), (None, 0, rows[0][2])]
    rows += [(506, 0, [float("nan")] * 20), (507, 1, [1e300] * 20), (508, 1, [1e-200] * 20), (509, 1, [1.0] * 20), (510, 1, [1.0] * 7), (511, 1, [2.0] * 7), (512, 0, [1.0, None] * 10)]
    frame = spark.createDataFrame([(*x, 3, "n") for x in rows], "vec_id long, label int, embedding array<double>, node int, kind string").repartition(3)
    got = pigeonhole.linked(frame)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got.collect()), key=str) == plain_links(rows)
    assert got.filter("kept").count() == got.filter("vec_id = component_id OR vec_id IS NULL").count()


def test_a_large_group_is_gathered_into_a_ball(spark):
    r = np.random.default_rng(5)
    centre, other = r.normal(size=16), r.normal(size=16)
    rows = [(k, 0, (centre + 0.01 * r.normal(size=16)).tolist()) for k in range(3000)] + [(3000 + k, 0, (other + 0.5 * r.normal(size=16)).tolist()) for k in range(100)]
    sample = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = {x.vec_id: x.n_links for x in pigeonhole.linked(sample).collect()}
    assert all(found[k] == 2999 for k in range(3000))
    leaders = pigeonhole._leaders(sample.limit(500).select(F.lit(0).alias("kind"), F.col("embedding").alias("vector")).collect(), 0.93)
    assert 1 <= len(leaders) <= pigeonhole.LEADERS


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert pigeonhole.linked(empty).count() == 0
    nulls = spark.createDataFrame([(1, None, [1.0]), (2, 0, None)], "vec_id long, label int, embedding array<float>")
    assert [tuple(x) for x in pigeonhole.linked(nulls).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
