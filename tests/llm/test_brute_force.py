"""Operators of the training-data subpackage against plain restatements, on the smallest tables and on planted rows."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nullgauge.llm import ann, html_crf, minhash, mixing, packing, pii, quality, repeats, shared, tokens, warc
from nullgauge.llm.suffix_array import reaches, suffix_array
from nullgauge.llm.transducer import compiled

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r for r in documents.collect()}


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_groups(texts):
    """The smallest id that each id reaches over links of similarity 0.75."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


# op1


def plain_quality(rows):
    """Base columns, both distances and the verdict, with dictionaries."""
    fold = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})

    def classes(text):
        out = [0] * 9
        for c in text:
            p = ord(c)
            if p >= 128:
                out[6 if p < 0x800 else 7 if p < 0x10000 else 8] += 1
            else:
                out[0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in " \t\n\x0b\x0c\r" else 4 if c in ".,;:!?'\"()-" else 5] += 1
        return out

    def distance(p, q):
        a, b = sum(p), sum(q)
        if not a or not b:
            return 0.0
        total = 0.0
        for x, y in zip(p, q, strict=True):
            x, y = x / a, y / b
            m = (x + y) / 2
            total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
        return math.sqrt(min(1, max(0, total / 2)))

    words, chars = {}, {}
    for r in rows:
        words.setdefault(r.lang, Counter()).update(w.translate(fold) for w in WORD.findall(r.text or ""))
        chars[r.lang] = [x + y for x, y in zip(chars.get(r.lang, [0] * 9), classes(r.text or ""), strict=True)]
    common = {x: [w for w, n in c.items() if n >= 0.004 * sum(c.values())] for x, c in words.items()}
    out = {}
    for r in rows:
        text = r.text or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = set()
        for k in range(len(w) - 7):
            if windows[tuple(w[k : k + 8])] > 1:
                covered.update(range(k, k + 8))
        seen, duplicates = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                duplicates += line in seen
                seen.add(line)
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        known = common[r.lang]
        total, held = sum(words[r.lang].values()), sum(words[r.lang][x] for x in known)
        reference = [words[r.lang][x] for x in known] + [total - held]
        mine = Counter(x.translate(fold) for x in w)
        own = [mine[x] for x in known]
        char_distance, word_distance = distance(classes(text), chars[r.lang]), distance([*own, len(w) - sum(own)], reference)
        limit = 0.45
        if len(w) * held / max(total, 1) >= 10:
            limit = min(limit, 0.95 * distance([0] * len(known) + [1], reference))
        kept = not failed and not (len(text) >= 200 and char_distance > 0.3) and not (len(w) >= 50 and word_distance > limit)
        out[r.doc_id] = len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered), failed, kept, round(char_distance, 9), round(word_distance, 9)
    return out


def test_quality_against_dictionaries(documents, texts):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.char_distance, 9), round(r.word_distance, 9)) for r in quality.quality(documents).collect()}
    assert got == plain_quality(list(texts.values()))


# op2


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"q{rng.randrange(10**9)}"
    return words


@pytest.fixture(scope="module")
def families():
    rng, out = random.Random(5), []
    for b in range(3):
        base = [f"w{b}_{rng.randrange(400)}" for _ in range(60)]
        roots = [edited(base, rng.randrange(5), rng) for _ in range(3)]
        out += [" ".join(edited(rng.choice(roots), rng.randrange(7), rng)) for _ in range(40)]
    return {3 * k + 1: t for k, t in enumerate(out)}


@pytest.mark.parametrize("drawn", [True, False])
def test_large_buckets_lose_no_link(spark, families, monkeypatch, drawn):
    """With every bucket large, all links that drawn centres leave are found by families."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    if not drawn:
        monkeypatch.setattr(minhash, "_met", lambda *_: spark.createDataFrame([], "a long, b long"))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(families.items()), "doc_id long, text string")).collect()}
    assert got == near_groups(families)


def family_links(spark, texts, monkeypatch):
    """Links found between members of one family, each a component of its own, and the pairs that each join makes."""
    made, join = [], minhash._key_pairs
    monkeypatch.setattr(minhash, "_key_pairs", lambda *x: (made.append((out := join(*x)).count()), out)[1])
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    heads = documents.mapInArrow(minhash._signatures, "doc_id long, n_shingles long, one long, two long, bands array<long>, packed array<long>")
    members, none = spark.createDataFrame([(0, k, k) for k in texts], "family long, doc_id long, component long"), spark.createDataFrame([], "a long, b long")
    links, tested = minhash._family_links(members, none, none, heads, documents, 75)
    return {(r.a, r.b) for r in links.collect()}, tested.count(), made


def joined(links, nodes):
    label = {k: k for k in nodes}
    for a, b in sorted(links):
        x, y = label[a], label[b]
        if x != y:
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    return label


def test_family_links_join_all_components(spark, families, monkeypatch):
    links, _, _ = family_links(spark, families, monkeypatch)
    sets = {k: shingle_set(t) for k, t in families.items()}
    assert all(100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) for a, b in links)
    assert joined(links, families) == near_groups(families)


def star(n, edits, seed=1):
    """Documents of 100 words, each with `edits` own words in a common base."""
    rng, out = random.Random(seed), {}
    for d in range(n):
        words = [f"b{k}" for k in range(100)]
        for j in rng.sample(range(100), edits):
            words[j] = f"o{d}_{j}"
        out[d] = " ".join(words)
    return out


def test_family_pairs_grow_with_the_members(spark, monkeypatch):
    rows = []
    for n in (250, 1000):
        texts = star(n, 2)
        links, tested, made = family_links(spark, texts, monkeypatch)
        monkeypatch.undo()
        rows.append(tested + sum(made))
        assert joined(links, texts) == near_groups(texts) if n == 250 else tested >= len(links) >= n - 1
    assert rows[1] <= 5 * rows[0]


def test_families_with_few_links_make_few_pairs(spark, monkeypatch):
    texts = star(300, 3)
    links, tested, made = family_links(spark, texts, monkeypatch)
    assert joined(links, texts) == near_groups(texts) and sum(made) < 300**2 / 50


# op3 and op4


def expected_pieces(rows, path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    out = set()
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            out.add((r.doc_id, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def check_packing(placed, rows):
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed} == expected_pieces(rows, public_tokenizers.path("word_bpe_49k.json"))
    sequences = {}
    for r in placed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= math.ceil(sum(r.length for r in placed) / 4096) + 3


def test_packing_against_the_library(documents, texts):
    check_packing(packing.pack(documents, public_tokenizers.path("word_bpe_49k.json")).collect(), texts.values())


@pytest.mark.parametrize("n", [1000, 10**6])
def test_plans_do_not_grow_with_the_rows(n):
    assert len(packing.plan({3000: n, 1000: n})) == len(packing.plan({3000: 1000, 1000: 1000}))
    assert len(packing.plan({2100: n, 1900: 2 * n, 90: 5 * n})) < 40


def test_reduction_without_exact_fill_takes_all_copies():
    state = packing._Plan({60: 1000, 39: 1000, 30: 0}, 100)
    state.reduce()
    assert state.patterns == [(((None, 60, 1), 39, 1), 1000)] and not state.left.any()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_machine_gives_the_library_s_ids(name):
    rng = random.Random(3)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "'s", "'ll", "1", "12", "é", "ß", "😀", "!", "...", "_", "<", "|", ">", "A", "İ", "日本", "\u0301", "\t", "xyz", "tion", "<|endoftext|>"]
    strings = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    strings += ["".join(rng.choice("abethins") for _ in range(rng.randrange(1, 200))) for _ in range(200)] + ["a" * 30_000, "ab" * 9000, "=-" * 3000, ""]
    machine = compiled(public_tokenizers.path(name))
    data, at, _ = shared.utf8(pa.array(strings))
    counts, ids = machine.run(data, at, True)
    only, _ = machine.run(data, at, False)
    edges = np.concatenate(([0], np.cumsum(counts)))
    for k, e in enumerate(machine.library.encode_batch(strings, add_special_tokens=False)):
        assert e.ids == ids[edges[k] : edges[k + 1]].tolist()
    assert only.tolist() == counts.tolist()


def test_transitions_carry_counts():
    machine = compiled(public_tokenizers.path("byte_bpe_50k.json"))
    piece = b"unbelievableness"
    state, total = 0, 0
    for k, symbol in enumerate(piece):
        to, change = machine.tokens._find(np.array([state << 9 | symbol]))
        state, change = int(to[0]), int(change[0])
        total += change
        assert total == len(machine.library.encode(piece[: k + 1].decode(), add_special_tokens=False).ids)


# op5


def test_archives_of_all_sizes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(k, f"http://x/{k}", "p" * (k % 3 + 1) * n) for k, n in enumerate([3, 3, 9000, 70_000, 400_000, 9000, 3])] + [(90, None, None), (91, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    records = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert {(r.page_id, r.payload_bytes) for r in records} == {(k, len(h or "")) for k, _, h in rows}
    payloads = {k: h for k, _, h in rows}
    assert all(r.payload == (payloads[r.page_id] or "") for r in records if r.record_type == "response")
    assert {r.page_id: r.refers_to for r in records if r.record_type == "revisit"} == {5: 2, 6: 0, 91: 90}
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "w").glob("part-*")))
    heads = [dict(x.split(b": ", 1) for x in h.split(b"\r\n")[1:]) for h in re.findall(rb"WARC/1\.1\r\n.*?(?=\r\n\r\n)", raw, re.S)]
    assert len({h[b"WARC-Record-ID"] for h in heads}) == len(rows)
    assert all(re.fullmatch(rb"20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", h[b"WARC-Date"]) for h in heads)
    own = {h[b"X-Page-ID"]: h for h in heads}
    for again, first in ((b"91", b"90"), (b"5", b"2")):
        assert own[again][b"WARC-Refers-To"] == own[first][b"WARC-Record-ID"] and own[again][b"WARC-Refers-To-Date"] == own[first][b"WARC-Date"]
    assert b"WARC-Refers-To-Target-URI" not in own[b"91"] and own[b"5"][b"WARC-Refers-To-Target-URI"] == b"http://x/2"


def test_repeated_pages(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "b", "x"), (None, "c", "x")]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "revisit", 1)]


# op6


def base_spans(text):
    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0

    out = []
    for k, (pattern, good) in enumerate(
        [
            (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
            (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
            (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
        ]
    ):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if good(m.group())]
    return sorted(out)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def plain_redaction(text, spans):
    out, at = "", 0
    for span in filter(None, spans.split(",")):
        kind, s, e = span.split(":")
        if int(s) >= at:
            out += text[at : int(s)] + f"<{kind.upper()}>"
        at = max(at, int(e))
    return out + text[at:]


def test_personal_data_against_patterns(spark, documents, texts):
    rng = random.Random(2)
    parts = ["a@b.c", "a@b..c", "1.2.3.4", "1.2.3.256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+1", "x", " ", "é", "😀", "-", ".", "12", "@", "+49 30 1234567"]
    rows = [(r.doc_id, r.text) for r in texts.values()] + [(10_000 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(30)))) for k in range(300)] + [(20_000, None), (20_001, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(table).collect()}
    clean = {r.doc_id: r.text for r in pii.redacted(table).collect()}
    for k, text in rows:
        base = base_spans(text or "")
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(sum(x[1] == kind for x in base) for kind in range(4))
        assert got[k].base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        assert set(filter(None, written(base).split(","))) <= set(got[k].spans.split(","))
        assert clean[k] == (plain_redaction(text, got[k].spans) if text is not None else None)


def test_labelers_add_credentials_and_leave_other_runs(spark):
    rng = random.Random(7)
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows, secret = [], {}
    for k in range(400):
        kind = k % 4
        run = [hexa(40), f"AKIA{''.join(rng.choice('ABCDEFGHJKLMNPQRSTUVWXYZ234567') for _ in range(16))}", f"version-{rng.randrange(100, 9999)}.{rng.randrange(100)}", f"{rng.randrange(1900, 2100)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}"][kind]
        lead = ["token = ", "access key: ", "see ", "since "][kind]
        rows.append((k, f"some words {lead}{run} and then more words follow here"))
        secret[k] = run if kind < 2 else None
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {k: text[int(s.split(":")[1]) : int(s.split(":")[2])] for k, text in rows for s in got[k].split(",") if s.startswith("identifier")}
    # runs of fewer than three digits aren't candidates
    wanted = {k for k, run in secret.items() if run and len(re.sub("[^0-9]", "", run)) >= 3}
    caught = {k for k in wanted if secret[k] in found.get(k, "")}
    assert len(caught) >= 0.95 * len(wanted) and len(set(found) - {k for k, run in secret.items() if run}) <= 0.05 * 200


def test_personal_data_of_long_texts(spark):
    many = " ".join(f"ab{k}cd99 +1 555 010 {k:04d}" for k in range(3000))
    table = spark.createDataFrame([(1, many)], "doc_id long, text string")
    row = pii.personal_data(table).first()
    assert row.n_phone == 3000 and pii.redacted(table).first().text == plain_redaction(many, row.spans)


# op7


def test_main_text_of_deep_broken_and_empty_pages(spark):
    texts = [b.text for b in html_crf.leaf_blocks('<article><p>one <svg a="b"/> two</p><select><option>a<option>b</select><div><button>x</div><p>three</p><object>q</article>z')]
    assert texts == ["one two", "three", "z"]
    assert len(html_crf.leaf_blocks("<body>" + "<div>x" * 20_000)) == 20_000
    assert len(html_crf.leaf_blocks("<body>" + "<span>x" * 20_000 + "<p>y" * 20_000)) == 20_001
    long = "<body><nav><p>a</p></nav><article>" + "<p>hello there you. </p>" * 3000 + "</article></body>"
    html_crf.train([long] * 20)
    rows = [(1, "u", None), (2, None, ""), (3, "v", "<article><p>Body text stands here, in full.</p></article><footer>(c)"), (3, "v", "<article><p>Body text stands here, in full.</p></article><footer>(c)")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_crf.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [(1, "", 0), (2, "", 0), *[(3, "Body text stands here, in full.", 31)] * 2]


def test_main_text_of_held_out_pages(spark):
    """Blocks of pages outside the training sample, against what their markup says."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_crf.train_on(pages, 60)
    sample = {r.page_id for r in pages.select("page_id", F.xxhash64("page_id", "url").alias("h")).orderBy("h").limit(60).collect()}
    right = total = 0
    for r in pages.collect():
        if r.page_id not in sample:
            blocks = html_crf.leaf_blocks(r.html)
            for b, keep in zip(blocks, model.content(blocks), strict=True):
                if b.label is not None:
                    total, right = total + 1, right + (keep == bool(b.label))
    assert total > 500 and right >= 0.99 * total


# op8 and whole rows


def test_clashing_columns_come_back(spark):
    names = "size source_size target whole taken turns repeat mix_source edge_turn row cut pii_1 pii_runs pii_spans pii_all pii_text clean n s t key component".split()
    rows = [(k, f"mail a{k % 9}@b.c " + "w " * (k % 7), "ab"[k % 2], *range(len(names))) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    for out in (mixing.repeated(table), pii.redacted(table), minhash.one_of_each(table)):
        assert out.columns == table.columns
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(range(len(names)))}


def test_mix_of_nulls_ties_and_repeats(spark):
    rows = [(1, "a b", None), (1, "a b", None), (None, "c", None), (2, None, "x"), (3, "", "x"), (4, "d " * 9, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    p = mixing.mix(table).toPandas()
    assert len(p) == 6 and (p.taken <= 3 * p["size"]).all() and p.taken.sum() <= 14
    total = sum(len(WORD.findall(r.text or "")) for r in mixing.repeated(table).collect())
    assert total == p.taken.sum()


# op9


def test_hot_minimizers_give_the_same(spark, monkeypatch):
    base = "".join(chr(97 + k * k % 26) for k in range(400))
    texts = [base, "x" + base[50:300] + "y" * 10, "a" * 5000, None, "", base[:199], "q" * 30 + base[100:380], "zz" + "a" * 450, "ab" * 300]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(tuple(r) for r in repeats.without_repeats(table).collect())
    monkeypatch.setattr(repeats, "HOT_BYTES", 0)
    assert sorted(tuple(r) for r in repeats.without_repeats(table).collect()) == want
    raw = [(t or "").encode() for t in texts]
    every = Counter(b[k : k + 200] for b in raw for k in range(len(b) - 199))
    for (_, _, removed, _, digest), b in zip(want, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if every[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        assert (removed, digest) == (gone.sum(), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())


def test_suffix_arrays_of_runs_and_periods():
    rng = np.random.default_rng(8)
    for turn in range(80):
        s = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 70)))
        s = np.repeat(s, rng.integers(1, 9, len(s))) if turn % 3 == 0 else np.tile(s[:7], 9) if turn % 5 == 0 else s
        order = suffix_array(s)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert reaches(s, order, 3).sum() == sum(any(i != j and s[i : i + 3].tolist() == s[j : j + 3].tolist() for j in range(len(s) - 2)) for i in range(len(s) - 2))
    assert suffix_array(np.full(300_000, 97)).tolist() == list(range(299_999, -1, -1))


# op10


def test_cells_follow_the_rows():
    assert ann.polytopes(64, 1000) == [64] and len(ann.polytopes(64, 10**6)) == 2 and len(ann.polytopes(64, 10**9)) >= 3
    # at the same cosines, the share of rows that the first probes meet falls as cells do
    cosines = np.full(40, 0.55)
    shares = []
    for rows in (2000, 20_000, 200_000):
        axes = ann.polytopes(64, rows)
        cells = int(np.prod([2 * n for n in axes]))
        shares.append(ann.first_probes(64, axes, cosines, min(ann.MOST, cells // 2)) / cells)
    assert shares[0] > shares[1] > shares[2]


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = x @ x[k]
        score[k] = -np.inf
        hits += len(set(ids[np.argsort(-score)[:20]].tolist()) & got[ids[k]])
        total += 20
    assert hits >= 0.9 * total


# empty tables and the pipeline


def test_empty_tables_everywhere(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert warc.round_trip(pages).count() == 0 and html_crf.main_texts(pages).count() == 0
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


def test_pipeline_stages_against_plain_ones(spark, documents, texts):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, documents, SF).collect()
    verdicts = plain_quality(list(texts.values()))
    assert sorted(map(tuple, kept)) == sorted(tuple(r) for r in texts.values() if verdicts[r.doc_id][6])

    left = stages["near_duplicates"](spark, spark.createDataFrame(kept, documents.schema), SF).collect()
    groups = near_groups({r.doc_id: r.text for r in kept})
    assert sorted(map(tuple, left)) == sorted(tuple(r) for r in kept if groups[r.doc_id] == r.doc_id)

    table = spark.createDataFrame(left, documents.schema)
    spans = {r.doc_id: r.spans for r in pii.personal_data(table).collect()}
    clean = stages["personal_data"](spark, table, SF).collect()
    assert {r.doc_id: r.text for r in clean} == {r.doc_id: plain_redaction(r.text, spans[r.doc_id]) for r in left}
    assert all(r.n_chars == len(r.text) for r in clean if spans[r.doc_id])

    table = spark.createDataFrame(clean, documents.schema)
    taken = {r.doc_id: r.taken for r in mixing.mix(table).collect()}
    mixed = stages["source_mix"](spark, table, SF).collect()
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {k: n for k, n in taken.items() if n} == dict(words)
    original = {r.doc_id: WORD.findall(r.text) for r in clean}
    assert all(WORD.findall(r.text) == original[r.doc_id][: len(WORD.findall(r.text))] for r in mixed)

    placed = stages["packing"](spark, spark.createDataFrame(mixed, documents.schema), SF).collect()
    assert len(placed) >= len(mixed)
    check_packing(placed, mixed)


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.use_checkpoints(Session())


# hashes on patterns that sums of powers modulo 2**64 can't tell apart


def thue_morse(n, flip=0):
    return "".join("ab"[(bin(k).count("1") + flip) & 1] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_thue_morse_patterns_are_told_apart(spark, n):
    one, two = thue_morse(n), thue_morse(n, 1)
    rows = spark.createDataFrame([(1, f"{one}\n{two}", "en"), (2, one, "en"), (3, two, "en"), (4, f"{one}\n{one}", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.n_dup_lines for r in quality.quality(rows).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(rows).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        library, text = compiled(path).library, f"{one}\n{two}"
        expected = library.encode(text, add_special_tokens=False).ids
        data = np.frombuffer(text.encode(), np.uint8)
        counts, ids = compiled(path).run(data, np.array([0, len(data)]), True)
        assert counts.tolist() == [len(expected)] and ids.tolist() == expected


def test_repeats_of_thue_morse_blocks(spark):
    block = "".join(random.Random(3).choices("cdefghijkl", k=64))
    texts = []
    for flip in (0, 1):
        own = random.Random(10)
        texts.append("".join(block + "".join(own.choices("mnopqrstuvwxyz", k=63)) + thue_morse(64, flip)[k] for k in range(64)))
    windows = [t[k : k + 200] for t in texts for k in range(len(t) - 199)]
    assert len(set(windows)) == len(windows)
    rows = repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.n_removed, r.n_spans) for r in rows] == [(0, 0), (0, 0)]


def test_equal_hashes_are_decided_by_bytes(monkeypatch):
    data = np.frombuffer(b"abcabdabcabd", np.uint8)
    starts = np.arange(0, 12, 3)
    monkeypatch.setattr(shared, "segment_hashes", lambda *a: np.zeros(4, np.uint64))
    assert len(set(shared.first_equal(data, starts, starts + 3).tolist())) == 2
    assert len(set(shared.first_equal(data, starts, starts + 3, np.array([0, 0, 1, 1])).tolist())) == 4


def test_blocks_return_only_rows_that_reach_a_querys_floor(spark, monkeypatch):
    draw = np.random.default_rng(5)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(2000, 64)))], "vec_id long, embedding array<double>")
    made, compared = [], ann._compared

    def counted(*args):
        out = ann.saved(compared(*args))
        made.append(out.count())
        return out

    monkeypatch.setattr(ann, "_compared", counted)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.nearest(table, every=50, k=5, probes=60).collect()}
    x = np.array([r.embedding for r in table.orderBy("vec_id").collect()])
    for q in range(0, 2000, 50):
        score = x @ x[q]
        order = [i for i in np.lexsort((np.arange(2000), -score)) if i != q][:5]
        assert [got[q, k + 1][0] for k in range(5)] == order
    # 40 queries, 8 tables, 60 cells and up to 6 rows a block would be 115,200 rows
    assert sum(made) < 115_200 / 10, made
