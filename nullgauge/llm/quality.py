"""Quality rules: divergence of a document from its language.

Every document gives two histograms, one of character classes and one of its language's common words. Both are
compared, by Jensen-Shannon distance (base 2, so from 0 to 1), to references that are summed over all documents of
the same language. A document is rejected if a distance is above its limit; a document shorter than the guard of a
distance isn't judged by it. Plain base rules (too few words, too much of the text in repeated 8-word windows) come
first.

A document without any common word has a distance that depends on its language alone, and that is the lower the fewer
of the language's words are common. LACK of this distance is the word limit where it is below max_word, so that a lack
of common words is rejected in every language; but only for documents long enough to hold EXPECTED common words.

Common words of a language are all words with at least `common_share` of its words. They are found exactly in two
passes: each partition gives a Misra-Gries summary of `SUMMARY` words, whose merge holds every word with a larger
share than 1 / SUMMARY; the second pass counts those candidates exactly.

Defined results: null text counts as empty (base_failed); null lang is a language of its own; empty table gives an
empty result; repeated rows are judged alike; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import BYTE_VALUE_FOLDED, distinct, first_equal, mixed, per_doc, segment_hashes, slices, utf8, word_edges

#: Words kept by a Misra-Gries summary; a common word has a larger share than 1 / SUMMARY.
SUMMARY = 2000
N_CLASSES = 9
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
LACK, EXPECTED = 0.95, 10

#: Character classes, by a character's first byte: lower, upper, digit, white space, sentence marks, other ASCII, and
#: characters of two, three and four bytes. Continuation bytes belong to none.
_CLASS = np.full(256, 5, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[0x80:0xC0], _CLASS[0xC0:0xE0], _CLASS[0xE0:0xF0], _CLASS[0xF0:] = -1, 6, 7, 8
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _languages(batch: pa.RecordBatch) -> list[str]:
    return ["" if x is None else "=" + x for x in batch.column("lang").to_pylist()]


def _folded_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_edges(data, at)
    return segment_hashes(data, starts, ends, BYTE_VALUE_FOLDED), first


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    pending: dict[str, list[np.ndarray]] = {}
    total: dict[str, int] = {}

    def fold(lang: str) -> None:
        words, n = np.unique(np.concatenate(pending.pop(lang)), return_counts=True)
        if lang in counts:
            both = np.concatenate((counts[lang][0], words))
            words, inverse = np.unique(both, return_inverse=True)
            n = np.bincount(inverse, np.concatenate((counts[lang][1], n))).astype(np.int64)
        if len(n) > SUMMARY:
            n = n - np.partition(n, len(n) - SUMMARY - 1)[len(n) - SUMMARY - 1]
            words, n = words[n > 0], n[n > 0]
        counts[lang] = words, n

    for whole in batches:
        for batch in slices(whole, "text"):
            data, at, _ = utf8(batch.column("text"))
            hashes, first = _folded_words(data, at)
            lang = np.array(_languages(batch), object)
            of = np.repeat(np.arange(batch.num_rows), np.diff(first))
            for x in dict.fromkeys(lang):
                own = hashes[(lang == x)[of]]
                pending.setdefault(x, []).append(own)
                total[x] = total.get(x, 0) + len(own)
                if sum(map(len, pending[x])) > 2_000_000:
                    fold(x)
    for x in [*pending]:
        fold(x)
    for x, (words, n) in counts.items():
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(words), pa.string()), pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["lang_key", "word", "n"])


def _counter(candidates: dict[str, np.ndarray]):
    """Counts, for each language, the candidate words, all words (word 0, kind 1) and the character classes (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, np.ndarray] = {}
        rest: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in slices(whole, "text"):
                data, at, _ = utf8(batch.column("text"))
                hashes, first = _folded_words(data, at)
                lang = np.array(_languages(batch), object)
                of = np.repeat(np.arange(batch.num_rows), np.diff(first))
                doc = np.repeat(np.arange(batch.num_rows), np.diff(at))
                for x in dict.fromkeys(lang):
                    mine = lang == x
                    own, known = hashes[mine[of]], candidates.get(x, np.zeros(0, np.uint64))
                    kinds = _CLASS[data[mine[doc]]]
                    rest[x] = rest.get(x, np.zeros(N_CLASSES + 1, np.int64)) + np.append(np.bincount(kinds[kinds >= 0], minlength=N_CLASSES), len(own))
                    if len(known):
                        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                        words[x] = words.get(x, 0) + np.bincount(place[known[place] == own], minlength=len(known))
        for x, n in rest.items():
            names = np.concatenate((candidates.get(x, np.zeros(0, np.uint64)).view(np.int64), np.arange(N_CLASSES), [0]))
            kinds = np.repeat([0, 2, 1], [len(names) - N_CLASSES - 1, N_CLASSES, 1])
            every = np.concatenate((words[x], n)) if x in words else n
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(names), pa.string()), pa.array(kinds, pa.int32()), pa.array(names, pa.int64()), pa.array(every, pa.int64())], ["lang_key", "kind", "word", "n"])

    return run


def language_references(documents: DataFrame, common_share: float) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By language: its common words' hashes, their counts with all other words last, and its character class counts.

    What comes to the driver is bounded by SUMMARY rows for each language, whatever the number of documents.
    """
    texts = documents.select("lang", "text")
    merged = texts.mapInArrow(_summaries, "lang_key string, word long, n long").groupBy("lang_key", "word").agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("place", F.row_number().over(Window.partitionBy("lang_key").orderBy(F.desc("n"), "word"))).filter(F.col("place") <= SUMMARY)
    found: dict[str, list[int]] = {}
    for row in ranked.select("lang_key", "word").toLocalIterator():
        found.setdefault(row.lang_key, []).append(row.word)
    candidates = {x: np.sort(np.array(words, np.int64).view(np.uint64)) for x, words in found.items()}
    counted: dict[str, tuple[dict[int, int], np.ndarray, list[int]]] = {}
    rows = texts.mapInArrow(_counter(candidates), "lang_key string, kind int, word long, n long").groupBy("lang_key", "kind", "word").agg(F.sum("n").alias("n"))
    for row in rows.toLocalIterator():
        words, classes, total = counted.setdefault(row.lang_key, ({}, np.zeros(N_CLASSES, np.int64), [0]))
        if row.kind == 0:
            words[row.word] = row.n
        elif row.kind == 1:
            total[0] = row.n
        else:
            classes[row.word] = row.n
    out = {}
    for x, (words, classes, (total,)) in counted.items():
        common = sorted((np.int64(w).view(np.uint64), n) for w, n in words.items() if n >= common_share * total and n > 0)
        n = np.array([n for _, n in common], np.int64)
        out[x] = np.array([w for w, _ in common], np.uint64), np.append(n, total - n.sum()), classes
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts p to the counts q; 0 where either is empty."""
    p = p / np.maximum(p.sum(-1, keepdims=True), 1)
    q = np.broadcast_to(q / max(q.sum(), 1), p.shape)
    m = (p + q) / 2

    def half(x):
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(-1)

    both = (p.sum(-1) > 0) & (q.sum(-1) > 0)
    return np.where(both, np.sqrt(np.clip((half(p) + half(q)) / 2, 0, 1)), 0.0)


def _repeated_words(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each document, its words in windows of WINDOW words that are found twice or more in it."""
    n, docs = len(hashes), len(first) - 1
    if n < WINDOW:
        return np.zeros(docs, np.int64)
    windows = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        windows += mixed(hashes[k : n - WINDOW + 1 + k] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
    of = np.repeat(np.arange(docs), np.diff(first))
    whole = np.flatnonzero(of[: n - WINDOW + 1] == of[WINDOW - 1 :])
    keys = mixed(windows[whole] ^ mixed(of[whole].astype(np.uint64) + np.uint64(1)))
    order = np.sort(keys)
    twice = distinct(order[1:][order[1:] == order[:-1]])
    covered = np.zeros(n + 1, np.int64)
    if len(twice):
        hit = whole[np.isin(keys, twice)]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    return per_doc(np.cumsum(covered[:-1]) > 0, first)


def _duplicate_lines(data: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each document, its \\n-split lines that hold a word and equal an earlier line."""
    docs = len(at) - 1
    breaks = np.flatnonzero(data == 10)
    begin = distinct(np.concatenate((at[:-1], breaks + 1)))
    begin = begin[begin < len(data)]
    of = np.searchsorted(at, begin, "right") - 1
    stop = np.minimum(np.append(begin[1:], len(data)), at[of + 1])
    stop -= data[np.maximum(stop - 1, 0)] == 10
    worded = np.searchsorted(starts, begin) < np.searchsorted(starts, stop)
    begin, stop, of = begin[worded], stop[worded], of[worded]
    unique = np.unique(first_equal(data, begin, stop, of))
    return np.bincount(of, minlength=docs) - np.bincount(of[unique], minlength=docs)


def _verdicts(batch: pa.RecordBatch, references: dict, max_char: float, max_word: float, guard_chars: int, guard_words: int) -> list[np.ndarray]:
    """The columns of NAMES after doc_id, for one slice of documents."""
    docs = batch.num_rows
    data, at, _ = utf8(batch.column("text"))
    starts, ends, first = word_edges(data, at)
    n_words = np.diff(first)
    lead = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    word_chars = per_doc(lead & (np.cumsum(inside[:-1]) > 0), at)
    repeated = _repeated_words(segment_hashes(data, starts, ends), first)
    failed = (n_words < MIN_WORDS) | (100 * repeated > REPEAT_PERCENT * n_words)
    doc = np.repeat(np.arange(docs), np.diff(at))
    chars = np.bincount(doc[lead] * N_CLASSES + _CLASS[data[lead]], minlength=docs * N_CLASSES).reshape(docs, N_CLASSES)
    hashes = segment_hashes(data, starts, ends, BYTE_VALUE_FOLDED)
    of = np.repeat(np.arange(docs), n_words)
    lang = np.array(_languages(batch), object)
    char_distance, word_distance, word_limit = np.zeros(docs), np.zeros(docs), np.full(docs, max_word)
    unknown = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(N_CLASSES, np.int64)
    for x in dict.fromkeys(lang):
        mine = np.flatnonzero(lang == x)
        common, word_counts, classes = references.get(x, unknown)
        char_distance[mine] = js_distance(chars[mine], classes)
        row = np.full(docs, -1)
        row[mine] = np.arange(len(mine))
        own = row[of] >= 0
        h, r = hashes[own], row[of[own]]
        place = np.minimum(np.searchsorted(common, h), max(len(common) - 1, 0))
        place = np.where(common[place] == h, place, len(common)) if len(common) else np.zeros(len(h), np.int64)
        k = len(common) + 1
        word_distance[mine] = js_distance(np.bincount(r * k + place, minlength=len(mine) * k).reshape(len(mine), k), word_counts)
        lacking = LACK * js_distance(np.eye(1, k, k - 1), word_counts)[0]
        expected = n_words[mine] * (word_counts[:-1].sum() / max(word_counts.sum(), 1))
        word_limit[mine] = np.where(expected >= EXPECTED, min(max_word, lacking), max_word)
    judged_chars, judged_words = chars.sum(1) >= guard_chars, n_words >= guard_words
    diverges = (judged_chars & (char_distance > max_char)) | (judged_words & (word_distance > word_limit))
    return [n_words, word_chars, per_doc(_SYMBOL[data], at), _duplicate_lines(data, at, starts), repeated, failed, ~failed & ~diverges, char_distance, word_distance]


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
_LIMITS = {"max_char": 0.3, "max_word": 0.45, "guard_chars": 200, "guard_words": 50}


def quality(documents: DataFrame, common_share: float = 0.004, **limits: float) -> DataFrame:
    """One row per document with its base counts, both distances and the verdict `kept`.

    documents: doc_id, text, lang. limits: max_char and max_word, the distances from which a document is rejected (by
    words also from LACK of the distance that its language gives without common words), and guard_chars and
    guard_words, the lengths from which it is judged by them. Two passes over the corpus make the
    references, a third judges; none shuffles text.
    """
    references, limits = language_references(documents, common_share), _LIMITS | limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                columns = [pa.array(c, {"b": pa.bool_(), "f": pa.float64()}.get(c.dtype.kind, pa.int64())) for c in _verdicts(batch, references, **limits)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], NAMES)

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"
    return documents.select("doc_id", "lang", "text").mapInArrow(run, schema)


def good_documents(documents: DataFrame, common_share: float = 0.004, **limits: float) -> DataFrame:
    """The rows of documents, with all their columns, that `quality` keeps."""
    references, limits = language_references(documents, common_share), _LIMITS | limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                yield batch.filter(pa.array(_verdicts(batch, references, **limits)[NAMES.index("kept") - 1]))

    return documents.mapInArrow(run, documents.schema)
