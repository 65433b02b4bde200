"""Removal of repeated byte strings, exact over the whole corpus, with suffix arrays of shards.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too. Strings are dealt to shards by their
minimizer, the smallest hash of their KGRAM-byte substrings, which equal strings share; neighbouring starts with one
minimizer travel together as an atom, one substring of the text.

1. Each text gives its atoms (minimizer, hash of the bytes, place); no bytes are moved yet.
2. Atoms whose minimizer occurs once in the corpus, and once in the atom, can't hold a repeat and go: most of them.
3. Atoms of equal bytes are one content. A content with several places is a repeat as a whole.
4. The distinct contents of minimizers that have several are cut out of the texts, shuffled by minimizer, and each
   shard gets its suffix array by induced sorting; permuted common prefixes tell which strings occur again.
   The contents of a minimizer with more than HOT_BYTES of them are dealt again, as texts of their own, by minimizers
   of longer substrings (the next of KGRAMS), which fewer strings share; at the last length, LENGTH itself, a minimizer
   is one string.
5. Repeated ranges go back to the places of their content, are merged for each text, and cut out of it.

Matches never cross texts. Rows of equal id and text hash share their ranges, which depend on the text only.
Defined results: null or empty texts have nothing to remove; texts under LENGTH bytes hold no such string; repeated
rows of LENGTH bytes or more are removed whole; a very long text is cut into atoms like any other, in memory in
proportion to it; other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BYTE_VALUE, MERSENNE, mixed, powers, prefix_sums, product, reduced, saved, slices, use_checkpoints, utf8
from .suffix_array import reaches, suffix_array

LENGTH = 200
KGRAMS = (64, 136, 184, LENGTH)
SHARD_BYTES, HOT_BYTES = 1_000_000, 8_000_000
#: Places or ranges up to which a table of them is broadcast (about 40 bytes each).
BROADCAST_PLACES = 1_000_000
#: The drawn base of the text hash modulo 2**61 - 1, and the values of bytes (below 2**30).
_BASE = 0x1B2F6A94D70C35E1 % (2**61 - 1)
_VALUE = BYTE_VALUE >> np.uint64(34)
_ODD = np.uint64(0x9E3779B97F4A7C15)
CACHED = 16_384


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, ...]:
    """High and low halves of the powers of the base, and its inverse powers, modulo 2**61 - 1; and odd powers and their
    inverses modulo 2**64."""
    up = powers(_BASE, n)
    odd, inverse = np.full(n, _ODD, np.uint64), np.full(n, pow(int(_ODD), -1, 2**64), np.uint64)
    odd[0] = inverse[0] = 1
    return up >> np.uint64(31), up & np.uint64(2**31 - 1), powers(pow(_BASE, -1, 2**61 - 1), n), np.cumprod(odd), np.cumprod(inverse)


def _content_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers of the text hash, modulo 2**61 - 1."""
    n = len(data)
    high, low, down, *_ = _powers(1 << max(n, 1 << 20).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    # in steps that stay in the processor's cache
    for at in range(0, n, CACHED):
        part = slice(at, min(at + CACHED, n))
        value = _VALUE[data[part]]
        top = value * high[part]
        inside = prefix_sums(reduced((top >> np.uint64(30)) + ((top & np.uint64(2**30 - 1)) << np.uint64(31)) + value * low[part]))
        sums[part.start + 1 : part.stop + 1] = reduced(inside[1:] + sums[at])
    return sums, down


def _contents(sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], wherever they stand; equal ones are taken for equal contents."""
    return mixed(product(reduced(sums[end] + MERSENNE - sums[start]), inverse[start]))


def _grams(data: np.ndarray, kgram: int) -> np.ndarray:
    """Hashes of all k-grams. They choose minimizers only, so that unlike k-grams of one hash share a shard and cost
    nothing but that; a sum modulo 2**64 does."""
    n = len(data)
    *_, up, down = _powers(1 << max(n, 1 << 20).bit_length())
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[:n], out=sums[1:])
    return mixed((sums[kgram:] - sums[:-kgram]) * down[: n - kgram + 1] + np.uint64(kgram))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every window of the width, by doubling."""
    n = 1
    while 2 * n <= width:
        values, n = pick(values[:-n], values[n:]), 2 * n
    return pick(values[: len(values) - (width - n)], values[width - n :]) if width > n else values


def _atoms_of(data: np.ndarray, at: np.ndarray, kgram: int) -> tuple[np.ndarray, ...]:
    """Minimizer, content hash, document, start, number of strings, and whether the minimizer recurs, of each atom."""
    n, width = len(data), LENGTH - kgram + 1
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool))
    grams = _grams(data, kgram)
    least = _sliding(grams, width, np.minimum)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[: n - LENGTH + 1]
    whole = np.arange(n - LENGTH + 1) + LENGTH <= at[doc + 1]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~whole[:-1]
    start = np.flatnonzero(new & whole)
    last = np.ones(len(least), bool)
    last[:-1] = new[1:] | ~whole[1:]
    end = np.flatnonzero(last & whole) + 1
    content = _contents(*_content_sums(data), start, end + LENGTH - 1)
    # a k-gram that is the least of one of its strings; with one for each atom, no minimizer recurs inside an atom
    padded = np.full(len(grams) + width - 1, 0, np.uint64)
    padded[width - 1 : width - 1 + len(least)] = np.where(whole, least, 0)
    chosen = np.flatnonzero(grams == _sliding(padded, width, np.maximum)[: len(grams)])
    recurs = np.zeros(len(start), bool)
    of = doc[start]
    odd = np.bincount(np.searchsorted(at, chosen, "right") - 1, minlength=len(at) - 1) != np.bincount(of, minlength=len(at) - 1)
    for k in np.flatnonzero(odd[of]).tolist():
        recurs[k] = np.count_nonzero(grams[start[k] : end[k] + width - 1] == least[start[k]]) > 1
    return least[start], content, of, start - at[of], end - start, recurs


ATOM_SCHEMA = "doc_id long, text_hash long, minimizer long, content long, start int, strings int, recurs boolean"


def _atoms(kgram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, at, _ = utf8(batch.column("text"))
                minimizer, content, of, start, strings, recurs = _atoms_of(data, at, kgram)
                rows = pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(minimizer.view(np.int64)), pa.array(content.view(np.int64)), pa.array(start, pa.int32()), pa.array(strings, pa.int32()), pa.array(recurs)],
                    ["doc_id", "text_hash", "minimizer", "content", "start", "strings", "recurs"],
                )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the atoms listed with each text."""
    for batch in batches:
        raw = batch.column("text").cast(pa.binary())
        out: list[tuple] = []
        for text, wanted in zip(raw, batch.column("wanted"), strict=True):
            b = text.as_py()
            out += [(w["minimizer"], w["content"], b[w["start"] : w["start"] + w["strings"] + LENGTH - 1]) for w in wanted.as_py()]
        columns = zip(*out, strict=True) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["minimizer", "content", "bytes"])


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sorted_shard(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Ranges of repeated strings in each content of whole minimizer groups, from the shard's suffix array."""
    joined = np.frombuffer(b"\0".join(b for _, _, b in rows) + b"\0", np.uint8).astype(np.int32) + 2
    sizes = np.array([len(b) for _, _, b in rows])
    edges = np.concatenate(([0], np.cumsum(sizes + 1)))
    joined[edges[1:] - 1] = 1
    starts, ends = _runs(_whole_strings(reaches(joined, suffix_array(joined), LENGTH), edges))
    of = np.searchsorted(edges, starts, "right") - 1
    return _ranges([rows[k][0] for k in of], [rows[k][1] for k in of], starts - edges[of], ends - edges[of] + LENGTH - 1)


def _whole_strings(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Leaves out positions whose string would cross the end of its content."""
    last = np.repeat(edges[1:] - 1, np.diff(edges))
    return flags & (np.arange(len(flags)) + LENGTH <= last)


def _ranges(minimizers, contents, starts, ends) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(minimizers, pa.int64()), pa.array(contents, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["minimizer", "content", "low", "high"])


def _sorted_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by minimizer; shards are of about SHARD_BYTES and hold whole groups."""
    rows: list[tuple[int, int, bytes]] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= SHARD_BYTES and row[0] != rows[-1][0]:
                yield _sorted_shard(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[2])
    if rows:
        yield _sorted_shard(rows)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges each text's ranges to maximal runs."""
    for batch in batches:
        lows, highs = [], []
        for spans in batch.column("spans"):
            low: list[int] = []
            high: list[int] = []
            for a, b in sorted((x["low"], x["high"]) for x in spans.as_py()):
                if high and a <= high[-1]:
                    high[-1] = max(high[-1], b)
                else:
                    low.append(a)
                    high.append(b)
            lows.append(low)
            highs.append(high)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32()))], ["doc_id", "text_hash", "lows", "highs"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = batch.column("text").cast(pa.binary())
        removed, runs, digests, sizes = [], [], [], []
        for text, lows, highs in zip(raw, batch.column("lows").to_pylist(), batch.column("highs").to_pylist(), strict=True):
            b, at, kept = text.as_py() or b"", 0, hashlib.sha256()
            for low, high in zip(lows or (), highs or (), strict=True):
                kept.update(b[at:low])
                at = high
            kept.update(b[at:])
            sizes.append(len(b))
            runs.append(len(lows or ()))
            removed.append(sum(highs or ()) - sum(lows or ()))
            digests.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(texts: DataFrame, level: int = 0) -> DataFrame:
    """(doc_id, text_hash, lows, highs): the maximal repeated byte runs of texts (doc_id, text_hash, text)."""
    spark = texts.sparkSession
    folder = f"{use_checkpoints(spark).rstrip('/')}/atoms-{uuid.uuid4().hex}"
    # a compressed table, read twice; a checkpoint would hold the rows uncompressed
    texts.filter(F.octet_length("text") >= LENGTH).mapInArrow(_atoms(KGRAMS[level]), ATOM_SCHEMA).write.parquet(folder)
    atoms = spark.read.parquet(folder)

    shared = atoms.groupBy("minimizer").agg(F.count("*").alias("n"), F.max("recurs").alias("recurs")).filter("n > 1 OR recurs").select("minimizer")
    shared = saved(shared)
    places = saved(atoms.join(shared, "minimizer", "left_semi"))
    contents = places.groupBy("minimizer", "content").agg(F.count("*").alias("n"), F.max("recurs").alias("recurs"), F.min(F.struct("doc_id", "text_hash", "start", "strings")).alias("first"))
    contents = saved(contents)

    # bytes of one place of each content that shares its minimizer with others, or may repeat within itself
    groups = contents.groupBy("minimizer").agg(F.count("*").alias("contents"), F.max("recurs").alias("recurs"), F.sum(F.col("first.strings").cast("long") + LENGTH - 1).alias("bytes")).filter("contents > 1 OR recurs").select("minimizer", (F.col("bytes") > HOT_BYTES).alias("hot"))
    groups = saved(groups)
    needed = saved(contents.join(groups, "minimizer", "left_semi").select("minimizer", "content", "first.*"))
    n_needed = needed.count()
    wanted = needed.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("minimizer", "content", "start", "strings")).alias("wanted"))
    cut = texts.join(F.broadcast(wanted) if n_needed <= BROADCAST_PLACES else wanted, ["doc_id", "text_hash"]).select("text", "wanted").mapInArrow(_cut, "minimizer long, content long, bytes binary").dropDuplicates(["minimizer", "content"])
    cut = cut.join(groups, "minimizer")
    hot = level + 1 < len(KGRAMS) and not groups.filter("hot").isEmpty()
    cut = saved(cut) if hot else cut
    ordered = (cut.filter("NOT hot") if hot else cut).select("minimizer", "content", "bytes").repartition("minimizer").sortWithinPartitions("minimizer")
    ranges = ordered.mapInArrow(_sorted_shards, "minimizer long, content long, low int, high int")
    if hot:
        again = repeated_ranges(cut.filter("hot").select(F.col("content").alias("doc_id"), F.col("minimizer").alias("text_hash"), F.col("bytes").alias("text")), level + 1)
        again = again.select(F.col("text_hash").alias("minimizer"), F.col("doc_id").alias("content"), F.explode(F.arrays_zip("lows", "highs")).alias("r"))
        ranges = ranges.unionByName(again.select("minimizer", "content", F.col("r.lows").alias("low"), F.col("r.highs").alias("high")))
    whole = contents.filter("n > 1").select("minimizer", "content", F.lit(0).alias("low"), (F.col("first.strings") + LENGTH - 1).alias("high"))
    ranges = ranges.join(whole.select("minimizer", "content"), ["minimizer", "content"], "left_anti").unionByName(whole)
    spans = places.join(ranges, ["minimizer", "content"]).select("doc_id", "text_hash", F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")).alias("span"))
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_list("span").alias("spans")).mapInArrow(_merged, "doc_id long, text_hash long, lows array<int>, highs array<int>")


def without_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of documents (doc_id, text)."""
    kind = dict(documents.dtypes)["doc_id"]
    texts = documents.select(F.col("doc_id").alias("id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = saved(repeated_ranges(texts.select("doc_id", "text_hash", "text")))
    n = ranges.agg(F.sum(F.size("lows"))).first()[0] or 0
    joined = texts.join(F.broadcast(ranges) if n <= BROADCAST_PLACES else ranges, ["doc_id", "text_hash"], "left").select("id", "text", "lows", "highs")
    return joined.mapInArrow(_without, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
