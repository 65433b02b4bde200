"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side with fixed-width keys may be broadcast (1M longs: about 8 MB).
BROADCAST_ROWS = 1_000_000
#: Narrow rows that one task may read.
TASK_ROWS = 200_000
#: Text bytes that one numpy step works on; a longer single text makes a step of its own.
SLICE_BYTES = 750_000


def use_checkpoints(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names; without one only a local session gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not folder:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        context.setCheckpointDir(folder)
    return folder or context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def gathered(df: DataFrame) -> DataFrame:
    """A checkpoint that is read again by as many tasks as its rows need, so that small tables make small shuffles."""
    df = saved(df)
    return df.coalesce(max(1, -(-df.count() // TASK_ROWS)))


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """Broadcasts a side of checked size; beyond the bound Spark's shuffle join is used."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def whole_row(df: DataFrame, name: str = "row") -> Column:
    """All columns of a table as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias(name)


def unpacked(df: DataFrame, columns: list[str], changed: dict[str, Column], row: str = "row") -> DataFrame:
    """The columns of a whole_row again, those in `changed` with new values."""
    return df.select(*[(changed[c] if c in changed else F.col(row)[c]).alias(c) for c in columns])


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets (n + 1) and validity of a string column, without copying the bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    return raw[at[0] : at[-1]], at - at[0], valid


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows into parts of at most `most` text bytes, or of one row."""
    _, at, _ = utf8(batch.column(column))
    low, n = 0, batch.num_rows
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high
    # a worker is reused by later stages, which shouldn't find its memory taken by buffers of this one
    pa.default_memory_pool().release_unused()


def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive offsets; empty documents give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values; a sort is faster here than numpy's hashing."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


_random = np.random.default_rng(20240229)
BYTE_VALUE = _random.integers(1, 2**64, 256, np.uint64)
BYTE_VALUE_FOLDED = BYTE_VALUE.copy()
BYTE_VALUE_FOLDED[65:91] = BYTE_VALUE[97:123]
_multipliers = np.zeros(0, np.uint64)


def multipliers(n: int) -> np.ndarray:
    """n odd pseudo-random factors, one for each place in a segment. They are drawn one by one and aren't powers of a
    base, whose sums modulo 2**64 vanish on Thue-Morse patterns."""
    global _multipliers
    if len(_multipliers) < n:
        _multipliers = mixed(np.arange(1, max(n, 1024) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _multipliers[:n]


def segment_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of each non-empty segment data[start:end]; segments are in order and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    edges = np.concatenate(([0], np.cumsum(lengths)))
    inside = np.arange(edges[-1]) - np.repeat(edges[:-1], lengths)
    values = table[data[inside + np.repeat(starts, lengths)]]
    values *= multipliers(int(lengths.max()))[inside]
    return mixed(np.add.reduceat(values, edges[:-1]) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def equal_segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether each non-empty segment has the bytes of the segment whose number `others` gives."""
    lengths = ends - starts
    same = lengths == lengths[others]
    if not same.any():
        return same
    lengths, here, there = lengths[same], starts[same], starts[others[same]]
    edges = np.concatenate(([0], np.cumsum(lengths)))
    inside = np.arange(edges[-1]) - np.repeat(edges[:-1], lengths)
    same[same] = np.logical_and.reduceat(data[inside + np.repeat(here, lengths)] == data[inside + np.repeat(there, lengths)], edges[:-1])
    return same


def first_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """For each non-empty segment the number of one that has the same bytes (and the same `of`), one for all equal ones.

    Hashes propose, bytes decide: segments of one hash and other bytes are told apart by a dictionary.
    """
    keys = segment_hashes(data, starts, ends)
    if of is not None:
        keys = mixed(keys ^ mixed(of.astype(np.uint64) + np.uint64(1)))
    _, one, back = np.unique(keys, return_index=True, return_inverse=True)
    first = one[back]
    same = equal_segments(data, starts, ends, first)
    if of is not None:
        same &= of == of[first]
    seen: dict = {}
    for k in np.flatnonzero(~same).tolist():
        first[k] = seen.setdefault((None if of is None else int(of[k]), data[starts[k] : ends[k]].tobytes()), k)
    return first


MERSENNE = np.uint64(2**61 - 1)


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**61 - 1, for any 64-bit x."""
    x = (x & MERSENNE) + (x >> np.uint64(61))
    return np.where(x >= MERSENNE, x - MERSENNE, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for a and b below it, by halves of 31 bits."""
    a_high, a_low, b_high, b_low = a >> np.uint64(31), a & np.uint64(2**31 - 1), b >> np.uint64(31), b & np.uint64(2**31 - 1)
    middle = a_high * b_low + a_low * b_high
    return reduced(np.uint64(2) * a_high * b_high + (middle >> np.uint64(30)) + ((middle & np.uint64(2**30 - 1)) << np.uint64(31)) + a_low * b_low)


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo 2**61 - 1, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate((out, product(out, np.uint64(pow(base, len(out), 2**61 - 1)))))
    return out[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... of the values modulo 2**61 - 1 (fewer than 2**31 values below it)."""
    low, high = np.zeros(len(values) + 1, np.uint64), np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values & np.uint64(2**31 - 1), out=low[1:])
    np.cumsum(values >> np.uint64(31), out=high[1:])
    return reduced((high >> np.uint64(30)) + ((high & np.uint64(2**30 - 1)) << np.uint64(31)) + low)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_edges(data: np.ndarray, at: np.ndarray, outside: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes that aren't `outside`: 0x20 and 0x09-0x0D), and each document's first
    word (n + 1)."""
    inside = ~outside[data]
    first = np.empty(len(data), bool)
    last = np.empty(len(data), bool)
    if len(data):
        first[0] = True
        first[1:] = ~inside[:-1]
        last[-1] = True
        last[:-1] = ~inside[1:]
        some = at[:-1] < at[1:]
        first[at[:-1][some]] = True
        last[at[1:][some] - 1] = True
    starts = np.flatnonzero(inside & first)
    return starts, np.flatnonzero(inside & last) + 1, np.searchsorted(starts, at)
