"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Sequences hold CAPACITY tokens, so an instance of any size is a histogram of at most CAPACITY lengths. The histogram
comes to the driver (its size doesn't grow with the data) and is solved there, whole classes of equal lengths at once:

1. Reduction: for the longest remaining length, a set that provably dominates all its alternatives is fixed: alone, if
   nothing fits beside it; with the largest partner, if that fills the sequence, if no two others fit, or if no three
   others fit and no two fitting ones are longer together than the partner.
2. What is left is packed best-fit in decreasing order.

The plan has a bounded number of patterns: each one uses up a length or an open class (see PLAN_ROWS). Pieces are then numbered within their length by a
two-step rank (salted, so that one length may hold any share of the rows) and take their places by a join with the
plan. Every piece of a length is alike to the plan, so which one goes where doesn't change the number of sequences.

Defined results: null or empty texts are the end id alone; repeated rows are packed as often as they occur; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved, slices, utf8
from .tokens import TOKEN_SLICE
from .transducer import compiled

CAPACITY, END_ID = 4096, 1
#: Rows of one length that a single task numbers.
RANK_ROWS = 50_000
#: A plan has at most so many rows for each token of capacity, whatever the number of pieces, and is broadcast.
PLAN_ROWS = 64

Pattern = tuple  # (parent pattern or None, length, copies)


class _Plan:
    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            self.left[length] = n
        self.patterns: list[tuple[Pattern, int]] = []
        self.open: dict[int, list[tuple[Pattern, int]]] = {}
        self.residuals: list[int] = []

    def _largest(self, most: int) -> int:
        """The largest remaining length up to `most`, or 0."""
        some = np.flatnonzero(self.left[: max(most, 0) + 1])
        return int(some[-1]) if len(some) else 0

    def _take(self, lengths: tuple[int, ...], times: int) -> None:
        pattern: Pattern = None
        for x in lengths:
            pattern = (pattern, x, 1)
            self.left[x] -= times
        self.patterns.append((pattern, times))

    def _smallest(self, count: int, other_than: int) -> list[int]:
        """The `count` smallest remaining items beside one of the given length."""
        out: list[int] = []
        for x in np.flatnonzero(self.left).tolist():
            out += [x] * min(count - len(out), int(self.left[x]) - (x == other_than))
            if len(out) >= count:
                break
        return out

    def _longest_two(self, room: int, other_than: int) -> int:
        """The largest sum of two remaining items that fit the room, or 0."""
        here = self.left.copy()
        here[other_than] -= 1
        some = np.flatnonzero(here > 0)
        if not len(some):
            return 0
        place = np.searchsorted(some, room - some, "right") - 1
        fits = place >= 0
        a, b = some[fits], some[place[fits]]
        same = (a == b) & (here[a] < 2)
        lower = np.where(same, some[np.maximum(place[fits] - 1, 0)], b)
        good = ~same | (place[fits] > 0)
        return int((a + lower)[good].max()) if good.any() else 0

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for length in np.flatnonzero(self.left)[::-1].tolist():
                while self.left[length] > 0:
                    room = self.capacity - length
                    self.left[length] -= 1
                    partner = self._largest(room)
                    self.left[length] += 1
                    if not partner:
                        self._take((length,), int(self.left[length]))
                        changed = True
                        break
                    small = self._smallest(3, length)
                    dominates = partner == room or len(small) < 2 or small[0] + small[1] > room
                    if not dominates and (len(small) < 3 or sum(small) > room):
                        dominates = partner >= self._longest_two(room, length)
                    if not dominates:
                        break
                    # what dominates once dominates for every further copy: as items go, the smallest ones left only
                    # grow and the longest fitting two only shrink, so all copies are fixed at once
                    times = int(self.left[length] // 2 if partner == length else min(self.left[length], self.left[partner]))
                    self._take((length, partner), times)
                    changed = True

    def _keep(self, residual: int, pattern: Pattern, times: int) -> None:
        if times:
            if residual not in self.open:
                insort(self.residuals, residual)
            self.open.setdefault(residual, []).append((pattern, times))

    def best_fit(self) -> None:
        for length in np.flatnonzero(self.left)[::-1].tolist():
            count = int(self.left[length])
            self.left[length] = 0
            while count:
                at = bisect_left(self.residuals, length)
                if at < len(self.residuals):
                    residual = self.residuals[at]
                    groups = self.open[residual]
                    pattern, times = groups.pop()
                    if not groups:
                        del self.open[residual], self.residuals[at]
                else:
                    residual, pattern, times = self.capacity, None, count
                each = residual // length
                full = min(times, count // each)
                self._keep(residual - each * length, (pattern, length, each), full)
                count -= full * each
                times -= full
                if count and times:
                    part = min(count, each)
                    self._keep(residual - part * length, (pattern, length, part), 1)
                    count -= part
                    times -= 1
                if pattern is not None:
                    self._keep(residual, pattern, times)
        for groups in self.open.values():
            self.patterns += groups


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, low, high, sequence, offset, copies): pieces of that length with rank in [low, high) go to sequence
    + (rank - low) // copies at offset + (rank - low) % copies * length."""
    state = _Plan(histogram, capacity)
    state.reduce()
    state.best_fit()
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in state.patterns:
        offset = 0
        while pattern is not None:
            pattern, length, copies = pattern
            low = used.get(length, 0)
            used[length] = low + times * copies
            rows.append((length, low, used[length], sequence, offset, copies))
            offset += copies * length
        sequence += times
    return rows


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text's ids, the end id last, cut at the capacity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text", TOKEN_SLICE):
                data, at, _ = utf8(batch.column("text"))
                counts, ids = machine.run(data, at, True)
                sizes = counts + 1
                edges = np.concatenate(([0], np.cumsum(sizes)))
                stream = np.full(edges[-1], END_ID, "<u4")
                inside = np.ones(edges[-1], bool)
                inside[edges[1:] - 1] = False
                stream[inside] = ids
                n = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                begin = edges[row] + start
                raw = memoryview(stream).cast("B")
                crc = [zlib.crc32(raw[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    spark = cut.sparkSession
    cut = saved(cut)
    histogram = {row["length"]: row["n"] for row in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    schema = "length long, low long, high long, sequence long, slot long, copies long"
    rows = plan(histogram, capacity)
    slots = spark.createDataFrame(pa.Table.from_arrays([pa.array([row[k] for row in rows], pa.int64()) for k in range(6)], names=[x.split()[0] for x in schema.split(", ")]))
    slots = F.broadcast(slots) if len(rows) <= PLAN_ROWS * capacity else slots
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    # ranks start where the lower salts of the same length end: at most salts rows for each length
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("local", local).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    placed = ranked.join(slots, (ranked["length"] == slots["length"]) & (ranked["rank"] >= slots["low"]) & (ranked["rank"] < slots["high"])).drop(slots["length"])
    turn = F.col("rank") - F.col("low")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(turn / F.col("copies"))).alias("sequence_id"), (F.col("slot") + turn % F.col("copies") * F.col("length")).alias("offset"))


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(pieces(documents, tokenizer, capacity), capacity)
