"""Ranked lexical search: exact maximum inner products over ball trees of sparse integer vectors.

1. Items (queries) come in blocks of about ITEM_BYTES of text, so what is sent to the executors is bounded whatever the
   number of items; each block ranks all documents. Only terms that some item of the block holds can score, so a
   document's vector has those terms alone.
2. One pass over the texts writes, for each document, the number of its terms and (term, occurrences) of its vector.
   Counts of documents, terms and documents with a term are added up in each task and then over tasks.
3. The weights of terms and, with them, the value of each (document, term) are integers, so scores are exact.
4. Each task deals its vectors into trees of up to TREE_ROWS documents. A node splits its documents between the one
   farthest from its centroid and the one farthest from that; it keeps the centroid c and the radius r, and no document
   below it scores more than q.c + |q|r. Sums are in double precision and bounds are rounded outwards by more than all
   their rounding errors, so no document is lost to rounding.
5. Nodes are visited best bound first. A node whose bound is under the k-th best score found so far by the task is left
   out with all its documents, and so are those after it; leaves are scored in 64-bit integers.
6. Each task returns its k best for each item, and a ranked window over those gives the k best of all.

Defined results: a null text has no term and is not counted; documents of one id are ranked one by one; a null doc_id
comes after all others of equal score; items of equal id and text are one, items of equal id and other texts are ranked
together (a document counts once, with its best score); an item with no term has no result; very long texts are read
whole; other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BYTE_VALUE_FOLDED, segment_hashes, slices, use_checkpoints, utf8, word_edges

ITEM_BYTES = 4_000_000
TREE_ROWS, TREE_ENTRIES, LEAF = 4096, 2_000_000, 32
#: Numbers that one step over centroids holds.
STEP = 2_000_000
_OUTSIDE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the terms (runs of ASCII letters, digits and other than ASCII bytes), and each text's first."""
    return word_edges(data, at, _OUTSIDE)


@dataclass
class Items:
    """A block of items. Term `t` of the vocabulary is the bytes text[edges[t]:edges[t + 1]], its hash is hashes[t]
    (sorted); item k asks for terms of[first[k]:first[k + 1]], `times` often each."""

    ids: list
    hashes: np.ndarray
    text: np.ndarray
    edges: np.ndarray
    first: np.ndarray
    of: np.ndarray
    times: np.ndarray


def parsed(rows: list) -> Items:
    """Items of rows (item_id, text)."""
    words: list[list[bytes]] = []
    for row in rows:
        data = np.frombuffer((row.text or "").encode(), np.uint8)
        starts, ends, _ = terms(data, np.array([0, len(data)]))
        folded = _FOLD[data].tobytes()
        words.append([folded[a:b] for a, b in zip(starts, ends, strict=True)])
    vocabulary = sorted({w for x in words for w in x})
    text = np.frombuffer(b"".join(vocabulary), np.uint8)
    edges = np.concatenate(([0], np.cumsum([len(w) for w in vocabulary]))).astype(np.int64)
    hashes = segment_hashes(text, edges[:-1], edges[1:], BYTE_VALUE_FOLDED)
    order = np.argsort(hashes, kind="stable")
    if len(hashes) != len(np.unique(hashes)):
        raise ValueError("two terms of the items have one hash")
    number = {vocabulary[k]: n for n, k in enumerate(order.tolist())}
    counts = [np.unique([number[w] for w in x], return_counts=True) if x else (np.zeros(0, np.int64),) * 2 for x in words]
    text = np.frombuffer(b"".join(vocabulary[k] for k in order.tolist()), np.uint8)
    edges = np.concatenate(([0], np.cumsum(np.diff(edges)[order])))
    first = np.concatenate(([0], np.cumsum([len(c[0]) for c in counts]))).astype(np.int64)
    return Items([r.item_id for r in rows], hashes[order], text, edges, first, np.concatenate([c[0] for c in counts]).astype(np.int64), np.concatenate([c[1] for c in counts]).astype(np.int64))


def _vectors(items: Items):
    """(doc_id, n, terms, times): the number of each text's terms, and those of the items' vocabulary that it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, at, _ = utf8(batch.column("text"))
                starts, ends, first = terms(data, at)
                n = np.diff(first)
                hashes = segment_hashes(data, starts, ends, BYTE_VALUE_FOLDED)
                place = np.minimum(np.searchsorted(items.hashes, hashes), max(len(items.hashes) - 1, 0))
                found = np.flatnonzero(items.hashes[place] == hashes) if len(items.hashes) else np.zeros(0, np.int64)
                found = found[_same_bytes(data, starts[found], ends[found], items, place[found])]
                doc = np.repeat(np.arange(len(n)), n)[found]
                keys, times = np.unique(doc * np.int64(len(items.hashes) + 1) + place[found], return_counts=True)
                doc, term = np.divmod(keys, len(items.hashes) + 1)
                edges = pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (term, times)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "times"])

    return run


def _same_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: Items, term: np.ndarray) -> np.ndarray:
    """Whether words with the hash of a term are the term."""
    lengths = ends - starts
    same = lengths == np.diff(items.edges)[term]
    if not same.any():
        return same
    lengths, starts, term = lengths[same], starts[same], term[same]
    edges = np.concatenate(([0], np.cumsum(lengths)))
    inside = np.arange(edges[-1]) - np.repeat(edges[:-1], lengths)
    equal = _FOLD[data[inside + np.repeat(starts, lengths)]] == items.text[inside + np.repeat(items.edges[term], lengths)]
    same[same] = np.logical_and.reduceat(equal, edges[:-1])
    return same


def _totals(size: int):
    """One task's counts: (term, documents with it), and under -1 the documents with a term, under -2 all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, length, holding = 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            documents, length = documents + int((n > 0).sum()), length + int(n.sum())
            holding += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((some, [-1, -2]))), pa.array(np.concatenate((holding[some], [documents, length])))], ["term", "n"])

    return run


@dataclass
class Rows:
    """Sparse rows: row k has values[edges[k]:edges[k + 1]] at columns[edges[k]:edges[k + 1]]; no row is empty."""

    edges: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        lengths = np.diff(self.edges)[rows]
        edges = np.concatenate(([0], np.cumsum(lengths)))
        flat = np.arange(edges[-1]) + np.repeat(self.edges[rows] - edges[:-1], lengths)
        return Rows(edges, self.columns[flat], self.values[flat])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * dense[self.columns], self.edges[:-1])


class Tree:
    """A ball tree of sparse non-negative integer rows. Node k has children left[k] and right[k], or if left[k] < 0 the
    rows leaf[k]; centroids and radii bound what is below it."""

    def __init__(self, rows: Rows, width: int):
        self.rows, self.width = rows, width
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaf: list[np.ndarray | None] = []
        self.centroids: list[tuple[np.ndarray, np.ndarray]] = []
        self.radii: list[float] = []
        exact = Rows(rows.edges, rows.columns, rows.values.astype(float))
        squares = np.add.reduceat(exact.values**2, exact.edges[:-1])
        stack = [(np.arange(len(squares)), -1, False)]
        while stack:
            members, parent, is_right = stack.pop()
            node, mine, lengths = len(self.left), exact.take(members), squares[members]
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            centroid = np.bincount(mine.columns, mine.values, width) / len(members)
            away = self._away(mine, lengths, centroid)
            self.left.append(-1)
            self.right.append(-1)
            self.leaf.append(None)
            some = np.flatnonzero(centroid)
            self.centroids.append((some, centroid[some]))
            # the squared distance is a difference of sums; it is rounded up by far more than their rounding errors
            self.radii.append(float(np.sqrt(max(0.0, (away + 1e-9 * (lengths + (centroid * centroid).sum())).max()))) * (1 + 1e-9))
            if len(members) <= LEAF:
                self.leaf[node] = members
                continue
            one = self._away(mine, lengths, self._dense(exact, members[int(away.argmax())]))
            two = self._away(mine, lengths, self._dense(exact, members[int(one.argmax())]))
            # no part is under an eighth; ties, such as rows that are all equal, are dealt in halves
            order, n, nearer = np.argsort(one - two, kind="stable"), len(members), int(np.count_nonzero(one < two))
            at = min(max(nearer, n // 8), n - n // 8) if nearer else n // 2
            stack += [(members[np.sort(order[:at])], node, False), (members[np.sort(order[at:])], node, True)]

    def _dense(self, rows: Rows, k: int) -> np.ndarray:
        out = np.zeros(self.width)
        out[rows.columns[rows.edges[k] : rows.edges[k + 1]]] = rows.values[rows.edges[k] : rows.edges[k + 1]]
        return out

    @staticmethod
    def _away(rows: Rows, squares: np.ndarray, point: np.ndarray) -> np.ndarray:
        return squares + (point * point).sum() - 2 * rows.dot(point)

    def bounds(self, first: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """(nodes x queries): what no row below a node scores more than, for sparse queries with no empty one."""
        weights = values.astype(float)
        norms = np.sqrt(np.add.reduceat(weights**2, first[:-1])) * (1 + 1e-9)
        out = np.empty((len(self.left), len(first) - 1))
        step = max(1, STEP // max(self.width, len(columns)))
        for low in range(0, len(out), step):
            part = self.centroids[low : low + step]
            dense = np.zeros((len(part), self.width))
            for k, (at, x) in enumerate(part):
                dense[k, at] = x
            out[low : low + step] = np.add.reduceat(dense[:, columns] * weights, first[:-1], axis=1)
        return (out + np.array(self.radii)[:, None] * norms) * (1 + 1e-9) + 1

    def search(self, bounds: np.ndarray, query: np.ndarray, best: list[tuple], ids: list, k: int) -> None:
        """Puts the rows of the k highest scores into the heap `best` of (score, -id); bounds: of each node, query: dense."""
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if len(best) == k and -bound < best[0][0]:
                return
            if self.leaf[node] is None:
                for child in (self.left[node], self.right[node]):
                    heapq.heappush(queue, (-bounds[child], child))
                continue
            members = self.leaf[node]
            scores = self.rows.take(members).dot(query)
            least = best[0][0] if len(best) == k else 1
            for x in np.flatnonzero(scores >= max(least, 1)).tolist():
                entry = (int(scores[x]), -ids[members[x]])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


NO_ID = 2**63 - 1
FOUND = "item int, doc_id long, score long"


def _searched(items: Items, weights: np.ndarray, documents: int, length: int, k: int):
    """The k best of a task's vectors for each item."""

    def tree_of(doc_ids: list, n: np.ndarray, lists: pa.Array, times: np.ndarray, found: list[list[tuple]]) -> None:
        sizes = np.diff(lists.offsets.to_numpy())
        some = np.flatnonzero(sizes)
        if not len(some):
            return
        m = 25 + (75 * n * documents) // length
        value = (1_000_000_000 * times) // (1000 * times + 8 * np.repeat(m, sizes))
        local, columns = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        tree = Tree(Rows(np.concatenate(([0], np.cumsum(sizes[some]))), columns, value), len(local))
        at = np.minimum(np.searchsorted(local, items.of), len(local) - 1)
        here = local[at] == items.of
        first = np.concatenate(([0], np.cumsum(here)))[items.first]
        asking = np.flatnonzero(np.diff(first))
        if not len(asking):
            return
        edges, columns, asked = np.concatenate((first[asking], first[-1:])), at[here], (items.times * weights[items.of])[here]
        ids = [NO_ID if doc_ids[x] is None else doc_ids[x] for x in some]
        query = np.zeros(len(local), np.int64)
        step = max(1, STEP // len(tree.left))
        for low in range(0, len(asking), step):
            part = edges[low : low + step + 1]
            bounds = tree.bounds(part - part[0], columns[part[0] : part[-1]], asked[part[0] : part[-1]])
            for x, item in enumerate(asking[low : low + step].tolist()):
                mine = slice(part[x], part[x + 1])
                query[columns[mine]] = asked[mine]
                tree.search(bounds[:, x], query, found[item], ids, k)
                query[columns[mine]] = 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple]] = [[] for _ in items.ids]
        held: list[pa.RecordBatch] = []
        rows = entries = 0

        def flush() -> None:
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                lists, times = (table.column(c).combine_chunks() for c in ("terms", "times"))
                tree_of(table.column("doc_id").to_pylist(), table.column("n").to_numpy(), lists, times.flatten().to_numpy().astype(np.int64), found)

        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                held.append(batch)
                rows, entries = rows + batch.num_rows, entries + len(batch.column("terms").flatten())
                if rows >= TREE_ROWS or entries >= TREE_ENTRIES:
                    flush()
                    held, rows, entries = [], 0, 0
        flush()
        flat = [(item, None if doc == -NO_ID else -doc, score) for item, best in enumerate(found) for score, doc in best]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*flat, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return run


def _ranked_block(spark: SparkSession, documents: DataFrame, rows: list, k: int, kind: str) -> DataFrame | None:
    items = parsed(rows) if rows else None
    if items is None or not len(items.hashes):
        return None
    folder = f"{use_checkpoints(spark).rstrip('/')}/vectors-{uuid.uuid4().hex}"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts.mapInArrow(_vectors(items), "doc_id long, n long, terms array<int>, times array<int>").write.parquet(folder)
    vectors = spark.read.parquet(folder)
    totals = {r.term: r.n for r in vectors.select("n", "terms").mapInArrow(_totals(len(items.hashes)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = totals.get(-1, 0)
    if not n:
        return None
    holding = np.array([totals.get(t, 0) for t in range(len(items.hashes))])
    weights = np.floor(1000 * np.log((2.0 * n + 2) / (2.0 * holding + 1))).astype(np.int64)
    # a term of no document is no column of any tree; one of most documents may weigh nothing or less than nothing
    found = vectors.filter("n > 0").mapInArrow(_searched(items, weights, n, totals[-2], k), FOUND)
    names = spark.createDataFrame(list(enumerate(items.ids)), f"item int, item_id {kind}")
    return found.join(F.broadcast(names), "item").select("item_id", "doc_id", "score")


def ranked(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 for each row of items (item_id, text)."""
    spark, kind = documents.sparkSession, dict(items.dtypes)["item_id"]
    items = items.select("item_id", "text").filter("text IS NOT NULL").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = max(1, -(-size // ITEM_BYTES)), None
    for block in range(blocks):
        part = _ranked_block(spark, documents, items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect(), k, kind)
        out = part if out is None else out if part is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    if blocks > 1 or items.count() > items.select("item_id").distinct().count():
        out = out.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
