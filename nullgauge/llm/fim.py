"""Fill-in-the-middle transformation with cuts at line ends, found in a Fenwick tree over blocks of the text.

A text is cut into blocks of BLOCK bytes. Two Fenwick trees of the same shape hold how many lines end in each block and
how many code points start in it. The descent by binary lifting takes the largest run of whole blocks with fewer line
ends than asked for, and adds up its code points on the way; the line end itself is then looked for in one block only.
So a cut costs the logarithm of the number of blocks and one block, however long the text is.

A document's draws are the first four 8-digit groups of the hex sha256 of `seed:doc_id`, so reruns and any partitioning
agree, and no state is shared between rows: a scan without a shuffle.

Defined results: a null text is empty, and an empty one is plain, as is a text that holds a sentinel; a null doc_id
draws as an empty string does; repeated rows give repeated results; a very long text is transformed whole, in memory in
proportion to it; other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices, utf8

BLOCK = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def fenwick(counts: np.ndarray) -> np.ndarray:
    """The tree of counts (blocks x kinds): row i (from 1) holds the sums of the `i & -i` blocks that end with block i."""
    total = np.concatenate((np.zeros((1, counts.shape[1]), np.int64), np.cumsum(counts, 0)))
    at = np.arange(len(total))
    return total - total[at - (at & -at)]


def descend(tree: list[list[int]], asked: int) -> tuple[int, int, int]:
    """Of a tree of (line ends, code points): the number of leading blocks with fewer than `asked` (1 or more) line ends
    in all, and the two sums over them."""
    place, ends, points = 0, 0, 0
    step = 1 << (len(tree) - 1).bit_length()
    while step:
        if place + step < len(tree) and ends + tree[place + step][0] < asked:
            place += step
            ends += tree[place][0]
            points += tree[place][1]
        step >>= 1
    return place, ends, points


class Lines:
    """The lines of one text, as bytes of UTF-8: [^\\n]*\\n|[^\\n]+."""

    def __init__(self, data: np.ndarray):
        self.data, blocks = data, -(-len(data) // BLOCK)
        edges = np.arange(blocks) * BLOCK
        counts = np.zeros((blocks, 2), np.int64)
        if blocks:
            counts[:, 0] = np.add.reduceat(data == 10, edges, dtype=np.int64)
            counts[:, 1] = np.add.reduceat((data & 0xC0) != 0x80, edges, dtype=np.int64)
        self.tree = fenwick(counts).tolist()
        self.ends, self.points = (int(x) for x in counts.sum(0))
        self.n = self.ends + bool(len(data) and data[-1] != 10)

    def cut(self, lines: int) -> tuple[int, int]:
        """The place after the first `lines` lines, in bytes and in code points."""
        if lines == 0:
            return 0, 0
        if lines > self.ends:
            return len(self.data), self.points
        block, ends, points = descend(self.tree, lines)
        part = self.data[block * BLOCK : (block + 1) * BLOCK]
        inside = int(np.flatnonzero(part == 10)[lines - ends - 1]) + 1
        return block * BLOCK + inside, points + int(np.count_nonzero((part[:inside] & 0xC0) != 0x80))


def fill_in_middle(documents: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for every row of documents (doc_id, text).

    rate: percent of the documents that are transformed; spm_rate: percent of those in suffix-prefix-middle form.
    """
    sentinels = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]

    def transformed(name: str, data: np.ndarray) -> tuple[int, str, int | None, int | None, bytes]:
        lines, raw = Lines(data), data.tobytes()
        digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
        one, two, three, four = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
        if not raw or three % 100 >= rate or any(s in raw for s in sentinels):
            return lines.n, "plain", None, None, raw
        low, high = sorted((one % (lines.n + 1), two % (lines.n + 1)))
        (begin, prefix_chars), (end, chars) = lines.cut(low), lines.cut(high)
        prefix, middle, suffix = raw[:begin], raw[begin:end], raw[end:]
        p, s, m = sentinels
        if four % 100 < spm_rate:
            return lines.n, "spm", prefix_chars, chars - prefix_chars, s + suffix + p + prefix + m + middle
        return lines.n, "psm", prefix_chars, chars - prefix_chars, p + prefix + s + suffix + m + middle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, at, _ = utf8(batch.column("text"))
                names = batch.column("name").to_pylist()
                rows = [transformed(name or "", data[at[k] : at[k + 1]]) for k, name in enumerate(names)]
                n, form, prefix, middle, output = zip(*rows, strict=True)
                columns = pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = dict(documents.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return documents.select("doc_id", F.col("doc_id").cast("string").alias("name"), "text").mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of a form was made of. Sentinels occur once each: texts that hold one are plain, and none
    can arise where two parts meet, since `<` stands only at a sentinel's start."""

    def after(s: str) -> Column:
        return F.expr(f"substring({output}, locate('{s}', {output}) + {len(s)})")

    def between(a: str, b: str) -> Column:
        start = f"locate('{a}', {output}) + {len(a)}"
        return F.expr(f"substring({output}, {start}, locate('{b}', {output}) - ({start}))")

    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
