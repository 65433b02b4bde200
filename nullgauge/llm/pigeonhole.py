"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c are apart by the squared distance 2 - 2c, which a rotation keeps. Cut into blocks of WIDTH
rotated components (wider for vectors of over BLOCKS x WIDTH), a pair within the limit has a block whose squared distance is at most its share of the limit, in
proportion to its width. So a range join in each low-dimensional block, and the exact test of the union of what these
joins find, loses no link.

1. Equal vectors of a label are one node with a weight. Groups of near copies are gathered into balls: a node goes to
   the first of a bounded number of leaders, drawn from the table, that is nearer than half of the limit. Nodes of one
   ball are linked whatever they are, by the triangle inequality, and are never compared.
2. In each block the leading components are cut into cells as wide as the block's limit, so a pair within it lies in the
   same or in neighbouring cells. Nodes of a cell and ball are dealt into parts of at most PART by hash.
3. Parts of neighbouring cells, but those of one ball, meet in one task each, where block distances by matrix products
   choose candidates. A pair counts in the first block that holds it within its limit only, which each task can tell
   from the two vectors, so links are counted without listing pairs and without counting one twice.
4. A task returns the number of links of each of its nodes, and a spanning forest of its links instead of the links.
   Sums of the first are n_links; components of the forests, joined with the balls, are the components.

The work grows with the pairs of neighbouring parts, but no pair becomes a row.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, and rows of a null label or
vec_id, link with nothing (n_links 0, component and id equal); vectors of different lengths don't link; rows of equal
vec_id are vectors of their own, with the component of the smallest id that each reaches; very long vectors are
compared whole; other columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import _rows, _unit, _usable, rotated
from .components import components
from .shared import saved, small_or_shuffled

WIDTH, PART = 8, 2048
#: Blocks that a vector is cut into at most; beyond it they get wider, so that a row isn't copied for ever more joins.
BLOCKS = 16
#: Rows of a label from which blocks are cut by more than one component, by one for each factor of CELL_GROWTH.
CELL_ROWS, CELL_GROWTH, MOST_AXES = 200_000, 8, 4
#: Rows drawn to look for leaders, the rows near one that make it a leader, and leaders kept.
DRAWN, CROWD, LEADERS = 2048, 8, 256
#: What rounding may add to a squared distance of unit vectors.
SLACK = 1e-9
#: Pairs that one step tests.
STEP = 100_000
_SEED = 7_000_000


def limit(cosine: float) -> float:
    """The squared distance of unit vectors of a cosine, rounded up."""
    return 2 - 2 * cosine + SLACK


def coordinates(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors (rows x blocks x width of a block), padded with zeros."""
    size = max(WIDTH, 1 << (x.shape[1] - 1).bit_length())
    return rotated(_unit(x), _SEED, size).reshape(len(x), -1, max(WIDTH, size // BLOCKS))


def _cells(cosine: float, axes: int):
    """The cell of each node in each block: one number for each of the leading components."""

    def run(batches):
        for batch in batches:
            x = _rows(batch.column("vector"))
            if len(x):
                y = coordinates(x)
                width = np.sqrt(limit(cosine) / y.shape[1]) * (1 + 1e-9)
                cells = np.floor(y[:, :, :axes] / width).astype(np.int32)
                n = y.shape[1]
                block = pa.array(np.tile(np.arange(n, dtype=np.int32), len(x)))
                flat = pa.array(cells.ravel())
                cell = pa.ListArray.from_arrays(pa.array(np.arange(len(x) * n + 1, dtype=np.int32) * axes), flat)
                rows = pa.array(np.repeat(np.arange(len(x)), n))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(rows), batch.column("kind").take(rows), batch.column("ball").take(rows), block, cell], ["node", "kind", "ball", "block", "cell"])

    return run


def _leaders(sample: list, cosine: float) -> list[tuple[int, np.ndarray]]:
    """(kind, unit vector) of drawn rows in whose ball many other drawn rows lie; most crowded first."""
    radius, out = limit(cosine) / 4 * 0.98, []
    kinds = np.array([r.kind for r in sample])
    for kind in dict.fromkeys(kinds.tolist()):
        x = _unit(np.array([r.vector for r, k in zip(sample, kinds, strict=True) if k == kind], np.float64))
        near = 2 - 2 * x @ x.T <= radius
        while len(near) and (n := near.sum(1)).max() >= CROWD:
            k = int(n.argmax())
            out.append((int(n[k]), kind, x[k]))
            left = ~near[k]
            near, x = near[left][:, left], x[left]
    return [(kind, x) for _, kind, x in sorted(out, key=lambda t: -t[0])[:LEADERS]]


def _balls(leaders: list[tuple[int, np.ndarray]], cosine: float):
    """The first leader of each node that is near enough, or -1."""
    # two nodes of a ball are apart by twice the radius at most, so their squared distance stays under the limit by 2 %
    radius = limit(cosine) / 4 * 0.98

    def run(batches):
        for batch in batches:
            x, kinds = _rows(batch.column("vector")), batch.column("kind").to_numpy()
            ball = np.full(len(kinds), -1, np.int32)
            if len(x):
                unit = _unit(x)
                for k, (kind, point) in enumerate(leaders):
                    mine = np.flatnonzero((kinds == kind) & (ball < 0)) if len(point) == x.shape[1] else []
                    if len(mine):
                        ball[mine[2 - 2 * unit[mine] @ point <= radius]] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ball)], [*batch.schema.names, "ball"])

    return run


def _linked(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the cosine of each pair of rows reaches the limit: sums in component order, in double precision."""
    product, one, two = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for k in range(x.shape[1]):
        product += x[:, k] * y[:, k]
        one += x[:, k] * x[:, k]
        two += y[:, k] * y[:, k]
    return product / (np.sqrt(one) * np.sqrt(two)) >= cosine


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1, so that no sum overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b among n nodes: the nodes that have one, and the smallest number that each reaches."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.unique(np.concatenate((a, b)))
    return some, label[some]


def _meet(cosine: float):
    """Links between the nodes of two parts, or within one, that are first within the limit in this block."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("head", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        block, same = left.column("block")[0].as_py(), left.column("same")[0].as_py()
        x, y = _rows(left.column("vector")), _rows(right.column("vector"))
        nodes, others = left.column("node").to_numpy(), right.column("node").to_numpy()
        weights, other_weights = left.column("weight").to_numpy(), right.column("weight").to_numpy()
        p, q = coordinates(x), coordinates(y)
        share = limit(cosine) / p.shape[1]
        mine, theirs = np.ascontiguousarray(p[:, block]), np.ascontiguousarray(q[:, block])
        squares = (theirs * theirs).sum(1)
        x, y = _scaled(x), _scaled(y)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for low in range(0, len(mine), step := max(1, 20 * STEP // len(theirs))):
            part = mine[low : low + step]
            rough = (part * part).sum(1)[:, None] + squares - 2 * part @ theirs.T
            a, b = np.nonzero(rough <= share + SLACK)
            a += low
            if same:
                a, b = a[nodes[a] < others[b]], b[nodes[a] < others[b]]
            for at in range(0, len(a), STEP):
                i, j = a[at : at + STEP], b[at : at + STEP]
                # the same sums in every task that sees the pair, so exactly one of its blocks is the first
                for k in range(block + 1):
                    gap = np.zeros(len(i))
                    for c in range(p.shape[2]):
                        gap += (p[i, k, c] - q[j, k, c]) ** 2
                    kept = gap <= share if k == block else gap > share
                    i, j = i[kept], j[kept]
                linked = _linked(x[i], y[j], cosine)
                found.append((i[linked], j[linked]))
        if not found:
            return schema.empty_table()
        i, j = (np.concatenate(z) for z in zip(*found, strict=True))
        if not len(i):
            return schema.empty_table()
        every, number = np.unique(np.concatenate((nodes, others)), return_inverse=True)
        a, b = number[: len(nodes)][i], number[len(nodes) :][j]
        links = np.zeros(len(every), np.int64)
        np.add.at(links, a, other_weights[j])
        np.add.at(links, b, weights[i])
        some, head = _forest(a, b, len(every))
        return pa.Table.from_arrays([pa.array(every[some]), pa.array(links[some]), pa.array(every[head])], schema=schema)

    return run


def _neighbours(cell: str, axes: int) -> Column:
    """The cell itself and the half of its neighbours that comes after it, so that two cells meet once."""
    steps = [()]
    for _ in range(axes):
        steps = [(*s, d) for s in steps for d in (-1, 0, 1)]
    after = [s for s in steps if s >= (0,) * axes]
    return F.array(*[F.array(*[(F.col(cell)[k] + d).cast("int") for k, d in enumerate(s)]) for s in after])


def linked(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, label, embedding)."""
    wide = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = saved(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.when(_usable("embedding"), F.col("embedding").cast(f"array<{wide}>")).alias("vector")))
    live = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    # numbers of nodes are drawn by place, so the table is saved before anything looks at them
    classes = live.groupBy("label", "vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    kinds = saved(live.groupBy("label", F.size("vector").alias("length")).agg(F.count("*").alias("rows")).withColumn("kind", F.monotonically_increasing_id()))
    most, n_kinds = kinds.agg(F.max("rows"), F.count("*")).first()
    out = rows.select("vec_id", "label", "vector")
    if most is None:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    axes = 1
    while axes < MOST_AXES and most > CELL_ROWS * CELL_GROWTH ** (axes - 1):
        axes += 1
    nodes = classes.withColumn("length", F.size("vector")).join(small_or_shuffled(kinds.drop("rows"), n_kinds), ["label", "length"])
    nodes = saved(nodes.select(F.monotonically_increasing_id().alias("node"), "kind", "label", "vector", "weight", "least"))
    # batches hold vectors of one length
    by_length = [nodes.filter(F.size("vector") == r.length) for r in kinds.select("length").distinct().orderBy("length").collect()]
    tables = []
    for table in by_length:
        sample = table.orderBy(F.xxhash64("least", "node"), "node").limit(DRAWN).select("kind", "vector").collect()
        leaders = _leaders(sample, cosine)
        table = saved(table.select("node", "kind", "vector", "weight").mapInArrow(_balls(leaders, cosine), f"node long, kind long, vector array<{wide}>, weight long, ball int"))
        tables.append(_met(table, cosine, axes))
        if leaders:
            whole = table.filter("ball >= 0").groupBy("kind", "ball").agg(F.sum("weight").alias("ball_weight"), F.min("node").alias("head"))
            tables.append(table.filter("ball >= 0").join(F.broadcast(whole), ["kind", "ball"]).select("node", (F.col("ball_weight") - F.col("weight")).alias("links"), "head"))
    parts = tables[0]
    for more in tables[1:]:
        parts = parts.unionByName(more)
    parts = saved(parts)
    counts = parts.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(parts.select("node", "head"), "node", "head")
    placed = nodes.select("node", "label", "vector", "weight", "least").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "component").join(counts, "node", "left")
    placed = placed.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    usable = out.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").join(placed, ["label", "vector"])
    rest = out.filter("vec_id IS NULL OR label IS NULL OR vector IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = usable.select("vec_id", "n_links", "component_id").unionByName(rest)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _met(table: DataFrame, cosine: float, axes: int) -> DataFrame:
    """(node, links, head) of the links of a table (node, kind, vector, weight, ball) of vectors of one length."""
    placed = saved(table.select("node", "kind", "ball", "vector").mapInArrow(_cells(cosine, axes), "node long, kind long, ball int, block int, cell array<int>"))
    cell = ["kind", "block", "cell", "ball"]
    sizes = placed.groupBy(*cell).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    sizes = saved(sizes.withColumn("group", F.monotonically_increasing_id()))
    sub = sizes.select(*cell, "group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # a short table of parts: cells that hold nodes, and one more row for each PART nodes of a cell
    one = sub.select("kind", "block", F.col("ball").alias("ball_a"), F.col("group").alias("group_a"), F.col("part").alias("part_a"), F.col("cell").alias("cell_a"), F.explode(_neighbours("cell", axes)).alias("cell"))
    two = sub.select("kind", "block", "cell", F.col("ball").alias("ball_b"), F.col("group").alias("group_b"), F.col("part").alias("part_b"))
    met = one.join(two, ["kind", "block", "cell"]).filter("ball_a < 0 OR ball_a != ball_b")
    # within a cell each pair of parts meets once
    met = met.filter("cell_a != cell OR group_a < group_b OR (group_a = group_b AND part_a <= part_b)")
    met = saved(met.withColumn("same", F.expr("group_a = group_b AND part_a = part_b")).withColumn("pair", F.monotonically_increasing_id()))
    n_sizes, n_met = sizes.count(), met.count()
    dealt = placed.join(small_or_shuffled(sizes, n_sizes), cell).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("node", "group", "part", "block")
    vectors = table.select("node", "vector", "weight")

    def side(k: str) -> DataFrame:
        pairs = met.select(F.col(f"group_{k}").alias("group"), F.col(f"part_{k}").alias("part"), "pair", "same")
        return dealt.join(small_or_shuffled(pairs, n_met), ["group", "part"]).join(vectors, "node").select(*[F.col(c).alias(c) for c in ("pair", "same", "block", "node", "weight", "vector")])

    return side("a").groupBy("pair").cogroup(side("b").groupBy("pair")).applyInArrow(_meet(cosine), "node long, links long, head long")
