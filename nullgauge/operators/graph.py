"""Graph operators on edge tables (src, dst, w); undirected edges are held once with src < dst."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import adjacency
from .draws import Latest, at_places, dealt, in_hash_order, intervals_of, key, numbered, ranged_draws, saved, spread, u32, written


#: Members of groups in a task that pairs them.
MEMBERS_A_TASK = 500_000
#: Classes of nodes whose square is the number of jobs that triangles are counted in.
FIRSTS = 64


def co_occurrence(members: DataFrame, group: str, item: str, most: int | None = None) -> DataFrame:
    """(src, dst, w): pairs of items that share groups, w the number of groups; groups above `most` items are left out
    where the measure says so, and counted by `oversized_groups`."""
    # tasks of so many members each, however many there are; the planner's own number follows bytes and grows each task
    tasks = max(members.sparkSession.sparkContext.defaultParallelism, -(-members.count() // MEMBERS_A_TASK))
    rows = members.select(group, item).repartition(tasks, group).distinct()
    if most is not None:
        rows = rows.join(rows.groupBy(group).count().filter(F.col("count") <= most).select(group), group, "left_semi")
    a, b = rows.select(group, F.col(item).alias("src")), rows.select(group, F.col(item).alias("dst"))
    return a.hint("merge").join(b, group).filter("src < dst").groupBy("src", "dst").agg(F.count("*").alias("w"))


def oversized_groups(members: DataFrame, group: str, item: str, most: int) -> DataFrame:
    sizes = members.select(group, item).distinct().groupBy(group).count()
    return sizes.agg(F.count_if(F.col("count") > most).alias("oversized"), F.count("*").alias("all_groups"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean, median and largest degree."""
    d = degrees(edges)
    out = d.agg(F.count("*").alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.avg("degree").alias("mean_degree"), F.percentile("degree", 0.5).alias("median_degree"), F.max("degree").alias("max_degree"))
    return out.withColumn("density", 2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)))


def _forest(edges: DataFrame) -> DataFrame:
    """Fewer edges that connect the same: ranges of nodes meet in tasks, where each node seen gets one edge to the smallest
    that the task's edges connect it to. Ids that aren't whole numbers stay as they are."""
    kinds = {edges.schema[c].dataType.simpleString() for c in ("src", "dst")}
    if not kinds <= {"bigint", "int"}:
        return edges.select("src", "dst")
    ends, n = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")), edges.count()
    trees = ends.repartitionByRange(max(1, -(-n // adjacency.EDGES)), "src").mapInArrow(adjacency.trees, "src long, dst long")
    return written(trees).select(*[F.col(c).cast(edges.schema[c].dataType) for c in ("src", "dst")])


def component_labels(edges: DataFrame) -> DataFrame:
    """(node, component): smallest reachable node, by hooking to the least neighbour label and jumping to label of label."""
    around = saved(both_ways(_forest(edges).withColumn("w", F.lit(1))).select("src", "dst").distinct())
    labels = saved(around.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("component")))
    before = None
    while True:
        seen = around.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(seen, "node").select("node", F.least("component", "near").alias("component"))
        jump = hooked.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = saved(hooked.join(jump, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component")))
        now = labels.agg(F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now


def triangles(edges: DataFrame) -> DataFrame:
    """(node, degree, triangles, clustering): nodes are dealt to classes, and each three classes meet in a task with the
    edges between them. A triangle is found in one task only, by the shorter of two lists, and no wedge is a row: an edge
    is copied, packed, to as many tasks as there are classes and one more."""
    d = degrees(edges).select("node", "degree")
    e = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src != dst")
    n = max(1, math.ceil(math.sqrt(3 * e.count() / adjacency.EDGES)))
    cls = {c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c in ("src", "dst")}
    ends = [F.struct(cls[c].alias("k"), F.col(c).alias("id")) for c in ("src", "dst")]
    ordered = e.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).select(F.col("a.k").alias("i"), F.col("b.k").alias("j"), F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    packs = written(ordered.groupBy("i", "j").applyInArrow(adjacency.packed_pairs, adjacency.PAIRS))
    # each first class is a job of its own, whose shuffle goes before the next, so that disks never hold all copies
    third, i, j = F.sequence(F.lit(0), F.lit(n - 1)), F.col("i"), F.col("j")

    def dealt(role: int, x: Column, y: Column, z: Column, fits: Column) -> DataFrame:
        return packs.withColumn("t", F.explode(third)).filter(fits).select(F.lit(role).alias("role"), x.alias("x"), y.alias("y"), z.alias("z"), "src", "dst")

    t = F.col("t")
    tasks = dealt(0, i, j, t, t >= j).unionByName(dealt(1, i, t, j, (t >= i) & (t <= j))).unionByName(dealt(2, t, i, j, t <= i))
    each, jobs = None, max(1, min(n, n * n // FIRSTS))
    for job in range(jobs):
        found = tasks.filter(F.col("x") % jobs == job).groupBy("x", "y", "z").applyInArrow(adjacency.closed, "node long, triangles long")
        found = written(found.groupBy("node").agg(F.sum("triangles").alias("triangles")))
        each = found if each is None else each.unionByName(found)
    each = each.groupBy("node").agg(F.sum("triangles").alias("triangles"))
    out = d.join(each, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return out.withColumn("clustering", F.when(F.col("degree") > 1, 2 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0))


def modularity(edges: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """One row (modularity) of a partition (node, label)."""
    ends = edges.join(labels.select(F.col("node").alias("src"), F.col(label).alias("ls")), "src").join(labels.select(F.col("node").alias("dst"), F.col(label).alias("ld")), "dst")
    inside = ends.agg(F.sum("w").alias("m"), F.sum(F.when(F.col("ls") == F.col("ld"), F.col("w"))).alias("own"))
    expected = degrees(edges).join(labels, "node").groupBy(label).agg(F.sum("strength").alias("k")).agg(F.sum(F.col("k").cast("double") ** 2).alias("kk"))
    return inside.crossJoin(expected).select((F.coalesce("own", F.lit(0)) / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def label_propagation(edges: DataFrame, rounds: int = 50, seed: str = "lpa") -> DataFrame:
    """(node, label): a node takes its neighbours' heaviest label, its own one where that is as heavy as any, other ties
    by hash; in rounds that move a hash-drawn half, until no node wants another label (or after so many rounds)."""
    blocks, latest = adjacency.Blocks(both_ways(edges)), Latest(edges.sparkSession)
    sent = latest.keep(blocks.alone(adjacency.own_labels))
    for turn in range(rounds):
        sent = latest.keep(blocks.meet(sent.filter(F.col("kind") == adjacency.LABELS), adjacency.spreading(seed, turn)))
        if sent.filter((F.col("kind") == adjacency.COUNT) & (F.col("b") != F.lit(bytes(8)))).isEmpty():
            break
    found = written(sent.filter(F.col("kind") == adjacency.STATE).mapInArrow(adjacency.found, adjacency.FOUND))
    blocks.close()
    latest.close()
    return found.select(F.col("id").alias("node"), "label")


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (ari) for two partitions (node, label) of the same nodes, from the contingency table's pair counts."""

    def pairs(c: str) -> Column:
        return F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)

    cells = a.select("node", F.col("label").alias("la")).join(b.select("node", F.col("label").alias("lb")), "node").groupBy("la", "lb").agg(F.count("*").alias("c"))
    both = cells.agg(pairs("c").alias("s"), F.sum("c").alias("n"))
    rows = cells.groupBy("la").agg(F.sum("c").alias("c")).agg(pairs("c").alias("ra"))
    columns = cells.groupBy("lb").agg(F.sum("c").alias("c")).agg(pairs("c").alias("rb"))
    out = both.crossJoin(rows).crossJoin(columns).withColumn("e", F.col("ra") * F.col("rb") / (F.col("n").cast("double") * (F.col("n") - 1) / 2))
    return out.select(F.when((F.col("ra") + F.col("rb")) / 2 == F.col("e"), 1.0).otherwise((F.col("s") - F.col("e")) / ((F.col("ra") + F.col("rb")) / 2 - F.col("e"))).alias("ari"))


def random_walk(edges: DataFrame, seeds: DataFrame, restart: float = 0.3, steps: int = 10) -> DataFrame:
    """(seed_set, node, score): random walks with restart for many seed sets (seed_set, node) at once.

    Mass moves along edges by weight over strength; a step sums it in tasks by blocks of the graph (see `adjacency`), so
    a row moves for each set, node and block that sees the node, not for each edge.
    """
    spark = edges.sparkSession
    blocks, latest = adjacency.Blocks(both_ways(edges)), Latest(spark)
    sets = written(numbered(seeds.select("seed_set").distinct(), "seed_set", name="lane"))
    start = written(seeds.withColumn("r", 1.0 / F.count("*").over(Window.partitionBy("seed_set"))).join(sets, "seed_set").select(F.col("lane").cast("long"), F.col("node").cast("long").alias("id"), "r"))
    if not steps or not len(blocks.homes.lows):
        score = written(start.groupBy("lane", "id").agg((F.sum("r") * (restart if steps else 1.0)).alias("score")))
    else:
        back = written(start.mapInArrow(adjacency.started(blocks.homes), "block int, lane long, id long, r double").groupBy("block").applyInArrow(adjacency.starts, adjacency.ROW))
        sent = latest.keep(blocks.meet(back, adjacency.walked(blocks.homes, restart, True, False)))
        for _ in range(steps - 1):
            sent = latest.keep(blocks.meet(back.unionByName(sent), adjacency.walked(blocks.homes, restart, False, False)))
        score = written(blocks.meet(back.unionByName(sent), adjacency.walked(blocks.homes, restart, False, True), adjacency.WALKED))
    blocks.close()
    latest.close()
    return score.join(sets, "lane").select("seed_set", F.col("id").cast(edges.schema["src"].dataType).alias("node"), "score")


def closure(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, ancestor, depth): all ancestors of every node, cycle-safe, in rounds that double the known distance until
    nothing is added."""
    known = saved(edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth")).distinct())
    before, n = -1, known.count()
    while n != before:
        far = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("top"), F.col("depth").alias("more"))
        grown = known.join(far, "ancestor").select("child", F.col("top").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        known = saved(known.unionByName(grown).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        before, n = n, known.count()
    return known


def hops(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(node, hop): nodes within `most` hops of the start nodes, with the fewest hops."""
    around = saved(both_ways(edges).select(F.col("src").alias("node"), F.col("dst").alias("next")))
    reached = start.select("node").distinct().withColumn("hop", F.lit(0))
    for k in range(1, most + 1):
        front = reached.filter(F.col("hop") == k - 1).join(around, "node").select(F.col("next").alias("node")).distinct().withColumn("hop", F.lit(k))
        reached = saved(reached.unionByName(front).groupBy("node").agg(F.min("hop").alias("hop")))
    return reached


def disconnected_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, size, pieces): communities with the number of connected pieces that they fall into."""
    ends = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("ls")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("ld")), "dst")
    inside = ends.filter("ls = ld").select("src", "dst", "w")
    pieces = labels.join(component_labels(inside), "node", "left").withColumn("piece", F.coalesce("component", "node"))
    return pieces.groupBy("label").agg(F.count("*").alias("size"), F.count_distinct("piece").alias("pieces"))


def agreement(edges: DataFrame, partitions: DataFrame) -> DataFrame:
    """(src, dst, w): the share of partitions (run, node, label) in which an edge's ends have one label."""
    runs = partitions.select("run").distinct().count()
    # a node's labels are one row, so that an edge stays one row and nothing is grouped by edges
    labels = saved(partitions.groupBy("node").agg(F.collect_list(F.struct("run", "label")).alias("l")))
    rows, e = edges.count(), edges.select("src", "dst")
    for end, name in (("src", "la"), ("dst", "lb")):
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-rows // 1_000_000))
        there = labels.select(F.col("node").alias(end), F.col("l").alias(name)).repartition(tasks, end)
        e = dealt(e, rows, end, each=1_000_000).join(there.hint("shuffle_hash"), end)
    same = F.size(F.filter("la", lambda x: F.exists("lb", lambda y: (y["run"] == x["run"]) & F.coalesce(y["label"] == x["label"], F.lit(False)))))
    both = F.exists("la", lambda x: F.exists("lb", lambda y: y["run"] == x["run"]))
    return e.filter(both).select("src", "dst", (same / max(runs, 1)).alias("w"))


def node_confidence(labels: DataFrame, partitions: DataFrame) -> DataFrame:
    """(node, label, size, confidence): how much of its consensus community a node shares in the single partitions."""
    size = F.count("*").over(Window.partitionBy("label"))
    named = labels.withColumn("size", size)
    inside = partitions.join(named.select("node", F.col("label").alias("home"), "size"), "node")
    mates = inside.groupBy("run", "home", "label").agg(F.count("*").alias("same"))
    each = inside.join(mates, ["run", "home", "label"]).groupBy("node", F.col("home").alias("label"), "size").agg(F.avg("same").alias("same"))
    return each.select("node", "label", "size", F.when(F.col("size") > 1, (F.col("same") - 1) / (F.col("size") - 1)).otherwise(1.0).alias("confidence"))


def matched_seed_sets(degrees_of: DataFrame, seeds: DataFrame, reps: int, seed: str, bins: int = 10) -> DataFrame:
    """(seed_set, rep, node): random seed sets with the degree bands of the real ones (seed_set, node)."""
    from .draws import replicates
    from .ranks import equal_count_bands

    banded = equal_count_bands(degrees_of.select("node", "degree"), "degree", "node", bins)
    placed = numbered(banded, "band", "node", name="_at")
    sizes = placed.groupBy("band").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    placed = saved(placed.join(F.broadcast(sizes), "band").select("band", "node", (F.col("_at") - F.col("_first")).alias("_pos"), "_n"))
    wanted = replicates(seeds.join(placed, "node").select("seed_set", "node", "band", "_n"), reps)
    drawn = wanted.withColumn("_pos", u32(seed, F.col("seed_set"), F.col("rep"), F.col("node")) % F.col("_n")).select("seed_set", "rep", "band", "_pos")
    return drawn.join(placed.select("band", "_pos", "node"), ["band", "_pos"]).select("seed_set", "rep", "node").distinct()


def path_sums(edges: DataFrame, sources: DataFrame, targets: DataFrame, weight: float = 0.45, most: int = 4) -> DataFrame:
    """(source, paths, score): simple paths from sources (node) to the target set (node), each counting weight**length."""
    around = saved(edges.select("src", "dst"))
    ends = targets.select(F.col("node").alias("at")).distinct().withColumn("end", F.lit(True))
    front = sources.select(F.col("node").alias("source"), F.array("node").alias("path"), F.col("node").alias("at"))
    found = None
    for k in range(1, most + 1):
        front = front.withColumnRenamed("at", "src").join(around, "src").filter(~F.array_contains("path", F.col("dst"))).select("source", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        front = saved(front.join(ends, "at", "left"))
        hits = front.filter("end").groupBy("source").agg(F.count("*").alias("paths")).withColumn("length", F.lit(k))
        found = hits if found is None else found.unionByName(hits)
        front = front.filter("end IS NULL").drop("end")
    return found.groupBy("source").agg(F.sum("paths").alias("paths"), F.sum(F.col("paths") * F.pow(F.lit(weight), F.col("length"))).alias("score"))


def without_group(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(group, src, dst, w): the graph of shared groups as each group (group, node) leaves it: its own clique counts one
    less on its pairs. Only the pairs of the group differ, so they alone are given."""
    pairs = members.select("group", F.col("node").alias("src")).join(members.select("group", F.col("node").alias("dst")), "group").filter("src < dst")
    return pairs.join(edges, ["src", "dst"]).select("group", "src", "dst", (F.col("w") - 1).alias("w"))


def average_precision(ranked: DataFrame, by: str, score: str, hit: str, ident: str) -> DataFrame:
    """(by, hits, ap) over each group's rows in falling score order, ties by id."""
    order = Window.partitionBy(by).orderBy(F.desc(score), ident)
    walked = ranked.withColumns({"_place": F.row_number().over(order), "_hits": F.sum(F.col(hit).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return walked.filter(hit).groupBy(by).agg(F.count("*").alias("hits"), F.avg(F.col("_hits") / F.col("_place")).alias("ap"))


def rewired(edges: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """A configuration-model graph of the same degrees (src, dst, w = 1) and a row of its lost edges (loops, doubles).

    Stubs are shuffled once, by ranges of their hash, and each second one takes the next as its other end.
    """
    counted = saved(degrees(edges).select("node", "degree"))
    n = counted.agg(F.sum("degree")).first()[0] or 0
    stubs = spread(counted, n).select("node", F.explode(F.sequence(F.lit(1), F.col("degree").cast("int"))).alias("stub"))
    mixed = in_hash_order(stubs, F.md5(key(seed, F.col("node"), F.col("stub")).cast("binary")), n, "node", "node", "stub")
    kept, counts = _kept(mixed.filter("pos % 2 = 0 AND after IS NOT NULL").select(F.col("node").alias("src"), F.col("after").alias("dst")))
    return kept, counts.select("drawn", "kept", (F.col("drawn") - F.col("kept")).alias("lost"))


def _kept(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A simple graph (src, dst, w = 1) of drawn ends, and a row (drawn, loops, doubles, kept)."""
    pairs = ends.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").alias("n"))
    kept, loop = pairs.filter("src != dst").select("src", "dst", F.lit(1).alias("w")), F.col("src") == F.col("dst")
    sums = {"drawn": F.sum("n"), "loops": F.sum(F.when(loop, F.col("n")))}
    counts = pairs.agg(*[F.coalesce(x, F.lit(0)).cast("long").alias(c) for c, x in sums.items()], F.count_if(~loop).alias("kept"))
    return kept, counts.select("drawn", "loops", (F.col("drawn") - F.col("loops") - F.col("kept")).alias("doubles"), "kept")


def expected_degrees(edges: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """A graph whose nodes have their degrees in expectation, and a row (drawn, loops, doubles, kept).

    As many edges as there are take both ends at random places of the nodes' cumulative degrees. Nodes are intervals of
    places, cut into blocks that draws are dealt by, so a node of many edges is no single key.
    """
    spans, n, width = intervals_of(degrees(edges).select("node", "degree"), "node", "degree")
    spans, m = saved(spans), n // 2
    drawn = ranged_draws(edges.sparkSession, 1, m).select([(u32(seed, side, F.col("slot")) % F.lit(max(n, 1))).alias(side) for side in ("a", "b")])
    return _kept(at_places(at_places(drawn, "a", m, spans, width, "src"), "b", m, spans, width, "dst"))


def permuted_ends(edges: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """The graph after its far ends are permuted over all edges and both directions made one, and a row (drawn, loops,
    doubles, kept). Before loops and doubles go, every node is as often a near end and as often a far end as it was.

    Near ends in their order are intervals of places, so only far ends are numbered.
    """
    spans, m, width = intervals_of(edges.groupBy("src").agg(F.count("*").alias("degree")), "src", "degree")
    mixed = in_hash_order(edges.select("src", "dst"), F.md5(key(seed, F.col("src"), F.col("dst")).cast("binary")), m, "dst", "src", "dst")
    return _kept(at_places(mixed.select("pos", "dst"), "pos", m, saved(spans), width, "src"))


def meeting_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, weight: float = 0.45, most: int = 6, salts: int = 4) -> tuple[DataFrame, DataFrame]:
    """(source, hops, paths, score) as `path_sums` gives for up to `most` hops, hops being the fewest, and the sizes of
    what was kept: (side, length, rows).

    A path of k hops is a half of ceil(k / 2) hops from its source and one of floor(k / 2) hops back from its target
    that meet in one node and share no other. Only halves are stored; whole paths are counted as they are joined. Nodes
    after the source and before the target aren't targets. A meeting node's halves are dealt to `salts` keys.
    """
    ends = saved(targets.select("node").distinct())
    ahead, back = saved(edges.select("src", "dst").distinct()), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()

    def grow(front: DataFrame, along: DataFrame) -> DataFrame:
        return saved(front.withColumnRenamed("at", "src").join(along, "src").filter(~F.array_contains("path", F.col("dst"))).select("end", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at")))

    forward = {0: sources.select(F.col("node").alias("end"), F.array("node").alias("path"), F.col("node").alias("at")).distinct()}
    backward = {0: ends.select(F.col("node").alias("end"), F.array("node").alias("path"), F.col("node").alias("at"))}
    sizes, hits = [], None
    for k in range(1, most + 1):
        f, b = -(-k // 2), k // 2
        if f not in forward:
            # a half that stands on a target is a whole path of one hop or none at all
            front = forward[f - 1].join(ends.withColumnRenamed("node", "at"), "at", "left_anti").select("end", "path", "at") if f > 1 else forward[0]
            forward[f] = grow(front, ahead)
            sizes.append(("forward", f, forward[f].count()))
        if b and b not in backward:
            backward[b] = saved(grow(backward[b - 1], back).join(ends.withColumnRenamed("node", "at"), "at", "left_anti").select("end", "path", "at"))
            sizes.append(("backward", b, backward[b].count()))
        left = forward[f].withColumn("_salt", F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int"))
        right = backward[b].select(F.col("path").alias("_back"), "at", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
        met = left.join(right, ["at", "_salt"]).filter(F.size(F.array_intersect("path", "_back")) == 1)
        counted = saved(met.groupBy(F.col("end").alias("source")).agg(F.count("*").alias("paths")).withColumn("length", F.lit(k)))
        hits = counted if hits is None else hits.unionByName(counted)
    found = hits.groupBy("source").agg(F.min("length").alias("hops"), F.sum("paths").alias("paths"), F.sum(F.col("paths") * F.pow(F.lit(weight), F.col("length"))).alias("score"))
    return found, edges.sparkSession.createDataFrame(sizes, "side string, length int, rows long")
