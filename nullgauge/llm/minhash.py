"""Near-duplicate groups by b-bit MinHash.

1. One pass over the texts makes, for each document, the hashes of its distinct word shingles, their number, a 128-bit
   hash of the word sequence, BANDS band keys from full 32-bit minima, and the packed low BITS bits of the minima.
   Rows with equal word sequences stand for each other: only the smallest id of a class goes on.
2. Classes that share a band key are candidates. In each bucket every member is paired with one centre, drawn by hash
   (bands share GROUPS drawings, so a large bucket has several centres), never with every other member.
3. Packed signatures give the collision-corrected similarity (p - 2**-BITS) / (1 - 2**-BITS) by bit counts; pairs below
   KEEP_ESTIMATE, 4.7 standard errors under the limit, and pairs whose sizes rule the limit out, go.
4. The rest is confirmed on full shingle sets, read again for the documents concerned only.
5. Components of confirmed links. Members of one bucket that are still in different components are paired with CENTRES
   drawn members of it. What is then apart is settled exactly: buckets of up to SMALL members pair them, and the members
   of larger buckets, gathered into families by their bucket's main component, go by what sets each off from its
   family (see _family_keys), so that no link is lost and a large group doesn't make all its pairs. Only pairs that
   may link leave these joins.

With 32 bands of 4 rows a link of similarity 0.75 shares no bucket with probability (1 - 0.75**4)**32 < 6e-6.

Defined results: null or wordless texts have an empty set and link with nothing; rows with a null id are returned with
a null component and kept; rows of equal id share their component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import BYTE_VALUE_FOLDED, gathered, mixed, saved, segment_hashes, slices, small_or_shuffled, utf8, word_edges

SHINGLE, BANDS, ROWS, BITS, GROUPS = 5, 32, 4, 4, 8
HASHES = BANDS * ROWS
KEEP_ESTIMATE = 0.56
#: Partners drawn for a bucket, and members up to which the members of a bucket are paired with each other.
CENTRES, SMALL = 4, 64
#: Cells of each property of a family's members, and families whose sizes may be broadcast (16 bytes each).
CELLS, FAMILIES = 128, 1_000_000
#: Shingles that a key of a family is made of at most, and keys of a member from which it is made of fewer.
DEEP, KEYS = 3, 256
_draw = np.random.default_rng(5)
_MULTIPLY = _draw.integers(1, 2**31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _draw.integers(0, 2**32, HASHES, np.uint32)
_PLACE = _draw.integers(1, 2**63, SHINGLE + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, each document's first one (n + 1), and two hashes of each document's word sequence."""
    starts, ends, first = word_edges(data, at)
    words = segment_hashes(data, starts, ends, BYTE_VALUE_FOLDED)
    n_words = np.diff(first)
    docs, n = len(n_words), len(words)
    of = np.repeat(np.arange(docs), n_words)
    rank = np.arange(n) - first[:-1][of]
    count = np.maximum(n_words - SHINGLE + 1, np.minimum(n_words, 1))
    parts = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        left = n - k
        if left > 0:
            parts[:left] += np.where(of[:left] == of[k:], words[k:] * _PLACE[k], np.uint64(k + 77))
    kept = parts[rank < count[of]]
    edges = np.concatenate(([0], np.cumsum(count)))
    sequence = np.zeros((2, docs), np.uint64)
    if n:
        some = n_words > 0
        steps = mixed(rank.astype(np.uint64) + np.uint64(11)) | np.uint64(1)
        for i, h in enumerate((words, mixed(words ^ np.uint64(0xA5A5A5A5DEADBEEF)))):
            sequence[i, some] = np.add.reduceat(h * steps, first[:-1][some])
    return mixed(kept), edges, mixed(sequence[0]), mixed(sequence[1])


def _distinct(hashes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, sorted, and the new edges."""
    docs = len(edges) - 1
    of = np.repeat(np.arange(docs), np.diff(edges))
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return h[new], np.concatenate(([0], np.cumsum(np.bincount(o[new], minlength=docs))))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            data, at, _ = utf8(batch.column("text"))
            raw, raw_edges, one, two = shingles(data, at)
            hashes, edges = _distinct(raw, raw_edges)
            size = np.diff(edges)
            some = np.flatnonzero(size)
            minima = np.zeros((HASHES, len(some)), np.uint32)
            if len(some):
                high = (hashes >> np.uint64(32)).astype(np.uint32)
                step = np.empty_like(high)
                for k in range(HASHES):
                    np.multiply(high, _MULTIPLY[k], out=step)
                    step += _ADD[k]
                    minima[k] = np.minimum.reduceat(step, edges[:-1][some])
            bands = np.zeros((BANDS, len(some)), np.uint64)
            for k in range(HASHES):
                bands[k // ROWS] += mixed(minima[k].astype(np.uint64) + np.uint64((k + 1) << 33))
            low = mixed(minima.astype(np.uint64))
            planes = np.zeros((HASHES // 64, BITS, len(some)), np.uint64)
            for k in range(HASHES):
                for b in range(BITS):
                    planes[k // 64, b] |= ((low[k] >> np.uint64(b)) & np.uint64(1)) << np.uint64(k % 64)
            where = np.zeros(batch.num_rows + 1, np.int32)
            where[1:][some] = 1
            counts = np.cumsum(where, dtype=np.int32)

            def lists(rows: np.ndarray, counts: np.ndarray = counts) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(counts * rows.shape[0], pa.int32()), pa.array(np.ascontiguousarray(rows.T).ravel().view(np.int64)))

            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists(mixed(bands)), lists(planes.reshape(-1, len(some)))],
                ["doc_id", "n_shingles", "one", "two", "bands", "packed"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            data, at, _ = utf8(batch.column("text"))
            raw, raw_edges, _, _ = shingles(data, at)
            hashes, edges = _distinct(raw, raw_edges)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["doc_id", "shingles"])


def estimated_similarity(a: str, b: str) -> Column:
    """Similarity of two packed signatures: equal low bits by bit counts, corrected for chance collisions."""
    differ = F.lit(0)
    for half in range(HASHES // 64):
        bits = [F.col(a)[half * BITS + k].bitwiseXOR(F.col(b)[half * BITS + k]) for k in range(BITS)]
        any_bit = bits[0]
        for x in bits[1:]:
            any_bit = any_bit.bitwiseOR(x)
        differ = differ + F.bit_count(any_bit)
    chance = 2.0**-BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def _may_link(percent: int) -> Column:
    """Whether sizes and signatures (size_a, packed_a, size_b, packed_b) allow a link."""
    return (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")) & (estimated_similarity("packed_a", "packed_b") >= KEEP_ESTIMATE)


def _side(signs: DataFrame, side: str, *more: str) -> DataFrame:
    return signs.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"size_{side}"), F.col("packed").alias(f"packed_{side}"), *[F.col(c) if c == "key" else F.col(c).alias(f"{c}_{side}") for c in more])


def _confirmed(near: DataFrame, documents: DataFrame, percent: int) -> DataFrame:
    """Those of the saved pairs (a, b) whose full shingle sets reach the limit."""
    ids = gathered(near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct())
    texts = documents.select("doc_id", "text").join(small_or_shuffled(ids, ids.count()), "doc_id", "left_semi")
    # rows of equal id may hold different texts: a pair holds if any of their sets reach the limit
    sets = texts.mapInArrow(_sets, "doc_id long, shingles array<long>").dropDuplicates(["doc_id", "shingles"])
    one, two = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return gathered(near.join(one, "a").join(two, "b").filter(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b").distinct())


def _still_apart(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """Members (key, doc_id, component, main, members) of buckets that hold several components; main is the component
    with the most members."""
    grouped = components(links, "a", "b").withColumnRenamed("node", "doc_id")
    apart = buckets.join(grouped, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    parts = apart.groupBy("key", "component").agg(F.count("*").alias("n"))
    several = parts.groupBy("key").agg(F.max_by("component", F.struct(F.col("n"), -F.col("component"))).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("members")).filter("parts > 1 AND members > 2").select("key", "main", "members")
    return gathered(apart.join(several, "key"))


def _partners(apart: DataFrame) -> DataFrame:
    """(key, doc_id, component): CENTRES members of each bucket, drawn by hash, one of the main component at least."""
    draws = [F.min(F.struct(F.xxhash64("doc_id", "key", F.lit(k)).alias("h"), "doc_id", "component")) for k in range(CENTRES - 1)]
    main = F.min(F.when(F.col("component") == F.col("main"), F.struct(F.xxhash64("doc_id", "key", F.lit(CENTRES)).alias("h"), "doc_id", "component")))
    return apart.groupBy("key").agg(F.array_distinct(F.array(main, *draws)).alias("drawn")).select("key", F.explode("drawn").alias("d")).select("key", "d.doc_id", "d.component").distinct()


def _met(seekers: DataFrame, partners: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one bucket whose sizes and signatures allow a link."""
    signs = heads.select("doc_id", "n_shingles", "packed")
    one, two = _side(seekers.join(signs, "doc_id"), "a", "key", "component"), _side(partners.join(signs, "doc_id"), "b", "key", "component")
    met = one.join(two, (one["key"] == two["key"]) & (F.col("component_a") != F.col("component_b")) & _may_link(percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _family_keys(members: DataFrame, documents: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of a family that link for certain, and the keys (family, key, doc_id, component, ...) that two members
    share if they may have any other link; of members (family, doc_id, component) of large buckets. Keys are made of what
    members don't have in common with their family.

    Let C be the shingles that over half of a family's members hold. A member x of size s lacks m shingles of C and has
    e others, h of them shared with some member. Two members have |C| - m - m' + o shingles in common, where o is the
    overlap of what sets them off from C (the missing ones and the others). So, with q = 100 + percent:

    * x and y link for certain if q(|C| - m - m') >= percent(s + s'), that is g + g' <= q|C| with g = qm + percent*s. The
      member of least g then links with both, and one pair for each of them says as much as all pairs.
    * A link needs q(|C| - max(m, m') + min(h, h')) >= percent(s + s'). Members for which no occupied cell of (m, s)
      in their family allows this have no link at all.
    * Any other link needs o >= (g + g' - q|C|) / q, so the two share one of the first m + e - o + 1 shingles that set
      either off, in a common order (rare ones first), and after the first one that they share are o - 1 more in both.
      If all members of a family need an overlap of DEEP at least, the two share DEEP of the first m + e - o + DEEP, so
      keys are made of as many shingles, where this makes at most KEYS of them for a member; such keys are far rarer.
    """
    q = 100 + percent
    ids = gathered(members.select("doc_id").distinct())
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small_or_shuffled(ids, ids.count()), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "doc_id long, shingles array<long>").select("doc_id", F.xxhash64("shingles").alias("variant"), F.size("shingles").alias("s"), "shingles").dropDuplicates(["doc_id", "variant"])
    who = ["family", "doc_id", "variant"]
    held = saved(members.join(sets, "doc_id").select(*who, "component", "s", "shingles"))
    counts = held.select("family", F.explode("shingles").alias("shingle")).groupBy("family", "shingle").agg(F.count("*").alias("holders"))
    sizes = held.groupBy("family").agg(F.count("*").alias("members"))
    counts = saved(counts.join(F.broadcast(sizes) if sizes.count() <= FAMILIES else sizes, "family").withColumn("core", 2 * F.col("holders") > F.col("members")))
    # the core is about as long as a member, so one row for each family; only what sets a member off is laid out
    cores = gathered(counts.filter("core").groupBy("family").agg(F.collect_list("shingle").alias("core_shingles")))
    cores = small_or_shuffled(cores, cores.agg(F.sum(F.size("core_shingles"))).first()[0] or 0)
    none = F.expr("CAST(array() AS array<bigint>)")
    split = held.join(cores, "family", "left").withColumn("core_shingles", F.coalesce("core_shingles", none))
    split = saved(split.select(*who, "component", "s", F.size("core_shingles").alias("core_size"), F.array_except("shingles", "core_shingles").alias("others"), F.array_except("core_shingles", "shingles").alias("lacks")))
    others = split.select(*who, F.explode("others").alias("shingle")).join(counts.filter("NOT core AND holders > 1").select("family", "shingle", F.col("holders").alias("often")), ["family", "shingle"])
    others = saved(others.select(*who, "shingle", F.lit(0).alias("kind"), "often"))
    profiles = split.select(*who, "component", "s", "core_size", F.size("lacks").alias("m")).join(others.groupBy(*who).agg(F.count("*").alias("h")), who, "left").withColumn("h", F.coalesce("h", F.lit(0)))
    profiles = saved(profiles.withColumn("g", q * F.col("m") + percent * F.col("s")))
    unit = F.greatest(F.floor(F.col("core_size") / CELLS), F.lit(1))
    cells = profiles.groupBy("family", F.floor(F.col("m") / unit).alias("m_cell"), F.floor(F.col("s") / unit).alias("s_cell")).agg(F.min("m").alias("m_least"), F.min("s").alias("s_least"), F.max("h").alias("h_most"))
    cells = gathered(cells.select(F.col("family").alias("f"), "m_least", "s_least", "h_most"))
    near = q * (F.col("core_size") - F.greatest("m", "m_least") + F.least("h", "h_most")) >= percent * (F.col("s") + F.col("s_least"))
    able = saved(profiles.join(small_or_shuffled(cells, cells.count()), (F.col("family") == F.col("f")) & near, "left_semi"))

    least = able.groupBy("family").agg(F.min(F.struct("g", "doc_id")).alias("hub"))
    starred = saved(able.join(least, "family").withColumn("alone", F.col("g") + F.col("hub.g") > q * F.col("core_size")))
    pairs = starred.filter("NOT alone AND doc_id != hub.doc_id").select(F.least("doc_id", "hub.doc_id").alias("a"), F.greatest("doc_id", "hub.doc_id").alias("b"))

    # what is left: one of the two at least is alone, so the other's partners start at the least g of those
    lone = starred.filter("alone").groupBy("family").agg(F.min("g").alias("lone_g"))
    sought = starred.join(lone, "family").withColumn("overlap", F.greatest(F.lit(1), F.ceil((F.col("g") + F.when(F.col("alone"), F.col("hub.g")).otherwise(F.col("lone_g")) - q * F.col("core_size")) / q)))
    sought = sought.withColumn("take", F.col("m") + F.col("h") - F.col("overlap") + 1).filter("take > 0").select(*who, "component", "s", "m", "h", "g", "core_size", "alone", "take", "overlap")
    sought = saved(sought)
    depth = sought.groupBy("family").agg(F.min("overlap").alias("least_overlap"), F.max("take").alias("most"))
    choices, deep = F.lit(1), F.lit(1)
    for k in range(2, DEEP + 1):
        choices = choices * k
        ways = F.col("most") + k - 1
        for x in range(1, k):
            ways = ways * (F.col("most") + k - 1 - x)
        deep = F.when((F.col("least_overlap") >= k) & (ways <= KEYS * choices), k).otherwise(deep)
    sought = sought.join(depth.select("family", deep.alias("deep")), "family").withColumn("take", F.col("take") + F.col("deep") - 1)
    others = others.join(sought.select(*who), who, "left_semi")
    lacking = split.select(*who, "lacks").join(sought.filter(F.col("take") > F.col("h")).select(*who), who, "left_semi").select(*who, F.explode("lacks").alias("shingle"))
    lacking = lacking.join(counts.filter("core").select("family", "shingle", F.lit(1).alias("kind"), (F.col("members") - F.col("holders")).alias("often")), ["family", "shingle"])
    order = Window.partitionBy(*who).orderBy("kind", "often", "shingle")
    first = others.unionByName(lacking.select(*who, "shingle", "kind", "often")).withColumn("place", F.row_number().over(order)).join(sought, who).filter(F.col("place") <= F.col("take"))
    alike = ["component", "s", "m", "h", "g", "core_size", "alone", "deep"]
    listed = first.groupBy(*who, *alike).agg(F.array_sort(F.collect_list(F.struct("place", "shingle"))).alias("list"))
    one = "transform(list, x -> struct(x.place AS place, xxhash64(x.shingle) AS key))"
    two = "flatten(transform(list, x -> transform(filter(list, y -> y.place > x.place), y -> struct(x.place AS place, xxhash64(x.shingle, y.shingle) AS key))))"
    three = "flatten(transform(list, x -> flatten(transform(filter(list, y -> y.place > x.place), y -> transform(filter(list, z -> z.place > y.place), z -> struct(x.place AS place, xxhash64(x.shingle, y.shingle, z.shingle) AS key))))))"
    keys = listed.withColumn("k", F.explode(F.expr(f"CASE deep WHEN 1 THEN {one} WHEN 2 THEN {two} ELSE {three} END")))
    return pairs, gathered(keys.select("family", F.col("k.key").alias("key"), "doc_id", *alike[:-1], (F.col("m") + F.col("h") - F.col("k.place") + 1).alias("behind")))


def _key_pairs(keys: DataFrame, partners: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members and partners of one key, of different components, that may link."""
    q = 100 + percent
    one, two = (t.select("family", "key", *[F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "component", "s", "m", "h", "g", "core_size", "alone", "behind")]) for t, k in ((keys, "a"), (partners, "b")))
    allowed = q * (F.col("core_size_a") - F.greatest("m_a", "m_b") + F.least("h_a", "h_b")) >= percent * (F.col("s_a") + F.col("s_b"))
    allowed &= q * F.least("behind_a", "behind_b") >= F.col("g_a") + F.col("g_b") - q * F.col("core_size_a")
    may = (F.col("component_a") != F.col("component_b")) & (F.col("alone_a") | F.col("alone_b")) & allowed
    shared = one.join(two, (one["family"] == two["family"]) & (one["key"] == two["key"]) & may)
    return shared.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()


def _drawn_partners(keys: DataFrame) -> DataFrame:
    """CENTRES members of each key, drawn by hash."""
    row = F.struct(*keys.columns)
    draws = [F.min_by(row, F.xxhash64("doc_id", "key", F.lit(k))) for k in range(CENTRES)]
    return keys.groupBy("family", "key").agg(F.array(*draws).alias("drawn")).select(F.explode("drawn").alias("d")).select("d.*").distinct()


def _family_links(members: DataFrame, tested: DataFrame, links: DataFrame, heads: DataFrame, documents: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links that join the components of families, and the pairs tested for them.

    First every member meets the drawn partners of its keys, which are as many rows as there are keys. Most of a dense
    family is one component then, and only pairs of different components meet in the last join.
    """
    certain, keys = _family_keys(members, documents, percent)
    new = links.limit(0), tested.limit(0)
    for near in (certain.unionByName(_key_pairs(keys, _drawn_partners(keys), percent)), None):
        if near is None:
            grouped = components(links.unionByName(new[0]), "a", "b").withColumnRenamed("node", "doc_id")
            keys = keys.withColumnRenamed("component", "old").join(grouped, "doc_id", "left").withColumn("component", F.coalesce("component", "old")).drop("old")
            keys = gathered(_of_several_components(keys))
            near = _key_pairs(keys, keys.filter("NOT of_main"), percent)
        near = near.distinct().join(tested.unionByName(new[1]), ["a", "b"], "left_anti")
        near = gathered(near.join(_side(heads, "a"), "a").join(_side(heads, "b"), "b").filter(_may_link(percent)).select("a", "b"))
        new = new[0].unionByName(_confirmed(near, documents, percent)), new[1].unionByName(near)
    return new


def _of_several_components(keys: DataFrame) -> DataFrame:
    """The rows of keys that members of several components hold, and whether they are of the key's main component. Of two
    components one isn't the main one, so its rows meet all others."""
    parts = keys.groupBy("family", "key", "component").agg(F.count("*").alias("n"))
    several = parts.groupBy("family", "key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    return keys.join(several.select("family", "key", "main"), ["family", "key"]).withColumn("of_main", F.col("component") == F.col("main")).drop("main")


def near_duplicates(documents: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of documents (doc_id, text)."""
    signs = saved(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signatures, "doc_id long, n_shingles long, one long, two long, bands array<long>, packed array<long>"))
    live = signs.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = live.groupBy("one", "two").agg(F.min("doc_id").alias("representative"), F.min_by(F.struct("n_shingles", "bands", "packed"), "doc_id").alias("sign"))
    classes = saved(classes)
    heads = classes.select(F.col("representative").alias("doc_id"), "sign.*")
    banded = heads.select("doc_id", F.posexplode("bands").alias("band", "key"))
    drawn = F.xxhash64("doc_id", F.col("band") % GROUPS)
    centres = banded.groupBy("key").agg(F.min(F.struct(drawn.alias("h"), "doc_id")).alias("centre"), F.count("*").alias("members")).filter("members > 1")
    buckets = saved(banded.join(centres, "key").select("key", "doc_id", F.col("centre.doc_id").alias("centre")))
    pairs = buckets.filter("doc_id != centre").select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    tested = gathered(pairs.join(_side(heads, "a"), "a").join(_side(heads, "b"), "b").filter(_may_link(percent)).select("a", "b"))
    links = _confirmed(tested, documents, percent)
    buckets = buckets.select("key", "doc_id")
    for last in (False, True):
        apart = _still_apart(buckets, links)
        if apart.isEmpty():
            break
        buckets = apart.select("key", "doc_id")
        # of two components one is not the bucket's main one: its members look for links
        seekers = apart.filter("component != main")
        if not last:
            near = _met(seekers, _partners(apart), heads, percent)
        else:
            # every link that is left: small buckets pair their members, the others go by families
            near = _met(seekers.filter(F.col("members") <= SMALL), apart.filter(F.col("members") <= SMALL), heads, percent)
            large = gathered(apart.filter(F.col("members") > SMALL).select(F.col("main").alias("family"), "doc_id", "component").distinct())
            if not large.isEmpty():
                found = _family_links(large, tested, links, heads, documents, percent)
                links, tested = links.unionByName(found[0]), tested.unionByName(found[1])
        near = gathered(near.distinct().join(tested, ["a", "b"], "left_anti"))
        links = links.unionByName(_confirmed(near, documents, percent))
        tested = tested.unionByName(near)
    # an id that occurs with several texts joins their classes
    keyed = live.select("doc_id", "one", "two").distinct()
    several = keyed.join(keyed.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "doc_id", "left_semi").join(classes.select("one", "two", "representative"), ["one", "two"])
    several = several.filter("doc_id != representative").select(F.least("doc_id", "representative").alias("a"), F.greatest("doc_id", "representative").alias("b"))
    grouped = components(links.unionByName(several), "a", "b").withColumnRenamed("node", "representative")
    # copies of a class take its component
    labelled = classes.select("one", "two", "representative").join(grouped, "representative", "left").select("one", "two", F.coalesce("component", "representative").alias("component"))
    out = signs.select("doc_id", "n_shingles", "one", "two").join(labelled, ["one", "two"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(documents: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of documents that stay: of each group of near-duplicates one, of rows of equal id one."""
    verdicts = saved(near_duplicates(documents, percent).select("doc_id", "kept"))
    gone = gathered(verdicts.filter("NOT kept").select("doc_id").distinct())
    left = documents.join(small_or_shuffled(gone, gone.count()), "doc_id", "left_anti")
    again = gathered(verdicts.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    n = again.count()
    if n:
        again = small_or_shuffled(again, n)
        left = left.join(again, "doc_id", "left_anti").unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left.select(*documents.columns)
