"""Near-duplicate groups by SuperMinHash (operator 5).

Signatures: each element of a set runs through a random permutation of the M slots and offers slot
p_j the value j + r_j; a slot keeps its smallest offer. Offers of a level j are always below those of
j + 1, so the levels are worked off one after another for all elements of many documents at once, and
a document stops as soon as its slots are all filled (the early stop). Slots are dealt by
permutation, hence correlated, which lowers the variance of the estimate.

Groups: each distinct set becomes one node with a number of its own, whatever ids its documents have. A node's signature is
cut into BANDS bands of ROWS values; nodes that agree on a band share a bucket. Buckets are never expanded into all pairs:

1. Each node is compared with one leader. A bucket's leader is the node that shares buckets with most others; a node takes
   the leader of most of its buckets.
2. The links found are united (components). Buckets whose nodes are all in one component are done.
3. In the buckets that are left, shingles that only one node has are counted. They are in no overlap, so
   nodes with too many of them cannot have a link any more and leave.
4. The nodes left that share a bucket meet by a prefix join: their shingles are put in order, rarest first, and two sets of that similarity
   share one of their first n - ceil(0.8 n) + 1. So variants of one text, which have its frequent shingles in common,
   only meet where they share an edit, and a pair only meets at the first shingle that both have. Nodes of the component
   that is the most frequent at a shingle do not meet each other there. How many of their first shingles two nodes share
   bounds what they share in all. Before all of them meet, a node meets, at each of its first shingles, a few of the component that is
   the most frequent there, namely those nearest to their leaders, in rounds until no link is found: a large group that belongs together
   becomes one component by links in proportion to its nodes, and what remains for step 5 is between components.
5. Every pair that is left is compared, and the links found are united.

Pairs are only dropped where their sizes, the shingles that others have too, their first shingles, or their distances from a
shared leader (the triangle inequality of the Jaccard distance) prove them under the threshold. Every link is confirmed on
full sets, which meet by pair, so that no node's set is sent to one task for all its pairs. A pair at similarity 0.8
shares no band with a chance of 3e-6.

Defined cases: a text without words (null, empty) has an empty set and is linked with nothing; rows
with the same id are one document (all its texts are linked); rows with a null id are grouped like others, and if a component
has no other ids its component_id is null; any 64-bit id is allowed; an empty table gives an
empty result; other columns are not read. Texts of any length are hashed in pieces. `keep_one` passes other columns
through and keeps one row of each component, whether ids are null or repeated: that with the smallest id (nulls last), then
the smallest hash of the row; rows with an empty set are all kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from ..operators.components import components
from .text_hash import U, mix, pieces, shingle_sets

BANDS, ROWS = 24, 4
SIMILARITY = 0.8
#: Ids of candidates (some 100 bytes each in a broadcast) up to which they are broadcast to where the texts are; beyond, the texts are shuffled to them.
BROADCAST_IDS = 500_000
#: Nodes of a shingle's main component that others meet in a round.
CENTRAL = 4
_UNSET = U(0xFFFFFFFFFFFFFFFF)


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (rows: documents, columns: the m slots); rows of empty sets stay unset."""
    sizes = np.array([len(s) for s in sets])
    out = np.full(len(sets) * m, _UNSET, dtype=np.uint64)
    if not sizes.sum():
        return out.reshape(-1, m)
    elements, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    went: list[np.ndarray] = []
    for level in range(m):
        r = mix(elements + U((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        drawn = level + (((r >> U(32)) * U(m - level)) >> U(32)).astype(np.int64)
        slot = drawn
        for earlier in range(level - 1, -1, -1):  # what earlier swaps put in the drawn place
            slot = np.where(slot == went[earlier], earlier, slot)
        np.minimum.at(out, doc * m + slot, (U(level) << U(32)) | (r & U(0xFFFFFFFF)))
        went.append(drawn)
        open_ = (out.reshape(-1, m) == _UNSET).any(axis=1) & (sizes > 0)
        if not open_.any():
            break
        more = open_[doc]
        if not more.all():
            elements, doc, went = elements[more], doc[more], [w[more] for w in went]
    return out.reshape(-1, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * U(0xA0761D6478BD642F), (len(signatures), 1))
    for k in range(rows):
        keys = mix(keys + signatures[:, k::rows][:, :bands])
    return keys


def _sketches(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in pieces(batch.column(1)):
                sets = shingle_sets(data, offsets, n)
                keys = band_keys(super_minhash(sets, bands * rows), bands, rows).view(np.int64)
                digests = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()), pa.array(keys.ravel())), *[c.slice(a, b - a) for c in batch.columns[2:]]],
                    ["id", "n", "digest", "bands", *batch.schema.names[2:]],
                )

    return run


def _digest(own: np.ndarray) -> bytes | None:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in pieces(batch.column(1)):
                sets = shingle_sets(data, offsets, n)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([_digest(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "digest", "sh"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b and other columns) with the similarity of their full sets (same), and whether it is enough (near)."""
    s = round(similarity * 10_000)
    pairs = written(pairs, "pairs")
    one, two = (pairs.select(*own, F.col(x).alias("node")).join(sets, "node").select(*own, F.col("sh").alias(f"s{x}")) for x, own in (("a", pairs.columns), ("b", ["a", "b"])))
    both = F.size("sa") + F.size("sb")
    met = one.join(two, ["a", "b"]).select(*pairs.columns, F.size(F.array_intersect("sa", "sb")).cast("long").alias("o"), both.cast("long").alias("both"))
    return written(met.select(*pairs.columns, (F.col("o") / (F.col("both") - F.col("o"))).alias("same"), (F.col("o") * (10_000 + s) >= F.col("both") * s).alias("near")), "tested")


def _open(entries: DataFrame) -> DataFrame:
    """Entries of the buckets that hold nodes of several components."""
    open_ = written(entries.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket"), "open")
    return entries.join(open_, "bucket")


def _linkable(entries: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Nodes (node, n, label, held) of open buckets that can still have a link; held is the number of shingles that another open node has too.

    Shingles of one node only are in no overlap, so an overlap is at most `held`. An entry goes if that is too few for
    the smallest size with which the bucket, or the threshold, would allow a link.
    """
    s = round(similarity * 10_000)
    nodes = entries.select("node").distinct()
    each = sets.join(nodes, "node", "left_semi").select("node", F.explode("sh").alias("h"))
    alone = each.groupBy("h").agg(F.min("node").alias("node"), F.max("node").alias("last")).where("node = last").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    least = written(entries.groupBy("bucket").agg(F.min("n").alias("least")), "least")
    rows = entries.join(written(alone, "alone"), "node", "left").join(least, "bucket").withColumn("held", F.col("n") - F.coalesce("alone", F.lit(0)))
    other = F.greatest(F.col("least"), F.ceil(F.col("n") * s / 10_000))
    rows = written(rows.where(F.col("held") * (10_000 + s) >= (F.col("n") + other) * s).select("bucket", "node", "n", "held", "label"), "entries")
    return written(_open(rows).select("node", "n", "held", "label").distinct(), "linkable")


def _first_shingles(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, k, h, at): the first k of a node's shingles, rarest among the nodes first, of which a near set has one; those that others have, with their places."""
    s = round(similarity * 10_000)
    own = sets.join(nodes.select("node"), "node", "left_semi").select("node", F.size("sh").alias("n"), F.explode("sh").alias("h"))
    often = own.groupBy("h").agg(F.count(F.lit(1)).alias("often"))
    ranked = own.join(often, "h").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("often", "h"))).alias("all"))
    least = (F.col("n") - F.ceil(F.col("n") * s / 10_000) + 1).cast("int")
    each = ranked.select("node", least.cast("long").alias("k"), F.posexplode(F.slice("all", F.lit(1), least)).alias("at", "x"))
    return each.where("x.often > 1").select("node", "k", F.col("x.h").alias("h"), "at")


#: Of four lanes of 15 bits in a long: the highest bit of each, and the others.
_HIGHEST = sum(1 << 15 * i + 14 for i in range(4))
_OTHERS = (1 << 60) - 1 - _HIGHEST


def _lanes(bands: Column, count: int) -> list[Column]:
    """The lowest 15 bits of the bands of a node, four to a long."""
    low = [F.get(bands, i).bitwiseAND(F.lit(0x7FFF)) for i in range(count)]
    return [sum((F.shiftleft(x, 15 * i) for i, x in enumerate(low[at + 1 : at + 4], 1)), low[at]).alias(f"w{at // 4}") for at in range(0, count, 4)]


def _share_a_band(count: int) -> Column:
    """Whether w0, w1 ... and w02, w12 ... have an equal lane: true if a band is equal, and for one pair in 32,768 / count besides.

    A lane is zero if its highest bit stays clear when all other bits of it are added to ones.
    """
    out = F.lit(False)
    for at in range(0, count, 4):
        unused = sum(1 << 15 * i for i in range(count - at, 4))
        x = F.col(f"w{at // 4}").bitwiseXOR(F.col(f"w{at // 4}2")).bitwiseOR(F.lit(unused).cast("long"))
        out = out | ((x.bitwiseAND(F.lit(_OTHERS)) + F.lit(_OTHERS)).bitwiseOR(x).bitwiseAND(F.lit(_HIGHEST)) != F.lit(_HIGHEST))
    return out


def _prefix_rows(nodes: DataFrame, sets: DataFrame, pivot: DataFrame, similarity: float) -> DataFrame:
    """A row for each of the first shingles (h, at its place) of a node that several components have, with what is known of the node."""
    rows = written(_first_shingles(nodes, sets, similarity).join(nodes.select("node", "label"), "node"), "first")
    # Only shingles that several components have can bring nodes of different ones together.
    rows = written(rows.join(written(_main(rows), "main"), "h").drop("main"), "shared_first")
    lists = rows.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "h")))["h"].alias("first"))
    return written(rows.join(lists, "node").join(nodes.drop("label"), "node").join(pivot, "node", "left"), "first")


def _main(rows: DataFrame) -> DataFrame:
    """(h, main): the component that is the most frequent at each shingle that several have."""
    return rows.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("h").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("h", "main")


def _can_be_near(similarity: float, bands: int) -> Column:
    """Whether two nodes that meet at a first shingle share a bucket, and nothing known of them proves them under the threshold."""
    s = round(similarity * 10_000)
    # The overlap is at most what either holds of shingles that others have too, and never more than either's size.
    both = F.col("n") + F.col("n2")
    fits = F.least("held", "held2") * (10_000 + s) >= both * s
    apart = F.coalesce((F.col("pivot") == F.col("pivot2")) & (F.abs(F.col("far") - F.col("far2")) > 1 - similarity + 1e-9), F.lit(False))
    # The set whose first shingles end earlier in the order has no others of the other's.
    most = F.size(F.array_intersect("first", "first2")) + F.greatest(F.col("n") - F.col("k"), F.col("n2") - F.col("k2"))
    return fits & _share_a_band(bands) & ~apart & (most * (10_000 + s) >= both * s)


def _second(rows: DataFrame) -> DataFrame:
    return rows.select("h", *[F.col(c).alias(f"{c}2") for c in rows.columns if c not in ("h", "main")])


def _central_pairs(rows: DataFrame, turn: int, similarity: float, bands: int) -> DataFrame:
    """(a, b, la, lb): each node with up to CENTRAL nodes of the main component of each of its first shingles, the nearest to their leaders of that shingle's nodes."""
    rows = rows.join(written(_main(rows), "main"), "h")
    deal = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(CENTRAL))
    central = rows.where("label = main").groupBy("h", deal.alias("deal")).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("h", "main")]), F.struct(F.coalesce("far", F.lit(1.0)), "node")).alias("x")).select("h", "x.*")
    met = rows.where("label <> main").join(_second(central), "h").where(_can_be_near(similarity, bands))
    return met.select(F.col("node").alias("a"), F.col("node2").alias("b"), F.col("label").alias("la"), F.col("label2").alias("lb")).distinct()


def _prefix_pairs(rows: DataFrame, similarity: float, bands: int) -> DataFrame:
    """(a, b, la, lb): pairs of nodes of different components that share a bucket and can be near, met by their first shingles."""
    s = round(similarity * 10_000)
    rows = written(rows.join(written(_main(rows), "main"), "h"), "first")
    differ = (F.col("label") != F.col("label2")) & ((F.col("label2") == F.col("main")) | (F.col("node") < F.col("node2")))
    # The shingle is the first that both have, so what both hold begins there.
    both, begins = F.col("n") + F.col("n2"), F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    once = (begins * (10_000 + s) >= both * s) & (F.array_intersect("first", "first2")[0] == F.col("h"))
    met = rows.where("label <> main").join(_second(rows), "h").where(differ & _can_be_near(similarity, bands) & once)
    return met.select(F.col("node").alias("a"), F.col("node2").alias("b"), F.col("label").alias("la"), F.col("label2").alias("lb"))


def _untested(pairs: DataFrame, seen: DataFrame) -> DataFrame:
    return pairs.join(seen, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")


def _relabelled(df: DataFrame, step: DataFrame) -> DataFrame:
    """df with each label replaced by the component that it is in, if it is in one."""
    return df.join(step.select(F.col("id").alias("label"), "component"), "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n, component_id) of every row of docs."""
    out, names = _grouped(docs, id_col, text_col, n, similarity, bands, rows)
    out = out.join(names, "component", "left")
    return out.select("id", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _row_key(df: DataFrame) -> Column:
    """A hash of all columns of a row that can be hashed, and of which of them are null."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if not re.search(r"\b(map<|variant\b)", f.dataType.simpleString())]
    return F.xxhash64(*cols, F.array(*[c.isNull() for c in cols]))


def _grouped(docs: DataFrame, id_col: str, text_col: str, n: int = 4, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((id, n, component, and key if it is given) of every row, (component, component_id) of every component).

    component is a number, null where the set is empty; component_id is its smallest id.
    """
    s = round(similarity * 10_000)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = source if key is None else docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), key.alias("key"))
    more = keyed.columns[2:]
    all_rows = written(keyed.mapInArrow(_sketches(n, bands, rows), ", ".join(["id long, n long, digest binary, bands array<bigint>", *(f"{c} long" for c in more)])), "sketches")
    named = all_rows.where("digest is not null")
    nodes = named.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("rows"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("bucket", "size")
    entries = written(buckets.join(written(shared, "shared"), "bucket").select("bucket", "size", "node", "n"), "entries")
    # The text that others are variants of agrees with most of them, so it leads.
    weight = written(entries.groupBy("node").agg(F.sum("size").alias("weight")), "weight")
    lead = entries.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("neg"))).alias("x")).select("bucket", "x.weight", (-F.col("x.neg")).alias("lead"))
    lead = written(lead, "lead")

    wanted = written(nodes.join(weight, "node", "left_semi").select("node", "digest", "id", "rows"), "wanted")
    some = F.broadcast if wanted.count() <= BROADCAST_IDS else lambda df: df.hint("merge")
    texts = source.join(some(wanted.select("id").where("id is not null").distinct()), "id", "left_semi").unionByName(source.where("id is null"))
    sets = texts.mapInArrow(_sets(n), "id long, digest binary, sh array<bigint>").where("digest is not null")
    sets = sets.join(some(wanted.withColumnRenamed("id", "own")), "digest").where(F.col("id").eqNullSafe(F.col("own"))).select("node", "rows", "sh")
    # Of equal rows, and of equal texts without an id, one is enough.
    sets = written(sets.where("rows = 1").unionByName(sets.where("rows > 1").dropDuplicates(["node"])).select("node", "sh"), "sets")

    led = entries.join(lead, "bucket").join(weight.withColumnRenamed("weight", "own"), "node").where("node <> lead")
    # Leaders of smaller weight than the node itself are left out, so that no pair comes twice.
    led = led.where("weight > own or weight = own and lead < node").groupBy("node", "n", "lead", "weight").agg(F.count(F.lit(1)).alias("k"))
    best = led.groupBy("node", "n").agg(F.max_by("lead", F.struct("k", "weight", -F.col("lead"))).alias("a"))
    first = best.select("a", F.col("node").alias("b"), "n").join(nodes.select(F.col("node").alias("a"), F.col("n").alias("m")), "a")
    tested = _verified(first.where(F.least("n", "m") * 10_000 >= F.greatest("n", "m") * s).select("a", "b"), sets, similarity)
    links = tested.where("near").select("a", "b")
    # The texts of an id that has several are linked.
    several = named.where("id is not null").groupBy("id").agg(F.min("digest").alias("first"), F.max("digest").alias("last")).where("first <> last").select("id", "first")
    several = written(several, "several")
    if not several.isEmpty():
        of = lambda c, x: nodes.select(F.col("digest").alias(c), F.col("node").alias(x))
        links = links.unionByName(named.join(several, "id").select("first", "digest").distinct().where("first <> digest").join(of("first", "a"), "first").join(of("digest", "b"), "digest").select("a", "b"))
    merged = [components(links)]
    pivot = tested.select(F.col("b").alias("node"), F.col("a").alias("pivot"), (1 - F.col("same")).alias("far"))

    left = written(_open(_relabelled(entries.select("bucket", "node", "n", F.col("node").alias("label")), merged[0])), "entries")
    if not left.isEmpty():
        open_ = _linkable(left, sets, similarity)
        open_ = open_.join(nodes.select("node", *_lanes(F.col("bands"), bands)), "node")
        met = _prefix_rows(open_, sets, pivot, similarity)
        pair = (F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
        seen, turn = tested.select(*pair), 0
        while True:
            found = _verified(_untested(_central_pairs(met, turn, similarity, bands), seen), sets, similarity)
            links = found.where("near")
            if links.isEmpty():
                break
            merged.append(components(links, "la", "lb"))
            met, seen, turn = written(_relabelled(met, merged[-1]), "first"), seen.unionByName(found.select(*pair)), turn + 1
        fresh = _untested(_prefix_pairs(met, similarity, bands), seen.unionByName(found.select(*pair)))
        merged.append(components(_verified(fresh, sets, similarity).where("near"), "la", "lb"))

    lookup = nodes.select("digest", "id", F.col("node").alias("label"))
    for step in merged:
        lookup = _relabelled(lookup, step)
    lookup = written(lookup.select("digest", "id", F.col("label").alias("component")), "components")
    names = lookup.groupBy("component").agg(F.min("id").alias("component_id"))
    return all_rows.select("id", "n", "digest", *more).join(lookup.drop("id"), "digest", "left").select("id", "n", "component", *more), names


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row of each group of near-duplicates (that with the smallest id), and every row with an empty set, with their own columns."""
    key = _row_key(docs)
    out, _ = _grouped(docs, id_col, text_col, **settings, key=key)
    # Rows are told apart by id and key; those with both in common are equal, and k counts them.
    each = out.where("n > 0").groupBy("component", "id", "key").agg(F.count(F.lit(1)).alias("k"))
    best = each.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "k")).alias("x")).select("x.id", "x.key", (F.col("x.k") > 1).alias("again"))
    empty = out.where("n = 0").select("id", "key", F.lit(False).alias("again")).distinct()
    keep = written(best.unionByName(empty), "keep")
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).cast("long").alias("doc_id"), key.alias("doc_key"))

    def kept(of: DataFrame) -> DataFrame:
        return rows.join(of, (F.col("doc_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    one = kept(keep.where("not again"))
    repeated = keep.where("again")
    if not repeated.isEmpty():
        one = one.unionByName(kept(repeated).dropDuplicates(["doc_id", "doc_key"]))
    return one.select("doc.*")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
