"""Exact and similar duplicates within trips: cohorts, banded Hamming pairs, components, scores, skips."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hex_bits
from ..functions.numeric import clamp01
from ..sources.work import written
from .components import components

THRESHOLD = 8


def exact_members(media: DataFrame) -> DataFrame:
    """(trip_id, file_hash, id, n): a row for each member of the cohorts of equal hashes; whatever their size, no row holds more than one."""
    rows = media.where("deleted_at is null and file_hash is not null").select("trip_id", "file_hash", "id")
    sizes = rows.groupBy("trip_id", "file_hash").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return rows.join(sizes, ["trip_id", "file_hash"]).select("trip_id", "file_hash", "id", "n")


def exact_cohorts(media: DataFrame) -> DataFrame:
    """(trip_id, file_hash, members, n): active media of a trip with equal hashes, two or more, by (created_at, id).

    For cohorts whose ids fit in a row; exact_members is the form for cohorts of any size.
    """
    rows = media.where("deleted_at is null and file_hash is not null")
    by = rows.groupBy("trip_id", "file_hash").agg(F.array_sort(F.collect_list(F.struct("created_at", "id"))).alias("m"), F.count(F.lit(1)).alias("n"))
    return by.where("n >= 2").select("trip_id", "file_hash", F.transform("m", lambda x: x["id"]).alias("members"), "n")


def exact_counts(media: DataFrame) -> DataFrame:
    """(trip_id, scanned, distinct_hashes, cohorts, members): counts only, so that no list is built."""
    by = media.where("deleted_at is null and file_hash is not null").groupBy("trip_id", "file_hash").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("trip_id").agg(F.sum("n").alias("scanned"), F.count(F.lit(1)).alias("distinct_hashes"), F.count_if(F.col("n") >= 2).alias("cohorts"), F.coalesce(F.sum(F.when(F.col("n") >= 2, F.col("n"))), F.lit(0)).alias("members"))


#: Probes that a hash may have in a scheme, and what a probe costs beside a pair that is compared.
PROBES, PROBE_COST = 1000, 3.0


def _scheme(threshold: int, blocks: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each block.

    The radii add up to threshold - blocks + 1: were a pair farther apart than the radius in every block, it would differ in more than
    `threshold` bits altogether.
    """
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    each, more = divmod(threshold - blocks + 1, blocks)
    return [(lo, hi - lo, each + (i < more)) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _flips(bits: int, radius: int) -> int:
    return sum(math.comb(bits, r) for r in range(radius + 1))


def _sides(radius: int) -> tuple[int, int]:
    """How many bits either hash of a pair flips, so that all values of a block within the radius meet."""
    return (radius + 1) // 2, radius // 2


def schemes(threshold: int) -> dict[int, tuple[int, float]]:
    """By number of blocks: (probes of a hash on both sides, share of the other hashes that it meets if bits are random)."""
    out = {}
    for m in range(1, threshold + 2):
        own = _scheme(threshold, m)
        probes = sum(_flips(bits, side) for _, bits, radius in own for side in _sides(radius))
        if probes <= PROBES or m == threshold + 1:
            out[m] = probes, sum(_flips(bits, radius) / 2.0**bits for _, bits, radius in own)
    return out


def near_hashes(nodes: DataFrame, threshold: int = THRESHOLD, blocks: int | None = None) -> DataFrame:
    """(trip_id, a, b, distance): distinct hashes of a trip within the threshold.

    The 64 bits are cut into blocks, each with a radius, such that hashes within the threshold are within the radius in one block at
    least (_scheme). Each side of an equi-join of (trip, block, value) flips up to half of the radius (_sides), which takes far fewer rows than
    all flips on one side; a pair counts only where the one flips the lowest of the bits that differ and the other the rest. Few long blocks need many probes
    for a hash and meet few others, many short blocks the other way round, so each trip takes the number of
    blocks that costs least for its own number of hashes: a large trip changes nothing for the others. A hash has
    at most PROBES probes. A pair counts only in the first block where it is that near.
    """
    known = {m: x for m, x in schemes(threshold).items()} if blocks is None else {blocks: (0, 0.0)}
    n = F.col("n_trip")
    cost = F.least(*[F.struct((F.lit(PROBE_COST * probes) + n * share).alias("cost"), F.lit(m).alias("m")) for m, (probes, share) in known.items()]) if len(known) > 1 else F.struct(F.lit(0.0).alias("cost"), F.lit(next(iter(known))).alias("m"))
    trips = nodes.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n_trip")).select("trip_id", cost["m"].alias("m"))
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    mask = lambda bits: signed((1 << bits) - 1)

    def flipped(side: int, limit) -> DataFrame:
        """(m, block, lo, mask, flip, limit) of each set of bits that this side flips; a few hundred rows."""
        flips = [(m, i, lo, mask(bits), signed(sum(1 << b for b in places)), limit(places, _sides(radius)[side])) for m in known for i, (lo, bits, radius) in enumerate(_scheme(threshold, m)) for r in range(_sides(radius)[side] + 1) for places in combinations(range(bits), r)]
        return F.broadcast(nodes.sparkSession.createDataFrame(flips, "m int, block int, lo int, mask long, flip long, limit int"))

    # Blocks and flips are rows, not branches: an expression with a branch for each scheme is too large for Spark's compiled code.
    own = nodes.join(trips, "trip_id").select("trip_id", "m", "bits", "node")
    value = F.expr("(shiftrightunsigned(bits, lo) & mask) ^ flip").alias("value")
    # The second flips only where the first has flipped its full number of bits, and only bits above them.
    asked = own.join(flipped(0, lambda places, full: max(places, default=-1) if len(places) == full else 64), "m").select("trip_id", "m", "bits", "node", "block", value, F.col("limit").alias("top"))
    other = own.join(flipped(1, lambda places, full: min(places, default=99)), "m").select("trip_id", "block", value, F.col("bits").alias("bits2"), F.col("node").alias("node2"), F.col("limit").alias("low"))
    differ = F.col("bits").bitwiseXOR(F.col("bits2"))
    distance = F.bit_count(differ)
    # By value first: rows are sorted by their keys in this order, and the trip tells few of them apart.
    near = asked.join(other, ["value", "block", "trip_id"]).where((F.col("low") > F.col("top")) & (F.col("node") < F.col("node2")) & (distance <= threshold))
    before = F.broadcast(nodes.sparkSession.createDataFrame([(m, [(lo, mask(bits), radius) for lo, bits, radius in _scheme(threshold, m)]) for m in known], "m int, own array<struct<lo: int, mask: long, radius: int>>"))
    near = near.select("trip_id", "m", "block", F.col("node").alias("a"), F.col("node2").alias("b"), distance.alias("distance"), differ.alias("differ")).join(before, "m")
    return near.where("not exists(slice(own, 1, block), x -> bit_count(shiftrightunsigned(differ, x.lo) & x.mask) <= x.radius)").select("trip_id", "a", "b", "distance")


def image_hashes(media: DataFrame) -> DataFrame:
    """(trip_id, id, bits) of active images, written before they are filtered, so that a derived hash is computed once."""
    return written(media.where("type = 'image' and deleted_at is null").select("trip_id", "id", hex_bits(F.col("perceptual_hash")).alias("bits")), "hashes").where("bits is not null")


def _nodes(hashes: DataFrame) -> DataFrame:
    return written(hashes.groupBy("trip_id", "bits").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")


def similar_classes(media: DataFrame, threshold: int = THRESHOLD, members: bool = False) -> DataFrame:
    """(trip_id, a, b, distance, n_a, n_b): links between classes of equal hashes, each named by its smallest id, with their sizes.

    A class of several images also has a row of its own (a = b, distance 0, which no link has); with `members`, a row for each of
    its images (b), so that all pairs of images follow from the rows. However large the classes, rows grow with the images and
    the links between different hashes; image_pairs expands them.
    """
    rows = image_hashes(media)
    nodes = _nodes(rows)
    size = nodes.select("trip_id", "node", "n")
    links = near_hashes(nodes, threshold).join(size.toDF("trip_id", "a", "n_a"), ["trip_id", "a"]).join(size.toDF("trip_id", "b", "n_b"), ["trip_id", "b"])
    classes = nodes.where("n > 1")
    classes = rows.join(classes, ["trip_id", "bits"]) if members else classes.withColumn("id", F.col("node"))
    own = classes.select("trip_id", F.col("node").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    return links.select("trip_id", "a", "b", "distance", "n_a", "n_b").unionByName(own)


def image_pairs(media: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(trip_id, a, b, distance): all pairs of images within the threshold, equal hashes included (the expanded form)."""
    rows = image_hashes(media)
    nodes = _nodes(rows)
    near = near_hashes(nodes, threshold)
    bits = nodes.select("trip_id", "node", "bits")
    links = near.join(bits.select("trip_id", F.col("node").alias("a"), F.col("bits").alias("x")), ["trip_id", "a"]).join(bits.select("trip_id", F.col("node").alias("b"), F.col("bits").alias("y")), ["trip_id", "b"]).select("trip_id", "x", "y", "distance")
    links = links.unionByName(links.select("trip_id", F.col("y").alias("x"), F.col("x").alias("y"), "distance")).unionByName(nodes.where("n > 1").select("trip_id", F.col("bits").alias("x"), F.col("bits").alias("y"), F.lit(0).alias("distance")))
    one, two = rows.select("trip_id", F.col("id").alias("a"), F.col("bits").alias("x")), rows.select("trip_id", F.col("id").alias("b"), F.col("bits").alias("y"))
    return links.join(one, ["trip_id", "x"]).join(two, ["trip_id", "y"]).where("a < b").select("trip_id", "a", "b", "distance")


def similar_cohorts(media: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(trip_id, component, id, bits): members of the components (two or more images) of similar images."""
    rows = image_hashes(media)
    nodes = _nodes(rows)
    found = components(near_hashes(nodes, threshold)).withColumnRenamed("id", "node")
    named = rows.join(nodes.select("trip_id", "bits", "node", "n"), ["trip_id", "bits"]).join(found, "node", "left")
    return named.where("component is not null or n > 1").select("trip_id", F.coalesce("component", "node").alias("component"), "id", "bits")


def cohort_scores(members: DataFrame) -> DataFrame:
    """(trip_id, component, n, max_distance, confidence): the largest distance of any two members, over distinct hashes.

    A pair can only be farther apart than the farthest from `end` (itself the farthest from `head`) if its distances from
    `head` sum to more; only such pairs meet, by their distances from `head`.
    """
    keys = ["trip_id", "component"]
    size = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    apart = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y)))
    one = members.select(*keys, "bits").distinct()
    one = one.join(one.groupBy(*keys).agg(F.min("bits").alias("head")), keys).withColumn("d", apart("bits", "head"))
    ends = one.groupBy(*keys).agg(F.max_by("bits", F.struct("d", "bits")).alias("end"), F.max("d").alias("most"))
    seen = one.join(ends, keys).withColumn("e", apart("bits", "end"))
    least = seen.groupBy(*keys).agg(F.max("e").alias("least"))
    open_ = seen.join(least, keys).where("d + most > least")
    other = open_.select(*keys, F.col("d").alias("level"), F.col("bits").alias("bits2"))
    levels = F.explode(F.sequence(F.greatest(F.col("least") - F.col("d") + 1, F.lit(0)), F.col("most")))
    far = open_.where("least - d + 1 <= most").select(*keys, "bits", levels.alias("level")).join(other, [*keys, "level"]).where("bits < bits2").groupBy(*keys).agg(F.max(apart("bits", "bits2")).alias("far"))
    out = size.join(least, keys).join(far, keys, "left")
    return out.select(*keys, "n", F.greatest("least", "far").alias("max_distance")).withColumn("confidence", clamp01(1 - F.col("max_distance") / 64))


def item_similarity(members: DataFrame) -> DataFrame:
    """(trip_id, component, id, similarity): each member against the one with the smallest id."""
    head = members.groupBy("trip_id", "component").agg(F.min_by("bits", "id").alias("head"))
    return members.join(head, ["trip_id", "component"]).select("trip_id", "component", "id", clamp01(1 - F.bit_count(F.col("bits").bitwiseXOR(F.col("head"))) / 64).alias("similarity"))


def fresh_cohorts(members: DataFrame, grouped: DataFrame, cohort: str = "component") -> DataFrame:
    """Members of cohorts of which no member is in an existing group (grouped: id)."""
    hit = members.join(grouped.select("id").distinct(), "id", "left_semi").select(cohort).distinct()
    return members.join(hit, cohort, "left_anti").select(*members.columns)


def histogram(df: DataFrame, column: str, keys: tuple[str, ...] | None = None) -> DataFrame:
    """(column, n); with keys, every key is there, with 0 where nothing is counted."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if keys is None:
        return counts
    all_keys = df.sparkSession.createDataFrame([(k,) for k in keys], f"{column} string")
    return all_keys.join(counts, column, "left").withColumn("n", F.coalesce("n", F.lit(0)))
