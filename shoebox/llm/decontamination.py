"""Benchmark decontamination over item-sized windows (operator 9), in DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words (a text of fewer words is
one shingle). A document leaks an item if one of its windows of the item's size has a weighted Jaccard
similarity of at least 0.8 with the item; the weight of a shingle is how often it stands there.

1. Anchors. A window as similar as that holds at least 0.8 of an item's shingles, so it holds at least
   one of any floor(0.2 m) + 1 of them. Those that fewest items share become the item's anchors, and
   only windows over an anchor are looked at. This step loses nothing.
2. Pairs of a document and an item stay if the whole document holds 0.8 of the item's shingles. This
   loses nothing either.
3. Each window over an anchor of a pair that is left gets a 64-bit SimHash (64 counters, four to a long in lanes of 16
   bits), as the item has. Fingerprints are cut into BLOCKS blocks; those within RADIUS of one another are within
   floor(RADIUS / BLOCKS) in one of the blocks. So an index holds each item under all values that near to its own, block by
   block (block_index), and windows meet it by a join on item, block and value (looked_up), which misses none within the radius.
4. The windows found are verified with the exact weighted similarity, within the pair's row. Where both sides repeat
   shingles, each is hashed with its occurrence number (numbered), so that the weighted similarity is that of sets.

At similarity 0.8 a bit of the fingerprints differs with a chance of 0.151, independently; more than RADIUS of 64 do with a
chance of 7e-11, and less at higher similarities: that is what step 3 can lose. A radius that wide lets 45 % of
unrelated windows pass, and blocks cannot select better; so it is steps 1 and 2, not the blocks, that keep documents
and items from meeting one another. With radius=None every window of step 2 is verified.

Defined cases: null and empty texts hold nothing; a document shorter than an item is one window; null
ids of documents and items are kept; repeated rows with equal id and text give one result; texts with one item_id are
items of their own, of which a document's best is reported, and texts without an item_id are reported each; items
without words match nothing; very long texts are searched whole, anchor by anchor, within the row; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table, written
from ..functions.hashing import majority

N = 5
SIMILARITY = 0.8
#: Blocks of four bits, in which a radius of one is five values; fewer blocks would take thousands of values for an item.
RADIUS, BLOCKS = 31, 16
#: Rows of anchors or of the index of blocks up to which they are broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 500_000


def shingles(text: Column, n: int = N) -> Column:
    """Hashes of the text's word shingles, in order and with repeats."""
    words = F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), "")

    def of(w: Column) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, every).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "), F.size(w)))).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def numbered(arr: Column) -> Column:
    """The hashes of an array, from the second time one stands there on hashed with that number; in any order."""

    def of(s: Column) -> Column:
        def each(h: Column, i: Column) -> Column:
            k = i - F.array_position(s, h) + 1
            return F.when(k == 0, h).otherwise(F.xxhash64(h, k))

        return F.transform(s, each)

    return let(arr, lambda a: F.when(F.size(F.array_distinct(a)) == F.size(a), a).otherwise(let(F.array_sort(a), of)))


def fingerprint(window: Column) -> Column:
    """64-bit SimHash of an array of hashes, each counted as often as it stands there."""
    return let(window, majority)


def _cuts(blocks: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, mask) of each block."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(lo, hi - lo, (1 << (hi - lo)) - 1 if hi - lo < 64 else -1) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _block(x: Column, lo: int, mask: int) -> Column:
    return F.shiftrightunsigned(x, lo).bitwiseAND(F.lit(mask).cast("bigint"))


def first_near(differ: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """The first block in which no more than floor(radius / blocks) bits differ; null if there is none."""
    near = [F.when(F.bit_count(_block(differ, lo, mask)) <= radius // blocks, i) for i, (lo, _, mask) in enumerate(_cuts(blocks))]
    return F.coalesce(*near)


def within(a: Column, b: Column, radius: int = RADIUS, blocks: int = BLOCKS) -> Column:
    """Whether two fingerprints are within the radius: near in a block, then counted in full."""
    return let(a.bitwiseXOR(b), lambda x: first_near(x, radius, blocks).isNotNull() & (F.bit_count(x) <= radius))


def block_index(items: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(item, block, value, item_fp): each item (item, item_fp) under every value of a block within floor(radius / blocks) bits of its own."""
    flips = [(i, lo, mask, sum(1 << b for b in places)) for i, (lo, bits, mask) in enumerate(_cuts(blocks)) for r in range(radius // blocks + 1) for places in combinations(range(bits), r)]
    flips = [(i, lo, mask, flip - (1 << 64) if flip >> 63 else flip) for i, lo, mask, flip in flips]
    every = F.broadcast(items.sparkSession.createDataFrame(flips, "block int, lo int, mask long, flip long"))
    return items.crossJoin(every).select("item", "block", F.expr("(shiftrightunsigned(item_fp, lo) & mask) ^ flip").alias("value"), "item_fp")


def looked_up(windows: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """The windows (item, fp and other columns) whose fingerprint is within the radius of their item's, found by a join on the values of blocks.

    A window that is near in several blocks is kept in the first of them only, so it comes once.
    """
    own = F.array(*[F.struct(F.lit(i).alias("block"), _block(F.col("fp"), lo, mask).alias("value")) for i, (lo, _, mask) in enumerate(_cuts(blocks))])
    probes = windows.select("*", F.explode(own).alias("b")).select(*windows.columns, "b.block", "b.value")
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    met = probes.join(index, ["item", "block", "value"]).where((first_near(differ, radius, blocks) == F.col("block")) & (F.bit_count(differ) <= radius))
    return met.select(*windows.columns)


def _key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for an id and a text."""
    own = F.concat(F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")), F.lit("\u0001"), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(own))


def prepared_items(items: DataFrame, id_col: str, text_col: str, n: int, similarity: float) -> DataFrame:
    """item (a key), item_id, sh (its shingles), m (their number), set (sh with occurrence numbers), and miss (how many of them a match can lack)."""
    rows = items.select(F.col(id_col).alias("item_id"), shingles(F.col(text_col), n).alias("sh")).where(F.size("sh") > 0).distinct()
    rows = rows.withColumn("item", F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col("item_id").cast("string")), F.lit("")), F.lit("\u0001"), F.array_join(F.col("sh").cast("array<string>"), ","))))).withColumn("m", F.size("sh")).withColumn("miss", F.floor((1 - similarity) * F.col("m") + 1e-9).cast("int"))
    return written(rows.withColumn("set", numbered(F.col("sh"))), "items")


def anchors_of(items: DataFrame) -> DataFrame:
    """The anchors (h, item, m) of each item: the shingles that fewest items share."""
    each = items.select("item", "m", "miss", F.explode(F.array_distinct("sh")).alias("h"))
    shared = each.groupBy("h").agg(F.count(F.lit(1)).alias("n_items"))
    ranked = each.join(shared, "h").groupBy("item", "m", "miss").agg(F.array_sort(F.collect_list(F.struct("n_items", "h"))).alias("all"))
    # Distinct shingles can be fewer than positions; then a match lacks no more distinct ones than positions.
    return ranked.select("item", "m", F.explode(F.slice("all", F.lit(1), F.col("miss") + 1)).alias("a")).select(F.col("a.h").alias("h"), "item", "m")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, similarity: float = SIMILARITY, radius: int | None = RADIUS) -> DataFrame:
    """(doc_key, id, item, similarity, start): each document and item that it leaks, with the first of its best windows.

    `start` counts shingles from 0. doc_key is a 128-bit digest of id and text, by which rows can be told apart.
    """
    prepared = prepared_items(items, item_col, item_text_col, n, similarity)
    anchors = written(anchors_of(prepared), "anchors")
    if anchors.count() <= BROADCAST_ROWS:
        anchors = F.broadcast(anchors)
    key = _key(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("doc_key"), F.col(text_col).alias("__text"))
    seen = rows.select("doc_key", F.explode(F.array_distinct(shingles(F.col("__text"), n))).alias("h"))
    pairs = written(seen.join(anchors, "h").groupBy("doc_key", "item").agg(F.count(F.lit(1)).alias("n_anchors")).select("doc_key", "item"), "pairs")

    found = rows.join(pairs.select("doc_key").distinct(), "doc_key", "left_semi").select("id", "doc_key", shingles(F.col("__text"), n).alias("sh")).dropDuplicates(["doc_key"])
    found = written(found, "found")
    small = prepared.select("item", "item_id", "m", F.col("sh").alias("item_sh"), F.col("set").alias("item_set"))
    held = pairs.join(found, "doc_key").join(small, "item")
    both = F.array_intersect("sh", "item_sh")
    enough = let(both, lambda x: F.size(F.filter("item_sh", lambda y: F.array_contains(x, y)))) >= F.ceil(F.col("m") * similarity - 1e-9)
    held = held.where(enough)

    own = anchors.groupBy("item").agg(F.collect_set("h").alias("anchor"))
    held = held.join(own, "item")
    places = F.filter(F.transform("sh", lambda x, i: F.when(F.array_contains("anchor", x), i)), lambda p: p.isNotNull())
    last = F.greatest(F.size("sh") - F.col("m"), F.lit(0))
    starts = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.least(F.greatest(p - F.col("m") + 1, F.lit(0)), last), F.least(p, last)))))
    # Repeats only count twice where both sides have them.
    plain = F.size(F.array_distinct("item_sh")) == F.size("item_sh")
    held = held.select("doc_key", "id", "item", "item_id", "m", "sh", "item_set", plain.alias("plain"), starts.alias("starts"))

    if radius is not None:
        held = written(held, "held")  # read for the fingerprints and for the exact check
        windows = held.select("doc_key", "item", "m", "sh", F.explode("starts").alias("start"))
        windows = windows.select("doc_key", "item", "start", fingerprint(numbered(F.slice("sh", F.col("start") + 1, F.col("m")))).alias("fp"))
        index = written(block_index(prepared.select("item", fingerprint(F.col("set")).alias("item_fp")), radius), "index")
        if index.count() <= BROADCAST_ROWS:
            index = F.broadcast(index)
        near = looked_up(windows, index, radius).groupBy("doc_key", "item").agg(F.collect_list("start").alias("starts"))
        held = held.drop("starts").join(near, ["doc_key", "item"])

    def of(start: Column) -> Column:
        window = F.slice("sh", start + 1, F.col("m"))
        same = F.when(F.col("plain"), F.size(F.array_intersect(window, F.col("item_set")))).otherwise(F.size(F.array_intersect(numbered(window), F.col("item_set")))).cast("double")
        return let(same, lambda o: F.struct((o / (F.least(F.size("sh"), F.col("m")) + F.col("m") - o)).alias("similarity"), (-start).alias("neg")))

    scored = held.withColumn("b", F.array_max(F.transform("starts", of))).where(F.col("b.similarity") >= similarity - 1e-12)
    one = F.when(F.col("item_id").isNull(), F.col("item"))
    best = scored.groupBy("doc_key", F.col("item_id"), one.alias("one")).agg(F.max(F.struct("b.similarity", "b.neg")).alias("b"), F.first("id").alias("id"))
    return best.select("doc_key", "id", F.col("item_id").alias("item"), "b.similarity", (-F.col("b.neg")).cast("long").alias("start"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The documents that leak no item, with their own columns whatever those are called."""
    leaks = decontaminate(docs, items, id_col, text_col, **settings).select("doc_key").distinct()
    rows = docs.select(F.struct("*").alias("doc")).withColumn("doc_key", _key(F.col("doc").getField(id_col), F.col("doc").getField(text_col)))
    return rows.join(leaks, "doc_key", "left_anti").select("doc.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("similarity", 9).alias("similarity"), "start")


ORACLE = """
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
d1 AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split(regexp_replace(lower(t), '[^\\pL\\pN]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM d),
ds AS (SELECT rid, p, w[p + 1:p + 5] AS s FROM d1, unnest(generate_series(0, len(w) - 5)) AS g(p) WHERE len(w) >= 5
       UNION ALL SELECT rid, 0, w FROM d1 WHERE len(w) BETWEEN 1 AND 4),
b1 AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\pL\\pN]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT item_id, p, w[p + 1:p + 5] AS s FROM b1, unnest(generate_series(0, len(w) - 5)) AS g(p) WHERE len(w) >= 5
       UNION ALL SELECT item_id, 0, w FROM b1 WHERE len(w) BETWEEN 1 AND 4),
bc AS (SELECT item_id, s, count(*) AS c FROM bs GROUP BY item_id, s),
bm AS (SELECT item_id, count(*) AS m FROM bs GROUP BY item_id),
dm AS (SELECT rid, count(*) AS m FROM ds GROUP BY rid),
hits AS (SELECT rid, item_id, p, s, c FROM ds JOIN bc USING (s)),
cand AS (SELECT rid, item_id, count(DISTINCT s) AS n FROM hits GROUP BY rid, item_id),
st AS (SELECT DISTINCT h.rid, h.item_id, bm.m, dm.m AS dm, least(greatest(h.p - k, 0), greatest(dm.m - bm.m, 0)) AS start
       FROM hits h JOIN cand USING (rid, item_id) JOIN bm ON bm.item_id = h.item_id JOIN dm ON dm.rid = h.rid, unnest(generate_series(0, bm.m - 1)) AS g(k) WHERE 2 * n >= bm.m),
ov AS (SELECT rid, item_id, start, sum(least(n, c)) AS o FROM (
        SELECT st.rid, st.item_id, st.start, h.s, any_value(h.c) AS c, count(*) AS n
        FROM st JOIN hits h ON h.rid = st.rid AND h.item_id = st.item_id AND h.p >= st.start AND h.p < st.start + st.m GROUP BY ALL) GROUP BY ALL),
sc AS (SELECT ov.rid, ov.item_id, ov.start, o::DOUBLE / (bm.m + least(bm.m, dm.m) - o) AS sim
       FROM ov JOIN bm ON bm.item_id = ov.item_id JOIN dm ON dm.rid = ov.rid)
SELECT d1.doc_id, sc.item_id, round(max(sim), 9) AS similarity, arg_min(start, struct_pack(a := -sim, b := start))::BIGINT AS start
FROM sc JOIN d1 USING (rid) WHERE sim >= 0.8 - 1e-12 GROUP BY d1.rid, d1.doc_id, sc.item_id
"""
