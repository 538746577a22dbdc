"""Quality rules as a bitmask ledger (operator 6), in DataFrame functions only.

`ledger` evaluates every rule once per document and stores the measurements and one bit per failed
rule. A policy is a named version with a mask of the rules it enforces; `apply_policy` and
`ablations` work on the stored bits alone, so a new policy never reads a text again.

Defined cases: a null or empty text has no words and fails `few_words`; a null doc_id is kept as it
is; repeated rows are judged each by itself; very long texts are measured whole, within the row; an empty table gives an empty ledger. Input columns
other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, table, words, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where `fails` (SQL over the measurements) is true. Bits are never reused."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 30 * n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    Rule(4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 40 * n_words)"),
)
BASE = Policy(0, ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy(1, tuple(r.name for r in RULES)))}


def mask(policy: Policy, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[name] for name in policy.rules)


#: Words up to which a window is packed into one long, its hash above its position.
PACKED_WORDS = 4096


def _repeated_words(ws: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Windows are hashed and sorted with their positions, so that equal windows are neighbours and no pairs are formed. Up to
    PACKED_WORDS words a hash of 51 bits or more and the position share a long; longer texts have 64 bits beside the position. So
    two different windows of a text pass for equal with a chance of less than 1e-8 in texts of up to 4,096 words, and 3e-8 in one of a million.
    """

    def of(ws: Column) -> Column:
        shift = F.length(F.bin(F.size(ws).cast("long")))
        hashed = lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
        starts = F.sequence(F.lit(0), F.size(ws) - 3)
        packed = F.transform(starts, lambda i: F.call_function("shiftleft", hashed(i), shift).bitwiseOR(i.cast("long")))
        apart = F.transform(starts, lambda i: F.struct(hashed(i).alias("h"), i.cast("long").alias("p")))

        def packed_places(s: Column) -> Column:
            key = lambda x: F.call_function("shiftrightunsigned", x, shift)
            twice = F.filter(s, lambda x, i: (key(x) == key(F.get(s, i + 1))) | (key(x) == key(F.get(s, i - 1))))
            return F.transform(twice, lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1))

        def apart_places(s: Column) -> Column:
            return F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"]))["p"]

        def covered(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)

        places = F.when(F.size(ws) <= PACKED_WORDS, let(F.sort_array(packed), packed_places)).otherwise(let(F.sort_array(apart), apart_places))
        return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(places), covered))

    return let(ws, of)


def measures(text_col: str = "text") -> list[Column]:
    """The measurements of a text as named columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return [
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(r"[ \t-\r]"))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
        _repeated_words(words(F.col(text_col))).alias("n_repeat_words"),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and one long column per measurement."""
    rows = docs.select(F.col(id_col), *measures(text_col))
    return rows.select(id_col, "n_words", "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words")


def bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """One long with the bit of each rule that fails; a rule that is null on a row does not fail it."""
    total = F.lit(0).cast("long")
    for rule in rules:
        total = total.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Id, measurements and `fail_bits` of every document, in one pass without a shuffle."""
    return measured(docs, id_col, text_col).withColumn("fail_bits", bits(rules))


def passes(policy: Policy, fail_bits: Column | None = None, rules: tuple[Rule, ...] = RULES) -> Column:
    return (F.col("fail_bits") if fail_bits is None else fail_bits).bitwiseAND(F.lit(mask(policy, rules)).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with `kept` and `policy_version`."""
    return rows.withColumn("kept", passes(policy, rules=rules)).withColumn("policy_version", F.lit(policy.version))


def ablations(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents it fails, documents only it fails, documents kept without it.

    The ledger is first counted by bit pattern (at most 2 ** rules rows leave each task).
    """
    all_bits = mask(policy, rules)
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(all_bits).cast("long")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    of = {r.name: r for r in rules}
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << of[name].bit).cast("long").alias("bit")) for name in policy.rules]))
    out = counts.select("pattern", "n", each.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("pattern").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("pattern") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("failed_only_here"),
        F.sum(F.when(F.col("pattern").bitwiseAND(F.lit(all_bits).cast("long").bitwiseXOR(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
    return out.withColumn("policy_version", F.lit(policy.version))


def keep_good(docs: DataFrame, policy: Policy = POLICIES[1], text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns whatever those are called."""
    rows = docs.select(F.struct("*").alias("doc")).withColumn("text", F.col("doc").getField(text_col))
    rows = rows.select("doc", *measures()).select("doc", "n_words", "word_chars", "n_symbols", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines"), "n_repeat_words")
    return rows.where(passes(policy, bits())).select("doc.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")), POLICIES[1])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(BASE)).alias("base_failed"), "kept", "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy version costs, from a stored ledger: no text is read again for a policy."""
    rows = written(ledger(table(spark, sf_dir, "documents")), "ledger").select("fail_bits")
    made = [ablations(rows, p) for p in POLICIES.values()]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


_BITS = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
      FROM (SELECT rid, regexp_extract_all(t, '[^ \\t-\\r]+') AS ws FROM d)),
g AS (SELECT rid, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM g WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, w, w2, w3) > 1),
p AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
m AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^ \\t-\\r]') GROUP BY rid),
a AS (SELECT d.rid, d.doc_id, len(regexp_extract_all(t, '[^ \\t-\\r]+'))::BIGINT AS n_words,
        length(regexp_replace(t, '[ \\t-\\r]', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(m.n_lines, 0)::BIGINT AS n_lines, coalesce(m.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN p USING (rid) LEFT JOIN m ON m.rid = d.rid),
b AS (SELECT *, ((n_words < 50)::BIGINT | ((100 * n_repeat_words > 50 * n_words)::BIGINT << 1) | ((100 * n_symbols > 30 * n_words)::BIGINT << 2)
        | ((n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines)::BIGINT << 3)
        | ((n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 40 * n_words))::BIGINT << 4)) AS fail_bits FROM a)
"""
ORACLE = f"{_BITS}SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b"
ABLATIONS_ORACLE = _BITS + ", v(policy_version, all_bits, rule, bit) AS (VALUES " + ", ".join(f"({p.version}, {mask(p)}, '{r.name}', {1 << r.bit})" for p in POLICIES.values() for r in RULES if r.name in p.rules) + """)
SELECT policy_version, rule, count(*) FILTER ((fail_bits & bit) <> 0) AS failed, count(*) FILTER ((fail_bits & all_bits) = bit) AS failed_only_here, count(*) FILTER ((fail_bits & all_bits & ~bit) = 0) AS kept_without FROM b, v GROUP BY policy_version, rule"""
