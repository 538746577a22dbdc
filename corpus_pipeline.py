"""A training corpus from documents: rules, near-duplicates, benchmark leaks, source mix, token shards.

Defined cases of the stages, which pass the columns of documents on whatever they are called:

- rules: a null or empty text fails `few_words` and goes; repeated rows are judged each by itself; null ids stay null.
- near_duplicates: null and repeated ids are told apart by their rows; of equal rows one stays; ties go to the smallest id (null
  last), then the smallest hash of the row; texts without words (the rules leave none) would all stay.
- benchmark_leaks: rows without text hold no item and stay; items without words match nothing; equal rows go or stay together.
- source_mix: a row may come up to three times; texts of no words are not taken; null is a source, last in order.
- tokens: null ids come first, equal ids in the order of a hash of their texts; a null text is the end id alone.

An empty table goes through every stage and ends as an empty index; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoebox.llm import decontamination, mixing, near_dedup, quality_rules, token_store
from shoebox.llm.common import table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule of policy 1."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8)."""
    return near_dedup.keep_one(docs, n=5)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The index of the token store that the documents are written to."""
    return token_store.stored(docs)


STAGES = [("quality_rules", rules), ("near_dedup", near_duplicates), ("decontamination", benchmark_leaks), ("mixing", source_mix), ("token_output", tokens)]
#: The last stage's ids come from a tokenizer, which SQL has not; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
