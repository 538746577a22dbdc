"""The pipeline against plain Python, stage by stage."""

import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from shoebox.llm import mixing, token_store
from tests.llm.test_near_dedup import brute
from tests.llm.test_rules_mixing_licenses import measures
from tests.llm.test_text_operators import plain_leaks


def passes(text):
    n, chars, symbols, dup, again = measures(text)
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return not (n < 50 or 100 * again > 50 * n or 100 * symbols > 30 * n or (len(lines) >= 4 and 100 * dup > 50 * len(lines)) or chars < 2 * n or chars > 40 * n)


def test_pipeline(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    text, source = dict(zip(docs.doc_id, docs.text)), dict(zip(docs.doc_id, docs.source))
    kept = [d for d in text if passes(text[d])]
    kept = [d for d, _, c in brute([(d, text[d]) for d in kept], 5) if d == c]
    leaks = {d for d, _ in plain_leaks([(d, text[d]) for d in kept], items)}
    kept = [d for d in kept if d not in leaks]
    assert leaks

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontamination", "mixing", "token_output"]
    out = corpus_pipeline.run(spark, sf).toPandas().sort_values("start")
    copies = Counter(out.doc_id.tolist())
    assert set(copies) <= set(kept) and max(copies.values()) <= 3 and (np.diff(out.doc_id) >= 0).all()

    size = {d: measures(text[d])[0] for d in kept}
    names = sorted({source[d] for d in kept}, key=lambda s: (s is None, s or ""))
    sums = [sum(size[d] for d in kept if source[d] == s) for s in names]
    for s, goal in zip(names, mixing.water_fill(sums, [mixing.WEIGHTS[i % 3] for i in range(len(names))])):
        own = [d for d in kept if source[d] == s]
        taken = sum(copies[d] * size[d] for d in own)
        assert abs(taken - goal) <= max(min(size[d] for d in own), 0.02 * goal), s

    tokenizer, at = Tokenizer.from_file(token_store.byte_bpe_path()), 0
    for r in out.itertuples():
        ids = tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_stages_keep_columns_and_bear_empty_tables(spark, docs, no_docs, sf):
    assert corpus_pipeline.ORACLE_SQL is None
    for frame in (docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, frame, sf).columns == docs.columns
    rows = no_docs
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, sf)
    assert rows.count() == 0


@pytest.mark.parametrize("name", ["op1_url_filters", "op2_licenses", "op6_quality_rules", "op8_warc", "op9_decontamination"])
def test_queries_agree_with_sql(spark, sf, name):
    import duckdb

    from shoebox.llm.queries import ORACLES, QUERIES

    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    want = c.execute(ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))
