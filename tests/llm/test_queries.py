"""The registered queries over given tables, and the pipeline's stages against brute force."""

import os

import pytest

import __spark_entry__ as E
import corpus_pipeline
from vigil.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    res = duck.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, res.fetchall())) == sorted(str(tuple(r[c] for c in cols)) for r in df.collect())


@pytest.mark.parametrize("name", ["op6_separator_scan_token_counts", "op7_quotation_linking"])
def test_whole_table_is_read(spark, name):
    table = "conversations" if name.startswith("op7") else "documents"
    assert E.queries()[name](spark, SF).count() == spark.read.parquet(os.path.join(SF, f"{table}.parquet")).count()


def test_pipeline_stages(spark):
    from test_decontaminate import brute as hits
    from test_ngram_join import brute as components
    from test_pii_boost import plain
    from test_packing import ENC

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], SF).cache())
        assert seen[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in d.collect()} for d in seen]
    assert set(rows[1]) <= set(rows[0]) and len(rows[1]) >= 0.95 * len(rows[0])
    assert set(rows[2]) == {d for d, _, c in components([(d, r.text) for d, r in rows[1].items()]) if d == c}
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(rows[3]) == {x[0] for x in hits([(d, r.text) for d, r in rows[2].items()], bench) if not x[4]}
    assert set(rows[4]) == set(rows[3])
    for d, r in rows[4].items():
        before = rows[3][d].text
        assert all(before[s:e] not in r.text for k, s, e in plain(before) if k != "ip") and r.n_chars == len(r.text)
        assert plain(before) or "[SECRET]" in r.text or r.text == before
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF).collect()
    lengths = {}
    for p in packed:
        lengths[p.doc_id] = lengths.get(p.doc_id, 0) + p.length
    assert lengths == {d: len(ENC.ids(r.text)) + 1 for d, r in rows[4].items()}


def test_stages_take_awkward_and_empty_tables(spark, awkward, empty):
    from pyspark.sql import functions as F

    for docs in (awkward, empty):
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("source", F.lit(None).cast("string"))
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF).cache()
        assert docs.columns[:3] == ["doc_id", "piece", "start"]
