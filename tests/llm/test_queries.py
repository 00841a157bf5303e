"""Registered queries on the given tables, and the pipeline stage by stage."""

import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from coverlay.llm.queries import CHECKS, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def results(spark):
    return {name: build(spark, DATA).toPandas() for name, build in QUERIES.items()}


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    want = sql.execute(CHECKS[name]).df()[df.columns]
    got = df.toPandas()
    assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, want.astype(got.dtypes.to_dict()).where(want.notna(), None).itertuples(index=False)))


def test_whole_tables(sql, results):
    docs = sql.execute("SELECT count(*) FROM documents").fetchall()[0][0]
    for n in (1, 2, 3, 6, 8, 9, 10, 13):
        (name,) = (q for q in QUERIES if q.startswith(f"op{n}_"))
        assert len(results[name]) == docs == results[name]["doc_id"].nunique(), name


def test_mixing(sql, results):
    got = results["op1_mixing"]
    sums = got.groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first", "size": "sum"})
    assert (sums["source_size"] == sums["size"]).all() and sums["target"].sum() == pytest.approx(1.5 * got["size"].sum())
    assert (abs(sums["taken"] / sums["target"] - 1) < 0.03).all() and (got["taken"] <= 2 * got["size"]).all()


def test_sharding(sql, results):
    got = results["op3_sharding"].set_index("doc_id")
    rows = sql.execute("SELECT doc_id, text FROM documents").fetchall()
    for doc_id, text in rows:
        raw = (text or "").encode()
        assert (got.loc[doc_id, "size"], got.loc[doc_id, "text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    counts = got["shard"].value_counts()
    assert len(counts) == 16 and counts.max() - counts.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_classifiers(sql, results):
    labels = dict((d, (q, t)) for d, q, t in sql.execute("SELECT doc_id, quality, toxic FROM labels").fetchall())
    lang = dict(sql.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = results["op8_quality"]
    known = got[got["doc_id"].isin(labels)]
    assert np.mean([labels[d][0] == p for d, p in zip(known["doc_id"], known["predicted"])]) > 0.95
    got = results["op10_language"]
    assert np.mean([lang[d] == p for d, p in zip(got["doc_id"], got["lang_pred"])]) > 0.95
    assert results["op2_toxicity"]["score"].between(0, 1).all() and results["op9_encoding"]["exact"].all()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            out = spark.createDataFrame(out.collect(), out.schema)
            before = {r[0] for r in docs.select("doc_id").collect()}
            assert {r[0] for r in out.select("doc_id").collect()} <= before, name
            docs = out
    assert out.count() == docs.count() and out.filter(~F.col("exact")).count() == 0
    spelled = out.select("doc_id", F.size("ids").alias("n")).agg(F.sum("n")).first()[0]
    assert spelled > 0


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
    empty = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_near_dedup_stage_keeps_one_row_of_a_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "clean text without a key"), (1, text), (1, text), (1, text + " z"), (None, text), (2, "another"), (2, "different")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.deduplicate(spark, docs, DATA).collect())
    assert len(got) == 4 and got[0] == (0, rows[0][1]) and got[1][0] == 1 and got[2:] == [(2, "another"), (2, "different")]
