"""The registered queries and the pipeline on the given tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gridstream.llm import fm_index, simhash
from gridstream.llm.queries import ORACLES, QUERIES
from tests.oracle import same_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same_rows(df, ORACLES[name], SF)
    else:
        assert df.count() > 0


def test_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    odd = spark.createDataFrame([(90_001, None, None, None, None), (90_002, "", "en", "s", 0), (90_003, "...", "en", "s", 3)], docs.schema)
    now = docs.unionByName(odd)
    for name, stage in P.STAGES[:-1]:
        now = stage(spark, now, SF).cache()
        assert now.columns == docs.columns, name
        if name == "language_id":
            assert now.count() == docs.count()
        if name == "simhash_near_dedup":
            left = simhash.near_duplicates(now)
            assert left.groupBy("component_id").count().where("count > 1").count() == 0
    assert fm_index.find_contamination(now, bench).where(F.size("spans") > 0).count() == 0
    assert now.where(F.col("n_chars") != F.char_length("text")).count() == 0
    packed = P.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == now.count()
    assert P.STAGES[0][1](spark, docs.limit(0), SF).count() == 0
