import math

import pytest
from pyspark.sql import functions as F

from lumenspar.llm import mixing


def docs(spark):
    return spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").when(F.col("id") % 30 == 0, "small").when(F.col("id") % 7 == 0, None).otherwise("none").alias("source"), (F.col("id") % 97 + 1).alias("n_tokens"))


TARGETS = [("big", 0.5, 1), ("small", 0.3, 4), ("absent", 0.2, 3), (None, 0.1, 1)]


@pytest.mark.parametrize("blocks", [50, 50_000])
def test_shares_and_caps(spark, blocks):
    d = docs(spark)
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats bigint")
    p = mixing.plan(d, t)
    m = mixing.mix(d, p, block_rows=blocks)
    rows = {r["source"]: r for r in mixing.shares(m, p).collect()}
    assert set(rows) == {"big", "small", "absent"}
    assert rows["small"]["most_repeats"] == 4 and rows["big"]["most_repeats"] == 1 and rows["absent"]["mix_tokens"] == 0
    assert rows["big"]["share"] == pytest.approx(0.5 / 0.8, abs=0.01) and rows["small"]["share"] == pytest.approx(0.3 / 0.8, abs=0.01)
    assert {r["source"] for r in m.select("source").distinct().collect()} == {"big", "small"}
    again = mixing.mix(d.repartition(7, "n_tokens"), p, block_rows=blocks)
    assert {tuple(r) for r in m.collect()} == {tuple(r) for r in again.collect()}
    e = mixing.emit(d, m)
    assert e.count() == m.agg(F.sum("copies")).first()[0]


def test_each_document_gets_its_expected_copies_within_one(spark):
    d = docs(spark).where("source = 'small'")
    t = spark.createDataFrame([("small", 1.0, 9)], "source string, target_share double, max_repeats bigint")
    p = mixing.plan(d, t, total_tokens=int(d.agg(F.sum("n_tokens")).first()[0] * 2.6))
    each = p.first()["copies"]
    c = {r["copies"] for r in mixing.mix(d, p).collect()}
    assert c <= {math.floor(each), math.ceil(each)}
    n = d.count()
    assert abs(mixing.mix(d, p).agg(F.sum("copies")).first()[0] - each * n) <= 1


def test_larger_total_caps_small_sources(spark):
    d = docs(spark)
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats bigint")
    p = mixing.plan(d, t, total_tokens=10**9)
    assert {r["source"]: r["copies"] for r in p.collect()} == {"big": 1.0, "small": 4.0, "absent": 0.0}


def test_tokens_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "The queue is full."), (2, "a", ""), (3, None, None), (4, "b", "队列满了。" * 100), (4, "b", "队列满了。" * 100)], "doc_id bigint, source string, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in mixing.token_counts(df).collect()}
    assert n[1] == 5 and n[2] == n[3] == 0 and n[4] > 100
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats bigint")
    s = mixing.token_counts(df.where("false"))
    p = mixing.plan(s, t)
    assert mixing.mix(s, p).count() == 0 and mixing.shares(mixing.mix(s, p), p).count() == 3
