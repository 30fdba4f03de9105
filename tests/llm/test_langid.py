import numpy as np
from pyspark.sql import functions as F

from veracity.llm import langid as L

from .conftest import SF, table


def test_held_out_accuracy(spark):
    got = L.op6_language_id(spark, SF).join(table(spark, "documents", SF).select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97
    assert got.where("score < 0 OR score > 1").count() == 0


def test_edge_cases(spark, edge_docs):
    model = L.train(table(spark, "documents"))
    got = L.predict(edge_docs.withColumn("lang_pred", F.lit(7)), model).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        has = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has) and (r.score == 0) == (not has)


def test_nothing_learned(spark, no_docs, edge_docs):
    model = L.train(no_docs)
    assert {(r.lang_pred, r.score) for r in L.predict(edge_docs, model).collect()} == {("und", 0.0)}
    assert L.predict(no_docs, model).collect() == []


def test_counts_and_posterior_by_hand(spark):
    docs = spark.createDataFrame([("aab", "x"), ("abb", "y"), (None, "x"), ("zz", None)], "text string, lang string")
    model = L.train(docs, buckets=1 << 12, alpha=1.0, orders=2)
    assert model["langs"] == ["x", "y"]
    count = {"x": {"a": 2, "b": 1, "aa": 1, "ab": 1}, "y": {"a": 1, "b": 2, "ab": 1, "bb": 1}}
    logs = {k: sum(np.log((c.get(g, 0) + 1) / (5 + (1 << 12))) for g in ("a", "b", "ab")) for k, c in count.items()}
    want = 1 / (1 + np.exp(min(logs.values()) - max(logs.values())))
    r = L.predict(spark.createDataFrame([("ab",)], "text string"), model).first()
    assert abs(r.score - want) < 1e-5 and r.lang_pred == "x"


def test_stage_keeps_clean_documents(spark):
    docs = table(spark, "documents")
    out = L.language_stage(spark, docs.unionByName(docs.limit(1).withColumn("text", F.lit("123 !!!"))), SF)
    assert out.columns == docs.columns and out.count() == docs.count()
