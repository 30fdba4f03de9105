import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veracity.llm import packing as K

from .conftest import table, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_every_piece_fits_and_bins_are_no_larger_than_needed(lengths):
    lengths = np.array(sorted(lengths, reverse=True), int)
    b, at, cap = K.best_fit(lengths, (16, 32, 64))
    for k in set(b.tolist()):
        mine = b == k
        used = lengths[mine].sum()
        assert set(cap[mine]) == {min(c for c in (16, 32, 64) if c >= used)}
        spans = sorted(zip(at[mine], lengths[mine]))
        assert all(x + n == y for (x, n), (y, _) in zip(spans, spans[1:])) and spans[0][0] == 0


def test_cost_steers_the_size_of_new_bins():
    lengths = np.array([10] * 12)
    assert set(K.best_fit(lengths, (16, 64), {16: 1.0, 64: 100.0})[2]) == {16}
    assert set(K.best_fit(lengths, (16, 64), {16: 100.0, 64: 100.0})[2]) == {64}



def test_least_fitting_room_is_taken():
    b, _, _ = K.best_fit(np.array([60, 50, 14, 4]), (64,))
    assert b.tolist() == [0, 1, 1, 0]


@pytest.mark.parametrize("group", [20_000, 50])
def test_documents(spark, group):
    docs = table(spark, "documents").select("doc_id", F.regexp_count("text", F.lit(K.WORD)).alias("n"))
    out = K.pack(docs, "doc_id", "n", (64, 128, 256), group=group).toPandas()
    want = {r.doc_id: len(words(r.text)) for r in table(spark, "documents").collect()}
    assert out.groupby("doc_id").length.sum().to_dict() == want
    for _, g in out.groupby("doc_id"):
        g = g.sort_values("piece")
        assert (g.start == g.length.cumsum() - g.length).all()
    bins = out[out.length > 0].groupby("bin_id")
    assert (bins.length.sum() <= bins.bin_capacity.first()).all() and (bins.bin_capacity.nunique() == 1).all()
    assert bins.length.sum().sum() / bins.bin_capacity.first().sum() > 0.9


def test_edge_cases(spark, edge_docs, no_docs):
    out = K.packed_documents(edge_docs.withColumn("piece", F.lit(1))).collect()
    total = sum(len(words(r.text)) for r in edge_docs.collect())
    assert sum(r.length for r in out) == total
    assert sum(r.piece == 0 for r in out) == edge_docs.count()
    assert all((r.bin_id is None) == (r.length == 0) for r in out)
    assert K.packed_documents(no_docs).collect() == []


def test_same_rows_same_bins(spark):
    docs = table(spark, "documents")
    a, b = (sorted(map(tuple, K.packed_documents(d).collect())) for d in (docs, docs.repartition(7)))
    assert a == b


def test_one_key_with_many_equal_lengths_is_spread(spark):
    """A null key with a third and more of the rows, all of one length, does not meet in one group."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.lit(100).alias("n"))
    got = K.pack(df, "k", "n", group=100).where("k is null").collect()
    groups = [r.bin_id.split("-")[0] for r in got]
    assert len(got) == 1000 and max(map(groups.count, set(groups))) < 100
