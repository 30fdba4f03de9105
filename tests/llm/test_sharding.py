from pyspark.sql import functions as F

from veracity.llm import sharding as S

from .conftest import table


def sizes(df):
    return {r.shard: (r.s, r.m, r.n) for r in df.groupBy("shard").agg(F.sum("row_bytes").alias("s"), F.max("shard_bytes").alias("m"), F.count("*").alias("n")).collect()}


def brute(keys, limit):
    """Split every bucket above the limit on its next bit."""
    out, todo = {}, [("", keys)]
    while todo:
        prefix, rows = todo.pop()
        if sum(b for _, b in rows) <= limit:
            out.update({k: prefix for k, _ in rows})
        else:
            todo += [(prefix + x, part) for x in "01" if (part := [(k, b) for k, b in rows if k[len(prefix)] == x])]
    return out


def test_directory_matches_bucket_by_bucket_splitting(spark):
    docs = table(spark, "documents").select("doc_id", F.octet_length("text").alias("n"))
    rows = docs.select(S.bits("doc_id").alias("k"), "n", "doc_id").collect()
    for limit in (20_000, 60_000, 10**9):
        want = brute([(r.k, r.n) for r in rows], limit)
        got = {r.doc_id: r for r in S.assign(docs, ["doc_id"], F.col("n"), limit).collect()}
        assert {r.doc_id: want[r.k] for r in rows} == {k: r.shard for k, r in got.items()}
        assert all(r.depth == len(r.shard) for r in got.values())


def test_equal_keys_are_paged_within_the_limit(spark, edge_docs):
    rows = edge_docs.crossJoin(spark.range(30)).drop("id").withColumn("shard", F.lit(5)).withColumn("n", F.octet_length("text"))
    got = S.assign(rows, ["doc_id"], F.col("n"), 3_000)
    assert got.count() == rows.count()
    for total, told, n in sizes(got).values():
        assert total == told and (total <= 3_000 or n == 1)


def test_empty_table(no_docs):
    assert S.assign(no_docs, ["doc_id"], F.octet_length("text"), 10).collect() == []
