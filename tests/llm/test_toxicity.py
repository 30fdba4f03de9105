import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veracity.llm import toxicity as X

from .conftest import SF, SF_TINY, table

MID = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = X.op3_toxicity(spark, MID).join(table(spark, "labels", MID), "doc_id").where("held_out").toPandas()
    assert len(got) > 800 and got.score.between(0, 1).all()
    assert got[got.toxic == 1].predicted.mean() > 0.8 and got[got.toxic == 0].predicted.mean() < 0.04


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (X.score(docs, X.train(docs, y)).orderBy("doc_id").select("score").collect() for y in (labels, flipped))
    assert a == b


def test_edge_cases(spark, edge_docs):
    docs = table(spark, "documents", SF)
    model = X.train(docs.unionByName(edge_docs), table(spark, "labels", SF).unionByName(
        spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")))
    got = X.score(edge_docs.withColumn("score", F.lit("s")).withColumn("toxic_whole", F.lit(1)), model).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if not (r.text or "").strip()}
    assert len(empty) == 1 and empty.pop() < 0.3


def test_nothing_learned(spark, no_docs, edge_docs):
    model = X.train(no_docs, table(spark, "labels"))
    assert all(r.score < 1e-9 for r in X.score(edge_docs, model).collect()) and X.score(no_docs, model).collect() == []


def test_probabilities_sum_to_at_most_one():
    """Each model's next-byte probabilities over all bytes after a context, against a direct computation."""
    rng = np.random.default_rng(1)
    text = rng.integers(97, 101, 4000).astype(np.uint64)
    gram = np.zeros(len(text) - 4, np.uint64)
    for j in range(X.ORDER):
        gram |= text[4 - j:len(text) - j] << np.uint64(8 * j)
    keys, t, o = X._summed(gram, rng.integers(0, 3, len(gram)), rng.integers(0, 3, len(gram)))
    m = X._tables(keys, t.astype(float), o.astype(float))
    context = np.uint64(0x61626364)
    after = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    p = np.full(256, 1 / 256)
    for n, (share, rest) in zip(range(1, X.ORDER), reversed(m["lower"])):
        g = X._cut(after, n)
        p = share[X._bucket(g, n)] + rest[X._bucket(g >> np.uint64(8), n - 1 + 8)] * p
    assert abs(p.sum() - 1) < 0.02
    for share, rest in m["top"]:
        q = share[X._bucket(after, X.ORDER)] + rest[X._bucket(after >> np.uint64(8), X.ORDER - 1 + 8)] * p
        assert abs(q.sum() - 1) < 0.02


def test_stage_removes_what_is_predicted(spark):
    docs = table(spark, "documents")
    out = X.toxicity_stage(spark, docs, SF_TINY)
    rejected = X.op3_toxicity(spark, SF_TINY).where("predicted = 1").count()
    assert out.columns == docs.columns and out.count() == docs.count() - rejected


def test_no_gram_is_dropped(spark):
    """The ratios of grams of a corpus with many distinct ones, against a direct computation."""
    rng = np.random.default_rng(4)
    spelt = ["".join(map(chr, w)) for w in rng.integers(97, 123, (120_000, 5))]
    rows = [(i, " ".join(spelt[200 * i:200 * i + 200])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    m = X.train(docs, labels)

    types, of = set(), (Counter(), Counter())
    for i, t in rows:
        fold = zlib.crc32(str(i).encode()) % 4
        grams = [("\0" * 5 + w)[k + 1:k + 6] for w in t.split() for k in range(5)] if fold != 2 else []
        types.update(grams)
        if fold < 2:
            of[i % 2].update(grams)

    def terms(n):
        total, kinds = Counter(), Counter()
        for g, k in n.items():
            total[g[:-1]] += k
            kinds[g[:-1]] += 1
        return lambda g, p: (max(n[g] - .95, 0) + .95 * kinds[g[:-1]] * p) / total[g[:-1]] if total[g[:-1]] else p

    lower, below = [], types
    for _ in range(4):
        n = Counter(g[1:] for g in below)
        lower.append(terms(n))
        below = set(n)
    top = [terms(n) for n in of]
    some = sorted(types)[::997]
    want = []
    for g in some:
        p = 1 / 256
        for k, f in enumerate(reversed(lower)):
            p = f(g[4 - k:], p)
        want.append(np.log(top[1](g, p)) - np.log(top[0](g, p)))
    got = X._ratio(m, np.array([sum(ord(c) << 8 * j for j, c in enumerate(reversed(g))) for g in some], np.uint64))
    assert len(types) > 150_000 and np.abs(got - want).max() < 1e-4
