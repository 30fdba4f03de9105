from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from veracity.llm import quality as Q

from .conftest import SF, table, words


def expected(text):
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def check(df, model):
    texts = sorted(((r.doc_id is None, r.doc_id or 0), expected(r.text)) for r in df.collect())
    got = Q.measure(df, model).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), tuple(r)[1:6]) for r in got) == texts
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= model["threshold"])
    return got


def test_documents_and_edge_cases(spark, edge_docs):
    model = Q.train(table(spark, "documents"), table(spark, "labels"))
    check(table(spark, "documents"), model)
    check(edge_docs.withColumn("score", F.lit(1)), model)
    lines = spark.createDataFrame([(1, "a b\na b\n\n \n\na b \nA b\nx"), (2, "\n\n"), (3, "q\r\nq\r\nq"), (4, "#|é<\nü" * 9)], "doc_id long, text string")
    check(lines, model)


def test_ratio_by_hand(spark):
    docs = spark.createDataFrame([(0, "p q p"), (1, "p r"), (5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(docs, labels, evidence=1.0)
    seen = Counter({"p": 3, "q": 1, "r": 1, "pq": 1, "qp": 1, "pr": 1})
    good = Counter({"p": 2, "q": 1, "pq": 1, "qp": 1})
    ratio = {g: np.log((good[g] + 1) / (seen[g] * 5 / 8 + 1)) for g in seen}
    got = {r.doc_id: r.score for r in Q.measure(docs, model).collect()}
    assert abs(got[0] - (2 * ratio["p"] + ratio["q"] + ratio["pq"] + ratio["qp"]) / 5) < 1e-9
    assert abs(got[1] - (ratio["p"] + ratio["r"] + ratio["pr"]) / 3) < 1e-9 and got[5] == 0


def test_no_labels_keep_everything(spark, no_docs):
    model = Q.train(table(spark, "documents"), table(spark, "labels").limit(0))
    assert Q.measure(table(spark, "documents"), model).where("NOT kept AND NOT base_failed").count() == 0
    assert Q.measure(no_docs, Q.train(no_docs, table(spark, "labels"))).collect() == []


def test_trusted_documents_stay(spark):
    got = Q.op8_quality_rules(spark, SF).join(table(spark, "labels", SF), "doc_id").where("NOT base_failed")
    by = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert by[1] > 0.99


def test_every_ngram_has_its_own_count(spark, monkeypatch):
    """Poor texts of words they share with nobody trusted are rejected however many distinct n-grams there are."""
    monkeypatch.setattr(Q, "COMMON", 1 << 10, raising=False)  # so that both ways of looking up a ratio are taken
    good = [(i, " ".join(f"g{(i * 7 + j) % 500}" for j in range(40))) for i in range(800)]
    poor = [(1000 + i, " ".join(f"p{(i * 11 + j * j) % 900}" for j in range(40))) for i in range(800)]
    fill = [(10_000 + i, " ".join(f"u{i}x{j}" for j in range(100))) for i in range(6000)]  # 1.2 million n-grams
    docs = spark.createDataFrame(good + poor + fill, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in Q.measure(docs, Q.train(docs, labels)).where("doc_id < 10000").collect()}
    assert all(r.kept for d, r in rows.items() if d < 1000)
    seen = Counter(g for _, t in good + poor + fill for w in [t.split()] for g in [*w, *zip(w, w[1:])])
    trusted = Counter(g for d, t in good if Q.zlib.crc32(str(d).encode()) % 4 != 3 for w in [t.split()] for g in [*w, *zip(w, w[1:])])
    share = sum(trusted.values()) / sum(seen.values())
    for d, t in good[:20] + poor[:20]:
        w = t.split()
        grams = [*w, *zip(w, w[1:])]
        assert abs(rows[d].score - np.mean([np.log((trusted[g] + 5) / (seen[g] * share + 5)) for g in grams])) < 1e-9


def test_poor_documents_are_rejected(spark):
    """Quality-0 documents that pass the base rule, over the largest table of the tests."""
    sf = "/root/testdata/sf0.1"
    got = Q.op8_quality_rules(spark, sf).join(table(spark, "labels", sf), "doc_id").where("NOT base_failed")
    by = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert by[0] < 0.04 and by[1] > 0.99


def test_every_trusted_document_teaches(spark):
    """More trusted documents than were once taken (100 000): all count, in the ratios and for the threshold."""
    n = 100_400
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")).unionByName(
        spark.range(n, n + 1).select(F.col("id").alias("doc_id"), F.lit("b").alias("text")))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    fold = {r.f: r.n for r in docs.where(F.col("doc_id") < n).groupBy((Q.fold(F.col("doc_id")) == 3).alias("f")).agg(F.count("*").alias("n")).collect()}
    model = Q.train(docs, labels, evidence=1.0)
    got = {r.text: r.score for r in docs.where(F.col("doc_id") >= n - 1).select("doc_id", "text").join(
        Q.measure(docs.where(F.col("doc_id") >= n - 1), model).select("doc_id", "score"), "doc_id").collect()}
    seen = fold[False]
    assert abs(got["b"] - np.log(1 / (seen / (n + 1) + 1))) < 1e-9
    assert abs(got["a"] - np.log((seen + 1) / (n * seen / (n + 1) + 1))) < 1e-9


def test_corpus_scored_by_its_own_counts(spark, edge_docs, no_docs, tmp_path, monkeypatch):
    """The query's packed passes give the scores that the table of all n-grams gives, and move fewer bytes than the n-grams' rows."""
    rng = np.random.default_rng(4)
    rows = [(i if i % 9 else None, " ".join(f"w{k}" for k in (rng.zipf(1.3, 60) % 5000)), "en", "s", 1) for i in range(1, 700)]
    docs = edge_docs.unionByName(spark.createDataFrame(rows + rows[:40], edge_docs.schema)).repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 700)] + [(None, 1)], "doc_id long, quality int")
    trusted = Q._trusted(labels)
    model = Q._ratios(docs, trusted, 5.0)

    def plain(df):
        return sorted(((r.doc_id is None, r.doc_id or 0), tuple(r)[1:6], round(r.score, 9)) for r in df.collect())

    want = plain(Q._scored(docs, model))
    for name, value in (("PASSES", Q.PASSES), ("PASSES", 3), ("RANGE_GRAMS", 500), ("PIECE_DOCS", 7)):
        monkeypatch.setattr(Q, name, value)
        assert plain(Q._own_scores(docs, trusted, 5.0)) == want
    assert plain(Q._own_scores(docs, Q._trusted(labels.limit(0)), 5.0)) == plain(Q._scored(docs, Q._ratios(docs, Q._trusted(labels.limit(0)), 5.0)))
    assert Q._own_scores(no_docs, trusted, 5.0).collect() == []


def test_packed_numbers_come_back(spark):
    rng = np.random.default_rng(1)
    for kind in ("<u4", "<u8"):
        for n in (0, 1, 1000):
            v = rng.integers(0, 1 << 31, n).astype(kind)
            assert (Q._unpack(Q._pack(v), n, kind) == v).all()
    gram = np.sort(rng.integers(0, 1 << 63, 100_000).astype(np.uint64))
    assert len(Q._pack(np.diff(gram, prepend=np.uint64(0)))) < 7 * len(gram)
