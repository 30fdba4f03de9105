import corpus_pipeline as C
from pyspark.sql import functions as F

from veracity.llm import common, minhash, packing, recompress
from veracity.llm.common import components, documents, stored

from .conftest import SF, SF_TINY, words


def test_stages_feed_each_other(spark):
    docs = documents(spark, SF_TINY)
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in C.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SF_TINY), "stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
        if stage is minhash.near_duplicate_stage:
            kept = {r.doc_id for r in minhash.near_groups(before, (80, 100), 27).where("kept").collect()}
            assert kept == {r.doc_id for r in docs.select("doc_id").collect()}
        if stage is recompress.substring_stage:
            want = {r.doc_id: r.kept for r in recompress.remove_repeats(before).where("n_removed > 0").collect()}
            assert all(r.text == want.get(r.doc_id, r.text) for r in docs.collect())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0]
    out = C.run(spark, SF_TINY).toPandas()
    assert out.groupby("doc_id").length.sum().to_dict() == {r.doc_id: len(words(r.text)) for r in docs.collect()}
    assert C.STAGES[-1][1] is packing.packing_stage and 4 <= len(C.STAGES) <= 5


def test_registered(spark):
    import __spark_entry__ as E
    names = E.queries()
    assert "pipeline" in names and [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == []
    assert set(E.oracle_sql()) <= set(names) and SF


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 90)]
    edges = spark.createDataFrame([*chain, *star, *star, (5000, 5000), (7, 3)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(90)}
    assert components(edges.limit(0)).collect() == []


def test_components_of_stars_need_no_round(spark, monkeypatch):
    """Every round costs the driver plans and tasks: edges that are stars take none, and what is returned is read, not made again."""
    written = []
    monkeypatch.setattr(common, "stored", lambda df, name: written.append(name) or stored(df, name))
    star = spark.createDataFrame([(10, 10 + i) for i in range(1, 20)] + [(12, 10), (40, 41)], "a long, b long")
    got = components(star)
    assert written == ["edges", "roots"] and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.node: r.root for r in got.collect()} == {10 + i: 10 for i in range(20)} | {40: 40, 41: 40}
    written.clear()
    two = spark.createDataFrame([(1, 3), (2, 3), (2, 4)], "a long, b long")  # 3 has two centres
    assert {r.node: r.root for r in components(two).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert written.count("edges") > 1


def test_stages_leave_columns_of_any_name_alone(spark):
    """The tables' own columns may be named like anything that a stage computes."""
    docs = documents(spark, SF_TINY)
    clash = ["kept", "n_words", "n_removed", "_text", "__at", "__doc", "__version", "toxic_whole", "score", "_toxic",
             "lang_pred", "_lang", "_posterior", "__row", "row", "component_id"]
    wide = docs.select("*", *[(F.col("doc_id") * 7 + k).alias(c) for k, c in enumerate(clash)]).select(*reversed([*docs.columns, *clash]))
    for name, stage in C.STAGES[:-1]:
        out = stored(stage(spark, wide, SF_TINY), "stage")
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[c] == r.doc_id * 7 + k for r in rows for k, c in enumerate(clash)), name
        assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, docs, SF_TINY).select("doc_id").collect()}, name


def test_stages_of_empty_tables_and_odd_rows(spark, edge_docs, no_docs):
    for name, stage in C.STAGES:
        out = stage(spark, no_docs, SF_TINY)
        assert out.count() == 0, name
        got = stage(spark, edge_docs, SF_TINY).collect()
        assert name == "packing" or {r.doc_id for r in got} <= {r.doc_id for r in edge_docs.collect()}, name
