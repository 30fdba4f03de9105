"""Row index, splits, leader clustering against a plain loop, training rows."""

import math
import random

from pyspark.sql import functions as F

from conftest import SF_MID
from veracity.operators import cluster as CL
from veracity.operators import rows as R
from veracity.operators import training as T


def test_row_index_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("k"))
    got = R.with_row_index(df, "k", partitions=7).select("k", "row_idx").collect()
    by_key = sorted(got, key=lambda r: r.k)
    assert [r.row_idx for r in by_key] == list(range(5000))


def test_split_rows_ratio(spark):
    d = spark.range(0, 1000).withColumnRenamed("id", "doc_id")
    s = R.split_rows(d, "doc_id", 0.0005, seed=42)
    assert s.filter(F.col("split") == "test").count() == math.ceil(0.0005 * 1000)


def _seeded(keys, seed):
    import hashlib
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k))


def test_split_is_the_head_of_the_seeded_order(spark, monkeypatch):
    keys = [k * 37 % 9001 for k in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for digits, ratio in ((4, 0.01), (1, 0.37), (1, 0.0), (2, 1.0)):
        monkeypatch.setattr(R, "CUT_DIGITS", digits)
        got = {r.k for r in R.split_rows(df, "k", ratio, seed=5).collect() if r.split == "test"}
        assert got == set(_seeded(keys, 5)[:math.ceil(ratio * len(keys))])


def test_split_of_empty_null_and_repeated_keys(spark):
    none = spark.createDataFrame([], "k long")
    assert R.split_rows(none, "k", 0.5).count() == 0
    df = spark.createDataFrame([(1,)] * 50 + [(k,) for k in range(2, 52)], "k long")
    sides = {}
    for r in R.split_rows(df, "k", 0.3).collect():
        sides.setdefault(r.k, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values())  # equal keys stay together


def test_split_writes_no_index_and_runs_no_job(spark):
    from veracity.session import _SCRATCH
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    before = len(_SCRATCH)
    plan = R.split_rows(df, "k", 0.1)._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
    assert len(_SCRATCH) == before and "Join" not in plan.split("scalar-subquery")[0]


def test_capped_train_and_test(spark):
    keys = list(range(2000))
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long")
    out = R.capped_train_and_test(df, "k", 0.1, seed=7, cap=800, start=100, n=900)
    test = set(_seeded(keys, 7)[:200])
    train = [k for k in keys if k not in test][:800]
    assert sorted(r.k for r in out.collect() if r.split == "train") == train[100:800]
    assert sorted(r.k for r in out.collect() if r.split == "test") == sorted(test)[:8]
    few = R.capped_train_and_test(df.limit(300), "k", 0.1, seed=7, cap=800, start=0, n=10)
    assert sum(r.split == "test" for r in few.collect()) == 270 // 100


def test_running_sums_small_blocks(spark):
    df = spark.range(0, 300).select(F.col("id").alias("b"), (F.col("id") % 5).alias("v"), (F.col("id") % 2).alias("g"))
    out = R.running_sums(df, "b", ["v"], partition_cols=["g"], widths=(16, 64)).collect()
    exp = {}
    for g in (0, 1):
        acc = 0
        for b in range(300):
            if b % 2 == g:
                acc += b % 5
                exp[b] = acc
    assert {r.b: r.cum_v for r in out} == exp


def _leader_loop(vectors, t):
    def cos(a, b):
        na = math.sqrt(sum(x * x for x in a))
        nb = math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / (na * nb)
    remaining = list(range(len(vectors)))
    out = []
    while remaining:
        lead = remaining[0]
        sim = [k for k in remaining if cos(vectors[lead], vectors[k]) > t]
        if len(sim) == 1:
            remaining = remaining[1:]
            continue
        out.append((lead, len(sim)))
        remaining = [k for k in remaining if k not in sim]
    return out


def test_leader_clusters_match_loop(spark):
    rnd = random.Random(11)
    rows = []
    for q in range(6):
        base = [rnd.gauss(0, 1) for _ in range(8)]
        for i in range(40 if q else 300):  # question 0 spans several chunks
            v = [b + rnd.gauss(0, 1.2) for b in base]
            rows.append((q, i, v))
    df = spark.createDataFrame(rows, "question_id long, sample_idx int, embedding array<double>")
    got = CL.leader_clusters(df, 0.6).collect()
    for q in range(6):
        vecs = [r[2] for r in rows if r[0] == q]
        exp = _leader_loop(vecs, 0.6)
        mine = sorted((r.cluster_pos, r.leader_idx, r.size) for r in got if r.question_id == q)
        assert [(l, s) for _, l, s in mine] == exp


def _greedy(n, edges):
    """Leaders and sizes from an edge list, by the sequential rule."""
    near = {}
    for i, j in edges:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    left, out = set(range(n)), []
    for i in range(n):
        if i in left:
            got = (near.get(i, set()) & left) | {i}
            left -= got if len(got) > 1 else {i}
            if len(got) > 1:
                out.append((i, len(got)))
    return out


def test_rounds_equal_the_sequential_rule(spark):
    rnd = random.Random(4)
    rows, expected = [], {}
    for q in range(12):
        n = rnd.choice([5, 30, 200])
        if q == 0:
            edges = [(i, i + 1) for i in range(12)]  # a chain in sample order
        elif q == 1:
            edges = [(0, j) for j in range(1, 150)] + [(j, j + 1) for j in range(1, 150, 2)]  # one hub
        else:
            edges = list({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(rnd.randrange(1, 4 * n))})
        expected[q] = _greedy(max(n, 200), edges)
        rows += [(q, i, j) for i, j in edges]
    pairs = spark.createDataFrame(rows, "question_id long, i int, j int")
    for limit in (0, 10 ** 6):
        got = {}
        for r in CL.leaders_of_pairs(pairs, fold_pairs=limit).collect():
            got.setdefault(r.question_id, []).append((r.leader_idx, r.size))
        assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in expected.items() if v}


def test_large_question_in_rounds(spark):
    """One question of 100 000 samples with neighbours anywhere, decided without a row that holds it."""
    n = 100_000
    rnd = random.Random(6)
    edges = list({(i, rnd.randrange(i + 1, n)) for i in range(n - 1) for _ in range(2)})
    import pandas as pd
    pairs = spark.createDataFrame(pd.DataFrame(edges, columns=["i", "j"])).select(
        F.lit(0).cast("long").alias("question_id"), F.col("i").cast("int"), F.col("j").cast("int"))
    got = sorted((r.leader_idx, r.size) for r in CL.leaders_of_pairs(pairs).collect())
    assert got == _greedy(n, edges)


def test_checked_clusters_give_back_vectors_without_direction(spark):
    rows = [(0, 0, [0.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [1.0, 0.1]), (0, 3, None), (1, 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "question_id long, sample_idx int, embedding array<double>")
    good, bad = CL.checked_clusters(df, 0.9)
    assert [(r.question_id, r.leader_idx, r.size) for r in good.collect()] == [(0, 1, 2)]
    assert sorted((r.question_id, r.sample_idx) for r in bad.collect()) == [(0, 0), (0, 3), (1, 0)]


def test_similar_pairs_chunking(spark):
    rnd = random.Random(2)
    rows = [(0, i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "question_id long, sample_idx int, embedding array<double>")
    a = {(r.i, r.j) for r in CL.similar_pairs(df, 0.5, chunk=7).collect()}
    b = {(r.i, r.j) for r in CL.similar_pairs(df, 0.5, chunk=1000).collect()}
    assert a == b and len(a) > 0


def test_similar_pairs_of_blocks_lose_nothing(spark):
    """Dense directions, equal vectors, opposite ones, several questions: pairs equal to the double loop, few compared."""
    import numpy as np
    rng = np.random.default_rng(5)
    rows = []
    for q, n in ((0, 900), (1, 400), (2, 30)):
        centres = rng.normal(size=(12, 6))
        for i in range(n):
            v = centres[i % 12] + rng.normal(size=6) * 0.08
            if i % 50 == 7:
                v = centres[0]
            if i % 61 == 3:
                v = -centres[1]
            rows.append((q, i, [float(x) for x in v]))
    rows += [(0, 900, [0.0] * 6), (0, 901, None), (1, 400, [float("nan")] * 6), (1, 401, [1e200] * 6), (3, 0, None)]
    df = spark.createDataFrame(rows, "question_id long, sample_idx int, embedding array<double>")
    want = set()
    for q in (0, 1, 2):
        own = [(i, np.array(v)) for k, i, v in rows if k == q and v is not None and 0 < np.sqrt((np.array(v) ** 2).sum()) < np.inf]
        unit = np.array([v / np.linalg.norm(v) for _, v in own])
        hit = np.argwhere(np.triu(unit @ unit.T > 0.97, 1))
        want |= {(q, own[a][0], own[b][0]) for a, b in hit}
    got = CL.similar_pairs(df, 0.97, chunk=32, pivots=16).select("question_id", "i", "j").collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == want and len(want) > 1000
    seen = {r.question_id: r for r in CL.compared_pairs(df, 0.97, chunk=32, pivots=16).collect()}
    assert seen[0].n_samples == 900 and seen[0].n_pairs == 900 * 899 // 2
    assert sum(1 for q, _, _ in want if q == 0) <= seen[0].n_compared < seen[0].n_pairs / 3
    assert seen[2].n_compared == seen[2].n_pairs == 30 * 29 // 2


def test_similar_pairs_without_rows_and_at_extreme_thresholds(spark):
    schema = "question_id long, sample_idx int, embedding array<double>"
    assert CL.similar_pairs(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(0, i, [1.0, float(i % 3)]) for i in range(20)], schema)
    for t in (-1.5, -1.0, 0.5, 0.999999):
        assert CL.similar_pairs(df, t, chunk=4, pivots=4).count() == CL.similar_pairs(df, t, chunk=100).count()


def test_zero_vector_quarantined(spark):
    df = spark.createDataFrame([(0, 0, [0.0, 0.0]), (0, 1, [1.0, 0.0])],
                               "question_id long, sample_idx int, embedding array<double>")
    good, bad = CL.quarantine_zero(df)
    assert good.count() == 1 and bad.count() == 1


def test_loss_mask_and_padding(spark):
    msgs = [[(0, "user", " hi there "), (1, "assistant", "yes sir")],
            [(0, "system", "be brief"), (1, "user", "q"), (2, "assistant", "a b c d e")]]
    df = spark.createDataFrame([(i, [{"turn": t, "role": r, "content": c} for t, r, c in m]) for i, m in enumerate(msgs)],
                               "conv_id long, messages array<struct<turn:int,role:string,content:string>>")
    rows = T.sft_rows(df, "chat", max_len=512, keep=("conv_id",))
    got = {r.conv_id: r for r in rows.collect()}
    assert got[0].tokens == ["[INST]", "hi", "there[/INST]", "yes", "sir</s>"]
    assert got[0].labels[:3] == [-100, -100, -100] and got[0].labels[3] != -100
    b = rows.withColumn("batch_id", F.lit(0))
    padded = {r.conv_id: r for r in T.pad_batches(b).collect()}
    n = max(len(r.tokens) for r in got.values())
    assert all(len(r.input_ids) == n for r in padded.values())
    assert padded[0].attention_mask == [1] * 5 + [0] * (n - 5)
    assert padded[0].labels[5:] == [-100] * (n - 5)
    un = {r.conv_id: r for r in T.unpad(T.pad_batches(b)).collect()}
    assert un[0].input_ids == got[0].input_ids


def test_padded_batches_write_keys_and_lengths_only(spark):
    from veracity.session import _SCRATCH
    rows = [(k, [1] * (k % 7 + 1)) for k in range(40)] + [(None, [1, 1])]
    df = spark.createDataFrame(rows, "k long, input_ids array<long>").withColumns(
        {"labels": F.col("input_ids"), "attention_mask": F.transform("input_ids", lambda x: F.lit(1))})
    before = len(_SCRATCH)
    got = {r.k: r for r in T.padded_batches(df, "k", size=8).collect()}
    for p in _SCRATCH[before:]:
        assert set(spark.read.parquet(p).columns) <= {"k", "_len", "_mid"}
    order = [None, *range(40)]  # null first, as Spark sorts
    size = {k: len(v) for k, v in rows}
    for i, k in enumerate(order):
        longest = max(size[x] for x in order[i // 8 * 8:i // 8 * 8 + 8])
        assert (got[k].batch_id, len(got[k].input_ids), sum(got[k].attention_mask)) == (i // 8, longest, size[k])
        assert got[k].labels[size[k]:] == [-100] * (longest - size[k])


def test_row_index_of_keys_only(spark):
    from veracity.session import _SCRATCH
    df = spark.createDataFrame([(i % 5, i // 5, "t" * i) for i in range(60)] + [(None, 1, "n")], "a int, b int, text string")
    before = len(_SCRATCH)
    slim = R.with_row_index(df, ["a", "b"], keys_only=True)
    assert slim.columns == R.with_row_index(df, ["a", "b"]).columns
    assert set(spark.read.parquet(_SCRATCH[before]).columns) == {"a", "b", "_mid"}
    rows = sorted(slim.collect(), key=lambda r: r.row_idx)
    assert [r.row_idx for r in rows] == list(range(61)) and rows[0].text == "n"
    assert [(r.a, r.b) for r in rows[1:]] == sorted((i % 5, i // 5) for i in range(60))


def test_response_mask(spark):
    df = spark.createDataFrame([(["a", "Confidence:", "7"],), (["a", "b"],), (["Confidence:"],)], "tokens array<string>")
    got = [r.response_mask for r in T.response_mask(df).collect()]
    assert got == [[0, 0, 1], [1, 1], [1]]


def _mask_loop(tokens, joiner=" ", marker="Confidence:"):
    """First position whose decoded prefix holds the marker, by trying every prefix."""
    for n in range(1, len(tokens) + 1):
        if marker in joiner.join(tokens[:n]):
            return (None if n == len(tokens) else n), n == len(tokens), [0] * (n if n < len(tokens) else 0) + [1] * (len(tokens) - n if n < len(tokens) else len(tokens))
    return None, True, [1] * len(tokens)


def test_response_mask_equals_the_prefix_loop(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        words = [rnd.choice(["a", "Conf", "idence:", "Confidence:", "x:", "Confidence", ":"]) for _ in range(rnd.randrange(0, 12))]
        rows.append((i, words))
    for joiner in (" ", ""):
        df = spark.createDataFrame(rows, "i int, tokens array<string>")
        got = {r.i: (r.first_idx, r.nonsense, r.response_mask) for r in T.response_mask(df, joiner=joiner).collect()}
        assert got == {i: _mask_loop(w, joiner) for i, w in rows}


def test_response_mask_joins_tokens_once(spark):
    df = spark.createDataFrame([(["a", "Confidence:", "7"],)], "tokens array<string>")
    d = T.response_mask(df.withColumn("input_ids", F.transform("tokens", lambda w: F.xxhash64(w))))
    for out in (d, T.length_report(d), T.check_lengths(d)[0]):
        plan = out._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
        assert plan.count("array_join") == 1


def test_length_report_and_quarantine(spark):
    df = spark.createDataFrame([([1], [1]), ([1, 2], [1]), (None, [1]), ([], [])], "input_ids array<int>, response_mask array<int>")
    good, bad = T.check_lengths(df)
    assert (good.count(), bad.count()) == (2, 2)
    assert {r.status: r.n_rows for r in T.length_report(df).collect()} == {"equal": 2, "different": 2}


def test_cluster_counts_on_embeddings(spark):
    from veracity.plans import derived as D
    n = CL.leader_clusters(D.samples(spark, SF_MID), 0.25).count()
    assert n == 119


def test_release_scratch(spark):
    import os
    from veracity.session import _SCRATCH, release_scratch
    df = spark.range(0, 100).withColumnRenamed("id", "k")
    R.with_row_index(df, "k").count()
    paths = [p for p in _SCRATCH]
    assert paths and all(os.path.exists(p) for p in paths)
    assert release_scratch(spark) >= 1
    assert not any(os.path.exists(p) for p in paths)
