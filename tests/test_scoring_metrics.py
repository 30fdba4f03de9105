"""Reward, correctness and calibration metrics."""

import random

from pyspark.sql import functions as F

from veracity.functions import scoring as S
from veracity.operators import metrics as MET


def test_reward_golden(spark):
    pairs = [(10, 10, 1.0), (0, 10, -1.0), (0, 0, 1.0), (10, 0, -1.0), (5, 5, 1.0), (10, 8, 0.92),
             (10, 85, -0.62), (0, 85, 0.98)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b, _ in pairs], "corr double, conf double")
    got = [round(r[0], 6) for r in df.select(S.reward("corr", "conf")).collect()]
    assert got == [p[2] for p in pairs]


def test_reward_range(spark):
    rnd = random.Random(1)
    rows = [(rnd.uniform(-20, 120), rnd.uniform(-20, 120)) for _ in range(500)]
    df = spark.createDataFrame(rows, "corr double, conf double")
    vals = [r[0] for r in df.select(S.reward("corr", "conf")).collect()]
    assert all(-1.0 - 1e-12 <= v <= 1.0 + 1e-12 for v in vals)


def test_substring_correctness(spark):
    df = spark.createDataFrame([("The answer is PARIS.", " paris "), ("London", "Paris"), ("any", "")], "a string, g string")
    assert [r[0] for r in df.select(S.substring_correctness("a", "g")).collect()] == [10.0, 0.0, 10.0]


def test_batch_placeholder(spark):
    df = spark.createDataFrame([(0, 8.0, 10.0), (0, 6.0, 0.0), (1, 4.0, 0.0), (1, 2.0, 0.0)],
                               "batch_id long, confidence double, correctness double")
    b = {r.batch_id: r for r in MET.batch_metrics(df).collect()}
    assert round(b[0].conf_pos, 6) == 0.8 and b[1].conf_pos == 0.0
    c = {r.batch_id: r for r in MET.cumulative_metrics(df).collect()}
    assert round(c[1].cumulative_conf_pos, 6) == 0.4
    c2 = {r.batch_id: r for r in MET.cumulative_metrics(df, placeholder=False).collect()}
    assert round(c2[1].cumulative_conf_pos, 6) == 0.8


def _pair_auroc(conf, target):
    pos = [c for c, t in zip(conf, target) if t]
    neg = [c for c, t in zip(conf, target) if not t]
    if not pos or not neg:
        return 0.0
    s = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return s / (len(pos) * len(neg))


def test_auroc_matches_pair_counting(spark):
    rnd = random.Random(5)
    rows = [(i // 8, float(rnd.randint(0, 10)), float(rnd.choice([0, 2, 5, 7, 10]))) for i in range(240)]
    df = spark.createDataFrame(rows, "batch_id long, confidence double, correctness double")
    got = MET.auroc(df).collect()[0].auroc
    assert abs(got - _pair_auroc([r[1] for r in rows], [r[2] >= 7 for r in rows])) < 1e-12
    cum = {r.batch_id: r.cumulative_auroc for r in MET.cumulative_auroc(df).collect()}
    for b in range(30):
        sub = [r for r in rows if r[0] <= b]
        assert abs(cum[b] - _pair_auroc([r[1] for r in sub], [r[2] >= 7 for r in sub])) < 1e-12


def test_batches_reaggregate_to_overall(spark):
    rnd = random.Random(9)
    rows = [(i // 8, float(rnd.randint(0, 10)), float(rnd.randint(0, 10))) for i in range(200)]
    df = spark.createDataFrame(rows, "batch_id long, confidence double, correctness double")
    last = MET.cumulative_metrics(df, placeholder=False).orderBy(F.desc("batch_id")).first()
    overall = MET.calibration_report(df).first()
    assert abs(last.cumulative_ece - overall.ece) < 1e-12
    assert abs(last.cumulative_accuracy - overall.accuracy) < 1e-12
    assert abs(last.cumulative_conf_pos - overall.conf_pos) < 1e-12


def test_r6_rounds_huge_values(spark):
    from veracity.plans.catalog import r6
    df = spark.createDataFrame([(33001176376178.152,), (1.23456789,), (-2.5e-7,)], "x double")
    got = [r[0] for r in df.select(r6("x")).collect()]
    assert got[0] == 33001176376200.0  # 12 significant digits above 4e9 (no long overflow)
    assert got[1:] == [1.234568, 0.0]


def test_cumulative_auroc_counts_pairs(spark, monkeypatch):
    """Hundreds of distinct confidences, groups, nulls and ties, with and without split windows."""
    import random
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i // 5, None if rng.random() < .05 else float(round(rng.choice([rng.random() * 9, rng.randint(0, 400)]), 2)), float(rng.randint(0, 10)))
            for i in range(600)]
    df = spark.createDataFrame(rows, "g string, batch_id long, confidence double, correctness double")
    want = {}
    for g in "ab":
        own = [r for r in rows if r[0] == g]
        for b in {r[1] for r in own}:
            seen = [r for r in own if r[1] <= b and r[2] is not None]
            pos, neg = [r[2] for r in seen if r[3] >= 7], [r[2] for r in seen if r[3] < 7]
            u = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
            want[g, b] = (u / (len(pos) * len(neg)) if pos and neg else 0.0, sum(r[2] is None for r in own if r[1] <= b))
    for small in (12, 2):
        monkeypatch.setattr(MET, "SMALL_LEVELS", small)
        got = {(r.g, r.batch_id): (r.cumulative_auroc, r.n_null) for r in MET.cumulative_auroc(df, ["g"], count_null=True).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)


def test_confidence_without_value(spark):
    df = spark.createDataFrame([(0, 5.0, 10.0), (0, None, 0.0)], "batch_id long, confidence double, correctness double")
    r = MET.batch_metrics(df).first()
    assert (r.n, r.ece, r.conf_pos, r.conf_neg) == (2, 0.5, 0.5, 0.0)
    r = MET.calibration_report(df).first()
    assert (r.n, r.ece, r.auroc) == (2, 0.5, 0.0)
