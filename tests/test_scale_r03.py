"""Work and memory that grow no faster than the input (findings of round 3)."""

import random

from conftest import SF_SMALL
from veracity.operators import metrics as MET
from veracity.plans import derived as D
from veracity.plans.evaluation import EvaluationRun


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_metric_log_sends_no_table_of_batches_to_all_tasks(spark):
    run = EvaluationRun(D.eval_attempts(spark, SF_SMALL), D.judge_replies(spark, SF_SMALL), batch_size=8, max_tries=2,
                        datasets=D.eval_datasets(spark, SF_SMALL))
    joins = [line for line in _plan(run.metric_log("r")).split("\n") if "BroadcastHashJoin" in line]
    assert joins and not any("batch_id" in j or "qid" in j for j in joins)  # row offsets and one row a dataset alone


def test_low_levels_of_the_cumulative_area_are_one_pass(spark):
    """Blocks that one task can count are not written level by level; NaN is above all confidences."""
    from veracity.session import _SCRATCH
    rnd = random.Random(4)
    rows = [(i // 4, rnd.choice([0.0, 1.5, 3.0, 7.25, float("nan"), float("inf")]), float(rnd.randrange(11))) for i in range(400)]
    df = spark.createDataFrame(rows, "batch_id long, confidence double, correctness double")
    before = len(_SCRATCH)
    got = {r.batch_id: r.cumulative_auroc for r in MET.cumulative_auroc(df).collect()}
    assert not any("auroc-levels" in p for p in _SCRATCH[before:])

    def key(x):
        return (1, 0.0) if x != x else (0, x)

    for b in (0, 17, 99):
        pos = [key(c) for k, c, y in rows if k <= b and y >= 7]
        neg = [key(c) for k, c, y in rows if k <= b and y < 7]
        area = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else 0.0
        assert abs(got[b] - area) < 1e-12


def test_high_levels_of_the_cumulative_area(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [("ab"[i % 2], i // 6, rnd.choice([float("nan"), rnd.random() * 10, 5.0]), float(rnd.randrange(11))) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, batch_id long, confidence double, correctness double")
    want = {(r.g, r.batch_id): r.cumulative_auroc for r in MET.cumulative_auroc(df, ["g"]).collect()}
    monkeypatch.setattr(MET, "BLOCK_ROWS", 16)
    got = {(r.g, r.batch_id): r.cumulative_auroc for r in MET.cumulative_auroc(df, ["g"]).collect()}
    assert got == want and len(got) == 200


def _samples(spark, rows):
    return spark.createDataFrame(rows, "question_id long, sample_idx int, embedding array<double>")


def _rows(seed, sizes):
    rnd = random.Random(seed)
    rows = [(q, 3 * i, [rnd.gauss(0, 1) for _ in range(6)]) for q, n in enumerate(sizes) for i in range(n)]
    rows += [(0, 3 * i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(0, 60, 7)]  # indices that repeat, with other vectors
    rows += rows[:25] + [(0, 1, [0.0] * 6), (0, 2, None), (0, None, [1.0] * 6), (None, 4, [1.0] * 6), (0, 4, [1.0] * 5), (0, 5, [2.0] * 5)]
    return rows


def test_large_questions_are_led_without_their_pairs(spark):
    """The clusters equal those of the pairs, whatever the head; indices repeat, are null, vectors differ in length."""
    from veracity.operators import cluster as CL
    df = _samples(spark, _rows(8, (300, 90, 20)))
    for t, head in ((0.3, 8192), (0.8, 80)):
        want = sorted(map(tuple, CL.leaders_of_pairs(CL.similar_pairs(df, t)).select("question_id", "leader_idx", "size").collect()))
        got = CL.leader_clusters(df, t, chunk=32, head=head).select("question_id", "leader_idx", "size")
        assert sorted(map(tuple, got.collect())) == want


def test_cosines_at_the_threshold_are_those_of_the_pairs(spark):
    from veracity.operators import cluster as CL
    rows = [(0, i, [float(i % 3 + 1), float(i % 5), 1.0]) for i in range(60)]
    df = _samples(spark, rows)
    for c in sorted({r.cosine for r in CL.similar_pairs(df, -1.0).collect()})[5:40:30]:
        want = sorted(map(tuple, CL.leaders_of_pairs(CL.similar_pairs(df, c)).select("leader_idx", "size").collect()))
        assert sorted(map(tuple, CL.leader_clusters(df, c, chunk=8, head=40).select("leader_idx", "size").collect())) == want


def test_large_means_many_rows_not_large_indices(spark):
    """Questions of few rows anywhere in a table need no pivots, and no table of block pairs is broadcast."""
    from veracity.operators import cluster as CL
    from veracity.session import _SCRATCH
    rnd = random.Random(9)
    few = _samples(spark, [(i // 5, i * 100, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(100)])
    before = len(_SCRATCH)
    assert CL.similar_pairs(few, 0.5).count() > 0
    assert not any("pivot-angles" in p for p in _SCRATCH[before:])
    many = _samples(spark, [(0, i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(400)])
    joins = [line for line in _plan(CL.similar_pairs(many, 0.95)).split("\n") if "BroadcastHashJoin" in line]
    assert not any("lo#" in j or "_block" in j for j in joins)
