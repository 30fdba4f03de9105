"""Direct checks of small operators used inside larger jobs."""

from pyspark.sql import functions as F

from veracity.functions import parse as P
from veracity.functions import scoring as S
from veracity.operators import cluster as CL
from veracity.operators import rows as R


def test_in_range_and_test_cap(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([-1, 0, 5, 10, 11])], "row_idx long, v double")
    assert [r.v for r in R.in_range(df, "v").orderBy("row_idx").collect()] == [0.0, 5.0, 10.0]
    assert R.cap_test_split(df, n_train=250).count() == 2


def test_drop_na_reasons_and_min_clusters(spark):
    df = spark.createDataFrame([(1, ["N/A", "ok"], 1), (2, ["N/A"], 3)], "q long, reasons array<string>, n_clusters int")
    kept = R.drop_na_reasons(df).collect()
    assert [(r.q, r.reasons) for r in kept] == [(1, ["ok"])]
    assert [r.q for r in CL.min_clusters(df, 2).collect()] == [2]


def test_clean_reward(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (0.5,)], "r double")
    got = [r[0] for r in df.select(S.clean_reward("r")).collect()]
    assert got[0] == 0.0 and got[1] > 1e300 and got[2] < -1e300 and got[3] == 0.5


def test_two_line_judge(spark):
    df = spark.createDataFrame([("Explanation:  fine \nScore: 9",), ("Score: x",)], "reply string")
    rows = df.select(P.judge_explanation("reply").alias("e"), P.judge_labeled_score("reply").alias("s")).collect()
    assert [(r.e, r.s) for r in rows] == [("fine", 9), ("", None)]


def test_stage_counts(spark):
    a = spark.range(5)
    out = {r.stage: r.n_rows for r in R.stage_counts({"all": a, "even": a.filter(F.col("id") % 2 == 0)}).collect()}
    assert out == {"all": 5, "even": 3}


def test_loss_rollup_logs_complete_windows_only(spark):
    from veracity.operators import runlog as RL
    rows = [("r", s, k, 1.0) for s in range(1, 13) for k in range(2)] + [("s", s, k, 2.0) for s in range(1, 11) for k in range(2 if s < 10 else 1)]
    log = spark.createDataFrame(rows, "run_id string, step long, rank int, value double")
    assert [tuple(r) for r in RL.loss_rollup(log, 10).collect()] == [("r", 10, 1.0, 2, 20)]


def test_response_mask_finds_a_marker_spread_over_tokens(spark):
    from veracity.operators import training as TR
    rows = [(["Conf", "idence", ":", " 7"],), (["a", "Confidence:7"],), (["a", " Confidence:", " 7", " b"],), ([],), (["Confidence:"],)]
    got = TR.response_mask(spark.createDataFrame(rows, "tokens array<string>"), joiner="").collect()
    assert [(r.first_idx, r.nonsense, list(r.response_mask)) for r in got] == [
        (3, False, [0, 0, 0, 1]), (None, True, [1, 1]), (2, False, [0, 0, 1, 1]), (None, True, []), (None, True, [1])]


def test_nonsense_agrees_with_the_mask(spark):
    from pyspark.sql import functions as F

    from veracity.functions import parse as P
    from veracity.operators import training as TR
    texts = ["a Confidence: 7", "a Confidence:7", "a Confidence:", "Confidence: \t", "x", "", "Confidence:7 of 8", "Confidence : 7", "b Confidence:\n9"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = TR.response_mask(df.withColumn("tokens", TR.tokens("t"))).select("t", "nonsense", P.has_nonsense("t").alias("m4")).collect()
    assert all(r.nonsense == r.m4 for r in got)
    assert df.select(P.sure_confidence(F.lit(None).cast("string")).alias("c")).first().c is None


def test_tokenizer_fills_labels(spark):
    from veracity.operators import training as TR
    df = spark.createDataFrame([("p q", "r s t")], "prompt string, completion string")
    ids = lambda texts: [[ord(c) for c in t] for t in texts]
    r = TR.sft_rows(df, "prompt_completion", max_len=6, tokenizer=ids).first()
    assert len(r.input_ids) == 6 and list(r.labels)[:3] == [-100] * 3 and list(r.labels)[3:] == list(r.input_ids)[3:]
    e = TR.encode_prompts(df, "prompt", max_len=2, tokenizer=ids).first()
    assert (list(e.input_ids), list(e.attention_mask), e.n_cut) == ([112, 32], [1, 1], 1)


def test_unjudged_questions_stay(spark):
    from veracity.operators import responses as RESP
    parsed = spark.createDataFrame([(1, 5.0), (2, 5.0)], "qid long, confidence double")
    gold = spark.createDataFrame([(1, 10.0)], "qid long, correctness double")
    got = {r.qid: (r.correctness, r.judged) for r in RESP.score_responses(parsed, gold, unjudged="zero").collect()}
    assert got == {1: (10.0, True), 2: (0.0, False)}
