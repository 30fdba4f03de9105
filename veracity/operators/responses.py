"""Response parsing, attempt resolution, judge scores and scoring.

Per-question reductions (attempts, judge tries) are ``groupBy(qid)`` with
``min_by``/``max_by``, which Spark pre-aggregates map-side; each question has
a handful of attempts, so no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.functions import parse as P
from veracity.functions import scoring as S


def parse_responses(df: DataFrame, mode: str = "main", response: str = "response") -> DataFrame:
    """Add ``answer``, ``reflection``, ``confidence`` and ``parse_status``."""
    r = F.col(response)
    if mode == "main":
        # Reflection, tail and digit runs are computed once as columns; the
        # confidence and the status are then built from them.
        d = df.withColumns({"reflection": P.main_reflection(r), "_tail": P.main_tail(r)})
        d = d.withColumn("_runs", F.regexp_extract_all(F.col("_tail"), F.lit("([0-9]+)"), 1))
        return d.withColumns({
            "answer": r,
            "confidence": P.confidence_from_parts(r, F.col("reflection"), F.col("_tail"), F.col("_runs")),
            "parse_status": P.status_from_parts(r, F.col("reflection"), F.col("_tail"), F.col("_runs")),
        }).drop("_tail", "_runs")
    if mode == "rtuning":
        return df.withColumns({
            "answer": r,
            "reflection": F.lit(""),
            "confidence": P.sure_confidence(r),
            "parse_status": F.when(r.isNull(), F.lit("no_text")).when(r.contains("unsure"), F.lit("unsure"))
                             .otherwise(F.lit("sure")),
        })
    if mode == "legacy":
        return df.withColumns({
            "answer": P.legacy_answer(r),
            "reflection": F.lit(""),
            "confidence": P.legacy_confidence(r),
            "parse_status": F.when(P.rfind(r, "I am") < 0, F.lit("no_hedge")).otherwise(F.lit("ok")),
        })
    raise ValueError(f"unknown parse mode {mode!r}")


def parse_report(parsed: DataFrame, group_cols=()) -> DataFrame:
    """Rows per parse status (the reference only logs these as warnings)."""
    return parsed.groupBy(*group_cols, "parse_status").agg(F.count(F.lit(1)).alias("n_rows"))


def split_samples(df: DataFrame, text: str = "text") -> DataFrame:
    """Split a sampled text into its reasoning chain and its reflection."""
    return df.withColumns({"chain": P.sample_chain(text), "reflection": P.sample_reflection(text)})


def clean_responses(df: DataFrame, response: str = "response", rtuning: bool = False,
                    literal: str | None = None) -> DataFrame:
    """R5 + R6: strip padding, keep text from the first ``[/INST]``, cut at the stop marker (or ``literal``)."""
    return df.withColumns({
        "cleaned": P.clean_response(response),
        "truncated": P.truncate_at_marker(response, rtuning, literal),
    }).withColumn("was_truncated", F.col("truncated") != F.col(response))


def flag_valid(df: DataFrame, mode: str = "main", response: str = "response") -> DataFrame:
    """``valid`` = non-empty and carrying the mode's confidence marker."""
    return df.withColumn("valid", P.is_valid(response, mode))


def resolve_attempts(attempts: DataFrame, max_tries: int = 3, mode: str = "main",
                     key: str = "qid", style: str = "eval") -> DataFrame:
    """One response per question out of its recorded attempts.

    Attempt 0 is the first answer, 1..max_tries the retries, max_tries+1 the
    forced-suffix attempt.  The first attempt valid in ``mode`` wins; if none,
    the last retry is kept when it holds any marker; otherwise the forced
    attempt is kept whatever it holds.  ``style="ppo"`` knows one marker only,
    ``Confidence:``, so a last retry with any other goes to the forced attempt.
    """
    if style not in ("eval", "ppo"):
        raise ValueError(f"unknown style {style!r}")
    a = attempts.withColumns({
        "_valid": P.is_valid("response", "main" if style == "ppo" else mode),
        "_any": P.is_valid("response", "main" if style == "ppo" else "any"),
    })
    fv_key = F.when(F.col("_valid") & (F.col("attempt") <= max_tries), F.col("attempt"))
    lr_key = F.when((F.col("attempt") == max_tries) & F.col("_any"), F.col("attempt"))
    g = a.groupBy(key).agg(
        F.min(fv_key).alias("_fv"), F.min(lr_key).alias("_lr"), F.max("attempt").alias("_last"),
        F.min_by("response", fv_key).alias("_rfv"), F.min_by("response", lr_key).alias("_rlr"),
        F.max_by("response", "attempt").alias("_rlast"),
        F.count(F.lit(1)).alias("n_attempts"),
    )
    # One pass: min_by/max_by ignore rows whose ordering value is null.
    return g.select(
        key,
        F.coalesce("_fv", "_lr", "_last").alias("attempt"),
        F.when(F.col("_fv").isNotNull(), F.col("_rfv"))
         .when(F.col("_lr").isNotNull(), F.col("_rlr"))
         .otherwise(F.col("_rlast")).alias("response"),
        "n_attempts",
        F.col("_fv").isNotNull().alias("resolved"))


def judge_scores(replies: DataFrame, max_tries: int = 3, key: str = "qid",
                 lo: int = 0, hi: int = 10) -> DataFrame:
    """First in-range judge score among the first ``max_tries`` replies, else 0."""
    r = replies.withColumn("_v", P.judge_value("reply"))
    ok = F.col("_v").between(lo, hi) & (F.col("attempt") < max_tries)
    g = r.groupBy(key).agg(
        F.min_by("_v", F.when(ok, F.col("attempt"))).alias("_score"),
        F.count(F.when(F.col("_v").isNull() & (F.col("attempt") < max_tries), 1)).alias("n_failed"),
        F.count(F.when(~F.col("_v").between(lo, hi) & (F.col("attempt") < max_tries), 1)).alias("n_out_of_range"),
    )
    return g.select(key, F.coalesce("_score", F.lit(0)).cast("bigint").alias("score"),
                    F.col("_score").isNotNull().alias("accepted"), "n_failed", "n_out_of_range")


def score_responses(parsed: DataFrame, gold: DataFrame, key: str = "qid",
                    correctness: str = "correctness", variant: str = "quadratic",
                    unjudged: str = "drop") -> DataFrame:
    """Attach gold correctness by key and compute the reward.

    A question without a score is outside the scored set (``drop``) or, as
    when its judge failed, kept with correctness 0 and ``judged`` false (``zero``).
    """
    if unjudged == "zero":
        s = parsed.join(gold.withColumn("judged", F.lit(True)), key, "left").withColumns({
            correctness: F.coalesce(F.col(correctness), F.lit(0.0)), "judged": F.coalesce("judged", F.lit(False))})
    elif unjudged == "drop":
        s = parsed.join(gold, key)
    else:
        raise ValueError(f"unknown rule {unjudged!r} for unjudged questions")
    return s.withColumns({
        "reward": S.reward(correctness, "confidence", variant),
        "reward_out_of_range": S.out_of_range(correctness, "confidence"),
    })


def substring_scores(parsed: DataFrame, gold: DataFrame, key: str = "qid",
                     answer: str = "answer", gold_text: str = "gold_text") -> DataFrame:
    """M1: correctness 10/0 from gold-text containment, joined on the key."""
    s = parsed.join(gold.select(key, gold_text), key)
    return s.withColumn("correctness", S.substring_correctness(answer, gold_text))


def penalise_nonsense(scored: DataFrame, response: str = "response") -> DataFrame:
    """M4/M5: reward -1 when no token follows ``Confidence:``; NaN/inf cleaned."""
    bad = P.has_nonsense(response)
    return scored.withColumns({
        "nonsense": bad,
        "reward": S.clean_reward(F.when(bad, F.lit(-1.0)).otherwise(F.col("reward"))),
    })


def output_records(scored: DataFrame, questions: DataFrame, key: str = "qid") -> DataFrame:
    """Result records (question, gold, response, correctness) joined on the key."""
    return questions.join(scored.select(key, "response", "correctness"), key)


def judge_two_line(replies: DataFrame, key: str = "qid") -> DataFrame:
    """R11 (re-aimed): explanation and score of ``Explanation: ...`` / ``Score: N`` replies."""
    return replies.select(key, "attempt", P.judge_explanation("reply").alias("explanation"),
                          P.judge_labeled_score("reply").alias("score"))


def score_with(df: DataFrame, scorer, out_schema: str) -> DataFrame:
    """U3 hook: a user scorer ``Iterator[pd.DataFrame] -> Iterator[pd.DataFrame]``
    run through ``mapInPandas`` (Arrow batches, one scorer instance per task)."""
    return df.mapInPandas(scorer, out_schema)
