"""End-to-end calibration evaluation over recorded model outputs.

recorded attempts -> resolve retries -> parse confidence -> judge scores ->
reward -> fixed-size batches -> per-batch, cumulative and overall metrics.
One lazy plan per output; shuffles happen at the per-question reductions,
the joins on ``qid``, the row index and the small per-batch aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.operators import metrics as MET
from veracity.operators import responses as RESP
from veracity.operators.rows import unsent, with_batches
from veracity.sources.io import to_metric_log


def scored_run(attempts: DataFrame, judge_replies: DataFrame, max_tries: int = 3, mode: str = "main",
               judge_tries: int = 3, key: str = "qid") -> DataFrame:
    """One scored row per question: resolved response, confidence, judge correctness, reward."""
    resolved = RESP.resolve_attempts(attempts, max_tries, mode, key)
    parsed = RESP.parse_responses(resolved, mode)
    judged = RESP.judge_scores(judge_replies, judge_tries, key).select(
        key, F.col("score").cast("double").alias("correctness"))
    return RESP.score_responses(parsed, unsent(judged), key, unjudged="zero")  # a failed judge scores 0


class EvaluationRun:
    """All outputs of one evaluation; each output is built only when asked for.

    (The row index behind the batch outputs writes a scratch table when it is
    built, so building it only for the batch outputs keeps the overall report
    a single plan.)
    """

    def __init__(self, attempts: DataFrame, judge_replies: DataFrame, batch_size: int = 8,
                 max_tries: int = 3, mode: str = "main", judge_tries: int = 3, key: str = "qid",
                 datasets: DataFrame | None = None):
        """``datasets`` (key and the columns that name a question's dataset) makes each dataset a run of its own.

        Its batches, cumulative metrics and log then count within the dataset;
        questions it lacks are left out.
        """
        self.key = key
        self.batch_size = batch_size
        self.scored = scored_run(attempts, judge_replies, max_tries, mode, judge_tries, key)
        self.groups: list[str] = []
        if datasets is not None:
            self.groups = [c for c in datasets.columns if c != key]
            self.scored = self.scored.join(unsent(datasets), key)
        self._batched: DataFrame | None = None

    def batched(self) -> DataFrame:
        if self._batched is None:
            slim = self.scored.select(*self.groups, self.key, "confidence", "correctness")  # the index copies no text
            self._batched = with_batches(slim, self.key, size=self.batch_size, group_cols=self.groups)
        return self._batched

    def records(self, questions: DataFrame | None = None) -> DataFrame:
        """Result rows; with ``questions`` (key, question, best_answer, correct_answers) also those."""
        out = self.scored.select(*self.groups, self.key, "response", "confidence", "correctness", "judged", "reward")
        return out if questions is None else questions.join(out, self.key)

    def batches(self) -> DataFrame:
        return MET.batch_metrics(self.batched(), self.groups)

    def cumulative(self) -> DataFrame:
        b = self.batched()
        return MET.cumulative_metrics(b, self.groups).join(unsent(MET.cumulative_auroc(b, self.groups)), [*self.groups, "batch_id"])

    def metric_log(self, run_id: str) -> DataFrame:
        """Per-batch and cumulative metrics as (run_id, dataset columns, step, metric, value) rows."""
        names = ["ece", "accuracy", "conf_pos", "conf_neg"]
        both = self.batches().join(unsent(self.cumulative()), [*self.groups, "batch_id"])
        return to_metric_log(both, run_id, "batch_id", [*names, *[f"cumulative_{m}" for m in [*names, "auroc"]]], self.groups)

    def overall(self, group_cols=None) -> DataFrame:
        return MET.calibration_report(self.scored, self.groups if group_cols is None else group_cols)
