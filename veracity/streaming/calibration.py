"""Streaming calibration (ST1-ST3).

Scored rows arrive as a stream; the running state is a histogram of
(confidence, correctness) pairs with counts, so state grows with the number
of distinct values, not with rows.  Every micro-batch writes the whole histogram
to a folder of its own epoch (written again alike if the epoch is retried), and
readers take the last complete one, so no reader sees a table in the making; all but
the last ``keep`` epochs are removed, so storage does not grow with batches.  The
checkpoint keeps the source position and the state, so a restarted query resumes where
it stopped.  The report (gap, accuracy, conf_pos/neg, AUROC) is computed from
the histogram with the batch formulas.

Micro-batches are not the reference's fixed-size batches: per-batch metrics
with placeholders need ``batch_id`` in the data and are computed in batch mode.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veracity.operators.metrics import NEG_MAX, POS_MIN, report_from_conf_histogram


def histogram(scored: DataFrame, group_cols=()) -> DataFrame:
    """(group, confidence, correctness) -> count; works on batch and streaming frames."""
    return scored.groupBy(*group_cols, F.col("confidence").cast("double").alias("confidence"),
                          F.col("correctness").cast("double").alias("correctness")).agg(
        F.count(F.lit(1)).alias("cnt"))


def stream_calibration(scored_stream: DataFrame, sink_path: str, checkpoint: str,
                       group_cols=(), available_now: bool = True,
                       processing_time: str | None = None, keep: int = 2) -> StreamingQuery:
    """Start the running-histogram query; each of the last ``keep`` epochs (2 or more) has a folder below ``sink_path``."""
    if keep < 2:
        raise ValueError("a reader needs the epoch before the one being written")
    hist = histogram(scored_stream, group_cols)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink_path}/epoch={epoch}")
        _remove_before(batch.sparkSession, sink_path, epoch - keep + 1)

    w = hist.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(write)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def _epochs(spark: SparkSession, sink_path: str):
    """The sink's file system and its (epoch, path) folders."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    fs = hadoop(sink_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    paths = [f.getPath() for f in fs.listStatus(hadoop(sink_path))]
    return fs, [(int(p.getName()[len("epoch="):]), p) for p in paths if p.getName().startswith("epoch=")]


def _remove_before(spark: SparkSession, sink_path: str, epoch: int) -> None:
    """Delete the folders of epochs before ``epoch``; called when that one and the next are complete."""
    fs, folders = _epochs(spark, sink_path)
    for number, path in folders:
        if number < epoch:
            fs.delete(path, True)


def latest_histogram(spark: SparkSession, sink_path: str) -> DataFrame:
    """The histogram of the last epoch that was written completely.

    An epoch counts once its commit marker is there, which Spark writes last.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    fs, folders = _epochs(spark, sink_path)
    done = [number for number, path in folders if fs.exists(hadoop(path, "_SUCCESS"))]
    last = max(done, default=None)
    if last is None:
        raise ValueError(f"no epoch has been written below {sink_path}")
    return spark.read.parquet(f"{sink_path}/epoch={last}")


def stream_records(stream_df: DataFrame, path: str, checkpoint: str, fmt: str = "json",
                   available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """ST2/ST3: append each micro-batch's rows to a file sink.

    The file sink and the checkpoint together commit every batch exactly
    once; a restarted query resumes after the last committed batch.
    """
    w = stream_df.writeStream.format(fmt).outputMode("append").option("path", path) \
        .option("checkpointLocation", checkpoint)
    if processing_time:
        w = w.trigger(processingTime=processing_time)
    elif available_now:
        w = w.trigger(availableNow=True)
    return w.start()


def report_from_histogram(hist: DataFrame, group_cols=()) -> DataFrame:
    """Overall metrics from a (confidence, correctness, cnt) histogram."""
    keys = list(group_cols)
    conf, corr, n = F.col("confidence"), F.col("correctness"), F.col("cnt")
    pos, neg = corr >= POS_MIN, corr <= NEG_MAX
    hp = hist.groupBy(*keys, conf.alias("conf")).agg(
        F.sum(n).alias("n"),
        F.sum(F.when(pos, n).otherwise(0)).alias("cp"), F.sum(F.when(~pos, n).otherwise(0)).alias("cn"),
        F.sum(n * F.abs(conf - corr)).alias("gap_sum"), F.sum(n * corr).alias("acc_sum"),
        F.coalesce(F.sum(F.when(pos, n * conf)), F.lit(0.0)).alias("pos_sum"),
        F.sum(F.when(pos, n).otherwise(0)).alias("pos_n"),
        F.coalesce(F.sum(F.when(neg, n * conf)), F.lit(0.0)).alias("neg_sum"),
        F.sum(F.when(neg, n).otherwise(0)).alias("neg_n"),
        F.sum(F.when(~conf.between(0, 10), n).otherwise(0)).alias("n_out"))
    return report_from_conf_histogram(hp, keys).drop("n_out_of_range")


def run_to_report(spark: SparkSession, scored_stream: DataFrame, work_dir: str, group_cols=()) -> DataFrame:
    """Drain the available input once (availableNow) and return the report."""
    sink = os.path.join(work_dir, "histogram")
    q = stream_calibration(scored_stream, sink, os.path.join(work_dir, "checkpoint"), group_cols)
    q.awaitTermination()
    return report_from_histogram(latest_histogram(spark, sink), group_cols)
