"""Run-log roll-ups (A9, A10) over long metric tables ``(run_id, step, ...)``.

Both are ordered per run.  The running minimum works on blocks of steps, so a
run with very many logged steps is still split over many window partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_min_before(df: DataFrame, order_col: str, value: str, partition_cols=(),
                       block_size: int = 1 << 16, out: str = "prev_min") -> DataFrame:
    """Minimum of ``value`` over all earlier rows of the partition (null for the first).

    Inside a block of ``block_size`` order values a window gives the minimum
    of earlier rows; a small table of per-block minima gives the minimum of
    earlier blocks.
    """
    pcols = list(partition_cols)
    d = df.withColumn("_blk", F.floor(F.col(order_col) / F.lit(block_size)))
    w_in = Window.partitionBy(*pcols, "_blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.min(value).over(w_in))
    blocks = d.groupBy(*pcols, "_blk").agg(F.min(value).alias("_bm"))
    w_b = Window.partitionBy(*pcols).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*pcols, "_blk", F.min("_bm").over(w_b).alias("_before"))
    d = d.join(blocks, [*pcols, "_blk"])
    return d.withColumn(out, F.least("_in", "_before")).drop("_blk", "_in", "_before")


def best_checkpoints(log: DataFrame, metric: str = "value", start: float = 1.0,
                     run: str = "run_id", step: str = "step") -> DataFrame:
    """Steps where the metric beats the best so far (initial best ``start``).

    ``least`` skips the null of the first row, so the first row is compared
    with ``start`` alone.
    """
    d = running_min_before(log, step, metric, [run])
    best = F.least(F.lit(start), F.col("prev_min"))
    return d.filter(F.col(metric) < best).select(run, step, metric)


def loss_rollup(log: DataFrame, k: int, grad_acc: int = 1, run: str = "run_id", step: str = "step",
                loss: str = "value", rank: str = "rank") -> DataFrame:
    """A10: every ``k`` steps: summed step loss, mean over ranks, / grad_acc / k.

    Steps start at 1; window ``w`` covers steps ``(w-1)*k+1 .. w*k`` and is
    logged at step ``w*k``, once every rank of the run has reached it.  Steps
    after the last such window are not logged.
    """
    w = F.floor((F.col(step) - 1) / k)
    g = log.groupBy(run, w.alias("_w")).agg(
        F.sum(loss).alias("_sum"), F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(F.when(F.col(step) == (w + 1) * k, F.col(rank))).alias("_reached"))
    ranks = log.groupBy(run).agg(F.countDistinct(rank).alias("n_ranks"))
    return g.join(ranks, run).filter(F.col("_reached") == F.col("n_ranks")).select(
        run, ((F.col("_w") + 1) * k).cast("bigint").alias("log_step"),
        (F.col("_sum") / F.col("n_ranks") / grad_acc / k).alias("avg_loss"), "n_ranks", "n_rows")
