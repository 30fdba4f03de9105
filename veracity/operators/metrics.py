"""Calibration metrics (A2-A8): per batch, cumulative and overall.

Inputs are scored rows with a numeric ``confidence`` and ``correctness``
(both nominally 0..10).  Rows are reduced to per-batch partial aggregates
first (map-side combine), so the ordered, cumulative part only ever sees one
row per batch and runs through the two-level ``running_sums`` helper.
AUROC is computed from a (confidence, target) histogram, never from pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracity.operators.rows import materialize, running_sums, unsent

POS_MIN = 7   # correctness >= 7 counts as right (conf_pos, AUROC target)
NEG_MAX = 3   # correctness <= 3 counts as wrong (conf_neg)


def _conf(c="confidence") -> Column:
    return F.col(c).cast("double")


def _corr(c="correctness") -> Column:
    return F.col(c).cast("double")


def batch_partials(scored: DataFrame, group_cols: Sequence[str] = (),
                   batch: str = "batch_id") -> DataFrame:
    """One row per (group, batch) with the sums the metrics are built from.

    Sums are kept on the 0..10 scale and divided by 10 only when a metric is
    formed, so integer confidences sum exactly whatever the summation order.
    A row without a confidence counts in ``n`` and the accuracy; the metrics of
    confidence are means over the rows that have one (``gap_n`` of them).
    """
    conf, corr = _conf(), _corr()
    pos = corr >= POS_MIN
    neg = corr <= NEG_MAX
    return scored.groupBy(*group_cols, batch).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.abs(conf - corr)), F.lit(0.0)).alias("gap_sum"),
        F.count(conf - corr).alias("gap_n"),
        F.sum(corr).alias("acc_sum"),
        F.coalesce(F.sum(F.when(pos, conf)), F.lit(0.0)).alias("pos_sum"),
        F.count(F.when(pos, conf)).alias("pos_n"),
        F.coalesce(F.sum(F.when(neg, conf)), F.lit(0.0)).alias("neg_sum"),
        F.count(F.when(neg, conf)).alias("neg_n"),
    )


def _ratio(num: str, den: str) -> Column:
    return F.when(F.col(den) > 0, F.col(num) / (F.col(den) * 10.0)).otherwise(F.lit(0.0))


def batch_metrics(scored: DataFrame, group_cols: Sequence[str] = (),
                  batch: str = "batch_id") -> DataFrame:
    """A2/A4/A5 per batch: gap ("ece"), accuracy, conf_pos, conf_neg (0 when empty)."""
    p = batch_partials(scored, group_cols, batch)
    return p.select(
        *group_cols, batch, "n",
        _ratio("gap_sum", "gap_n").alias("ece"),
        _ratio("acc_sum", "n").alias("accuracy"),
        _ratio("pos_sum", "pos_n").alias("conf_pos"),
        _ratio("neg_sum", "neg_n").alias("conf_neg"),
    )


def cumulative_metrics(scored: DataFrame, group_cols: Sequence[str] = (),
                       batch: str = "batch_id", placeholder: bool = True) -> DataFrame:
    """A3/A4/A5 cumulative up to each batch.

    With ``placeholder`` (the reference behaviour) a batch without any
    right (wrong) row adds one 0 to the conf_pos (conf_neg) list.
    """
    p = batch_partials(scored, group_cols, batch)
    if placeholder:
        p = p.withColumn("pos_d", F.greatest(F.col("pos_n"), F.lit(1))) \
             .withColumn("neg_d", F.greatest(F.col("neg_n"), F.lit(1)))
    else:
        p = p.withColumn("pos_d", F.col("pos_n")).withColumn("neg_d", F.col("neg_n"))
    vals = ["n", "gap_sum", "gap_n", "acc_sum", "pos_sum", "pos_d", "neg_sum", "neg_d"]
    c = running_sums(p, batch, vals, partition_cols=group_cols)
    return c.select(
        *group_cols, batch,
        F.col("cum_n").alias("n_seen"),
        _ratio("cum_gap_sum", "cum_gap_n").alias("cumulative_ece"),
        _ratio("cum_acc_sum", "cum_n").alias("cumulative_accuracy"),
        _ratio("cum_pos_sum", "cum_pos_d").alias("cumulative_conf_pos"),
        _ratio("cum_neg_sum", "cum_neg_d").alias("cumulative_conf_neg"),
    )


#: Confidences are summed up inside each integer, then over each 2^20 of these.
CONF_WIDTHS = (1, 1 << 20)
#: Levels of batch blocks counted together by one task, at most, and the histogram rows of such a block.
SMALL_LEVELS, BLOCK_ROWS = 14, 1 << 19


def _within(batch: np.ndarray, p: np.ndarray, cp: np.ndarray, cn: np.ndarray, levels: int) -> np.ndarray:
    """For each row the sum over the pairs with rows of the batches that differ in the lowest ``levels`` bits only.

    A row counts, where it is the later one of a pair, its right rows against the wrong ones of
    smaller confidence and its wrong rows against the right ones of larger confidence.  The rows
    come in order of (batch, p); each level merges the halves of its blocks into order of p.
    """
    # Rank of the confidence, so that one number orders (block, confidence).
    _, rank = np.unique(p, return_inverse=True)
    width = np.int64(rank.max()) + 1
    out = cp * 0.0
    # Batch and p do not repeat together, so the pairs inside a batch are those of smaller p alone.
    local = batch - batch.min()
    order = np.lexsort((rank, local))
    start = np.append(0, np.cumsum(cn[order]))
    first = np.searchsorted(local[order], local)
    at = np.empty(len(p), np.int64)
    at[order] = np.arange(len(p))
    out += cp * (start[at] - start[first] + cn / 2.0)
    for level in range(levels):
        block, right = batch >> (level + 1), (batch >> level) & 1 == 1
        block = block - block.min()
        if not right.any() or right.all():
            continue
        left_key = block[~right] * width + rank[~right]
        o = np.argsort(left_key, kind="stable")
        left_key = left_key[o]
        wrong, good = (np.append(0, np.cumsum(x[~right][o])) for x in (cn, cp))
        key = block[right] * width + rank[right]
        lo, hi = np.searchsorted(left_key, key, "left"), np.searchsorted(left_key, key, "right")
        begin, end = np.searchsorted(left_key, block[right] * width), np.searchsorted(left_key, (block[right] + 1) * width)
        below = wrong[lo] - wrong[begin] + (wrong[hi] - wrong[lo]) / 2.0
        above = good[end] - good[hi] + (good[hi] - good[lo]) / 2.0
        out[right] += cp[right] * below + cn[right] * above
    return out


def _below(h: DataFrame, keys: Sequence[str], p: str, value: str = "cn") -> DataFrame:
    """``h`` with ``below``: sum of ``value`` over the smaller ``p`` of the same keys.

    The histogram (one row per distinct confidence) is written once, as the
    running sums read it at several levels.
    """
    r = running_sums(materialize(h, "conf-histogram"), p, [value], partition_cols=keys, widths=CONF_WIDTHS)
    return r.withColumn("below", F.col(f"cum_{value}") - F.col(value)).drop(f"cum_{value}")


def _histogram(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right and wrong rows by confidence; rows without a confidence or correctness are left out."""
    target = _corr() >= POS_MIN
    return scored.where(_conf().isNotNull() & _corr().isNotNull()).groupBy(*keys, (_conf() / 10.0).alias("p")).agg(
        F.count(F.when(target, 1)).alias("cp"),
        F.count(F.when(~target, 1)).alias("cn"))


def auroc(scored: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """A6 overall: Mann-Whitney form of the ROC area from a histogram.

    ``sum_p cp(p) * (neg below p + cn(p) / 2) / (P * N)``; 0 when one class
    is missing.  The histogram has one row per distinct confidence.
    """
    h = _below(_histogram(scored, group_cols), group_cols, "p")
    a = h.groupBy(*group_cols).agg(
        F.sum(F.col("cp") * (F.col("below") + F.col("cn") / 2.0)).alias("u"),
        F.sum("cp").alias("n_pos"), F.sum("cn").alias("n_neg"))
    return a.select(*group_cols, F.when(F.col("n_pos") * F.col("n_neg") > 0,
                                        F.col("u") / (F.col("n_pos") * F.col("n_neg")))
                    .otherwise(F.lit(0.0)).alias("auroc"))


def _block_gains(h: DataFrame, keys: Sequence[str], batch: str, low: int) -> DataFrame:
    """(keys, batch, u): the pairs within each block of ``2^low`` batches, a task's group for each block."""
    schema = T.StructType([*[h.schema[k] for k in keys], T.StructField(batch, T.LongType()), T.StructField("u", T.DoubleType())])

    def gains(t: pa.Table) -> pa.Table:
        b, p, cp, cn = (t.column(c).to_numpy() for c in ("_at", "p", "cp", "cn"))
        each, back = np.unique(b, return_inverse=True)
        first = np.zeros(len(each), np.int64)
        first[back] = np.arange(len(b))
        u = np.bincount(back, weights=_within(b, p, cp, cn, low), minlength=len(each))
        own = [t.column(k).take(pa.array(first)) for k in keys]
        return pa.Table.from_arrays([*own, pa.array(each), pa.array(u)], [*keys, batch, "u"])

    at = F.col(batch).cast("long")
    rows = h.where(F.col(batch).isNotNull()).select(*keys, at.alias("_at"), "p", "cp", "cn", F.shiftright(at, low).alias("_block"))
    return rows.groupBy(*keys, "_block").applyInArrow(gains, schema)


def _level_gains(h: DataFrame, keys: Sequence[str], batch: str, low: int, levels: int) -> DataFrame:
    """(keys, batch, u): the pairs across the halves of the blocks of every level from ``low`` on."""
    at = F.explode(F.sequence(F.lit(low), F.lit(levels - 1))).alias("level")
    e = h.select(*keys, batch, "p", "cp", "cn", at).withColumns({
        "block": F.expr(f"shiftright(`{batch}`, level + 1)"), "right": F.expr(f"shiftright(`{batch}`, level) & 1 = 1")})
    block = [*keys, "level", "block"]
    # Left half of every block by confidence; the confidences of its right half are in it with 0.
    left = e.groupBy(*block, "p").agg(*[F.sum(F.when(~F.col("right"), F.col(c)).otherwise(0)).alias(f"l{c}") for c in ("cp", "cn")],
                                      F.max("right").alias("met"))
    left = materialize(left, "auroc-levels")
    total = left.groupBy(*block).agg(F.sum("lcp").alias("tcp"))
    run = running_sums(left, "p", ["lcp", "lcn"], partition_cols=block, widths=CONF_WIDTHS).where("met").join(unsent(total), block)
    return (e.where("right").join(unsent(run), [*block, "p"])
            .select(*keys, batch, (F.col("cp") * (F.col("cum_lcn") - F.col("lcn") / 2.0)
                                   + F.col("cn") * (F.col("tcp") - F.col("cum_lcp") + F.col("lcp") / 2.0)).alias("u")))


def cumulative_auroc(scored: DataFrame, group_cols: Sequence[str] = (), batch: str = "batch_id",
                     count_null: bool = False) -> DataFrame:
    """A6 cumulative: ROC area over all rows of batches <= each batch, for each group.

    A batch adds to the area's numerator the pairs of which it holds the later
    row: its right rows against the wrong ones of batches before, its wrong
    rows against the right ones before, and the pairs within it.  The pairs
    across batches are counted by halving: at level ``l`` the batches fall in
    blocks of ``2^(l+1)``, and the rows of a block's right half meet the running
    counts by confidence of its left half.  Each pair of batches is apart at
    one level only.  The lowest levels, up to blocks of ``BLOCK_ROWS`` histogram
    rows, are counted by one task for each block, so a row is sent once for all of
    them and once more for each level above, whatever the number of confidences.
    Rows without a confidence or correctness are left out (``count_null`` adds how
    many, up to the batch).
    """
    keys = list(group_cols)
    h = materialize(_histogram(scored, [*keys, batch]), "batch-histogram")
    batches = scored.groupBy(*keys, batch).agg(
        F.count(F.when(_conf().isNull() | _corr().isNull(), 1)).alias("n_null"))
    most = h.groupBy(*keys, batch).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.max(batch)).first()
    levels = int(most[1] or 0).bit_length()
    low = min(levels, SMALL_LEVELS, max(0, (BLOCK_ROWS // (most[0] or 1)).bit_length() - 1))
    gained = _block_gains(h, keys, batch, low)
    if levels > low:
        gained = gained.unionByName(_level_gains(h, keys, batch, low, levels))
    gained = gained.groupBy(*keys, batch).agg(F.sum("u").alias("u"))
    sizes = h.groupBy(*keys, batch).agg(F.sum("cp").alias("cp"), F.sum("cn").alias("cn"))
    each = (batches.join(unsent(gained), [*keys, batch], "left").join(unsent(sizes), [*keys, batch], "left")
            .fillna(0, subset=["u", "cp", "cn"]))
    each = materialize(each, "auroc-gains")
    a = running_sums(each, batch, ["u", "cp", "cn", "n_null"], partition_cols=keys)
    area = F.when(F.col("cum_cp") * F.col("cum_cn") > 0, F.col("cum_u") / (F.col("cum_cp") * F.col("cum_cn"))).otherwise(F.lit(0.0))
    return a.select(*keys, batch, area.alias("cumulative_auroc"), *([F.col("cum_n_null").alias("n_null")] if count_null else []))


def report_from_conf_histogram(hp: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overall metrics from per-(group, confidence) partial sums, without a join.

    ``hp`` has one row per group and distinct confidence with columns
    ``conf, n, cp, cn, gap_sum, acc_sum, pos_sum, pos_n, neg_sum, neg_n,
    n_out`` (and optionally ``reward_sum``, ``reward_n``).  A window over
    the confidences of a group gives the negatives below each confidence;
    one aggregate then yields every metric and the ROC area.
    """
    keys = list(keys)
    # A null confidence has a row of its own, which has no place in the order.
    h = hp.withColumns({"conf": F.coalesce("conf", F.lit(float("-inf"))), "_gap_n": F.when(F.col("conf").isNull(), 0).otherwise(F.col("n")),
                        "cp": F.when(F.col("conf").isNull(), 0).otherwise(F.col("cp")),
                        "cn": F.when(F.col("conf").isNull(), 0).otherwise(F.col("cn"))})
    h = _below(h, keys, "conf")
    has_reward = "reward_sum" in hp.columns
    aggs = [F.sum("n").alias("n"), F.sum("gap_sum").alias("_gap"), F.sum("_gap_n").alias("_gn"), F.sum("acc_sum").alias("_acc"),
            F.sum("pos_sum").alias("_pos"), F.sum("pos_n").alias("_pos_n"),
            F.sum("neg_sum").alias("_neg"), F.sum("neg_n").alias("_neg_n"),
            F.sum("n_out").alias("n_out_of_range"),
            F.sum(F.col("cp") * (F.col("below") + F.col("cn") / 2.0)).alias("_u"),
            F.sum("cp").alias("_P"), F.sum("cn").alias("_N")]
    if has_reward:
        aggs += [F.sum("reward_sum").alias("_rs"), F.sum("reward_n").alias("_rn")]
    a = h.groupBy(*keys).agg(*aggs)
    return a.select(
        *keys, "n", _ratio("_gap", "_gn").alias("ece"), _ratio("_acc", "n").alias("accuracy"),
        _ratio("_pos", "_pos_n").alias("conf_pos"), _ratio("_neg", "_neg_n").alias("conf_neg"),
        "n_out_of_range",
        *([(F.col("_rs") / F.col("_rn")).alias("mean_reward")] if has_reward else []),
        F.when(F.col("_P") * F.col("_N") > 0, F.col("_u") / (F.col("_P") * F.col("_N")))
         .otherwise(F.lit(0.0)).alias("auroc"))


def calibration_report(scored: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Overall metrics per group (e.g. per dataset), one job for all groups.

    Rows are first reduced to one row per (group, distinct confidence); the
    rest works on that small histogram.
    """
    keys = list(group_cols)
    conf, corr = _conf(), _corr()
    pos = corr >= POS_MIN
    neg = corr <= NEG_MAX
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(pos, 1)).alias("cp"), F.count(F.when(~pos, 1)).alias("cn"),
        F.coalesce(F.sum(F.abs(conf - corr)), F.lit(0.0)).alias("gap_sum"), F.sum(corr).alias("acc_sum"),
        F.coalesce(F.sum(F.when(pos, conf)), F.lit(0.0)).alias("pos_sum"), F.count(F.when(pos, conf)).alias("pos_n"),
        F.coalesce(F.sum(F.when(neg, conf)), F.lit(0.0)).alias("neg_sum"), F.count(F.when(neg, conf)).alias("neg_n"),
        F.count(F.when(~conf.between(0, 10), 1)).alias("n_out"),
    ]
    if "reward" in scored.columns:
        aggs += [F.sum("reward").alias("reward_sum"), F.count("reward").alias("reward_n")]
    hp = scored.groupBy(*keys, conf.alias("conf")).agg(*aggs)
    return report_from_conf_histogram(hp, keys)


def conf_reward_gap(scored: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean |confidence - reward| (mixes 0..10 with -1..1, kept under its own name).

    Rewards are at most 1, so for confidence >= 1 the gap is confidence -
    reward: large confidences (parsed digit runs can be huge) are summed
    apart from the small rewards, which keeps the sum independent of the
    summation order.
    """
    conf, rew = _conf(), F.col("reward")
    big = conf >= 1.0
    a = scored.groupBy(*group_cols).agg(
        F.coalesce(F.sum(F.when(big, conf)), F.lit(0.0)).alias("_c"),
        F.coalesce(F.sum(F.when(big, rew)), F.lit(0.0)).alias("_r"),
        F.coalesce(F.sum(F.when(~big, F.abs(conf - rew))), F.lit(0.0)).alias("_s"),
        F.count(F.lit(1)).alias("n"))
    return a.select(*group_cols, ((F.col("_c") - F.col("_r") + F.col("_s")) / F.col("n")).alias("conf_reward_gap"), "n")
