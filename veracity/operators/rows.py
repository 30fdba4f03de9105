"""Row order, slices, splits and filters.

Order-dependent operators need a dense row index.  ``with_row_index`` builds
one without a single-partition window: rows are range-partitioned on the
order key, numbered inside each partition, materialised once (checkpoint in
the shared checkpoint folder, so a lost executor does not renumber rows) and
shifted by the row counts of the partitions before them.  The offsets table
has one row per partition, so broadcasting it is bounded by the partition
count, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.functions.text import col_, word_count
from veracity.session import scratch_path

LOCAL_BITS = 33  # monotonically_increasing_id keeps the in-partition position in the low 33 bits


def _cols(cols) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [col_(c) for c in cols]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads the files instead of
    recomputing the plan) and computes the input exactly once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the data: the rows meet by a shuffle, none passes the driver.

    Spark estimates a table's size by its files, and the written tables of ids and
    counts are many times smaller as files than as the rows it would send to all tasks.
    """
    return df.hint("merge")


def with_row_index(df: DataFrame, order: Sequence[str | Column] | str | Column,
                   name: str = "row_idx", partitions: int | None = None,
                   materialize_input: bool = False, keys_only: bool = False) -> DataFrame:
    """Add a dense 0-based ``name`` column following ``order`` (must be a unique key).

    ``keys_only`` numbers a table of the order columns (names, then) alone and joins it
    back, nulls included, so wide rows are neither sorted nor written; the
    input is read twice.  Without it whole rows are written.

    Range partitioning samples its input in a separate job; for an expensive
    input (heavy string work) ``materialize_input`` writes it once first so
    the sampling and the numbering both read parquet.
    """
    spark = df.sparkSession
    if keys_only:
        names = [order] if isinstance(order, str) else list(order)
        index = with_row_index(df.select(*names), names, name, partitions)
        return join_keys(df, index, names)
    if materialize_input:
        df = materialize(df, "row-index-input")
    if partitions is None:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _cols(order)
    ranged = (df.repartitionByRange(partitions, *keys)
              .sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = materialize(ranged, "row-index")
    tagged = (tagged.withColumn("_pid", F.shiftright("_mid", LOCAL_BITS))
              .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per range partition: the broadcast is bounded by the partition count
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_loc")).cast("bigint")).drop(
        "_pid", "_loc", "_mid", "_off")


def join_keys(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the other columns of ``other`` on equal keys, where null equals null."""
    right = other.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    on = [df[k].eqNullSafe(right[f"_key_{k}"]) for k in keys]
    return df.join(right, on).drop(*[f"_key_{k}" for k in keys])


def running_sums(df: DataFrame, order_col: str, value_cols: Sequence[str],
                 partition_cols: Sequence[str] = (), prefix: str = "cum_",
                 widths: Sequence[int] = (1 << 12, 1 << 24)) -> DataFrame:
    """Inclusive running sums of ``value_cols`` along a numeric ``order_col`` without ties.

    The order values are cut into blocks of ``widths[0]``, these into blocks of
    ``widths[1]`` and so on (each a multiple of the one before).  A row's sum is
    that inside its block plus the earlier blocks of each level, so every
    window works inside one block of the next level.
    """
    pcols = list(partition_cols)
    blocks = [f"_b{k}" for k in range(len(widths))]
    at = F.col(order_col)
    if df.schema[order_col].dataType.typeName() in ("float", "double"):
        at = F.nanvl(at, F.lit(float("inf")))  # NaN is above all numbers
    d = df.withColumns({b: F.floor(at / F.lit(w)) for b, w in zip(blocks, widths)})
    inside = Window.partitionBy(*pcols, *blocks).orderBy(order_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = d.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in value_cols])
    offsets, total = None, d
    for k in reversed(range(len(blocks))):  # from the widest level: what lies before each of its blocks
        level = blocks[k:]
        total = d.groupBy(*pcols, *level).agg(*[F.sum(c).alias(f"_t_{c}") for c in value_cols])
        before = Window.partitionBy(*pcols, *level[1:]).orderBy(level[0]).rowsBetween(Window.unboundedPreceding, -1)
        own = total.select(*pcols, *level, *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_n_{c}") for c in value_cols])
        if offsets is not None:
            own = own.join(unsent(offsets), [*pcols, *level[1:]]).select(
                *pcols, *level, *[(F.col(f"_n_{c}") + F.col(f"_o_{c}")).alias(f"_n_{c}") for c in value_cols])
        offsets = own.select(*pcols, *level, *[F.col(f"_n_{c}").alias(f"_o_{c}") for c in value_cols])
    out = out.join(unsent(offsets), [*pcols, *blocks])
    return out.select(*df.columns, *[(F.col(f"_in_{c}") + F.col(f"_o_{c}")).alias(f"{prefix}{c}") for c in value_cols])


def with_batches(df: DataFrame, order, size: int = 8, name: str = "batch_id",
                 keep_index: bool = True, materialize_input: bool = False, keys_only: bool = False,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """A1: fixed-size batches in input order: ``floor(row_idx / size)``.

    With ``group_cols`` rows and batches are numbered from 0 in each group: the
    rows are numbered in order of (group, ``order``) and the group's least
    number, one row a group, is taken away.
    """
    groups = list(group_cols)
    if groups:
        names = [order] if isinstance(order, str) else list(order)
        d = with_row_index(df, [*groups, *names], materialize_input=materialize_input, keys_only=keys_only)
        first = d.groupBy(*groups).agg(F.min("row_idx").alias("_first"))
        d = join_keys(d, first, groups).withColumn("row_idx", F.col("row_idx") - F.col("_first")).drop("_first")
    elif "row_idx" in df.columns:
        d = df
    else:
        d = with_row_index(df, order, materialize_input=materialize_input, keys_only=keys_only)
    d = d.withColumn(name, F.floor(F.col("row_idx") / F.lit(size)).cast("bigint")) \
         .withColumn("pos_in_batch", (F.col("row_idx") % F.lit(size)).cast("int"))
    return d if keep_index else d.drop("row_idx")


# --- filters -------------------------------------------------------------------

def filter_once(df: DataFrame, predicate) -> DataFrame:
    """Keep rows where ``predicate(row_struct)`` holds, evaluating costly columns once.

    A plain ``filter`` on a computed column is pushed below the projection
    that computes it, with the column's whole expression inlined into the
    condition, so heavy string/array work runs twice.  Filtering a
    one-element array and inlining it back keeps the predicate above the
    projection (the generator's output cannot be pushed through).
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.select(F.inline(F.filter(F.array(row), predicate)))


def computed_once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``df`` with the columns, each computed once for a row however often it is used later.

    Catalyst may copy a column's expression to every use; the output of a
    generator over a one-element array cannot be copied.
    """
    row = F.struct(*[c.alias(k) for k, c in cols.items()])
    return df.drop(*cols).select("*", F.inline(F.array(row)))


def chat_word_count(messages: Column | str) -> Column:
    """Total whitespace-word count of all message contents of a chat; a null content has no words."""
    return F.aggregate(col_(messages), F.lit(0),
                       lambda acc, m: acc + F.coalesce(word_count(m["content"]), F.lit(0)))


def word_budget(chat: DataFrame, max_words: int = 200, messages: str = "messages",
                out: str = "n_words") -> DataFrame:
    """keep chats whose total word count is strictly below ``max_words`` (count kept as ``out``)."""
    return filter_once(chat.withColumn(out, chat_word_count(messages)), lambda r: r[out] < max_words)


def word_budget_long(turns: DataFrame, max_words: int = 200, key: str = "conv_id",
                     text: str = "text") -> DataFrame:
    """F1 on long rows (one row per message): partial sums per chat, then a semi join."""
    keep = (turns.groupBy(key).agg(F.sum(word_count(text)).alias("n_words"))
            .filter(F.col("n_words") < max_words))
    return turns.join(keep.select(key), key, "left_semi")


def row_slice(df: DataFrame, start: int, n: int | None, index: str = "row_idx") -> DataFrame:
    """rows ``start .. start+n-1`` of the file order index."""
    cond = F.col(index) >= start
    if n is not None:
        cond = cond & (F.col(index) < start + n)
    return df.filter(cond)


def slice_in_order(df: DataFrame, order, start: int, n: int, name: str = "row_idx") -> DataFrame:
    """rows ``start .. start+n-1`` in order, as a top-k: no other row is moved or kept.

    The row index is numbered over the ``n`` rows of the slice alone.
    """
    keys = _cols(order)
    cut = df.orderBy(*keys).offset(start).limit(n)
    return cut.withColumn(name, (F.row_number().over(Window.orderBy(*keys)) - 1 + start).cast("bigint"))


def seeded_key(key: Column | str, seed: int) -> Column:
    """Reproducible pseudo-random order key: ``md5('<seed>:<key>')``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col_(key).cast("string")))


def seeded_order(df: DataFrame, key: str, seed: int = 42, name: str = "shuffle_idx") -> DataFrame:
    """seeded shuffle as a dense position in md5 order (ties on the key)."""
    d = df.withColumn("_h", seeded_key(key, seed))
    return with_row_index(d, ["_h", key], name=name).drop("_h")


#: Hex digits by which ``order_cut`` first tells keys apart: 65 536 groups.
CUT_DIGITS = 4


def order_cut(df: DataFrame, key: str, seed: int, rank: Column) -> Column:
    """The order key (md5, key) of the row that stands at ``rank`` (from 1) in seeded order, as a scalar.

    Distributed selection: one pass counts the keys by their first md5 digits,
    which names the group that holds the rank; a second pass puts that group's
    keys (one in 65 536) in order.  ``rank`` may use the total row count, column
    ``n``.  Nothing is numbered or written, and no job runs before the result is used.
    """
    d = df.select(seeded_key(key, seed).alias("_h"), F.col(key).alias("_k"))
    first = F.substring("_h", 1, CUT_DIGITS)

    def located(rows, group, at):
        counts = rows.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        d = counts.select("_g", upto.alias("_upto"), (upto - F.col("_c")).alias("_before"),
                          F.sum("_c").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
        d = d.withColumn("_at", at.cast("bigint"))
        return d.where("_before < _at and _at <= _upto").select(F.struct("_g", (F.col("_at") - F.col("_before")).alias("_at")).alias("_f"))

    group = located(d, first, rank).scalar()
    return located(d.where(first == group["_g"]), F.struct("_h", "_k"), group["_at"]).select("_f._g").scalar()


def split_rows(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """train/test split; test = first ``ceil(ratio * n)`` rows of the seeded order.

    ``key`` must be unique; rows that repeat a key stay on one side together.
    The rows pass once, with a comparison to the cut key (``order_cut``).
    """
    cut = order_cut(df, key, seed, F.ceil(F.lit(float(ratio)) * F.col("n")))
    test = F.coalesce(F.struct(seeded_key(key, seed), F.col(key)) <= cut, F.lit(False))
    return df.withColumn("split", F.when(test, F.lit("test")).otherwise(F.lit("train")))


def capped_train_and_test(df: DataFrame, key: str, ratio: float, seed: int, cap: int, start: int, n: int,
                          divisor: int = 100) -> DataFrame:
    """F5 after F3: rows ``start .. start+n-1`` of the first ``cap`` training rows in key order, and the first
    (number of capped training rows) // ``divisor`` test rows, with ``split``.

    Both are top-k, so no row index is written; the number of training rows is one aggregate.
    """
    s = split_rows(df, key, ratio, seed)
    train, test = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    rows = slice_in_order(train, key, start, max(0, min(n, cap - start))).drop("row_idx")
    counted = train.agg(F.least(F.count(F.lit(1)), F.lit(cap)).alias("c")).scalar()
    first = slice_in_order(test, key, 0, cap // divisor)
    return rows.unionByName(cap_test_split(first, counted, divisor).drop("row_idx"))


def capped_split(df: DataFrame, cap: int, start: int, n: int,
                 index: str = "row_idx") -> DataFrame:
    """cap to the first ``cap`` rows, then take ``[start, start+n)`` of those."""
    capped = df.filter(F.col(index) < cap)
    return capped.filter((F.col(index) >= start) & (F.col(index) < start + n))


def sample_rows(df: DataFrame, key: str, k: int = 3, seed: int = 42) -> DataFrame:
    """k rows in seeded order (a top-k by the md5 key, no global sort)."""
    h = seeded_key(key, seed)
    return df.withColumn("_h", h).orderBy("_h", key).limit(k).drop("_h")


def preview(df: DataFrame, every: int = 10, n: int = 5, batch: str = "batch_id",
            pos: str = "pos_in_batch") -> DataFrame:
    """F8: first ``n`` rows of every ``every``-th batch."""
    return df.filter((F.col(batch) % every == 0) & (F.col(pos) < n))


def drop_na_reasons(df: DataFrame, reasons: str = "reasons") -> DataFrame:
    """drop reasons containing ``N/A``; drop the row when none is left."""
    d = df.withColumn(reasons, F.filter(F.col(reasons), lambda x: ~x.contains("N/A")))
    return d.filter(F.size(reasons) > 0)


def in_range(df: DataFrame, col: str, lo: float = 0, hi: float = 10) -> DataFrame:
    """rows whose value lies in [lo, hi]."""
    return df.filter(F.col(col).between(lo, hi))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """Row count of each named stage, as one small table."""
    parts = [d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(k).alias("stage"), "n_rows")
             for k, d in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def condition_counts(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """rows of ``df`` that meet each condition, counted in one pass over it."""
    one = df.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in stages.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("stage"), F.col(k).alias("n_rows")) for k in stages]))
                      .alias("s")).select("s.stage", "s.n_rows")


def cap_test_split(test: DataFrame, n_train: int | Column, divisor: int = 100,
                   index: str = "row_idx") -> DataFrame:
    """test rows capped at ``n_train // divisor`` (in file order)."""
    n = n_train if isinstance(n_train, Column) else F.lit(n_train)
    return test.filter(F.col(index) < F.floor(n / divisor))


def split_sizes(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Row count per split (used as caps by later slices)."""
    return df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n_rows"))
