"""Best-fit packing into bins of several permitted lengths.

Texts are measured once, cut into pieces of at most the largest length, and dealt by hash
into groups of about ``GROUP`` pieces, so each group packs alone with little loss.  Within
a group pieces go longest first: into the open bin with the least room that still fits,
else into a new bin.  A new bin takes the length whose cost for each token it can expect
to hold is least, looking ahead at the pieces still to come; so the permitted lengths are
chosen together with the contents.  In the end every bin shrinks to the least permitted
length that holds it.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm.common import WORD, documents, stored

CAPACITIES = (512, 1024, 2048, 4096)
GROUP = 20_000
#: Pieces that the choice of a new bin's length looks ahead.
AHEAD = 16


def best_fit(lengths: np.ndarray, capacities: tuple[int, ...], cost: dict[int, float] | None = None):
    """(bin, offset, capacity) of each length; ``lengths`` descend and fit the largest capacity.

    ``cost`` is the price of a bin by capacity (its length where none is given).  Ties go to
    the bin opened first and to the smaller capacity.
    """
    caps = sorted(capacities)
    price = [(cost or {}).get(c, float(c)) for c in caps]
    below = (-np.asarray(lengths)).tolist()  # ascends, for bisect
    bins, offsets, used, room = [], [], [], []  # room: (room left, bin) ascending

    def expected(i: int, length: int, cap: int) -> int:
        left, j = cap - length, i + 1
        for _ in range(AHEAD):
            j = bisect.bisect_left(below, -left, j)
            if left == 0 or j >= len(below):
                break
            left += below[j]
            j += 1
        return cap - left

    for i, neg in enumerate(below):
        length = -neg
        k = bisect.bisect_left(room, (length, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            _, cap = min((p / expected(i, length, c), c) for c, p in zip(caps, price) if c >= length)
            b, left = len(used), cap
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += length
        if left > length:
            bisect.insort(room, (left - length, b))
    final = np.array(caps)[np.searchsorted(caps, used)] if used else np.zeros(0, int)
    return np.array(bins, np.int64), np.array(offsets, np.int64), final[bins] if bins else final


def pack(df: DataFrame, key: str, length: str, capacities: tuple[int, ...] = CAPACITIES,
         cost: dict[int, float] | None = None, group: int = GROUP) -> DataFrame:
    """(key, piece, start, length, bin_id, bin_offset, bin_capacity): every token of every row placed once.

    A row longer than the largest capacity gives several pieces, in order of ``start``.
    Null or zero lengths give one piece of length 0 without a bin.  Repeated rows are packed
    each on its own; rows are ordered by length, then key, so ties do not matter.  Groups
    are dealt by a number of the row too, so one key with any share of the rows is spread
    over all of them; which row shares a group with which depends on how the input is cut
    into partitions.
    """
    top = max(capacities)
    rows = stored(df.select(F.col(key).alias("key"), F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("total"),
                            F.monotonically_increasing_id().alias("row")), "lengths")
    cut = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / top) - 1, F.lit(0)).cast("int"))).alias("piece")
    pieces = rows.select("key", "total", "row", cut).select(
        "key", "piece", "row", (F.col("piece").cast("long") * top).alias("start"),
        F.least(F.lit(top), F.col("total") - F.col("piece").cast("long") * top).alias("length"))
    n = rows.agg(F.sum(F.greatest(F.ceil(F.col("total") / top), F.lit(1)))).first()[0] or 0
    groups = max(1, -(-n // group))
    key_type = rows.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, piece int, start long, length long, bin_id string, bin_offset long, bin_capacity int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "key", "row", "piece"], ascending=[False, True, True, True], kind="stable")
        b, at, cap = best_fit(pdf["length"].to_numpy(), capacities, cost)
        name = str(pdf["grp"].iloc[0])
        return pdf.assign(bin_id=[f"{name}-{x}" for x in b], bin_offset=at, bin_capacity=cap.astype(np.int32)).drop(columns=["grp", "row"])

    spread = F.pmod(F.xxhash64("key", "piece", "length", "row"), F.lit(groups))
    packed = pieces.where("length > 0").withColumn("grp", spread).groupBy("grp").applyInPandas(run, schema)
    empty = pieces.where("length <= 0").select(
        "key", "piece", "start", "length", F.lit(None).cast("string").alias("bin_id"),
        F.lit(None).cast("long").alias("bin_offset"), F.lit(None).cast("int").alias("bin_capacity"))
    return packed.unionByName(empty).withColumnRenamed("key", key)


def packed_documents(docs: DataFrame) -> DataFrame:
    """Documents packed by their number of words."""
    return pack(docs.select("doc_id", F.regexp_count("text", F.lit(WORD)).alias("n_words")), "doc_id", "n_words")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_documents(docs)
