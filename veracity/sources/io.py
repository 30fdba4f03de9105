"""Readers and writers.

JSON shapes the reference reads are mapped onto DataFrames; writes go
through Spark's committers (one writer per task, atomic job commit), which
removes the every-rank-writes-the-same-file race of the original.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_columnar_json(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
                       schema: StructType | None = None) -> DataFrame:
    """One JSON object ``{column: [values...]}`` -> one row per list position.

    ``row_idx`` keeps the file order.  The file is a single JSON value, so the
    parse itself is one task per file; everything after it is distributed.
    """
    r = spark.read.option("multiLine", True)
    raw = (r.schema(schema) if schema is not None else r).json(path)
    cols = list(columns or raw.columns)
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in cols])
    out = raw.select(F.posexplode(zipped).alias("row_idx", "_z"))
    return out.select(F.col("row_idx").cast("bigint"), *[F.col(f"_z.{c}").alias(c) for c in cols])


def read_record_json(spark: SparkSession, path: str,
                     required: Sequence[str] = ("question", "answer", "negative_answer")) -> DataFrame:
    """JSON list of records; exactly ``required`` columns (a missing key fails)."""
    df = spark.read.option("multiLine", True).json(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"records lack required keys: {missing}")
    return df.select(*required)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON Lines (splittable, the format to use at scale)."""
    r = spark.read
    return (r.schema(schema) if schema is not None else r).json(path)


HEAD_BYTES = 1 << 20


def _head(spark: SparkSession, path: str) -> tuple[str, bool, bool]:
    """Up to ``HEAD_BYTES`` of the file (of a folder: its first data file), whether that is all of it, and whether it is the only file.

    Only these bytes are read, through Spark's file systems.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    status = fs.getFileStatus(where)
    files = [status]
    if status.isDirectory():
        files = sorted((st for st in fs.listStatus(where) if st.isFile() and st.getLen() > 0
                        and not st.getPath().getName().startswith(("_", "."))), key=lambda st: st.getPath().toString())
        if not files:
            raise ValueError(f"no data files under {path}")
    stream = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(  # noqa: SLF001
        spark.sparkContext._jsc.hadoopConfiguration()).getCodec(files[0].getPath())  # noqa: SLF001
    opened = fs.open(files[0].getPath())
    try:
        data = bytes((stream.createInputStream(opened) if stream else opened).readNBytes(HEAD_BYTES))
    finally:
        opened.close()
    return data.decode("utf-8", "replace"), len(data) < HEAD_BYTES, len(files) == 1


def sniff_format(spark: SparkSession, path: str) -> str:
    """``records``, ``columnar``, ``jsonl`` or ``parquet``.

    A file is columnar only if one object spans it and every field of it is a
    list, all of one length: a second value after the first makes it JSON
    Lines, whatever the first line's fields are, and so do several files.  An
    object that does not end within ``HEAD_BYTES`` is JSON Lines if two lines
    of the table are objects by themselves.  Neither the number of records nor
    a bad line plays a part; a caller that knows better names the format.
    """
    head, all_of_it, alone = _head(spark, path)
    head = head.lstrip("\ufeff \t\r\n")
    if head.startswith("["):
        return "records"
    if not head.startswith("{"):
        return "parquet"
    first = head.split("\n", 1)[0].rstrip()
    try:
        value, end = json.JSONDecoder(strict=False).raw_decode(head)
    except ValueError:
        value, end = None, len(head)
    if value is None:  # longer than the head, or no JSON
        if all_of_it or _object_lines(spark, path) > 1:
            return "jsonl"
        return "columnar" if re.match(r'\{\s*"(?:[^"\\]|\\.)*"\s*:\s*\[', head) else "records"
    if head[end:].strip() or not all_of_it or not alone:
        return "jsonl" if first.endswith("}") else "records"
    lists = [v for v in value.values() if isinstance(v, list)]
    if value and len(lists) == len(value) and len({len(v) for v in lists}) == 1 and not any(isinstance(x, dict) for v in lists for x in v):
        return "columnar"
    return "jsonl" if len(first) >= end else "records"


def _object_lines(spark: SparkSession, path: str) -> int:
    """Lines that are an object by themselves, counted up to two."""
    line = F.trim("value")
    return spark.read.text(path).where(line.startswith("{") & line.endswith("}")).limit(2).count()


def read_checked(spark: SparkSession, path: str, fmt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of a file in any of the formats, and the lines that are not rows (``line``).

    Bad lines of JSON Lines never change how the others are read; the other
    formats are one value, so they are read whole or fail.
    """
    fmt = fmt or sniff_format(spark, path)
    none = spark.createDataFrame([], "line string")
    if fmt == "records":
        return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path), none
    if fmt == "columnar":
        return read_columnar_json(spark, path), none
    if fmt == "parquet":
        return spark.read.parquet(path), none
    if fmt != "jsonl":
        raise ValueError(f"unknown format {fmt!r}")
    bad = "_corrupt_record"
    inferred = [f for f in spark.read.json(path).schema.fields if f.name != bad]
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if not inferred:
        return spark.createDataFrame([], StructType([])), lines.select(F.col("value").alias("line"))
    schema = StructType([*inferred, StructField(bad, StringType())])
    parsed = lines.select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": bad}).alias("row"))
    good = F.col("row").isNotNull() & F.col(f"row.{bad}").isNull()
    return (parsed.filter(good).select(*[F.col(f"row.`{f.name}`") for f in inferred]),
            parsed.filter(~good).select(F.col("value").alias("line")))


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """The good rows of ``read_checked``; use that to see the lines left out."""
    return read_checked(spark, path, fmt)[0]


def read_split(df: DataFrame, prefer: Sequence[str] = ("validation", "test"),
               split_col: str = "split") -> DataFrame:
    """Rows of the first available split in ``prefer`` order (error when none exists).

    Which splits exist is one distinct over the split column restricted to
    ``prefer`` (at most ``len(prefer)`` values reach the driver); the result is
    a literal filter, so a table partitioned by split is pruned to one folder.
    """
    present = {r[0] for r in df.filter(F.col(split_col).isin(*prefer)).select(split_col).distinct().collect()}
    for name in prefer:
        if name in present:
            return df.filter(F.col(split_col) == name)
    raise ValueError(f"none of the splits {list(prefer)} is present")


def write_records(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "json") -> None:
    """Write result records (JSON lines by default)."""
    df.write.mode(mode).format(fmt).save(path)


def write_snapshots(df: DataFrame, path: str, every: int = 100, index: str = "row_idx",
                    partition: bool = False) -> None:
    """Progress snapshots every ``every`` items.

    A Spark write is atomic, so there is no half-written file to protect
    against; the snapshot number is recorded as a column.  ``partition=True``
    also makes one folder per snapshot (clustered first, one file each) -
    only sensible for coarse ``every``, since fine snapshots mean many tiny
    files.
    """
    d = df.withColumn("snapshot", F.floor(F.col(index) / every).cast("bigint"))
    if partition:
        d.repartition("snapshot").write.mode("overwrite").partitionBy("snapshot").json(path)
    else:
        d.write.mode("overwrite").json(path)


def to_metric_log(df: DataFrame, run_id: str, step: str, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Wide metric rows -> long ``(run_id, *keys, step, metric, value)`` rows."""
    wide = df.select(*keys, step, *[F.col(m).cast("double").alias(m) for m in metrics])  # one value type
    long = wide.unpivot([*keys, step], list(metrics), "metric", "value")
    return long.select(F.lit(run_id).alias("run_id"), *keys, F.col(step).alias("step"), "metric",
                       F.col("value").cast("double").alias("value"))


def append_metric_log(df: DataFrame, path: str) -> None:
    """Append metric rows to the log table."""
    df.write.mode("append").parquet(path)
