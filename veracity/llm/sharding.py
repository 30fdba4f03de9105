"""Byte-bounded shards by extendible hashing.

A row's key hash (md5 of the key, read as bits) starts in the bucket of its first bit
prefix; a bucket above the byte limit splits on the next bit and no other bucket is
touched.  The directory is made from a histogram over hash prefixes, never from rows:
each round sums bytes for every prefix of ``step`` further bits inside the buckets that
are still too large, in one combined aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracity.llm.common import documents, stored

#: Bits of md5 that are used; buckets that are still too large there hold equal keys.
MAX_BITS = 60


def bits(*columns) -> F.Column:
    """First 60 bits of the md5 of the columns' text (joined by a unit separator), as 0/1 text."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    whole = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 2)
    return F.lpad(whole, MAX_BITS, "0")


def directory(sizes: DataFrame, limit: int, step: int = 10) -> DataFrame:
    """(prefix, depth, shard_bytes, n_rows) of every bucket of the final directory.

    ``sizes`` has _bits and _bytes.  A bucket is the shortest prefix whose bytes fit the
    limit; at ``MAX_BITS`` a bucket stays as it is.  Empty buckets are not listed.
    """
    open_rows, found, low = sizes.select("_bits", "_bytes"), None, 0
    while True:
        high = min(low + step, MAX_BITS)
        cells = open_rows.groupBy(F.substring("_bits", 1, high).alias("cell")).agg(
            F.sum("_bytes").alias("bytes"), F.count("*").alias("rows"))
        totals = cells.select(F.explode(F.transform(F.sequence(F.lit(low), F.lit(high)),
                                                    lambda d: F.struct(d.alias("depth"), F.substring("cell", F.lit(1), d).alias("prefix")))).alias("p"),
                              "bytes", "rows") \
            .groupBy("p.prefix", "p.depth").agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("n_rows"))
        totals = stored(totals, "shards")
        # A prefix is a bucket if it fits and its parent, one bit shorter, does not.
        parent = totals.where(F.col("shard_bytes") > limit).select(F.col("prefix").alias("over"))
        fits = totals.where((F.col("shard_bytes") <= limit) | (F.col("depth") == MAX_BITS))
        first = fits.where("depth = 0") if low == 0 else fits.limit(0)
        inner = fits.where(F.col("depth") > low).join(parent, F.expr("substring(prefix, 1, depth - 1) = over"), "left_semi")
        new = first.unionByName(inner)
        found = new if found is None else found.unionByName(new)
        left = totals.where((F.col("depth") == high) & (F.col("shard_bytes") > limit)).select(F.col("prefix").alias("over"))
        if high == MAX_BITS or left.isEmpty():
            return found
        open_rows = open_rows.join(left, F.substring("_bits", 1, high) == F.col("over"), "left_semi")
        low = high


def assign(df: DataFrame, key: list[str], size: F.Column, limit: int) -> DataFrame:
    """Each row with shard (bit prefix), depth, shard_bytes and row_bytes, replacing such columns.

    Every shard fits ``limit`` bytes, or is a single row above it.  Rows whose keys agree in
    all hash bits cannot be told apart by splitting; their bucket is cut into pages
    (``prefix.group.page``, shard_bytes the page's) by a hash of the row and then running size.
    Null keys hash like any value; null sizes count 0; an empty table gives no row.
    """
    names = ["shard", "depth", "shard_bytes", "row_bytes"]
    rows = df.withColumn("_bytes", F.coalesce(size.cast("long"), F.lit(0))).withColumn("_bits", bits(*key))
    kept = [c for c in df.columns if c not in names]
    table = stored(directory(rows, limit), "directory")
    depths = [r.depth for r in table.select("depth").distinct().orderBy("depth").collect()]  # at most 61 numbers
    # A row offers one prefix for each depth in use and meets its only bucket by equality.
    offers = F.explode(F.array(*[F.substring("_bits", 1, d) for d in depths] or [F.lit("")]))
    placed = rows.withColumn("_at", offers).join(table.withColumnRenamed("prefix", "_at"), "_at") \
        .select(*[rows[c] for c in kept], "_bytes", F.col("_at"), F.col("depth"), F.col("shard_bytes"))
    whole = placed.where(F.col("shard_bytes") <= limit).select(
        *kept, F.col("_at").alias("shard"), "depth", "shard_bytes", F.col("_bytes").alias("row_bytes"))
    groups = F.ceil(F.col("shard_bytes") * 4 / limit)
    group = F.pmod(F.xxhash64(*[F.col(c) for c in kept]), groups)
    run = Window.partitionBy("_at", "_group", "_large").orderBy(*kept).rowsBetween(Window.unboundedPreceding, -1)
    paged = placed.where(F.col("shard_bytes") > limit).withColumn("_group", group) \
        .withColumn("_large", F.col("_bytes") > limit // 2)
    before = F.coalesce(F.sum(F.when(F.col("_large"), limit).otherwise(F.col("_bytes"))).over(run), F.lit(0))
    paged = paged.withColumn("_page", F.floor(before / F.when(F.col("_large"), limit).otherwise(limit - limit // 2))) \
        .withColumn("shard", F.concat_ws(".", "_at", "_group", F.concat(F.when(F.col("_large"), "L").otherwise("S"), F.col("_page"))))
    pages = paged.groupBy("shard").agg(F.sum("_bytes").alias("_total"))
    paged = paged.join(pages, "shard").select(*kept, "shard", "depth", F.col("_total").alias("shard_bytes"),
                                              F.col("_bytes").alias("row_bytes"))
    return whole.unionByName(paged)


def op4_extendible_shards(spark: SparkSession, sf_dir: str, limit: int = 1 << 20) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.octet_length("text").alias("_n"))
    return assign(docs, ["doc_id"], F.col("_n"), limit).select("doc_id", "row_bytes", "shard", "depth", "shard_bytes")


ORACLE_SQL = """
WITH sized AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS row_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents),
prefixes AS (
  SELECT d AS depth, substr(bits, 1, d) AS prefix, sum(row_bytes) AS shard_bytes
  FROM sized, (SELECT unnest(range(0, 25)) AS d) GROUP BY ALL),
buckets AS (
  SELECT p.* FROM prefixes p LEFT JOIN prefixes q ON q.depth = p.depth - 1 AND q.prefix = substr(p.prefix, 1, q.depth)
  WHERE p.shard_bytes <= 1048576 AND (p.depth = 0 OR q.shard_bytes > 1048576))
SELECT doc_id, row_bytes, prefix AS shard, CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM sized JOIN buckets ON substr(bits, 1, buckets.depth) = prefix
"""
