"""Small shared pieces of the llm operators: folds, scratch tables, byte views, components.

Texts reach Python as Arrow batches and are handled as flat byte arrays: ``spans`` gives
the bytes of a whole chunk of documents and ``words`` finds every word in it, so no
Python object is made per word.  A chunk holds ``CHUNK_BYTES`` of text (or one longer
document), which bounds a task's memory.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.session import _SCRATCH, scratch_path

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Text bytes handled at once inside a task.
CHUNK_BYTES = 2 << 20
#: Stands for a null id inside an operator, so that such rows rank last.
NULL_ID = (1 << 63) - 1

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text modulo 4; null ids have no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def known_id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID))


def given_id(doc_id: Column) -> Column:
    return F.when(doc_id != NULL_ID, doc_id)


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``used`` in one struct, and the columns that give the table back.

    An operator's own columns then cannot clash with the table's, whatever their names.
    """
    rest = [c for c in docs.columns if c not in used]
    if not rest:
        return docs, [F.col(c) for c in docs.columns]
    kept = docs.select(*[F.col(c) for c in used if c in docs.columns], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest"))
    return kept, [F.col("__rest").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the folder of a table that ``stored`` gave and nothing reads any more."""
    spark = df.sparkSession
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for at in [p for p in _SCRATCH if p.rsplit("/", 1)[-1] in names]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _SCRATCH.remove(at)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results are stored.

    Spark removes a shuffle once the driver's JVM has collected the plan that made it, which
    in a driver with room may be long after the last use; a collection makes it do so now.
    Python objects that hold plans (those in cycles too) have to go first; py4j tells the JVM
    of them from a thread that looks once a second.  What a first collection releases may
    hold more plans, so there is a second one.
    """
    gc.collect()
    time.sleep(1.2)
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def let_go(spark: SparkSession) -> None:
    """What ``free_shuffles`` does, without waiting for it: for steps in turn, whose plans and sent tables fill the driver."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` documents, as a batch is held whole by a task."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def chunks(batches, text: str, size: int = CHUNK_BYTES):
    """Slices of the record batches, each with at most ``size`` text bytes (one document at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = raw(batch.column(batch.schema.get_field_index(text)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def words(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word's index of each document (n+1)."""
    full = ~_SPACE[flat]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    cuts = at[(at > 0) & (at < len(flat))]
    first[cuts] = full[cuts]
    last[cuts - 1] = full[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def lower(flat: np.ndarray) -> np.ndarray:
    return _LOWER[flat]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial fingerprints modulo 2^64 of any ranges of a sequence of numbers.

    The power tables are kept and grow with the longest sequence seen.
    """

    def __init__(self, base: int):
        self.base = base | 1
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def tables(self, n: int) -> None:
        if len(self.power) < n:
            m = max(n, 2 * len(self.power))
            for name, b in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                t = np.full(m, b, np.uint64)
                t[0] = 1
                setattr(self, name, np.multiply.accumulate(t))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self.tables(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.power[:len(values)], dtype=np.uint64, out=out[1:])
        return out

    def of(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((prefix[hi] - prefix[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64))


#: Word bytes fingerprinted at once (or one longer word).
WORD_BYTES = 1 << 20


def word_hashes(roll: Rolling, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprint of every word; the power table is as long as the longest word, and nothing else as the text."""
    size = ends - starts
    if not len(size):
        return np.zeros(0, np.uint64)
    roll.tables(int(size.max()))
    through = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(len(size), np.uint64)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(through, through[lo] + WORD_BYTES, "right")) - 1)
        first = through[lo:hi] - through[lo]
        inside = np.arange(int(through[hi] - through[lo])) - np.repeat(first, size[lo:hi])
        letters = flat[inside + np.repeat(starts[lo:hi], size[lo:hi])].astype(np.uint64) + np.uint64(1)
        out[lo:hi] = np.add.reduceat(letters * roll.power[inside], first)
        lo = hi
    return mix(out + size.astype(np.uint64))


def tie(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a and b; roots are the least index."""
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root[:] = root[root]


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Connected components: (node, root) for every node of ``edges`` (a, b); root is the least node.

    Large-star and small-star steps in turn: each round is two grouped minima over the
    edges and halves the distances to the root.  The only hub that gathers edges is a
    root, whose edges arrive as already combined minima.  Every round is written to the
    shared folder; only whether stars are left reaches the driver.  The rounds end with the
    first that leaves stars alone, and what the driver holds of each is let go.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        let_go(spark)
        if _stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        now = stored(small, "edges")
    else:
        raise RuntimeError(f"components did not settle within {rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stored(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")


def _stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (u, v) is either a centre v or the u of one edge."""
    ends = (edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")),
                                           F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*"))
    return (ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("centre"))
            .where("out > 1 or out = 1 and centre = 0").isEmpty())
