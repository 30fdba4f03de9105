"""Byte-level BPE by overlapping chunks.

Long texts are cut into chunks that overlap; every chunk is split into pre-tokens on its
own, in parallel.  Splitting looks only forward, so from any position where two chunks
both have a pre-token boundary they agree: the stitch switches to the next chunk at the
first such boundary in their overlap.  Where none lies there (a pre-token longer than the
overlap) the stitch splits again from the last sure boundary over the joined text.  The
stitched pieces are then merged by rank.  Texts of one chunk skip the shuffle.

Decoding joins the raw bytes of the ids; bytes need not be valid UTF-8 in between.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracity.llm.common import documents, small_batches

CHUNK, OVERLAP = 32_768, 256
#: Characters after a boundary that must be known before it is sure: contractions look two ahead.
MARGIN = 4
#: Distinct pieces a task remembers; beyond it the memory starts afresh.
CACHE = 400_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks from a tiktoken file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: join the adjacent pair of least rank (leftmost first) until none has one."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, where = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, where = r, i
        if best is None:
            break
        parts[where:where + 2] = [parts[where] + parts[where + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """As ``merge`` with a heap and links, n log n for very long pieces."""
    import heapq
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < n:
            r = ranks.get(parts[i] + parts[j])
            if r is not None:
                heapq.heappush(heap, (r, i, len(parts[i]), len(parts[j])))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if parts[i] is None or len(parts[i]) != a:
            continue
        j = after[i]
        if j >= n or len(parts[j]) != b:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Pieces to packed ids, remembered within a task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split, self.known = ranks, regex.compile(pattern), {}

    def pack(self, pieces: list[str]) -> bytes:
        """Ids of the pieces in order, as little-endian int32."""
        if len(self.known) > CACHE:
            self.known = {}
        known, ranks = self.known, self.ranks
        for p in set(pieces).difference(known):
            known[p] = np.array(merge(p.encode("utf-8"), ranks), "<i4").tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def stitch(self, texts: list[str], ends: list[np.ndarray], step: int) -> bytes:
        """Ids of the text whose chunks start every ``step`` characters and run into the next one."""
        out, text, cut, start = [], texts[0], ends[0], 0
        base = 0  # where ``text`` begins in the whole text
        for i in range(1, len(texts)):
            sure = cut[(cut <= len(text) - MARGIN) & (cut >= start)]  # a later character cannot move these
            meet = np.intersect1d(sure, np.concatenate([[0], ends[i]]) + (i * step - base))
            if len(meet):
                out.append(self.pack(_pieces(text, start, cut[(cut > start) & (cut <= meet[0])])))
                start = int(meet[0]) - (i * step - base)
                text, cut, base = texts[i], ends[i], i * step
                continue
            last = int(sure[-1]) if len(sure) else start
            out.append(self.pack(_pieces(text, start, cut[(cut > start) & (cut <= last)])))
            text = text[last:i * step - base] + texts[i]
            base, start = base + last, 0
            cut = self.ends(text)
        out.append(self.pack(_pieces(text, start, cut[cut > start])))
        return b"".join(out)

    def ends(self, text: str) -> np.ndarray:
        return np.fromiter((m.end() for m in self.split.finditer(text)), np.int32)


def _pieces(text: str, start: int, ends: np.ndarray) -> list[str]:
    out = []
    for e in ends.tolist():
        out.append(text[start:e])
        start = e
    return out


def _listed(packed: list[bytes]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text",
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids) for every row: the BPE ids of the whole text.

    A null or empty text has no ids.  Repeated rows each give a row.  The vocabulary file
    must be readable on the driver; its ranks are broadcast (fixed size).
    """
    spark = docs.sparkSession
    small_batches(spark, 400)
    ranks = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    key_type = docs.schema[key].dataType.simpleString()

    def short(batches):
        enc = Encoder(ranks.value, pattern)
        for b in batches:
            packed = [enc.pack(enc.split.findall(t) if t else []) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _listed(packed)], ["key", "ids"])

    def cut(batches):
        for b in batches:
            for k, h, t in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for i, at in enumerate(range(0, len(t), chunk)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k.as_py()], b.schema.field(0).type), pa.array([h]), pa.array([i], pa.int32()),
                         pa.array([t[at:at + chunk + overlap]])], ["key", "whole", "i", "part"])

    def split(batches):
        enc = Encoder({}, pattern)
        for b in batches:
            ends = [enc.ends(t).tobytes() for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends, pa.binary())], [*b.schema.names, "ends"])

    encoders = {}

    def join(table):
        # Equal rows of one key meet here: their chunks are equal, and each gives a result.
        enc = encoders.setdefault(0, Encoder(ranks.value, pattern))
        i = table.column("i").to_numpy()
        order, first = np.unique(i, return_index=True)
        parts, ends = table.column("part"), table.column("ends")
        packed = enc.stitch([parts[int(j)].as_py() for j in first],
                            [np.frombuffer(ends[int(j)].as_py(), np.int32) for j in first], chunk)
        n = int((i == 0).sum())
        return pa.table({"key": table.column("key").slice(0, 1).combine_chunks().take(pa.array([0] * n)),
                         "ids": _listed([packed] * n)})

    schema = f"key {key_type}, ids array<int>"
    few = rows.where(F.length("text") <= chunk).mapInArrow(short, schema)
    many = (rows.where(F.length("text") > chunk).select("key", F.md5("text").alias("whole"), "text")
            .mapInArrow(cut, f"key {key_type}, whole string, i int, part string")
            .repartition("key", "whole", "i")
            .mapInArrow(split, f"key {key_type}, whole string, i int, part string, ends binary")
            .groupBy("key", "whole").applyInArrow(join, schema))
    return few.unionByName(many).select(F.col("key").alias(key), "ids")


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the joined raw bytes of each id list (null list: null; unknown ids fail)."""
    spark = df.sparkSession
    ranks = read_ranks(spark, ranks_path)
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for k, v in ranks.items():
        size[v] = len(k)
    flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)
    table = spark.sparkContext.broadcast((flat, np.concatenate([[0], np.cumsum(size)])))
    df = df.drop(out)
    where = df.columns.index(ids)
    schema = T.StructType([*df.schema, T.StructField(out, T.BinaryType())])

    def run(batches):
        flat, at = table.value
        for b in batches:
            col = b.column(where)
            lists = [None if not x.is_valid else x.values.to_numpy(zero_copy_only=False) for x in col]
            got = [None if x is None else _bytes(x, flat, at) for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def _bytes(ids: np.ndarray, flat: np.ndarray, at: np.ndarray) -> bytes:
    if not len(ids):
        return b""
    size = at[ids + 1] - at[ids]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1]) + np.repeat(at[ids] - ends + size, size)].tobytes()


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = decode(encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
