"""Quality rules: text statistics and an n-gram log-likelihood ratio.

The ratio compares two multinomials over word n-grams (one and two words): trusted
documents (labels with quality 1) against the raw corpus, which is every document.  Both
are counted in Spark by the n-gram's 64-bit fingerprint, and stay a table as long as the
corpus has distinct n-grams; one with little evidence is drawn towards ratio one.  The
common n-grams (at most ``COMMON``) are sent to all tasks, so no key of the join of the
documents' other n-grams with the table is large.  A document's score is the mean log
ratio of its n-grams; a document is kept if that reaches the threshold, a fixed low
quantile, less a margin, of the scores of trusted documents (one crc32 fold) that the
target has not seen.

A corpus that is scored by its own counts (the query) needs no table of them.  Its n-grams
are dealt by fingerprint in ``PASSES`` passes, packed: for a piece of the corpus and a range
of fingerprints the sorted fingerprints, each with its documents.  A task that holds a range
of all pieces counts its n-grams and gives each document's sum of their log ratios.
"""

from __future__ import annotations

import math
import zlib  # noqa: F401  (the tests take crc32 from here)

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracity.llm.common import Rolling, chunks, documents, fold, free_shuffles, mix, raw, small_batches, stored, word_hashes, words
from veracity.operators.rows import with_row_index

#: An n-gram is common from one in so many of all, so there are no more of them than this.
COMMON = 1 << 20
#: Chunks of text whose n-grams a task sums up before it hands them on.
SUMMED = 8
#: Trusted ids that a join sends to every task (9 bytes each) instead of moving texts.
SENT_IDS = 4_000_000
#: Passes over the corpus, each of which moves its share of the n-grams.
PASSES = 2
#: Bytes of text, and documents, of a piece of the corpus whose n-grams are packed at once.
PIECE_BYTES = 16 << 20
PIECE_DOCS = 60_000
#: Ranges of fingerprints in a pass (at least), and n-grams with repeats in one (about, at most).
RANGES = 16
RANGE_GRAMS = 4 << 20
SYMBOLS = "#*$%&|<>"
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def _grams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words and of the pairs within a document, and each one's document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    two = mix(h[pair] * np.uint64(3) + h[pair + 1])
    return np.concatenate([mix(h), two]).view(np.int64), np.concatenate([doc, doc[pair]])


def _summed(gram: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, back = np.unique(gram, return_inverse=True)
    return (keys, *(np.bincount(back, weights=x, minlength=len(keys)).astype(np.int64) for x in (n, good)))


def _each(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each document's range."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _again(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every element: does an earlier one equal it, does any other one (same key and group)."""
    order = np.lexsort((keys, groups))
    same = (keys[order][1:] == keys[order][:-1]) & (groups[order][1:] == groups[order][:-1])
    earlier, other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:]] = same
    other[order[1:]] = same
    other[order[:-1]] |= same
    return earlier, other


def _profile(roll: Rolling, seq: Rolling, flat: np.ndarray, at: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    starts, ends, first = words(flat, at)
    h = word_hashes(roll, flat, starts, ends)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    point = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[flat])])
    out = {"n_words": n, "word_chars": _each(point[ends] - point[starts], first), "n_symbols": symbol[at[1:]] - symbol[at[:-1]]}

    breaks = np.flatnonzero(flat == 10)
    lo = np.unique(np.concatenate([at[:-1][at[:-1] < at[1:]], breaks + 1]))
    lo = lo[lo < len(flat)]
    line_doc = np.searchsorted(at, lo, "right") - 1
    brk = np.concatenate([breaks, [len(flat)]])
    hi = np.minimum(brk[np.searchsorted(brk, lo)], at[line_doc + 1])
    has = np.searchsorted(starts, hi) > np.searchsorted(starts, lo)
    lo, hi, line_doc = lo[has], hi[has], line_doc[has]
    earlier, _ = _again(roll.of(roll.prefix(flat.astype(np.uint64) + np.uint64(1)), lo, hi), line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[earlier], minlength=len(n))

    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) >= WINDOW:
        s = np.arange(len(h) - WINDOW + 1)
        s = s[doc[s] == doc[s + WINDOW - 1]]
        _, other = _again(seq.of(seq.prefix(h), s, s + WINDOW), doc[s])
        np.add.at(covered, s[other], 1)
        np.add.at(covered, s[other] + WINDOW, -1)
    out["n_repeat_words"] = _each((np.cumsum(covered)[:-1] > 0).astype(np.int64), first)
    return out, h, first


def _trusted(labels: DataFrame) -> DataFrame:
    """(doc_id, unseen): every trusted document's id, and whether the target does not see it."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1")
            .select("doc_id", (fold(F.col("doc_id")) == 3).alias("unseen")))


def _marked(docs: DataFrame, trusted: DataFrame, column: str) -> DataFrame:
    """``docs`` (doc_id a long) with ``column``: null for an untrusted document, else whether the target does not see it.

    Up to ``SENT_IDS`` trusted ids go to every task, so that no text moves; beyond, both sides are shuffled.
    """
    ids = trusted.select(F.col("doc_id").alias("_trusted"), F.col("unseen").alias(column))
    ids = F.broadcast(ids) if trusted.count() <= SENT_IDS else ids
    return docs.join(ids, F.col("doc_id") == F.col("_trusted"), "left").drop("_trusted")


def _ratios(docs: DataFrame, trusted: DataFrame, evidence: float) -> dict:
    """Log ratio of every n-gram of ``docs``: the common ones as arrays, the others as a table (gram, ratio)."""
    spark = docs.sparkSession
    small_batches(spark)

    def count(batches):
        roll, held = Rolling(0x9E3779B97F4A7C15), []

        def summed():
            found = _summed(*map(np.concatenate, zip(*held)))
            held.clear()
            for lo in range(0, len(found[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[lo:lo + 100_000]) for x in found], ["gram", "n", "good"])

        for part in chunks(batches, "text"):
            flat, at = raw(part.column(1))
            starts, ends, first = words(flat, at)
            gram, doc = _grams(word_hashes(roll, flat, starts, ends), first)
            own = part.column(0).to_numpy(zero_copy_only=False)
            held.append(_summed(gram, np.ones(len(gram)), own[doc]))
            if len(held) == SUMMED:
                yield from summed()
        if held:
            yield from summed()

    seen = F.coalesce(~F.col("_unseen"), F.lit(False)).alias("seen")
    texts = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), trusted, "_unseen").select(seen, "text")
    counts = stored(texts.mapInArrow(count, "gram long, n long, good long").groupBy("gram")
                    .agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "ngrams")
    n, good = counts.agg(F.sum("n"), F.sum("good")).first()
    if not good:
        return {"common": (np.zeros(0, np.int64), np.zeros(0)), "others": None}
    ratio = F.log((F.col("good") + float(evidence)) / (F.col("n") * (good / n) + float(evidence))).alias("ratio")
    common = F.col("n") * COMMON >= n
    rows = counts.where(common).select("gram", ratio).toPandas().sort_values("gram")  # at most COMMON rows
    return {"common": (rows["gram"].to_numpy(np.int64), rows["ratio"].to_numpy(float)),
            "others": counts.where(~common).select("gram", ratio)}


def _threshold(scored: DataFrame, trusted: DataFrame, quantile: float, margin: float) -> float:
    """The threshold from the scores of all unseen trusted documents among ``scored``."""
    rows = scored.where("n_words >= 10 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "score")
    own = stored(_marked(rows, trusted, "_unseen").where("_unseen").select("score"), "unseen-scores")
    n = own.count()
    if not n:
        return -math.inf
    at = math.floor((n - 1) * quantile)
    return with_row_index(own, "score").where(F.col("row_idx") == at).first()["score"] - margin


def train(docs: DataFrame, labels: DataFrame, evidence: float = 5.0, quantile: float = 0.001,
          margin: float = 0.05) -> dict:
    """Log ratio of every n-gram, and the threshold.

    ``labels`` has doc_id and quality; rows with nulls are ignored, an id with both labels
    is not trusted.  Without trusted documents every ratio is 0 and everything passes.
    """
    trusted = stored(_trusted(labels), "trusted")
    model = _ratios(docs, trusted, evidence)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    inside = _marked(texts, trusted, "_unseen").where("_unseen").select("doc_id", "text")
    model["threshold"] = _threshold(_scored(inside, model), trusted, quantile, margin)
    return model


STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scored(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, statistics, score) of every row; n-grams that the model has not counted have ratio 0."""
    spark = docs.sparkSession
    small_batches(spark)
    sent, joined = spark.sparkContext.broadcast(model["common"]), model["others"] is not None
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    own = ["row", "doc_id", *STATISTICS, "n_grams", "common"]
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           *[T.StructField(c, T.LongType()) for c in [*STATISTICS, "n_grams"]], T.StructField("common", T.DoubleType()),
                           T.StructField("gram", T.LongType()), T.StructField("k", T.LongType())])

    def run(batches):
        """A row for each document and, with ``k``, one for each of its n-grams that are not common."""
        roll, seq = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)
        keys, ratio = sent.value
        for part in chunks(batches, "text"):
            out, h, first = _profile(roll, seq, *raw(part.column(2)))
            gram, doc = _grams(h, first)
            out["n_grams"] = np.bincount(doc, minlength=part.num_rows)
            at = np.minimum(np.searchsorted(keys, gram), max(len(keys) - 1, 0))
            hit = keys[at] == gram if len(keys) else np.zeros(len(gram), bool)
            common = np.bincount(doc[hit], weights=ratio[at[hit]], minlength=part.num_rows)
            number = part.column(0).to_numpy()
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *[pa.array(out[c].astype(np.int64)) for c in [*STATISTICS, "n_grams"]],
                 pa.array(common.astype(float)), pa.array(mix(number.astype(np.uint64)).view(np.int64)), none], [*own, "gram", "k"])
            if not joined:
                continue
            gram, doc = gram[~hit], doc[~hit]
            order = np.lexsort((gram, doc))
            gram, doc = gram[order], doc[order]
            new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1]))) if len(gram) else np.zeros(0, int)
            k = np.diff(np.append(new, len(gram)))
            for lo in range(0, len(new), 100_000):
                s = slice(lo, lo + 100_000)
                n = len(new[s])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(number[doc[new[s]]]), pa.nulls(n, part.column(1).type), *[pa.nulls(n, pa.int64())] * (len(STATISTICS) + 1),
                     pa.nulls(n, pa.float64()), pa.array(gram[new[s]]), pa.array(k[s])], [*own, "gram", "k"])

    got = rows.mapInArrow(run, schema)
    total = F.col("common")
    if joined:
        others = model["others"].select(F.col("gram").alias("other"), "ratio")
        got = (got.join(others, (F.col("gram") == F.col("other")) & F.col("k").isNotNull(), "left").groupBy("row")
               .agg(*[F.max(c).alias(c) for c in own[1:]], F.coalesce(F.sum(F.col("k") * F.col("ratio")), F.lit(0.0)).alias("rest")))
        total = total + F.col("rest")
    return got.select("doc_id", *STATISTICS, (total / F.greatest("n_grams", F.lit(1))).alias("score"))


def _pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of equal bytes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def _packed(gram: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams in ascending order, each one's first pair, and the pairs' documents and counts."""
    order = np.argsort(gram)
    gram = gram[order]
    new = np.append(True, gram[1:] != gram[:-1])
    pair = np.sort(((np.cumsum(new) - 1).astype(np.uint64) << np.uint64(32)) | doc[order].astype(np.uint64))
    at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    of = (pair[at] >> np.uint64(32)).astype(np.int64)
    return gram[new], np.searchsorted(of, np.arange(int(new.sum()))), (pair[at] & np.uint64(0xFFFFFFFF)).astype("<u4"), np.diff(np.append(at, len(pair))).astype("<u4")


def _own_sums(texts: DataFrame, turn: int, ranges: int, share: float, evidence: float) -> DataFrame:
    """(key, part): for every document of ``texts`` (key, seen, text) its sum of log ratios over one pass's n-grams."""
    small_batches(texts.sparkSession)
    edges = [(turn * ranges + r << 64) // (PASSES * ranges) for r in range(ranges + 1)]
    lo, hi = np.uint64(edges[0]), np.uint64(edges[-1] - 1)

    def pack(batches):
        from pyspark import TaskContext
        roll, held, task = Rolling(0x9E3779B97F4A7C15), [], TaskContext.get().partitionId()
        piece = docs = size = 0

        def rows():
            gram, doc = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            name = (task << 40) + (piece << 20)
            found = piece % ranges  # the range that also hands on the documents' keys
            if len(gram):
                gram, first, docs_of, k = _packed(gram, doc)
                first = np.append(first, len(k))
                cut = np.append(np.searchsorted(gram, np.array(edges[:-1], np.uint64)), len(gram))
            else:
                gram, first, docs_of, k, cut = (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, "<u4"), np.zeros(0, "<u4"), np.zeros(ranges + 1, np.int64))
            for r in range(ranges):
                a, b = cut[r], cut[r + 1]
                if a == b and r != found:
                    continue
                g, at = gram[a:b], first[a:b + 1]
                s = slice(at[0], at[-1]) if a < b else slice(0, 0)
                yield [r, name, len(g), len(k[s]), np.concatenate([h[2] for h in held]).tobytes() if r == found else None,
                       _pack(np.diff(g, prepend=np.uint64(0))), _pack(np.diff(at).astype("<u4")), _pack(docs_of[s]), _pack(k[s])]

        def flushed():
            for row in rows():
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        schema = pa.schema([("range", pa.int32()), ("piece", pa.int64()), ("n_grams", pa.int32()), ("n_pairs", pa.int32()),
                            *[(c, pa.binary()) for c in ("keys", "gaps", "pairs", "docs", "counts")]])
        for part in chunks(batches, "text"):
            flat, at = raw(part.column(2))
            starts, ends, first = words(flat, at)
            gram, doc = _grams(word_hashes(roll, flat, starts, ends), first)
            gram = gram.view(np.uint64)
            mine = (gram >= lo) & (gram <= hi)
            seen = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((gram[mine], 2 * (doc[mine] + docs) + seen[doc[mine]], part.column(0).to_numpy()))
            docs, size = docs + part.num_rows, size + len(flat)
            if docs >= PIECE_DOCS or size >= PIECE_BYTES:
                yield from flushed()
                held.clear()
                piece, docs, size = piece + 1, 0, 0
        if held:
            yield from flushed()

    def count(t):
        names, sizes, pairs = t.column("piece").to_numpy(), t.column("n_grams").to_numpy(), t.column("n_pairs").to_numpy()
        blobs = {c: t.column(c).to_pylist() for c in ("keys", "gaps", "pairs", "docs", "counts")}

        def all_of(c, ns, kind, change=lambda v: v):
            return np.concatenate([change(_unpack(v, int(n), kind)) for v, n in zip(blobs[c], ns) if n] or [np.zeros(0, kind)])

        ids, keys, parts = [], [], []
        for name, k in zip(names, blobs["keys"]):
            if k is not None:
                own = np.frombuffer(k, np.int64)
                ids.append(name + np.arange(len(own)))
                keys.append(own)
                parts.append(np.zeros(len(own)))
        known = sum(map(len, keys))
        if sizes.sum():
            gram = all_of("gaps", sizes, "<u8", lambda v: np.cumsum(v, dtype=np.uint64))
            each = all_of("pairs", sizes, "<u4").astype(np.int64)
            doc, k = all_of("docs", pairs, "<u4").astype(np.int64), all_of("counts", pairs, "<u4").astype(np.int64)
            first = np.concatenate([[0], np.cumsum(each)])[:-1]
            n, good = np.add.reduceat(k, first), np.add.reduceat(k * (doc & 1), first)
            _, back = np.unique(gram, return_inverse=True)
            n, good = (np.bincount(back, weights=v) for v in (n, good))
            ratio = np.log((good + evidence) / (n * share + evidence))[back]
            one = np.repeat(names, pairs) + (doc >> 1)
            one, at = np.unique(one, return_inverse=True)
            ids.append(one)
            parts.append(np.bincount(at, weights=np.repeat(ratio, each) * k))
        ids, parts = np.concatenate(ids or [np.zeros(0, np.int64)]), np.concatenate(parts or [np.zeros(0)])
        keys = pa.concat_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.nulls(len(ids) - known, pa.int64())])
        return pa.table({"id": ids, "key": keys, "part": parts})

    blobs = texts.select("key", "seen", "text").mapInArrow(
        pack, "range int, piece long, n_grams int, n_pairs int, keys binary, gaps binary, pairs binary, docs binary, counts binary")
    return (blobs.groupBy("range").applyInArrow(count, "id long, key long, part double")
            .groupBy("id").agg(F.max("key").alias("key"), F.sum("part").alias("part"))
            .groupBy("key").agg(F.avg("part").alias("part")))  # rows of one key have equal ids and texts


def _own_scores(docs: DataFrame, trusted: DataFrame, evidence: float) -> DataFrame:
    """``_scored`` of ``docs`` by the ratios of their own counts, without a table of these."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           *[T.StructField(c, T.LongType()) for c in STATISTICS]])

    def profile(batches):
        roll, seq = Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)
        for part in chunks(batches, "text"):
            out, _, _ = _profile(roll, seq, *raw(part.column(2)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(out[c].astype(np.int64)) for c in STATISTICS]],
                                             ["key", "doc_id", *STATISTICS])

    grams = F.when(F.col("n_words") > 0, 2 * F.col("n_words") - 1).otherwise(0)
    own = stored(rows.mapInArrow(profile, schema).withColumn("n_grams", grams), "profiles")
    seen = F.coalesce(~F.col("_unseen"), F.lit(False)).alias("seen")
    marked = _marked(own.select(F.col("doc_id").cast("long").alias("doc_id"), "n_grams"), trusted, "_unseen").select(seen, "n_grams")
    n, good = marked.agg(F.sum("n_grams"), F.sum(F.when(F.col("seen"), F.col("n_grams")))).first()
    if not good:
        return own.select("doc_id", *STATISTICS, F.lit(0.0).alias("score"))
    ranges = max(RANGES, -(-n // (PASSES * RANGE_GRAMS)))
    texts = _marked(rows.select("key", F.col("doc_id").cast("long").alias("doc_id"), "text"), trusted, "_unseen").select("key", seen, "text")
    parts = None
    for turn in range(PASSES):
        part = stored(_own_sums(texts, turn, ranges, good / n, float(evidence)), "sums")
        free_shuffles(spark)
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy("key").agg(F.sum("part").alias("part"))
    return own.join(sums, "key", "left").select("doc_id", *STATISTICS, (F.col("part") / F.greatest("n_grams", F.lit(1))).alias("score"))


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(threshold)))


def measure(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, statistics, score, kept): one row for every row of ``docs``.

    Null and empty texts have zero statistics and score 0; they fail the base rule.
    """
    return _judged(_scored(docs, model), model["threshold"])


def op8_quality_rules(spark: SparkSession, sf_dir: str, evidence: float = 5.0, quantile: float = 0.001,
                      margin: float = 0.05) -> DataFrame:
    docs = documents(spark, sf_dir)
    trusted = stored(_trusted(spark.read.parquet(f"{sf_dir}/labels.parquet")), "trusted")
    scored = stored(_own_scores(docs, trusted, evidence), "scored")
    return _judged(scored, _threshold(scored, trusted, quantile, margin)).select("doc_id", *STATISTICS, "base_failed", "kept", "score")
