"""Toxicity by class-conditional Kneser-Ney models of word spelling.

Toxic and ordinary text each have an interpolated Kneser-Ney model of a word's next byte
given the four before it.  Only the highest order has counts of its own class; all lower
orders are continuation counts shared by both, gathered over the whole training corpus,
labelled or not, so an expression that is rare in one class falls back to the same
estimate in both and says little.  Spelling rather than whole words lets inflected forms
of an insult share their evidence.

A word is scored by the difference of its two log-likelihoods.  A document's features are
normalised by its length: the mean difference for each byte, and the mean for each word of
what exceeds one and two units (a few insults in a long text do not drown in the rest);
and the sums over its worst one, three and five words.  A logistic curve, fitted on
labelled documents that the counts have not seen, maps them to 0 to 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracity.llm.common import Rolling, aside, chunks, documents, fold, held_out, raw, small_batches, word_hashes, words

ORDER = 5
DISCOUNT = 0.95
#: Units that a word must exceed to count, each with the rate added before its logarithm.
EXCESS = {1.0: 0.01, 2.0: 0.003}
#: Numbers of worst words that are summed.
WORST = (1, 3, 5)
FEATURES = ["toxic_whole", *(f"toxic_excess{k:g}" for k in EXCESS), *(f"toxic_worst{k}" for k in WORST)]
#: At most so many labelled documents (least xxhash64 of the id first) teach the classes.
MAX_LABELLED = 200_000
#: At most so many of them fit the logistic curve.
MAX_FITTED = 20_000


class Terms:
    """Numbers by gram, one for every gram that was counted; others have ``rest``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, rest: float):
        self.keys, self.values, self.rest = keys, values.astype(np.float32), np.float32(rest)

    def __getitem__(self, gram: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(gram), self.rest)
        at = np.minimum(np.searchsorted(self.keys, gram), len(self.keys) - 1)
        return np.where(self.keys[at] == gram, self.values[at], self.rest)


def _bucket(gram: np.ndarray, n: int) -> np.ndarray:
    """What ``Terms`` know a gram or context of order ``n`` by: the gram itself, each order having its own."""
    return gram


def _spell(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last ``ORDER`` bytes at every byte of the words (zero before a word), and each byte's word."""
    size = ends - starts
    word = np.repeat(np.arange(len(size)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = np.repeat(starts, size) + inside
    gram = np.zeros(len(at), np.uint64)
    for j in range(ORDER):
        gram |= np.where(inside >= j, flat[np.maximum(at - j, 0)], 0).astype(np.uint64) << np.uint64(8 * j)
    return gram, word


def _cut(gram: np.ndarray, n: int) -> np.ndarray:
    return gram & np.uint64((1 << (8 * n)) - 1)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def labelled(labels: DataFrame) -> DataFrame:
    """Ids with one toxic label each (an id with both counts as toxic), a bounded sample."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Gram tables of both classes, shared lower orders and the logistic curve.

    Documents of the held-out fold teach nothing; null texts, ids and labels are ignored.
    The counts reach the driver as one row for every distinct gram of the words, of which
    there are far fewer than words; the tables are as long as that.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labelled(labels).withColumn("fold", fold(F.col("doc_id"))).toPandas()
    count_on = known[known["fold"] != 3].sort_values("doc_id")
    sent = spark.sparkContext.broadcast((count_on["doc_id"].to_numpy(np.int64), count_on["toxic"].to_numpy(np.int64)))

    def count(batches):
        roll, held = Rolling(0x9E3779B97F4A7C15), []
        for part in chunks(batches, "text"):
            flat, at = raw(pc.utf8_lower(part.column(1)))
            starts, ends, first = words(flat, at)
            if not len(starts):
                continue
            ids, toxic = sent.value
            doc = part.column(0).to_numpy()
            where = np.minimum(np.searchsorted(ids, doc), max(len(ids) - 1, 0))
            kind = np.where(ids[where] == doc, toxic[where], 2) if len(ids) else np.full(len(doc), 2)
            _, one, back = np.unique(word_hashes(roll, flat, starts, ends), return_index=True, return_inverse=True)
            by = np.repeat(kind, np.diff(first))
            n = np.stack([np.bincount(back[by == k], minlength=len(one)) for k in (1, 0)])
            gram, word = _spell(flat, starts[one], ends[one])
            held.append(_summed(gram, n[0][word], n[1][word]))
            if len(held) > 8:
                held = [_summed(*map(np.concatenate, zip(*held)))]
        if held:
            gram, t, o = _summed(*map(np.concatenate, zip(*held)))
            for lo in range(0, len(gram), 50_000):
                s = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram[s].astype(np.int64)), pa.array(t[s]), pa.array(o[s])], ["gram", "toxic", "ordinary"])

    learn = _texts(docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))))
    rows = (learn.mapInArrow(count, "gram long, toxic long, ordinary long").groupBy("gram")
            .agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")).toPandas().sort_values("gram"))
    model = _tables(rows["gram"].to_numpy(np.int64).astype(np.uint64), rows["toxic"].to_numpy(float), rows["ordinary"].to_numpy(float))
    model["curve"] = None
    fit_on = known[known["fold"] == 3].head(MAX_FITTED).sort_values("doc_id")
    if model["ready"] and fit_on["toxic"].nunique() == 2:
        ids = spark.sparkContext.broadcast(fit_on["doc_id"].to_numpy(np.int64))
        chosen = learn.where(fold(F.col("doc_id")) == 3).mapInArrow(
            lambda batches: (b.filter(pa.array(np.isin(b.column(0).to_numpy(), ids.value))) for b in batches), learn.schema)
        got = features(chosen, model).toPandas().sort_values("doc_id").merge(fit_on, on="doc_id")
        model["curve"] = _logistic(got[FEATURES].to_numpy(), got["toxic"].to_numpy(float))
    return model


def _summed(gram: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray):
    keys, back = np.unique(gram, return_inverse=True)
    return (keys, *(np.bincount(back, weights=x, minlength=len(keys)).astype(np.int64) for x in (toxic, ordinary)))


def _tables(gram: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> dict:
    """Kneser-Ney terms by gram: for each order the discounted share and the weight of the next lower order."""
    model = {"ready": toxic.sum() > 0 and ordinary.sum() > 0, "top": [], "lower": []}
    for n in (toxic, ordinary):
        model["top"].append(_order(gram, n, ORDER))
    types = gram
    for n in range(ORDER - 1, 0, -1):
        types, cont = np.unique(_cut(types, n), return_counts=True)
        model["lower"].append(_order(types, cont.astype(float), n))
    return model


def _order(gram: np.ndarray, n: np.ndarray, order: int) -> tuple[Terms, Terms]:
    seen = n > 0
    gram, n = _bucket(gram[seen], order), n[seen]
    contexts, ctx = np.unique(_bucket(gram >> np.uint64(8), order - 1 + 8), return_inverse=True)
    total = np.bincount(ctx, weights=n, minlength=len(contexts))
    kinds = np.bincount(ctx, minlength=len(contexts))
    return Terms(gram, (n - DISCOUNT).clip(0) / total[ctx], 0.0), Terms(contexts, DISCOUNT * kinds / total, 1.0)


def _ratio(model: dict, gram: np.ndarray) -> np.ndarray:
    """log P(byte | toxic) - log P(byte | ordinary) at every gram."""
    p = np.full(len(gram), 1 / 256)
    for n, (share, rest) in zip(range(1, ORDER), reversed(model["lower"])):
        g = _cut(gram, n)
        p = share[_bucket(g, n)] + rest[_bucket(g >> np.uint64(8), n - 1 + 8)] * p
    at, ctx = _bucket(gram, ORDER), _bucket(gram >> np.uint64(8), ORDER - 1 + 8)
    toxic, ordinary = (share[at] + rest[ctx] * p for share, rest in model["top"])
    return np.log(toxic) - np.log(ordinary)


def features(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``FEATURES``, replacing such columns; a text without words has the features of an even text."""
    docs = docs.drop(*FEATURES)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index("text")
    schema = T.StructType([*docs.schema, *[T.StructField(c, T.DoubleType()) for c in FEATURES]])

    def run(batches):
        roll, m = Rolling(0x9E3779B97F4A7C15), sent.value
        for part in chunks(batches, "text"):
            flat, at = raw(pc.utf8_lower(part.column(where)))
            starts, ends, first = words(flat, at)
            n = np.diff(first)
            out = {c: np.zeros(part.num_rows) for c in FEATURES}
            if len(starts) and m["ready"]:
                _, one, back = np.unique(word_hashes(roll, flat, starts, ends), return_index=True, return_inverse=True)
                gram, word = _spell(flat, starts[one], ends[one])
                each = np.bincount(word, weights=_ratio(m, gram), minlength=len(one))[back]
                out["toxic_whole"] = _sums(each, first) / np.maximum(_sums(ends - starts, first), 1)
                for k in EXCESS:
                    out[f"toxic_excess{k:g}"] = _sums(np.maximum(each - k, 0), first) / np.maximum(n, 1)
                doc = np.repeat(np.arange(len(n)), n)
                worst = each[np.lexsort((-each, doc))]
                rank = np.arange(len(each)) - np.repeat(first[:-1], n)
                for k in WORST:
                    out[f"toxic_worst{k}"] = _sums(np.where(rank < k, worst, 0), first)
            for k, rate in EXCESS.items():
                out[f"toxic_excess{k:g}"] = np.log(out[f"toxic_excess{k:g}"] + rate)
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(out[c]) for c in FEATURES]], [*part.schema.names, *FEATURES])

    return docs.mapInArrow(run, schema)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> dict:
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(w)) / 100, z.T @ (p - y) + ridge * len(y) / 100 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return {"mean": mean, "scale": scale, "w": w}


def score(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """``docs`` with the score under ``out``, for every row; 0 where nothing could be learned.

    Empty and null texts score as a text that favours neither class in any word.
    """
    small_batches(docs.sparkSession)
    rows = features(docs.drop(out), model)
    z = F.lit(-700.0)
    if c := model["curve"]:
        z = F.lit(float(c["w"][0]))
        for k, name in enumerate(FEATURES):
            z = z + (F.col(name) - float(c["mean"][k])) / float(c["scale"][k]) * float(c["w"][k + 1])
    return rows.withColumn(out, 1 / (1 + F.exp(-z))).drop(*FEATURES)


def op3_toxicity(spark: SparkSession, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Documents with a score below the threshold."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, back = aside(docs, "doc_id", "text")
    return score(rows, model).where(F.col("score") < threshold).select(*back)
