"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts every n-gram of every labelled document in Spark (map-side dense counts
per task, one grouped sum).  The log-probability matrix has ``buckets`` rows and one
column per language, so its size is fixed before any data is seen; it is broadcast and
batches of documents are scored against it in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracity.llm.common import aside, chunks, documents, held_out, small_batches

LETTER = regex.compile(r"\p{L}")


def _grams(texts: list[str], orders: int, buckets: int):
    """For each order: bucket of the n-gram at every character, ``buckets`` where it would leave its text."""
    low = [t.lower() for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    at = np.concatenate([[0], np.cumsum(size)])
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(at[1:], size) - np.arange(at[-1])
    key = np.zeros(len(code), np.uint64)
    out = []
    for n in range(orders):
        key = key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n + 1)
        key[:len(code) - n] += code[n:]
        mixed = (key * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
        out.append(np.where(left > n, (mixed % np.uint64(buckets)).astype(np.int64), buckets))
    return at, out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", orders: int = 3,
          buckets: int = 1 << 16, alpha: float = 0.1) -> dict:
    """Counts of hashed n-grams by language, turned into a log-probability matrix.

    Rows with a null text or language teach nothing.  The grouped counts that reach the
    driver hold at most ``buckets`` rows for each language.
    """
    small_batches(docs.sparkSession)

    def count(batches):
        sums, docs_of = {}, {}
        for part in chunks(batches, text):
            texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
            for name in set(langs):
                own = [t for t, x in zip(texts, langs) if x == name]
                total = sums.setdefault(name, np.zeros(buckets + 1, np.int64))
                docs_of[name] = docs_of.get(name, 0) + len(own)
                for g in _grams(own, orders, buckets)[1]:
                    total += np.bincount(g, minlength=buckets + 1)
        for name, total in sums.items():
            total[buckets] = docs_of[name]
            hit = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(hit), pa.string()), pa.array(hit.astype(np.int32)), pa.array(total[hit])],
                ["lang", "bucket", "n"])

    rows = (docs.select(F.col(text).alias(text), F.col(lang).alias("lang")).where(F.col(text).isNotNull() & F.col("lang").isNotNull())
            .mapInArrow(count, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    names = sorted(rows["lang"].unique())
    counts = np.zeros((buckets + 1, len(names)))
    counts[rows["bucket"].to_numpy(), np.searchsorted(names, rows["lang"].to_numpy())] = rows["n"].to_numpy()
    prior, grams = counts[buckets].copy(), counts[:buckets] + alpha
    logp = np.zeros((buckets + 1, len(names)), np.float32)
    logp[:buckets] = np.log(grams / grams.sum(0))
    return {"langs": names, "logp": logp, "prior": np.log(prior / prior.sum()) if names else np.zeros(0),
            "orders": orders, "buckets": buckets}


def predict(docs: DataFrame, model: dict, text: str = "text",
            out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and its posterior under the names in ``out``, replacing such columns.

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned.
    Ties go to the language that sorts first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop(*out)
    sent = spark.sparkContext.broadcast(model)
    where = docs.columns.index(text)
    schema = T.StructType([*docs.schema, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType())])

    def score(batches):
        m = sent.value
        names, logp, prior = m["langs"], m["logp"], m["prior"]
        for part in chunks(batches, text):
            texts = [t or "" for t in part.column(where).to_pylist()]
            at, grams = _grams(texts, m["orders"], m["buckets"])
            total = np.tile(prior, (len(texts), 1))
            full = np.flatnonzero(at[1:] > at[:-1])
            if names and len(full):
                for g in grams:
                    for k in range(len(names)):
                        total[full, k] += np.add.reduceat(logp[:, k][g], at[full], dtype=np.float64)
            best, p = ["und"] * len(texts), np.zeros(len(texts))
            for i, t in enumerate(texts):
                if names and LETTER.search(t):
                    k = int(total[i].argmax())
                    best[i], p[i] = names[k], 1.0 / np.exp(total[i] - total[i][k]).sum()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string()), pa.array(p)],
                                             [*part.schema.names, *out])

    return docs.mapInArrow(score, schema)


def learnt(docs: DataFrame) -> dict:
    return train(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = predict(docs.select("doc_id", "text"), learnt(docs))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Keep documents whose language is known with a posterior of at least ``least``."""
    rows, back = aside(docs, "doc_id", "text", "lang")
    known = predict(rows, learnt(docs))
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select(*back)
