"""Spelling variants: words one edit apart, found through blocked Gram matrices.

A word is its vector of letter counts.  One inserted or deleted letter changes the vector
by a squared distance of 1, one replaced letter by 2, so only pairs at most 2 apart in
equal or adjacent lengths can be near.  Words are dealt into blocks by length and by the
counts of a few groups of letters; one edit moves at most one unit of one group or from one
group to another, which names every block that can hold a partner.  Each block is cut into
tiles, and each pair of tiles is one row: a NumPy product of their count matrices gives all
squared distances, and the pairs that are left are compared letter by letter.

The number of letter groups follows the measured number of words, so that a block stays
near ``BLOCK`` words; every number of groups gives the same pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm.common import documents, stored

LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Words for each block that the number of letter groups aims at, and words of a tile.
BLOCK = TILE = 1024
#: Letters of a tile at most (one word at least).
TILE_LETTERS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """(word, n): occurrences of every word of at least ``least`` letters over all texts.

    Runs of letters are lower-cased in A-Z alone.  Where ``every`` divides the crc32 of
    ``<key>:<run>`` the letter at that number modulo the run's length is left out (a null key
    counts as empty text).  Null texts have no words; repeated rows count again.
    """
    run = F.explode(F.expr(f"regexp_extract_all(`{text}`, '[{LETTERS}]{{{least},}}', 0)"))
    runs = (docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), run.alias("run"))
            .select("_id", F.translate("run", UPPER, LOWER).alias("run")))
    hashed = runs.select("run", F.crc32(F.concat("_id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = F.expr("cast(h % length(run) as int)")
    word = F.when(F.col("h") % every == 0, F.concat(F.expr("substring(run, 1, cast(h % length(run) as int))"),
                                                    F.col("run").substr(cut + 2, F.length("run")))).otherwise(F.col("run"))
    return (hashed.select(word.alias("word")).where(F.length("word") >= least)
            .groupBy("word").agg(F.count("*").alias("n")))


def letter_groups(words: int, lengths: int = 8) -> int:
    """Groups of letters that give about ``BLOCK`` words a block, for words of about ten letters."""
    g = 2
    while g < 12 and lengths * math.comb(10 + g - 1, g - 1) * BLOCK < 4 * words:
        g += 1
    return g


def _counts(word: Column, groups: int) -> list[Column]:
    """Letters of each group in a word: what is left when the group's letters are taken out."""
    alphabet = LOWER + "".join(chr(c) for c in range(0xC0, 0x100))
    return [(F.length(word) - F.length(F.translate(word, alphabet[g::groups], ""))).cast("int") for g in range(groups)]


def near_pairs(words: DataFrame, groups: int | None = None) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of distinct words (word, n) that differ by one letter, once each.

    Words hold letters of ``[a-z\\u00C0-\\u00FF]`` only and are given once each.
    """
    groups = groups or letter_groups(words.count())
    keyed = words.select("word", "n", F.array(*_counts(F.col("word"), groups)).alias("block"))
    size = keyed.groupBy("block").agg(F.count("*").alias("rows"), F.first(F.length("word")).alias("length"))
    tile_rows = F.expr(f"greatest(1, least({TILE}, {TILE_LETTERS} div length))")
    size = size.select("block", F.ceil(F.col("rows") / tile_rows).cast("long").alias("tiles"))
    tiles = (keyed.join(size, "block")
             .withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")))
             .groupBy("block", "tile").agg(F.collect_list("word").alias("words"), F.collect_list("n").alias("ns")))
    tiles = stored(tiles, "tiles")
    step = [[int(i == g) for i in range(groups)] for g in range(groups)]  # one more letter
    step += [[int(i == g) - int(i == h) for i in range(groups)] for g in range(groups) for h in range(g + 1, groups)]
    moved = [F.array(*[F.col("block")[i] + d for i, d in enumerate(s)]) for s in step]
    visits = tiles.select(F.col("tile").alias("from"), F.col("words").alias("a"), F.col("ns").alias("a_n"),
                          F.explode(F.concat(F.array(F.struct(F.col("block"), F.lit(True).alias("own"))),
                                             F.array(*[F.struct(m.alias("block"), F.lit(False).alias("own")) for m in moved])))
                          .alias("to")).select("from", "a", "a_n", "to.block", "to.own").where("array_min(block) >= 0")
    met = (visits.join(tiles.select("block", "tile", F.col("words").alias("b"), F.col("ns").alias("b_n")), "block")
           .where("not own or from <= tile").select("a", "a_n", "b", "b_n", (F.expr("own and from = tile")).alias("same")))

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, a_n, b, b_n, same = (batch.column(k)[i] for k in range(5))
                for x, y in gram_pairs(a.values.to_pylist(), b.values.to_pylist(), same.as_py()):
                    x, y = pa.array(x), pa.array(y)
                    yield pa.RecordBatch.from_arrays([a.values.take(x), a_n.values.take(x), b.values.take(y), b_n.values.take(y)],
                                                     ["a", "a_n", "b", "b_n"])

    # A joined row holds two tiles, so few go into one Arrow batch.
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(words.sparkSession.conf.get(conf)) > 64:
        words.sparkSession.conf.set(conf, "64")
    return met.mapInArrow(compare, "a string, a_n long, b string, b_n long")


def gram_pairs(a: list[str], b: list[str], same: bool):
    """Index pairs of the words of two tiles that are one edit apart; of a tile with itself each pair once."""
    (code_a, x), (code_b, y) = _matrix(a), (_matrix(b) if not same else (None, None))
    if same:
        code_b, y = code_a, x
    exact = np.float32 if max(code_a.shape[1], code_b.shape[1]) < 2048 else np.float64  # whole numbers up to 2^23
    x, y = x.astype(exact), y.astype(exact)
    distance = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)
    i, j = np.nonzero((distance >= 1) & (distance <= 2))
    if same:
        i, j = i[i < j], j[i < j]
    at_once = max(1, (1 << 22) // max(code_b.shape[1], 1))
    for lo in range(0, len(i), at_once):
        p, q = i[lo:lo + at_once], j[lo:lo + at_once]
        ok = _one_edit(code_a[p], code_b[q])
        if ok.any():
            yield p[ok], q[ok]


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters (one byte each) and letter counts of words of one length."""
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    at = np.arange(len(words))[:, None] * 256 + flat
    return flat, np.bincount(at.ravel(), minlength=256 * len(words)).reshape(-1, 256)[:, _ALPHABET]


_ALPHABET = np.r_[97:123, 0xC0:0x100]


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of equal length differ in one place, or the longer row has one letter more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    n = a.shape[1]
    start = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(1)
    end = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return start + end >= n


def variants(words: DataFrame, times: int = 10, groups: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of (word, n).

    ``form`` is the near word of largest n (ties: the smallest by code points) if its n is at
    least ``times`` the word's own, ``root`` the last word when forms are followed.  As n grows
    ``times``-fold with each step, a chain is short; links are doubled until none changes.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = near_pairs(words, groups)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("form")).alias("near")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("form")).alias("near")))).alias("e"))
    best = both.groupBy("e.word").agg(F.count("*").alias("n_near"), F.min("e.near").alias("near"))
    chosen = -F.col("near.n") >= times * F.col("n")
    rows = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(chosen, F.col("near.form")).alias("form"), F.when(chosen, -F.col("near.n")).alias("form_n")), "variants")
    links = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("last"))
        links = stored(links.join(further, "root", "left").select(
            "word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")), "links")
        if not links.where("moved").limit(1).count():
            break
        links = links.drop("moved")
    return (rows.join(links.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of seven letters or more that occurs at least twice."""
    return variants(damaged_words(documents(spark, sf_dir)).where("n >= 2"))
