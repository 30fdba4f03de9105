"""Derived views over the driver tables.

The driver tables hold no model outputs, so each query first derives one
from them with plain column arithmetic (the same expression is written in
DuckDB SQL in ``plans/oracle.py``).  Everything is lazy and grows with the
tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> F.Column:
    return c.cast("string")


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, dataset, response: five response shapes chosen by ``doc_id % 10``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    a = F.concat(F.lit("Answer: "), F.col("text"))
    c = _s((F.col("doc_id") * 7 + 3) % 13)
    k = F.col("doc_id") % 10
    lang = F.col("lang")
    resp = (F.when(k < 6, F.concat(a, F.lit(" Self-reflection: about "), lang, F.lit(" Confidence: "), c))
            .when(k == 6, F.concat(a, F.lit(" Self-reflection: about "), lang))
            .when(k == 7, F.concat(a, F.lit(" Confidence: "), c))
            .when(k == 8, F.concat(a, F.lit(" Self-reflection: about "), lang, F.lit(" Confidence: "), c,
                                   F.lit("/10")))
            .otherwise(F.concat(F.lit("Confidence: "), c, F.lit(" Self-reflection: late"))))
    return d.select(F.col("doc_id").alias("qid"), lang.alias("dataset"), resp.alias("response"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, correctness (10 / 5 / 2 from quality and toxic), gold_text."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "text")
    corr = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(10.0))
            .when(F.col("quality") == 1, F.lit(5.0)).otherwise(F.lit(2.0)))
    k = F.col("doc_id") % 3
    gtext = (F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit(" "), F.col("text"), F.lit("\t")))
             .otherwise(F.concat(F.col("text"), F.lit(" and more"))))
    return lab.join(doc, "doc_id").select(F.col("doc_id").alias("qid"), corr.alias("correctness"),
                                          gtext.alias("gold_text"))


def gold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, correctness from ``labels`` alone (joined later with responses derived from documents)."""
    lab = table(spark, sf_dir, "labels")
    corr = (F.when((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(10.0))
            .when(F.col("quality") == 1, F.lit(5.0)).otherwise(F.lit(2.0)))
    return lab.select(F.col("doc_id").alias("qid"), corr.alias("correctness"))


def rtuning_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, response in the sure/unsure style."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 4
    a = F.col("text")
    resp = (F.when(k == 0, F.concat(a, F.lit(" I am unsure.")))
            .when(k == 1, F.concat(a, F.lit(" I am sure.")))
            .when(k == 2, F.concat(F.lit("unsure: "), a))
            .otherwise(a))
    return d.select(F.col("doc_id").alias("qid"), resp.alias("response"))


def legacy_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, response in the ``... I am N% sure`` style."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 5
    a = F.col("text")
    n = _s(F.col("doc_id") % 101)
    resp = (F.when(k == 0, F.concat(a, F.lit(". I am "), n, F.lit("% sure")))
            .when(k == 1, F.concat(a, F.lit(" I am I am "), n, F.lit(" of 4")))
            .when(k == 2, F.concat(a, F.lit(" "), n))
            .when(k == 3, F.lit(""))
            .otherwise(a))
    return d.select(F.col("doc_id").alias("qid"), resp.alias("response"))


def decoded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, raw decoded text with padding, tags and text after the stop marker."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 4
    a = F.col("text")
    c = _s(F.col("doc_id") % 11)
    resp = (F.when(k == 0, F.concat(F.lit("<pad><pad>[INST] q [/INST] "), a, F.lit(" Confidence: "), c,
                                    F.lit(" and more text")))
            .when(k == 1, F.concat(F.lit("[INST] q [/INST] "), a, F.lit(" I am sure. tail")))
            .when(k == 2, F.concat(a, F.lit("<pad>")))
            .otherwise(F.concat(F.lit("[INST] q [/INST]"), a)))
    return d.select(F.col("doc_id").alias("qid"), resp.alias("response"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, attempt, response: four recorded attempts per question from ``events``."""
    e = table(spark, sf_dir, "events").select("event_id")
    eid = F.col("event_id")
    marker = ((eid % 5 == 0) | ((eid % 4 == 3) & (eid % 7 != 0)))
    resp = F.concat(F.lit("draft "), _s(eid),
                    F.when(marker, F.concat(F.lit(" Confidence: "), _s(eid % 11)))
                    .when(eid % 13 == 1, F.lit(" I am sure"))
                    .otherwise(F.lit("")))
    return e.select(F.floor(eid / 4).cast("bigint").alias("qid"), (eid % 4).cast("int").alias("attempt"),
                    resp.alias("response"))


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, attempt, reply: three recorded judge replies per question from ``events``."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    eid, v = F.col("event_id"), F.col("value")
    k = eid % 7
    reply = (F.when(k == 0, F.concat(F.lit("Score: "), _s(F.floor(v).cast("bigint") % 15)))
             .when(k == 1, F.concat(F.lit("Score: "), _s(F.floor(v).cast("bigint") % 100 / 10.0)))
             .when(k == 2, F.lit("Rating: 7/10"))
             .when(k == 3, F.concat(F.lit("a: "), _s(eid % 11), F.lit(": 9")))
             .when(k == 4, F.lit("Explanation: fine\nScore: 9"))
             .when(k == 5, F.lit("Score: -0.5"))
             .otherwise(F.lit("no colon here")))
    return e.select(F.floor(eid / 3).cast("bigint").alias("qid"), (eid % 3).cast("int").alias("attempt"),
                    reply.alias("reply"))


def rating_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, attempt, reply: rating replies (null = failed call)."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    eid, v = F.col("event_id"), F.col("value")
    k = eid % 8
    num = _s(F.floor(v).cast("bigint") % 11)
    reply = (F.when(k == 0, F.concat(F.lit("reason: ok. score: "), num))
             .when(k == 1, F.concat(F.lit("Score: "), num, F.lit("/10")))
             .when(k == 2, F.concat(F.lit("no marker "), num))
             .when(k == 3, F.lit("8 out"))
             .when(k == 4, F.lit("score: 1.2.3"))
             .when(k == 5, F.concat(F.lit("SCORE: "), num, F.lit(".5")))
             .when(k == 6, F.lit(None).cast("string"))
             .otherwise(F.lit("score: none")))
    return e.select(F.floor(eid / 4).cast("bigint").alias("question_id"),
                    (eid % 4).cast("int").alias("attempt"), reply.alias("reply"))


def summary_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, attempt, reply: summary replies (null = failed call)."""
    e = table(spark, sf_dir, "events").select("event_id")
    eid = F.col("event_id")
    k = eid % 5
    reply = (F.when(k == 0, F.concat(F.lit("Reason:  I lack event "), _s(eid), F.lit(". ")))
             .when(k == 1, F.lit(None).cast("string"))
             .when(k == 2, F.lit("no marker"))
             .when(k == 3, F.concat(F.lit("Reason: a"), _s(eid), F.lit(" Reason: b")))
             .otherwise(F.concat(F.lit("x\nReason:\n"), _s(eid % 17))))
    return e.select(F.floor(eid / 3).cast("bigint").alias("question_id"),
                    (eid % 3).cast("int").alias("attempt"), reply.alias("reply"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, sample_idx, vec_id, text, embedding from ``embeddings``.

    ``question_id`` is the label within a block of 500 vector ids;
    ``sample_idx`` is the order of ``vec_id`` inside it.  ``text`` is a sampled response with chain and reflection.
    """
    e = table(spark, sf_dir, "embeddings")
    v = F.col("vec_id")
    k = v % 5
    text = (F.when(k == 0, F.concat(F.lit("think "), _s(v), F.lit(". Self-reflection: unsure of "), _s(v % 7),
                                    F.lit(" Confidence: 4")))
            .when(k == 1, F.concat(F.lit("think only "), _s(v)))
            .when(k == 2, F.concat(F.lit("a"), _s(v), F.lit(" Self-reflection: b Self-reflection: c")))
            .when(k == 3, F.concat(F.lit("a Self-reflection: Confidence: "), _s(v % 9)))
            .otherwise(F.concat(F.lit(" chain "), _s(v), F.lit(" Self-reflection: x"), _s(v % 3),
                                F.lit(" Are you sure you accurately answered the question based on your "
                                      "internal knowledge? yes Confidence: 2"))))
    from pyspark.sql import Window
    # A question is one label inside a block of 500 vector ids, so no question
    # grows with the table (the sampler draws a fixed number per question).
    qid = (F.col("label").cast("bigint") * 1000000 + F.floor(v / 500)).cast("bigint")
    w = Window.partitionBy(qid).orderBy("vec_id")
    return e.select(qid.alias("question_id"),
                    (F.row_number().over(w) - 1).cast("int").alias("sample_idx"),
                    "vec_id", text.alias("text"), "embedding")


def growing_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, sample_idx, embedding from ``embeddings``: question 0 holds a third of all vectors, so it
    grows with the table; the others have ten each, and some vectors are zero or missing."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    v = F.col("vec_id")
    zero = F.transform("embedding", lambda x: x * F.lit(0).cast("float"))
    vector = F.when(v % 41 == 0, zero).when(v % 97 == 5, F.lit(None)).otherwise(F.col("embedding"))
    return e.select(F.when(v % 3 == 0, F.lit(0)).otherwise(F.floor(v / 15) + 1).cast("bigint").alias("question_id"),
                    v.cast("int").alias("sample_idx"), vector.alias("embedding"))


def folded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``growing_samples`` with vectors of four components, each the sum of every fourth one of the whole vector."""
    def every_fourth(k: int):
        own = F.filter("embedding", lambda x, i: i % 4 == k)
        return F.aggregate(own, F.lit(0.0), lambda acc, x: acc + x.cast("double"))

    sums = F.array(*[every_fourth(k) for k in range(4)])
    return growing_samples(spark, sf_dir).withColumn("embedding", F.when(F.col("embedding").isNotNull(), sums))


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, confidence, correctness from ``orders`` (for batch metrics at scale)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    conf = ((F.col("o_orderkey") * 7 + 3) % 13).cast("double")
    corr = (F.col("o_custkey") % 11).cast("double")
    return o.select("o_orderkey", conf.alias("confidence"), corr.alias("correctness"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, step, rank, metric value from ``events``."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return e.select(F.col("user_id").alias("run_id"), (F.col("event_id") + 1).alias("step"),
                    (F.col("event_id") % 2).cast("int").alias("rank"),
                    (F.col("value") / 500.0).alias("value"))


def dense_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, step, rank, value: 20 runs with two ranks, steps 1, 2, ... without gaps, from ``events``.

    The number of steps is not a multiple of ten, and in some runs one rank
    stops a step before the other.
    """
    from pyspark.sql import Window
    e = table(spark, sf_dir, "events").select("event_id", "value")
    run = F.col("event_id") % 20
    i = F.row_number().over(Window.partitionBy(run).orderBy("event_id")) - 1
    return e.select(run.alias("run_id"), (F.floor(i / 2) + 1).cast("bigint").alias("step"), (i % 2).cast("int").alias("rank"),
                    (F.col("value") / 500.0).alias("value"))


def five_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, attempt, response: first answer, three retries and the forced attempt, from ``events``."""
    eid = F.col("event_id")
    resp = F.concat(F.lit("draft "), _s(eid),
                    F.when(eid % 6 == 0, F.concat(F.lit(" Confidence: "), _s(eid % 11)))
                    .when(eid % 13 < 5, F.lit(" I am sure")).otherwise(F.lit("")))
    return table(spark, sf_dir, "events").select(F.floor(eid / 5).cast("bigint").alias("qid"), (eid % 5).cast("int").alias("attempt"),
                                                 resp.alias("response"))


def wide_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, o_orderstatus, confidence (thousands of values, some null), correctness from ``orders``."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    conf = F.when(F.col("o_orderkey") % 29 != 0, F.floor("o_totalprice") % 6007)
    return o.select("o_orderkey", "o_orderstatus", conf.cast("double").alias("confidence"),
                    (F.col("o_custkey") % 11).cast("double").alias("correctness"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, role, content from ``conversations``."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", F.col("turn").cast("int").alias("turn"), "role", F.col("text").alias("content"))


def qa_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question, answer, negative_answer ('/'-separated) from ``benchmark``; every part holds the whole text."""
    b = table(spark, sf_dir, "benchmark")
    k = F.col("item_id") % 3
    half = F.floor(F.length("text") / 2).cast("int")
    neg = (F.when(k == 0, F.lit(None).cast("string"))
           .when(k == 1, F.concat(F.substring("text", F.lit(1), half), F.lit("/"), F.substring("text", half + 1, F.length("text")), F.lit("/")))
           .otherwise(F.lit("solo")))
    return b.select(F.col("item_id").alias("qid"),
                    F.concat(F.lit(" "), F.col("text"), F.lit("\n")).alias("question"),
                    F.concat(F.col("text"), F.lit(" ")).alias("answer"),
                    neg.alias("negative_answer"))


def yesno_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, question, answer (boolean, some null), facts, term from ``benchmark``."""
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    ans = F.when(i % 5 == 0, F.lit(None).cast("boolean")).otherwise(i % 2 == 0)
    return b.select(i.alias("qid"), F.col("text").alias("question"), ans.alias("answer"),
                    F.lit("").alias("facts"), F.lit("").alias("term"))


def pair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, prompt, completion: the two halves of one whole document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    return d.select(F.col("doc_id").alias("qid"), F.substring("text", F.lit(1), half).alias("prompt"),
                    F.substring("text", half + 1, F.length("text")).alias("completion"))


def eval_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, dataset of the questions of ``eval_attempts``."""
    qid = F.floor(F.col("event_id") / 4).cast("bigint")
    return table(spark, sf_dir, "events").select(qid.alias("qid")).distinct().select(
        "qid", F.concat(F.lit("set "), _s(F.col("qid") % 3)).alias("dataset"))


def eval_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, attempt, response: recorded attempts with reflections (four per question)."""
    e = table(spark, sf_dir, "events").select("event_id")
    eid = F.col("event_id")
    k = eid % 3
    resp = F.concat(F.lit("answer "), _s(eid),
                    F.when(k == 0, F.concat(F.lit(" Self-reflection: ok Confidence: "), _s(eid % 11)))
                    .when(k == 1, F.lit(" Self-reflection: hmm"))
                    .otherwise(F.lit("")))
    return e.select(F.floor(eid / 4).cast("bigint").alias("qid"), (eid % 4).cast("int").alias("attempt"),
                    resp.alias("response"))
