"""Ingest-side normalisation (P1-P7, F9): format dispatch and canonical tables.

Canonical shapes::

    qa   : qid, question, best_answer, correct_answers array<string>,
           negative_answers array<string> (nullable)
    chat : conv_id, messages array<struct<turn:int, role:string, content:string>>
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions.text import py_strip

ROLES = ("system", "user", "assistant")


def detect_format(df: DataFrame, purpose: str = "eval") -> str:
    """Pick the normaliser from the column names (first match wins).

    eval: messages -> yes/no (facts and term) -> qa (question and answer) -> truthful.
    sft:  prompt_completion (prompt and completion) -> messages -> error.
    ppo:  messages -> error.
    """
    cols = set(df.columns)
    if purpose == "eval":
        if "messages" in cols:
            return "chat"
        if {"facts", "term"} <= cols:
            return "yesno"
        if {"question", "answer"} <= cols:
            return "qa"
        return "truthful"
    if purpose == "sft":
        if {"prompt", "completion"} <= cols:
            return "prompt_completion"
        if "messages" in cols:
            return "chat"
        raise ValueError("need prompt/completion or messages columns")
    if purpose == "ppo":
        if "messages" in cols:
            return "chat"
        raise ValueError("need a messages column")
    raise ValueError(f"unknown purpose {purpose!r}")


def bool_answer(c: Column | str) -> Column:
    """Boolean answer -> 'True' / 'False' (null counts as false)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(F.coalesce(col, F.lit(False)), F.lit("True")).otherwise(F.lit("False"))


def normalise(df: DataFrame, fmt: str | None = None, key: str = "qid") -> DataFrame:
    """One canonical ``qa`` table from the question/answer shapes."""
    fmt = fmt or detect_format(df)
    if fmt == "qa":
        best = py_strip("answer")
        neg = (F.split(F.col("negative_answer"), "/", -1) if "negative_answer" in df.columns
               else F.lit(None).cast("array<string>"))
        return df.select(key, py_strip("question").alias("question"), best.alias("best_answer"),
                         F.array(best).alias("correct_answers"), neg.alias("negative_answers"))
    if fmt == "yesno":
        best = bool_answer("answer")
        return df.select(key, F.col("question"), best.alias("best_answer"),
                         F.array(best).alias("correct_answers"),
                         F.lit(None).cast("array<string>").alias("negative_answers"))
    if fmt == "truthful":
        # The question is kept unstripped in this shape.
        return df.select(key, "question", "best_answer", "correct_answers",
                         F.lit(None).cast("array<string>").alias("negative_answers"))
    raise ValueError(f"normalise does not handle {fmt!r}")


def qa_to_chat(df: DataFrame, key: str = "qid", question: str = "question",
               response: str = "response") -> DataFrame:
    """question/response row -> two-message chat (user, assistant)."""
    msgs = F.array(
        F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col(question).alias("content")),
        F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col(response).alias("content")))
    return df.select(F.col(key).alias("conv_id"), msgs.alias("messages"))


def build_chats(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Long rows (conv_id, turn, role, content) -> one chat row with ordered messages.

    One shuffle on the chat key; a chat is one conversation, so the array is
    bounded by the conversation length.
    """
    return turns.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("messages"))


def chat_problem(messages: Column | str = "messages") -> Column:
    """reason a chat is invalid (empty, unknown role), null when valid."""
    m = F.col(messages) if isinstance(messages, str) else messages
    bad_role = F.exists(m, lambda x: ~x["role"].isin(*ROLES) | x["role"].isNull())
    return (F.when(m.isNull() | (F.size(m) == 0), F.lit("empty_messages"))
            .when(bad_role, F.lit("unknown_role")))


def validate_chat(chat: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """split chats into (valid, quarantined); ``strict`` raises on the first bad row."""
    d = chat.withColumn("problem", chat_problem())
    if strict:
        d = d.withColumn("problem", F.when(F.col("problem").isNotNull(),
                                           F.raise_error(F.concat(F.lit("invalid chat: "), F.col("problem")))))
    return d.filter(F.col("problem").isNull()).drop("problem"), d.filter(F.col("problem").isNotNull())


def scoring_view(df: DataFrame, key: str = "qid") -> DataFrame:
    """The three fields kept for scoring (negatives dropped)."""
    return df.select(key, "question", "best_answer", "correct_answers")
