"""Training-table operators (T1-T8, F10, A13): token arrays, loss masks, padding.

Tokenisation is a column: by default a whitespace split with ``xxhash64``
token ids, computed by JVM expressions.  Any other tokeniser can be plugged
in with ``tokenize_with`` (``mapInPandas``, Arrow batches, one tokeniser per
task).  Lengths are then in those tokens.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.functions import markers as M
from veracity.functions.text import WORD_SPLIT
from veracity.operators import prompts as PR
from veracity.operators.rows import computed_once, filter_once, join_keys, with_batches

IGNORE = M.IGNORE_INDEX


def tokens(text: Column | str, max_len: int | None = None) -> Column:
    """Whitespace tokens of a text (empty pieces dropped).

    With ``max_len`` only the first ``max_len`` tokens are returned (the
    truncation of the encoders); the split then stops after ``max_len + 2``
    pieces, since the last piece only holds words that truncation drops.
    """
    t = F.col(text) if isinstance(text, str) else text
    if max_len is None:
        return F.filter(F.split(t, WORD_SPLIT), lambda w: w != "")
    pieces = F.split(t, WORD_SPLIT, max_len + 2)
    return F.slice(F.filter(pieces, lambda w: w != ""), 1, max_len)


def token_ids(toks: Column) -> Column:
    return F.transform(toks, lambda w: F.xxhash64(w))


def tokenize_with(df: DataFrame, fn: Callable, text: str, out: str = "input_ids") -> DataFrame:
    """Plug in a tokeniser: ``fn(list[str]) -> list[list[int]]`` applied per Arrow batch."""
    from pyspark.sql.types import ArrayType, LongType, StructType
    schema = StructType(list(df.schema.fields)).add(out, ArrayType(LongType()))
    register_pickle_by_value(sys.modules[__name__])  # executors need not have this package installed

    def run(batches):
        for pdf in batches:
            pdf[out] = fn(pdf[text].fillna("").tolist())
            yield pdf

    return df.mapInPandas(run, schema)


def _encode(d: DataFrame, text: Column, prompt: Column, max_len: int, tokenizer: Callable | None = None) -> DataFrame:
    if tokenizer is None:
        d = d.withColumns({"tokens": tokens(text, max_len), "_np": F.size(tokens(prompt, max_len))})
        d = d.withColumn("input_ids", token_ids(F.col("tokens")))
    else:
        d = tokenize_with(d.withColumn("_whole", text), tokenizer, "_whole", "_ids")
        d = tokenize_with(d.withColumn("_head_text", prompt), tokenizer, "_head_text", "_head_ids")
        d = d.withColumns({"input_ids": F.when(F.col("_whole").isNotNull(), F.slice("_ids", 1, max_len)),
                           "_np": F.least(F.size("_head_ids"), F.lit(max_len))})
        d = d.withColumn("tokens", F.col("input_ids").cast("array<string>")).drop("_whole", "_head_text", "_ids", "_head_ids")
    # Mask by concatenation rather than a lambda over the prompt length: a
    # lambda capturing an outer column would have that column's whole
    # expression inlined and re-evaluated for every element.
    n_mask = F.least(F.col("_np"), F.size("input_ids"))
    labels = F.concat(F.array_repeat(F.lit(IGNORE).cast("bigint"), n_mask),
                      F.slice("input_ids", n_mask + 1, F.greatest(F.size("input_ids") - n_mask, F.lit(0))))
    return d.withColumns({
        "labels": labels,
        "attention_mask": F.array_repeat(F.lit(1), F.size("input_ids")),
    }).drop("_np")


def sft_rows(df: DataFrame, flavour: str = "chat", max_len: int = 512, eos: str = PR.EOS,
             bos: str | None = None, keep: tuple[str, ...] = (), tokenizer: Callable | None = None) -> DataFrame:
    """Encoded training rows (tokens, input_ids, labels, attention_mask).

    ``tokenizer`` (``list[str] -> list[list[int]]``, run on Arrow batches)
    replaces the whitespace tokens: its ids fill ``input_ids`` and the length
    of the prompt's ids sets the masked labels.

    chat: all messages rendered (P8), prompt = all but the last message, so
    earlier assistant turns are masked too.  prompt_completion: P16 join.
    pair: QA training pair.  The prompt part of the labels is set to -100.
    """
    if flavour == "chat":
        d = PR.chat_text(df, eos=eos, bos=bos, out="_text")
        d = d.withColumn("_head", F.slice("messages", 1, F.greatest(F.size("messages") - 1, F.lit(0))))
        d = PR.chat_text(d, eos=eos, bos=bos, messages="_head", out="_prompt")
        d = d.withColumn("_prompt", F.coalesce(F.col("_prompt"), F.lit(bos or "")))
    elif flavour == "prompt_completion":
        d = PR.join_completion(df, eos=eos, bos=bos, out="_text")
        d = d.withColumn("_prompt", F.col("prompt") if not bos else F.concat(F.lit(bos), F.col("prompt")))
    elif flavour == "pair":
        d = PR.render_prompt(df, "pair", response="response", bos=bos, out="_text")
        d = PR.render_prompt(d, "newline", bos=bos, out="_prompt")
    else:
        raise ValueError(f"unknown flavour {flavour!r}")
    # Rows whose text is null (unknown role) keep null arrays; ``trainable_only`` drops them.
    enc = _encode(d, F.col("_text"), F.col("_prompt"), max_len, tokenizer)
    return enc.select(*keep, "tokens", "input_ids", "labels", "attention_mask")


def encode_prompts(df: DataFrame, prompt: str = "prompt", max_len: int = 512, tokenizer: Callable | None = None) -> DataFrame:
    """T1 for evaluation and PPO prompts: input_ids and attention_mask, no labels.

    Prompts keep their first ``max_len`` ids; ``n_cut`` counts the ids beyond.
    """
    if tokenizer is None:
        d = df.withColumn("_ids", token_ids(tokens(prompt)))
    else:
        d = tokenize_with(df, tokenizer, prompt, "_ids")
    ids = F.slice("_ids", 1, max_len)
    return d.withColumns({"input_ids": ids, "attention_mask": F.array_repeat(F.lit(1), F.size(ids)),
                          "n_cut": F.greatest(F.size("_ids") - max_len, F.lit(0))}).drop("_ids")


def trainable_only(df: DataFrame) -> DataFrame:
    """drop rows whose labels are all -100 (chats with an unknown role have null labels)."""
    return filter_once(df, lambda r: F.coalesce(F.exists(r["labels"], lambda x: x != IGNORE), F.lit(False)))


def pad_batches(df: DataFrame, batch: str = "batch_id", pad_id: int = 0,
                label_pad: int = IGNORE) -> DataFrame:
    """Pad every row to the longest row of its batch (batches are small)."""
    return _pad(df.withColumn("_max", F.max(F.size("input_ids")).over(Window.partitionBy(batch))), pad_id, label_pad)


def padded_batches(rows: DataFrame, key: str, size: int = 8, pad_id: int = 0, label_pad: int = IGNORE) -> DataFrame:
    """A1 + A13/T4: batches of ``size`` rows in order of ``key`` (unique), every row padded to its batch's longest.

    Row numbers and batch maxima come from keys and lengths alone, which meet
    the rows by key: token and label arrays are neither sorted nor written.
    ``rows`` is computed twice, first for the lengths.
    """
    lengths = with_batches(rows.select(key, F.size("input_ids").alias("_len")), key, size=size)
    longest = lengths.withColumn("_max", F.max("_len").over(Window.partitionBy("batch_id"))).drop("_len")
    return _pad(join_keys(rows, longest, [key]), pad_id, label_pad)


def _pad(d: DataFrame, pad_id: int, label_pad: int) -> DataFrame:
    fill = F.col("_max") - F.size("input_ids")
    return d.withColumns({
        "input_ids": F.concat("input_ids", F.array_repeat(F.lit(pad_id).cast("bigint"), fill)),
        "labels": F.concat("labels", F.array_repeat(F.lit(label_pad).cast("bigint"), fill)),
        "attention_mask": F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), fill)),
    }).drop("_max")


def unpad(df: DataFrame, ids: str = "input_ids", mask: str = "attention_mask") -> DataFrame:
    """T5: keep the ids whose attention mask is 1."""
    z = F.arrays_zip(F.col(ids).alias("t"), F.col(mask).alias("m"))
    return df.withColumn(ids, F.transform(F.filter(z, lambda x: x["m"] == 1), lambda x: x["t"]))


def marker_end(toks: Column | str, marker: str = M.CONFIDENCE_BARE, joiner: str = " ") -> Column:
    """Least number of leading tokens whose joined text holds ``marker``; null if even all do not.

    The marker's end in the joined text is found once and meets the running
    token lengths, so the marker may be spread over several tokens
    (``joiner=""`` for sub-word pieces that carry their own spaces).  The end
    is part of the fold's state: a lambda that took it from outside would join
    all tokens again for each token.
    """
    t = F.col(toks) if isinstance(toks, str) else toks
    gap = len(joiner)
    start = F.struct(F.lit(0).alias("n"), F.lit(-gap).alias("len"),
                     (F.instr(F.array_join(t, joiner), marker) - 1 + len(marker)).alias("end"))
    state = F.aggregate(t, start, lambda a, x: F.when(a["len"] >= a["end"], a).otherwise(F.struct(
        (a["n"] + 1).alias("n"), (a["len"] + gap + F.length(x)).alias("len"), a["end"].alias("end"))),
        lambda a: F.when(a["end"] >= len(marker), a["n"]))
    return state


def response_mask(df: DataFrame, toks: str = "tokens", marker: str = M.CONFIDENCE_BARE,
                  old_length: str | None = None, joiner: str = " ") -> DataFrame:
    """0 before the first position whose decoded prefix holds ``marker``, 1 from there.

    No such position inside the response means the response is nonsense: the
    mask then starts at ``old_length`` (the length before the forced retry)
    when given, else covers everything.  Linear in the number of tokens.
    """
    d = computed_once(df, {"_first": marker_end(toks, marker, joiner)})
    first, n = F.col("_first"), F.size(toks)
    ok = F.coalesce(first < n, F.lit(False))
    start = F.when(ok, first)
    if old_length is not None:
        start = F.coalesce(start, F.col(old_length))
    s0 = F.least(F.coalesce(start, F.lit(0)), n)
    return d.withColumns({"first_idx": F.when(ok, first), "nonsense": ~ok, "response_mask": F.concat(
        F.array_repeat(F.lit(0), s0), F.array_repeat(F.lit(1), n - s0))}).drop("_first")


def same_length(a: str = "input_ids", b: str = "response_mask") -> Column:
    """Whether two arrays of a row have equal length (a null array differs from everything)."""
    return F.coalesce((F.size(a) == F.size(b)) & F.col(a).isNotNull() & F.col(b).isNotNull(), F.lit(False))


def check_lengths(df: DataFrame, a: str = "input_ids", b: str = "response_mask") -> tuple[DataFrame, DataFrame]:
    """Rows whose two arrays have equal length, and the others (quarantine).

    Each side reads ``df`` for itself; ``length_report`` counts both in one pass.
    """
    d = computed_once(df, {"_same": same_length(a, b)})
    return d.filter("_same").drop("_same"), d.filter("not _same").drop("_same")


def length_report(df: DataFrame, a: str = "input_ids", b: str = "response_mask") -> DataFrame:
    """(status, n_rows) of rows with equal and with different lengths, in one pass."""
    status = F.when(same_length(a, b), F.lit("equal")).otherwise(F.lit("different"))
    return df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n_rows"))
