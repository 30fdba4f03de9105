"""Prompt rendering (P8-P22) with array higher-order functions.

Templates are parameters; the defaults below are short templates of our own.
Only the instruction tags are fixed values (see ``functions/markers.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions import markers as M
from veracity.functions.text import py_strip, rfind, py_slice

EOS = "</s>"
OPEN = M.INST_OPEN + "\n"      # "[INST]\n"
CLOSE = M.INST_CLOSE + "\n"    # "[/INST]\n"

DEFAULT_INSTRUCTION = ("Answer step by step, then on a new line write 'Confidence: ' "
                       "and a number from 1 to 10.")
DEFAULT_UNTUNED = ("After answering, give the reason for your confidence, then write "
                   "'Confidence: ' and an integer from 1 to 10.")
DEFAULT_JUDGE = ("Question: <QUESTION>\nResponse: <RESPONSE>\nReference: <CORRECT_ANSWER>\n"
                 "Reply with 'Score: N' (0-10).")
DEFAULT_JUDGE_OTHER = ("Question: <QUESTION>\nResponse: <RESPONSE>\nBest: <BEST_ANSWER>\n"
                       "Also correct:\n<OTHER_CORRECT_ANSWERS>\nReply with 'Score: N' (0-10).")
DEFAULT_SUMMARY = "Summarise these reasons in one to three sentences.\n<REASONS>\nReply as 'Reason: ...'."
DEFAULT_RATING = ("Question: <QUESTION>\n\nSampled Responses:\n<RESPONSES>\nReason: <REASON>\n"
                  "Reply as 'reason: ... score: N' (0-10).")


def _tagged(content: Column) -> Column:
    return F.concat(F.lit(OPEN), py_strip(content), F.lit(M.INST_CLOSE + "\n"))


def _is_prompt_role(role: Column) -> Column:
    return role.isin("system", "user")


def with_instruction(df: DataFrame, instruction: str | None, messages: str = "messages") -> DataFrame:
    """P14 for chats: put the instruction in front of message 0's content."""
    if instruction is None:
        return df
    m = F.col(messages)
    return df.withColumn(messages, F.transform(m, lambda x, i: F.when(
        i == 0, x.withField("content", F.concat(F.lit(instruction), x["content"]))).otherwise(x)))


def chat_text(df: DataFrame, eos: str = EOS, bos: str | None = None,
              messages: str = "messages", out: str = "text") -> DataFrame:
    """Chat -> training text; prompt roles tagged, every assistant turn + EOS + newline.

    The whole text is stripped.  A chat with an unknown role gets null.
    """
    m = F.col(messages)
    piece = lambda x: (F.when(_is_prompt_role(x["role"]), _tagged(x["content"]))
                       .when(x["role"] == "assistant",
                             F.concat(py_strip(x["content"]), F.lit(eos + "\n"))))
    bad = F.exists(m, lambda x: ~x["role"].isin("system", "user", "assistant") | x["role"].isNull())
    text = py_strip(F.array_join(F.transform(m, piece), ""))
    if bos:
        text = F.concat(F.lit(bos), text)
    return df.withColumn(out, F.when(~bad & (F.size(m) > 0), text))


def chat_prompt_answer(df: DataFrame, style: str = "eval", eos: str = EOS, bos: str | None = None,
                       cut_hedge: bool | None = None, instruction: str | None = None,
                       messages: str = "messages") -> DataFrame:
    """Chat -> (prompt, answer, question).

    The last message, when it is an assistant one, becomes the answer; earlier
    assistant turns are rendered as newline + text + EOS + newline.  ``ppo``
    style adds a newline to the prompt for the answer, ``eval`` does not and
    cuts the answer at its last ``I am`` (hedge).  ``question`` is the
    stripped content of the second-last message (null for one message).
    """
    if style not in ("eval", "ppo"):
        raise ValueError(f"unknown style {style!r}")
    if cut_hedge is None:
        cut_hedge = style == "eval"
    d = with_instruction(df, instruction, messages)
    m = F.col(messages)
    n = F.size(m)
    last_tail = F.lit("\n") if style == "ppo" else F.lit("")

    def piece(x, i):
        return (F.when(_is_prompt_role(x["role"]), _tagged(x["content"]))
                .when((x["role"] == "assistant") & (i != n - 1),
                      F.concat(F.lit("\n"), py_strip(x["content"]), F.lit(eos + "\n")))
                .when(x["role"] == "assistant", last_tail))

    bad = F.exists(m, lambda x: ~x["role"].isin("system", "user", "assistant") | x["role"].isNull())
    prompt = F.array_join(F.transform(m, piece), "")
    if bos:
        prompt = F.concat(F.lit(bos), prompt)
    last = F.element_at(m, -1)
    answer = F.when(last["role"] == "assistant", py_strip(last["content"])).otherwise(F.lit(""))
    if cut_hedge:
        answer = F.when(answer.contains(M.HEDGE), py_slice(answer, None, rfind(answer, M.HEDGE))) \
                  .otherwise(answer)
    question = F.when(n >= 2, py_strip(F.element_at(m, -2)["content"]))
    ok = ~bad & (n > 0)
    return d.withColumns({"prompt": F.when(ok, prompt), "answer": F.when(ok, answer),
                          "question": F.when(ok, question)})


def cut_hedge(df: DataFrame, col: str, marker: str = M.HEDGE) -> DataFrame:
    """Cut a text at the last ``marker`` (kept unchanged when absent; no strip after)."""
    c = F.col(col)
    return df.withColumn(col, F.when(c.contains(marker), py_slice(c, None, rfind(c, marker))).otherwise(c))


def render_prompt(df: DataFrame, style: str = "newline", question: str = "question",
                  response: str | None = None, instruction: str | None = None,
                  bos: str | None = None, out: str = "prompt") -> DataFrame:
    """Plain QA prompts.

    ``tag``: ``[INST]q[/INST]\\n``; ``newline``: ``[INST]\\nq\\n[/INST]\\n``;
    ``pair``: newline form + stripped response + newline (training pair);
    ``untuned``: instruction after the question inside the tags.  With
    ``instruction`` (explicit confidence) the instruction goes first inside
    the tags (for ``tag`` the already wrapped prompt is wrapped again).
    """
    q = py_strip(question)
    if style == "tag":
        p = F.concat(F.lit(M.INST_OPEN), q, F.lit(CLOSE))
        if bos:
            p = F.concat(F.lit(bos), p)
        if instruction is not None:
            p = F.concat(F.lit(OPEN + instruction + " \n"), py_strip(p), F.lit("\n" + CLOSE))
        return df.withColumn(out, p)
    if style == "untuned":
        body = F.concat(F.lit(OPEN), q, F.lit("\n" + (instruction or DEFAULT_UNTUNED)), F.lit(CLOSE))
    elif instruction is not None:
        body = F.concat(F.lit(OPEN + instruction + " \n"), q, F.lit("\n" + CLOSE))
    else:
        body = F.concat(F.lit(OPEN), q, F.lit("\n" + CLOSE))
    if style == "pair":
        if response is None:
            raise ValueError("pair style needs a response column")
        body = F.concat(body, py_strip(response), F.lit("\n"))
    elif style not in ("newline", "untuned"):
        raise ValueError(f"unknown style {style!r}")
    if bos:
        body = F.concat(F.lit(bos), body)
    return df.withColumn(out, body)


def join_completion(df: DataFrame, eos: str = EOS, bos: str | None = None,
                    prompt: str = "prompt", completion: str = "completion", out: str = "text") -> DataFrame:
    """Prompt + completion with one space only when neither side has one at the seam."""
    p, c = F.col(prompt), F.col(completion)
    ws = (" ", "\n", "\t")
    p_end = F.substring(p, -1, 1).isin(*ws) & (F.length(p) > 0)
    c_start = F.substring(c, 1, 1).isin(*ws)
    text = F.when(~p_end & ~c_start, F.concat(p, F.lit(" "), c)).otherwise(F.concat(p, c))
    text = F.concat(text, F.lit(eos))
    if bos:
        text = F.concat(F.lit(bos), text)
    return df.withColumn(out, text)


def judge_prompt(df: DataFrame, template: str = DEFAULT_JUDGE, question: str = "question",
                 response: str = "response", gold: str = "best_answer",
                 others: str | None = None, out: str = "judge_prompt") -> DataFrame:
    """Chained literal replacement (question, response, gold[, other answers])."""
    t = F.replace(F.lit(template), F.lit("<QUESTION>"), F.col(question))
    t = F.replace(t, F.lit("<RESPONSE>"), F.col(response))
    if others is None:
        t = F.replace(t, F.lit("<CORRECT_ANSWER>"), F.col(gold))
    else:
        t = F.replace(t, F.lit("<BEST_ANSWER>"), F.col(gold))
        t = F.replace(t, F.lit("<OTHER_CORRECT_ANSWERS>"), F.array_join(F.col(others), "\n"))
    return df.withColumn(out, t)


def cluster_listing(clusters: Column | str, share: str = "count",
                    n_samples: Column | None = None) -> Column:
    """P20: ``k. (size%) text`` lines, k from 1.

    ``share='count'`` prints the cluster size where a percentage is announced
    (the reference behaviour); ``share='percent'`` prints size / n_samples.
    """
    c = F.col(clusters) if isinstance(clusters, str) else clusters

    def line(x, i):
        size = x["size"].cast("string")
        if share == "percent":
            size = F.round(x["size"] * 100.0 / n_samples, 0).cast("bigint").cast("string")
        return F.concat((i + 1).cast("string"), F.lit(". ("), size, F.lit("%) "), x["response"], F.lit("\n"))

    return F.array_join(F.transform(c, line), "")


def summary_prompt(reasons: Column | str, template: str = DEFAULT_SUMMARY) -> Column:
    """Newline-joined reasons put into the template."""
    r = F.col(reasons) if isinstance(reasons, str) else reasons
    return F.replace(F.lit(template), F.lit("<REASONS>"), F.array_join(r, "\n"))


def clean_question(q: Column | str) -> Column:
    """Drop the instruction tags and strip."""
    c = F.col(q) if isinstance(q, str) else q
    return py_strip(F.replace(F.replace(c, F.lit(M.INST_OPEN), F.lit("")), F.lit(M.INST_CLOSE), F.lit("")))


def rating_prompt(question: Column, listing: Column, reason: Column,
                  template: str = DEFAULT_RATING) -> Column:
    """Rating prompt: cleaned question, cluster listing and summarised reason."""
    t = F.replace(F.lit(template), F.lit("<QUESTION>"), clean_question(question))
    t = F.replace(t, F.lit("<RESPONSES>"), listing)
    return F.replace(t, F.lit("<REASON>"), reason)
