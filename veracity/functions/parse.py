"""Response, judge-reply and rating parsing as Column expressions.

Each function restates one parsing rule with Spark built-ins, including the
Python slicing quirks of the rule (``find`` returning -1 and a slice still
being taken).  Digits are ASCII digits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from veracity.functions import markers as M
from veracity.functions.text import col_, find, py_slice, py_strip, rfind, single_number


# --- model responses ---------------------------------------------------------

def main_reflection(response: Column | str) -> Column:
    """Text between ``Self-reflection: `` and ``Confidence: `` (Python slice rules)."""
    r = col_(response)
    a = find(r, M.SELF_REFLECTION)
    b = find(r, M.CONFIDENCE)
    return py_slice(r, a + len(M.SELF_REFLECTION), b)


def main_tail(response: Column | str) -> Column:
    """Text after ``Confidence: `` (from index 11 when the marker is missing)."""
    r = col_(response)
    return py_slice(r, find(r, M.CONFIDENCE) + len(M.CONFIDENCE), None)


def confidence_from_parts(r: Column, refl: Column, tail: Column, runs: Column) -> Column:
    """Main-parse confidence from precomputed reflection, tail and digit runs."""
    return (F.when(r.isNull(), F.lit(None).cast("double"))
            .when((refl == "") | (tail == ""), F.lit(0.0))
            .when(F.size(runs) == 1, F.get(runs, 0).try_cast("double"))
            .otherwise(F.lit(0.0)))


def status_from_parts(r: Column, refl: Column, tail: Column, runs: Column) -> Column:
    """Why a response gets the confidence it gets (for the parse report)."""
    n = F.size(runs)
    return (F.when(r.isNull(), F.lit("null"))
            .when(r == "", F.lit("empty"))
            .when(~r.contains(M.CONFIDENCE_BARE), F.lit("no_confidence_marker"))
            .when((refl == "") | (tail == ""), F.lit("empty_part"))
            .when(n == 0, F.lit("no_number"))
            .when(n > 1, F.lit("several_numbers"))
            .when(F.get(runs, 0).try_cast("double") > 10, F.lit("out_of_range"))
            .otherwise(F.lit("ok")))


def main_confidence(response: Column | str) -> Column:
    """Confidence of the main parse: the single number after ``Confidence: ``.

    0 when the reflection or the tail is empty or when the tail does not hold
    exactly one digit run (so ``8/10`` and ``8.5`` give 0, ``85`` gives 85).
    """
    r = col_(response)
    tail = main_tail(r)
    return confidence_from_parts(r, main_reflection(r), tail, F.regexp_extract_all(tail, F.lit("([0-9]+)"), 1))


def main_status(response: Column | str) -> Column:
    """Parse status of the main parse."""
    r = col_(response)
    tail = main_tail(r)
    return status_from_parts(r, main_reflection(r), tail, F.regexp_extract_all(tail, F.lit("([0-9]+)"), 1))


def sure_confidence(response: Column | str) -> Column:
    """Sure/unsure parse: 0 when the text contains ``unsure``, else 10; null for a null text."""
    r = col_(response)
    return F.when(r.contains(M.UNSURE), F.lit(0.0)).when(r.isNotNull(), F.lit(10.0))


def legacy_answer(response: Column | str) -> Column:
    """Legacy parse answer: text before the last ``I am`` (``r[:-1]`` when absent)."""
    r = col_(response)
    return py_slice(r, None, rfind(r, M.HEDGE))


def legacy_confidence(response: Column | str) -> Column:
    """Legacy parse confidence: single number in the text from the last ``I am`` on."""
    r = col_(response)
    return single_number(py_slice(r, rfind(r, M.HEDGE), None))


# --- sampled texts -------------------------------------------------------------

def sample_chain(text: Column | str) -> Column:
    """Reasoning chain of a sampled text: before the first ``Self-reflection:``."""
    return py_strip(F.split_part(col_(text), F.lit(M.SELF_REFLECTION_BARE), F.lit(1)))


def sample_reflection(text: Column | str, follow_up: str = M.FOLLOW_UP) -> Column:
    """Reflection of a sampled text, ``N/A`` when the marker is missing."""
    t = col_(text)
    second = F.split_part(t, F.lit(M.SELF_REFLECTION_BARE), F.lit(2))
    ref = py_strip(F.split_part(second, F.lit(M.CONFIDENCE_BARE), F.lit(1)))
    ref = py_strip(F.split_part(ref, F.lit(follow_up), F.lit(1)))
    return F.when(t.contains(M.SELF_REFLECTION_BARE), ref).otherwise(F.lit(M.NOT_AVAILABLE))


# --- decoded-text cleanup --------------------------------------------------------

def clean_response(response: Column | str) -> Column:
    """Drop ``<pad>`` and keep the text from the first ``[/INST]``.

    When the tag is missing the slice starts at -1, i.e. only the last
    character survives.
    """
    z = F.replace(col_(response), F.lit(M.PAD), F.lit(""))
    return py_slice(z, find(z, M.INST_CLOSE), None)


def truncate_at_marker(response: Column | str, rtuning: bool = False, literal: str | None = None) -> Column:
    """Cut a recorded text right after the first stop marker.

    The stop markers are ``Confidence: <digits>`` (and ``I am sure`` /
    ``I am unsure`` in r-tuning mode), or ``literal`` alone where it is given,
    searched after the first ``[/INST]``.
    Text without a marker is returned unchanged.  Two linear searches
    (``instr`` for the tag, ``regexp_instr`` for the marker) instead of one
    lazy regex that backtracks over long texts.
    """
    r = col_(response)
    alts = [r"Confidence: [0-9]+"]
    if rtuning:
        alts += [r"I am sure", r"I am unsure"]
    if literal is not None:
        alts = [re.escape(literal)]
    pattern = "(" + "|".join(alts) + ")"
    tag = F.instr(r, M.INST_CLOSE)
    tail = F.substring(r, tag + len(M.INST_CLOSE), F.length(r) + 1)
    at = F.regexp_instr(tail, F.lit(pattern), F.lit(1))
    hit = F.regexp_extract(tail, pattern, 1)
    end = tag + len(M.INST_CLOSE) - 1 + at - 1 + F.length(hit)
    return F.when((tag > 0) & (at > 0), F.substring(r, F.lit(1), end)).otherwise(r)


def is_valid(response: Column | str, mode: str = "main") -> Column:
    """Validity of an attempt: non-empty and carrying the confidence marker."""
    r = col_(response)
    if mode == "main":
        has = r.contains(M.CONFIDENCE_BARE)
    elif mode == "rtuning":
        has = r.contains(M.SURE_PHRASE) | r.contains(M.UNSURE_PHRASE)
    elif mode == "any":
        has = r.contains(M.CONFIDENCE_BARE) | r.contains(M.SURE_PHRASE) | r.contains(M.UNSURE_PHRASE)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return F.coalesce((F.length(r) > 0) & has, F.lit(False))


def has_nonsense(response: Column | str) -> Column:
    """True when no whitespace token follows the one that completes ``Confidence:`` (or the marker is missing).

    The same rule as the response mask (T6) on whitespace tokens: the prefix
    that first holds the marker must be shorter than the whole response.
    """
    r = col_(response)
    tail = py_slice(r, find(r, M.CONFIDENCE_BARE) + len(M.CONFIDENCE_BARE), None)
    rest = F.regexp_replace(tail, "^" + M.PY_WHITESPACE_CLASS.replace("[", "[^", 1) + "*", "")
    return F.coalesce(~r.contains(M.CONFIDENCE_BARE) | (py_strip(rest) == ""), F.lit(True))


# --- judge replies ---------------------------------------------------------------

def judge_value(reply: Column | str) -> Column:
    """Judge score: first line, text after the first ``:``, stripped, float, truncated.

    Unparseable replies give null (the status column says why).
    """
    r = col_(reply)
    first = F.split_part(r, F.lit("\n"), F.lit(1))
    v = py_strip(F.split_part(first, F.lit(":"), F.lit(2))).try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 2.0 ** 63) & first.contains(":")
    return F.when(ok, v.try_cast("bigint"))


def judge_explanation(reply: Column | str) -> Column:
    """Two-line judge reply: text after ``Explanation:`` on its line."""
    return py_strip(F.regexp_extract(col_(reply), r"Explanation:([^\n]*)", 1))


def judge_labeled_score(reply: Column | str) -> Column:
    """Two-line judge reply: number after ``Score:``."""
    return F.nullif(F.regexp_extract(col_(reply), r"Score:\s*([0-9]+)", 1), F.lit("")).try_cast("bigint")


# --- explanation ratings and summaries ---------------------------------------------

def rating_value(reply: Column | str) -> Column:
    """Rating: first ``d+(.d+)*`` after the first ``score:`` (case-insensitive).

    Without the marker the search starts at character 5 (``find`` = -1 plus
    the marker length).  ``1.2.3``, no number and null give null.
    """
    r = col_(reply)
    start = F.instr(F.lower(r), M.SCORE_MARKER) - 1 + len(M.SCORE_MARKER)
    t = F.substring(r, start + 1, F.length(r) + 1)
    m = F.regexp_extract(t, r"([0-9]+(\.[0-9]+)*)", 1)
    return F.nullif(m, F.lit("")).try_cast("double")


def summary_reason(reply: Column | str) -> Column:
    """Summary: text between the first and second ``Reason:``, stripped; '' if absent."""
    r = col_(reply)
    return F.when(r.contains(M.REASON_MARKER),
                  py_strip(F.split_part(r, F.lit(M.REASON_MARKER), F.lit(2)))).otherwise(F.lit(""))
