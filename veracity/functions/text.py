"""Column helpers that restate Python string semantics with Spark built-ins.

All helpers return Columns built from JVM functions, so they stay inside
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veracity.functions.markers import PY_WHITESPACE_CHARS, PY_WHITESPACE_CLASS

# Python str.split() with no argument splits on runs of any isspace character.
WORD_SPLIT = PY_WHITESPACE_CLASS + "+"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """Python ``str.strip()``: removes every ``isspace`` character at both ends.

    Spark's one-argument ``trim`` only removes spaces; ``btrim`` with the
    full character set strips like Python and avoids a regex scan.
    """
    return F.btrim(col_(c), F.lit(PY_WHITESPACE_CHARS))


def find(c: Column | str, marker: str) -> Column:
    """Python ``str.find``: 0-based index of the first occurrence, -1 if absent."""
    return F.instr(col_(c), marker) - 1


def rfind(c: Column | str, marker: str) -> Column:
    """Python ``str.rfind``: 0-based index of the last occurrence, -1 if absent."""
    s = col_(c)
    rev = F.instr(F.reverse(s), marker[::-1])
    return F.when(rev > 0, F.length(s) - rev - F.lit(len(marker)) + 1).otherwise(F.lit(-1))


def py_slice(c: Column | str, start: Column | int | None = None,
             stop: Column | int | None = None) -> Column:
    """Python ``s[start:stop]`` with negative indices and clipping."""
    s = col_(c)
    n = F.length(s)

    def norm(v, default):
        if v is None:
            return default
        v = F.lit(v) if isinstance(v, int) else v
        return F.when(v < 0, F.greatest(n + v, F.lit(0))).otherwise(F.least(v, n))

    a = norm(start, F.lit(0))
    b = norm(stop, n)
    return F.when(b > a, F.substring(s, a + 1, b - a)).otherwise(F.lit(""))


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    return F.size(F.filter(F.split(col_(c), WORD_SPLIT), lambda w: w != ""))


def digit_runs(c: Column | str) -> Column:
    """All runs of ASCII digits, as in ``re.findall(r'\\d+', s)``."""
    return F.regexp_extract_all(col_(c), F.lit(r"([0-9]+)"), 1)


def single_number(c: Column | str) -> Column:
    """The number when the text holds exactly one digit run, else 0."""
    runs = digit_runs(c)
    return F.when(F.size(runs) == 1, F.get(runs, 0).try_cast("double")).otherwise(F.lit(0.0))
