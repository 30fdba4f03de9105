"""Golden edge rows for the parsing rules (FIXTURES section 4) and property checks."""

import random
import re

from conftest import one_col

from veracity.functions import parse as P
from veracity.functions.text import py_strip


def test_main_parse_golden(spark):
    rows = [
        ("ans Self-reflection: sure Confidence: 8", "sure ", 8.0),
        ("ans Confidence: 8", "", 0.0),
        ("Self-reflection: x", "", 0.0),
        ("", "", 0.0),
        ("Confidence: 8 Self-reflection: late", "", 0.0),
        ("A Self-reflection: a Confidence: 8/10", "a ", 0.0),
        ("A Self-reflection: a Confidence: 8.5", "a ", 0.0),
        ("A Self-reflection: a Confidence: 85", "a ", 85.0),
        ("A Self-reflection: Confidence: 5", "", 0.0),
        ("plain 7 text with one number", "h one numbe", 0.0),
        ("[/INST]\nlonger response with year 1999 only and more", "esponse with year 1999 only and mor", 1999.0),
    ]
    texts = [r[0] for r in rows]
    assert one_col(spark, texts, P.main_reflection) == [r[1] for r in rows]
    assert one_col(spark, texts, P.main_confidence) == [r[2] for r in rows]


def test_legacy_and_sure_golden(spark):
    texts = ["Paris. I am 80% sure", "Paris", "Paris 7", "I am I am 3 of 4", ""]
    assert one_col(spark, texts, P.legacy_answer) == ["Paris. ", "Pari", "Paris ", "I am ", ""]
    assert one_col(spark, texts, P.legacy_confidence) == [80.0, 0.0, 7.0, 0.0, 0.0]
    assert one_col(spark, ["I am unsure", "I am sure", "whatever"], P.sure_confidence) == [0.0, 10.0, 10.0]


def test_judge_golden(spark):
    texts = ["Score: 7", "Score: 7.9", "Score: -0.5", "Score: 12", "a: 5: 9", "Score: 7/10", "7",
             "Score: nan", "Explanation: x\nScore: 9"]
    assert one_col(spark, texts, P.judge_value) == [7, 7, 0, 12, 5, None, None, None, None]


def test_rating_and_summary_golden(spark):
    texts = ["reason: ok. score: 9", "Score: 7/10", "no marker 8", "8 out", "score: 1.2.3", "score: none", None]
    assert one_col(spark, texts, P.rating_value) == [9.0, 7.0, 8.0, None, None, None, None]
    texts = ["Reason: I lack the date.", "no marker", "Reason: a Reason: b"]
    assert one_col(spark, texts, P.summary_reason) == ["I lack the date.", "", "a"]


def test_sample_split_golden(spark):
    texts = ["think. Self-reflection: unsure of date Confidence: 4", "think only",
             "a Self-reflection: b Self-reflection: c", "a Self-reflection: Confidence: 3"]
    assert one_col(spark, texts, P.sample_chain) == ["think.", "think only", "a", "a"]
    assert one_col(spark, texts, P.sample_reflection) == ["unsure of date", "N/A", "b", ""]


def test_clean_and_truncate(spark):
    texts = ["<pad>[INST] q [/INST] a Confidence: 7 more", "no tag", "[INST] q [/INST] I am sure. x"]
    assert one_col(spark, texts, P.clean_response) == ["[/INST] a Confidence: 7 more", "g", "[/INST] I am sure. x"]
    out = one_col(spark, texts, lambda c: P.truncate_at_marker(c, rtuning=True))
    assert out == ["<pad>[INST] q [/INST] a Confidence: 7", "no tag", "[INST] q [/INST] I am sure"]


# --- property check: main parse against a plain restatement of the rule ---------------

def _main_rule(r):
    a, b = r.find("Self-reflection: "), r.find("Confidence: ")
    refl = r[a + 17:b]
    tail = r[b + 12:]
    if not refl or not tail:
        return refl, 0.0
    nums = re.findall(r"[0-9]+", tail)
    return refl, float(nums[0]) if len(nums) == 1 else 0.0


def test_main_parse_random(spark):
    rnd = random.Random(7)
    parts = ["Self-reflection: ", "Confidence: ", "8", "10", "x", " ", "é", "\n", "7/10", "3.5", ""]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 8))) for _ in range(600)]
    refl = one_col(spark, texts, P.main_reflection)
    conf = one_col(spark, texts, P.main_confidence)
    for t, r, c in zip(texts, refl, conf):
        assert (r, c) == _main_rule(t), repr(t)


def test_strip_matches_python(spark):
    ws = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ws + "ab é") for _ in range(rnd.randint(0, 10))) for _ in range(300)]
    assert one_col(spark, texts, py_strip) == [t.strip() for t in texts]


def test_word_count_matches_python_split(spark):
    from veracity.functions.text import word_count
    ws = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(ws + "abé") for _ in range(rnd.randint(0, 20))) for _ in range(300)]
    assert one_col(spark, texts, word_count) == [len(t.split()) for t in texts]


def test_limited_tokens_equal_truncated_split(spark):
    from veracity.operators.training import tokens
    ws = " \t\n　\xa0"
    rnd = random.Random(12)
    texts = ["".join(rnd.choice(ws + "ab") for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    full = one_col(spark, texts, lambda c: tokens(c))
    for n in (0, 1, 3, 7):
        assert one_col(spark, texts, lambda c: tokens(c, n)) == [f[:n] for f in full]


def test_truncate_at_marker_matches_lazy_regex(spark):
    rnd = random.Random(13)
    parts = ["[/INST]", "Confidence: ", "7", "12", "I am sure", "I am unsure", "x", " ", "\n"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(500)]
    pat = re.compile(r"(?s)^(.*?\[/INST\].*?(?:Confidence: [0-9]+|I am sure|I am unsure))")
    exp = [(m.group(1) if (m := pat.match(t)) else t) for t in texts]
    assert one_col(spark, texts, lambda c: P.truncate_at_marker(c, rtuning=True)) == exp
