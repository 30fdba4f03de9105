"""Attempt resolution and judge retries against a plain simulation of the retry loops."""

import random

from veracity.operators import responses as RESP

MARKERS = ["Confidence: 5", "I am sure", "I am unsure", "", "text", "Confidence:"]


def _valid(r, mode):
    if not r:
        return False
    if mode == "main":
        return "Confidence:" in r
    return "I am sure" in r or "I am unsure" in r


def _any(r):
    return bool(r) and ("Confidence:" in r or "I am sure" in r or "I am unsure" in r)


def _simulate(attempts, max_tries, mode):
    if _valid(attempts[0], mode):
        return 0
    for k in range(1, max_tries + 1):
        if _valid(attempts[k], mode):
            return k
    if _any(attempts[max_tries]):
        return max_tries
    return max_tries + 1


def test_resolve_attempts_random(spark):
    rnd = random.Random(4)
    for mode in ("main", "rtuning"):
        rows, expect = [], {}
        for q in range(300):
            a = ["x " + rnd.choice(MARKERS) if rnd.random() < 0.9 else "" for _ in range(5)]
            rows += [(q, k, a[k]) for k in range(5)]
            expect[q] = _simulate(a, 3, mode)
        df = spark.createDataFrame(rows, "qid long, attempt int, response string")
        got = {r.qid: (r.attempt, r.response) for r in RESP.resolve_attempts(df, 3, mode).collect()}
        by_key = {(q, k): r for q, k, r in rows}
        assert {q: v[0] for q, v in got.items()} == expect
        assert all(got[q][1] == by_key[(q, expect[q])] for q in expect)


def test_judge_retries_random(spark):
    rnd = random.Random(6)
    replies = ["Score: 7", "Score: 12", "bad", "Score: -3", "Score: 10", "Score: 0.5"]

    def value(r):
        try:
            return int(float(r.split("\n")[0].split(":")[1].strip()))
        except (IndexError, ValueError):
            return None

    rows, expect = [], {}
    for q in range(300):
        rs = [rnd.choice(replies) for _ in range(4)]
        rows += [(q, k, rs[k]) for k in range(4)]
        vals = [value(r) for r in rs[:3]]
        ok = [v for v in vals if v is not None and 0 <= v <= 10]
        expect[q] = ok[0] if ok else 0
    df = spark.createDataFrame(rows, "qid long, attempt int, reply string")
    got = {r.qid: r.score for r in RESP.judge_scores(df, 3).collect()}
    assert got == expect
