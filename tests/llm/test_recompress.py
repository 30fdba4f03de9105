import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veracity.llm import recompress as R
from veracity.llm.common import Rolling, raw, word_hashes
from veracity.llm.common import words as split

from .conftest import SCHEMA, words


def brute(rows):
    """{(doc, text): kept words}; rows of one id and text are one document."""
    seen, out = set(), {}
    order = sorted({(1 << 63 if d is None else d, t or "") for d, t in rows})
    for d, t in order:
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - R.WINDOW + 1):
            key = tuple(w[s:s + R.WINDOW])
            if key in seen:
                gone[s:s + R.WINDOW] = [True] * R.WINDOW
            seen.add(key)
        out[d, t] = [x for x, g in zip(w, gone) if not g]
    return out


def check(df):
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    got = R.remove_repeats(df).collect()
    assert len(got) == df.count()
    for r in got:
        kept = want[1 << 63 if r.doc_id is None else r.doc_id, r.text or ""]
        assert r.kept == " ".join(kept)
        assert (r.n_words, r.n_removed) == (len(words(r.text)), len(words(r.text)) - len(kept))


def test_edge_cases(edge_docs):
    check(edge_docs)


def test_empty_table(no_docs):
    assert R.remove_repeats(no_docs).collect() == []


def test_extra_columns_with_own_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x", [1]), (2, None, None, None, None)], "doc_id long, text string, n_words int, kept string, doc array<int>")
    got = {r.doc_id: r for r in R.remove_repeats(df).collect()}
    assert got[1].n_words == 2 and got[1].kept == "a b" and got[1].doc == [1] and got[2].n_removed == 0


def test_random_repeats(spark):
    rng = random.Random(7)
    vocab = ["a", "b", "c", "dd", "e" * 50]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages) if rng.random() < .6 else [f"u{rng.randint(0, 999)}" for _ in range(rng.randint(1, 30))]
            if rng.random() < .2:
                w += [rng.choice(vocab)] * rng.randint(1, 70)
        rows.append((i, " ".join(w), "en", "s", 1))
    check(spark.createDataFrame(rows, SCHEMA).repartition(5))


def test_many_passages_under_one_name(spark, monkeypatch):
    """More passages than HEAVY share a boundary, so their windows are sent on singly."""
    monkeypatch.setattr(R, "HEAVY", 2)
    middle = " ".join(f"m{i}" for i in range(22))
    rows = [(i, f"{' '.join(f'l{i}x{j}' for j in range(9))} {middle} {' '.join(f'r{i}x{j}' for j in range(9))}", "en", "s", 1) for i in range(40)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(3))


def test_boundary_of_a_window_depends_on_the_window_alone():
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 30)}" for _ in range(400)]

    def filed(w):
        flat, at = raw(pa.array([" ".join(w)], pa.large_string()))
        starts, ends, first = split(flat, at)
        lo, hi, place, rank = R.filed(word_hashes(Rolling(11), flat, starts, ends), first)
        return {s: (int(p - s), int(k)) for a, b, p, k in zip(lo, hi, place, rank) for s in range(a, b + 1)}

    whole = filed(base)
    assert set(whole) == set(range(400 - R.WINDOW + 1))
    for s in range(0, 380, 7):
        part = [f"x{s}"] * 3 + base[s:s + R.WINDOW] + [base[s + R.WINDOW - 1]] * 4
        assert filed(part)[3] == whole[s]


def test_stage_keeps_columns_and_untouched_texts(spark, edge_docs):
    out = R.substring_stage(spark, edge_docs.withColumn("kept", F.lit(3)), "")
    assert out.columns == [*edge_docs.columns, "kept"]
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert (6, " \t\n\r ") in got and (2, "") in got and (4, None) in got
    assert np.all([r.n_chars == len(r.text) for r in out.where("doc_id = 2").collect()])


def test_many_texts_under_one_id(spark):
    """A third of the rows has no id, another a common one; every text is cut as its own words say."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(90):
        own = [f"o{i}x{j}" for j in range(rng.randint(5, 30))]
        rows.append(([None, 5, 100 + i][i % 3], " ".join(own + (passage if i % 2 else []) + own[:3])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = R.remove_repeats(df).collect()
    assert len(got) == 90
    whole = [r for r in got if "p0" in r.text.split() and r.n_removed == 0]
    assert len(whole) == 1 and whole[0].doc_id == 5  # the least id with the passage keeps it
    for r in got:
        w = r.text.split()
        want = w if r in whole or "p0" not in w else [x for x in w if x[0] != "p"]
        assert r.kept.split() == want and r.n_removed == len(w) - len(want)


def test_repeated_ids_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(R, "REPEATED_IDS", 0)
    test_many_texts_under_one_id(spark)
