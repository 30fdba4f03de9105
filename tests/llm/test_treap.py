import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import veracity.llm.treap as X


def split(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k=10):
    """[(item, rank, doc, score)] by the formula over every document."""
    held = [(d, split(t)) for d, t in docs]
    held = [(d, t, Counter(t)) for d, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t, _ in held)
    df = Counter(t for _, _, c in held for t in c)
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(split(text)) if df[t]}
        scored = []
        for d, t, c in held:
            m = 100 - 90 + (90 * len(t) * n_docs) // length
            s = sum(x * ((10 ** 9 * c[term]) // (1000 * c[term] + 8 * m)) for term, x in w.items() if c[term])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if none else d, -s))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[1], r[3], r[2] is None, r[2] or 0))


def answer(spark, docs, items, k=10):
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(items, "item_id long, text string")
    return order([tuple(r) for r in X.search(X.build(docs), items, k).collect()])


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force_over_many_shards(spark, seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(X, "SHARD_BYTES", 3_000)
    monkeypatch.setattr(X, "BEAM", r.choice([1, 3, 50]))
    monkeypatch.setattr(X, "BLOCK_TERMS", 40)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÉTÉ", "中文", "A1b"]
    docs = [(i, " ".join(r.choice(words[:r.randrange(1, len(words))]) for _ in range(r.choice([0, 1, 8, 40])))) for i in range(400)]
    docs += [(1000 + i, "same words here") for i in range(30)]
    items = [(i, ", ".join(r.choice(words) for _ in range(r.randrange(1, 12)))) for i in range(15)] + [(99, "same SAME words")]
    assert answer(spark, docs, items) == order(brute(docs, items))


def test_nulls_ties_repeats_and_unknown_terms(spark):
    docs = [(5, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (None, "alpha beta"), (None, None), (7, ""), (8, "- -"),
            (9, " ".join(f"x{i}" for i in range(30_000)) + " alpha")]
    items = [(1, "alpha"), (2, "nowhere"), (3, None), (4, ""), (None, "beta, x17")]
    assert answer(spark, docs, items) == order(brute(docs, items))
    assert answer(spark, docs, items, k=2) == order(brute(docs, items, 2))


def test_empty_tables_and_clashing_columns(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "copy1 copy2 one")], "item_id long, text string")
    assert X.search(X.build(no_docs), items).count() == 0
    assert X.search(X.build(edge_docs), items.limit(0)).count() == 0
    docs = edge_docs.withColumn("terms", F.lit(1)).withColumn("tree", F.lit(2)).withColumn("score", F.lit(3))
    clash = items.withColumn("doc_id", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("grams", F.lit(1)).withColumn("item", F.lit(1))
    got = order([tuple(r) for r in X.search(X.build(docs), clash).collect()])
    assert got == order(brute([(r.doc_id, r.text) for r in edge_docs.collect()], [(1, "copy1 copy2 one")]))


def test_tree_holds_its_points_and_bounds():
    r = np.random.default_rng(1)
    cells = np.unique(r.integers(0, [900, 70], (2_000, 2)), axis=0)
    gram, doc = cells[:, 0].astype(np.uint64), cells[:, 1]
    by = np.argsort(doc, kind="stable")
    gram, doc = gram[by], doc[by]
    terms, tree = X.shard(gram, doc, np.arange(70) + 500, 70, len(gram))
    known, df, place = X._unpack(terms)
    t, ids = X.load(tree, 70, len(gram))
    assert ids.tolist() == list(range(500, 570)) and df.sum() == len(gram)
    points = t.mask == 0
    row_gram = np.empty(len(place), np.uint64)
    row_gram[place] = known
    assert {(int(row_gram[a]), int(b)) for a, b in zip(t.row[points], t.col[points])} == set(zip(gram.astype(int).tolist(), doc.tolist()))
    assert len(t.mask) < 2 * points.sum()
    for node in np.flatnonzero(~points):
        kids = t.child[node] + np.arange(X._ONES[t.mask[node]])
        assert (t.level[kids] > t.level[node]).all() and len(kids) > 1
        assert t.bound[node] >= t.bound[kids].max() - X.UNIT


def test_only_some_ranges_are_halved():
    """A search for one rare term leaves nearly all of the grid alone."""
    r = np.random.default_rng(2)
    doc = np.repeat(np.arange(2_000), 30)
    gram = r.integers(0, 5_000, len(doc)).astype(np.uint64)
    terms, tree = X.shard(gram, doc, np.arange(2_000), 2_000, len(gram))
    known, _, place = X._unpack(terms)
    t, ids = X.load(tree, 2_000, len(gram))
    best = X.Best(1, 10)
    halved = X.descend(t, ids, np.zeros(2, np.int64), place[:2].astype(np.int64), np.array([5_000, 4_000]), best)
    assert 0 < len(best.doc) <= 10 and halved < 500
