import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from veracity.llm import minhash as M

from .conftest import SCHEMA, table, words


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, share=85):
    sets, root = {}, {d: d for d, _ in rows}
    for d, t in rows:
        sets.setdefault(d, []).append(shingles(t))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        for x in sets[a]:
            for y in sets[b]:
                if x and y and 100 * len(x & y) >= share * len(x | y):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return {d: find(d) for d in root}


def check(df):
    rows = [(1 << 63 if r.doc_id is None else r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    got = M.near_groups(df).collect()
    assert len(got) == len(rows)
    for r in got:
        d = 1 << 63 if r.doc_id is None else r.doc_id
        root = want[d] if r.n_shingles else d  # nothing links to a text without words
        assert (1 << 63 if r.component_id is None else r.component_id) == root
        assert r.kept == (root == d)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t)) for _, t in rows)


def test_edge_cases(edge_docs):
    check(edge_docs)


def test_empty_table(no_docs):
    assert M.near_groups(no_docs).collect() == []


def test_documents(spark):
    check(table(spark, "documents"))


def edited(rng, n_docs, n_words, rate):
    base = [f"w{i}" for i in range(n_words)]
    return [(i, " ".join(f"e{rng.randint(0, 10**6)}" if rng.random() < rate else x for x in base), "en", "s", 1) for i in range(n_docs)]


def test_chains_and_many_near_copies(spark):
    rng = random.Random(5)
    rows = edited(rng, 90, 150, .01)
    w = [f"c{i}" for i in range(200)]
    for i in range(12):  # each is near the one before, the ends are not near each other
        w = w[:]
        w[rng.randrange(200)] = f"d{i}"
        w[rng.randrange(200)] = f"f{i}"
        rows.append((1000 + i, " ".join(w), "en", "s", 1))
    check(spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).repartition(4))


def test_large_keys_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 8)
    check(spark.createDataFrame(edited(random.Random(9), 60, 120, .02), SCHEMA))


def test_every_pair_within_the_distance_shares_a_key(spark):
    rng = np.random.default_rng(2)
    for distance, errors in ((22, 1), (27, 1), (5, 2), (63, 0)):
        parts = M.plan(M.POSITIONS, distance, errors)
        assert sum(e + 1 for _, e in parts) == distance + 1 and sum(len(p) for p, _ in parts) == M.POSITIONS
    rows = []
    for i in range(60):
        a = rng.integers(0, 1 << 16, M.POSITIONS).astype("<u2")
        b = a.copy()
        b[rng.choice(M.POSITIONS, M.DISTANCE, replace=False)] ^= 1
        rows += [(2 * i, a.tobytes() + bytes(4)), (2 * i + 1, b.tobytes() + bytes(4))]
    keys = M.keys(spark.createDataFrame(rows, "node long, sig binary")).distinct()
    pairs = {(r.a, r.b) for r in keys.alias("x").join(keys.alias("y"), "key").where("x.node < y.node").selectExpr("x.node AS a", "y.node AS b").distinct().collect()}
    assert {(2 * i, 2 * i + 1) for i in range(60)} <= pairs


def test_stage_keeps_one_of_each_group(spark, edge_docs):
    out = M.near_duplicate_stage(spark, edge_docs, "")
    assert out.columns == edge_docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert 1 in ids and 2 not in ids and 4 in ids and 5 in ids


def test_rows_without_or_under_one_id_are_told_apart(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(80)) for c in "abcd"}
    rows = [(5, text["a"]), (None, text["a"] + " tail"), (None, text["b"]), (None, text["c"]), (None, text["c"]), (None, None),
            (7, text["d"]), (7, text["b"] + " tail"), (None, text["d"])]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    out = M.near_duplicate_stage(spark, docs, "").collect()
    want = [(5, text["a"]), (7, text["b"] + " tail"), (None, text["c"]), (None, None), (7, text["d"])]
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(want, key=str)
    groups = M.near_groups(docs).collect()
    assert len(groups) == len(rows) and sum(r.kept for r in groups) == len(want)


def test_query_goes_by_the_id(spark, tmp_path):
    text = " ".join(f"t{i}" for i in range(80))
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (3, " ".join(f"z{i}" for i in range(90))), (None, "x y")], "doc_id long, text string")
    rows.select("doc_id", "text", *[F.lit(None).cast("string").alias(c) for c in ("lang", "source")], F.lit(0).cast("long").alias("n_chars")) \
        .write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in M.op5_minhash_near_duplicates(spark, str(tmp_path)).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def crowd(rng, n_docs, n_words, n_edits):
    """Texts edited in as many places each, so that all pairs are about alike."""
    out = []
    for i in range(n_docs):
        w = [f"w{k}" for k in range(n_words)]
        for k in rng.sample(range(n_words // 10), n_edits):
            w[10 * k + 5] = f"e{i}x{k}"
        out.append((i, " ".join(w), "en", "s", 1))
    return out


def test_pairs_of_a_crowd_are_not_listed(spark, monkeypatch):
    """Texts that are all near by signature, few of them links: the pairs handed on grow as the texts, and no link is lost."""
    listed, confirmed = [], M._confirmed
    monkeypatch.setattr(M, "_confirmed", lambda pairs, *more: listed.append(pairs.count()) or confirmed(pairs, *more))
    monkeypatch.setattr(M, "HELD_PAIRS", 1000, raising=False)
    rng = random.Random(3)
    rows = crowd(rng, 240, 400, 11)
    w = rows[7][1].split()
    rows += [(1000 + i, " ".join(w[:380 - 2 * i]), "en", "s", 1) for i in range(3)]  # links of one of them
    rows += [(2000, rows[100][1].replace("w17 ", "u ").replace("w117 ", "v "), "en", "s", 1), (None, rows[30][1] + " tail", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = brute([(1 << 63 if d is None else d, t) for d, t, *_ in rows], 80)
    assert 100 < len(set(want.values())) < len(rows)
    for nodes, size in ((M.CROWD_NODES, M.CROWD_BYTES), (64, M.CROWD_BYTES), (M.CROWD_NODES, 1 << 18)) if hasattr(M, "CROWD_NODES") else ((0, 0),):
        monkeypatch.setattr(M, "CROWD_NODES", nodes, raising=False)
        monkeypatch.setattr(M, "CROWD_BYTES", size, raising=False)
        got = {1 << 63 if r.doc_id is None else r.doc_id: r.component_id for r in M.near_groups(df, (80, 100), 27).collect()}
        assert got == want
    assert max(listed) < 8 * len(rows)
