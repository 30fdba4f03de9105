import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF, SF_TINY, table
from veracity.llm.spelling import damaged_words, letter_groups, near_pairs, op12_spelling_variants, variants


def brute_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                cut = h % len(run)
                run = run[:cut] + run[cut + 1:]
            if len(run) >= 7:
                n[run] += 1
    return n


def spellings(word):
    """All texts with one place left open: near words of equal length share one, a longer one holds the shorter."""
    return {word[:i] + "\0" + word[i + 1:] for i in range(len(word))}, {word[:i] + word[i + 1:] for i in range(len(word))}


def brute(n):
    """word -> (form, root, n, n_near, form_n)."""
    near, holes = {w: set() for w in n}, {}
    for w in n:
        open_, shorter = spellings(w)
        for s in open_:
            holes.setdefault(s, []).append(w)
        for s in shorter & near.keys():
            near[w].add(s)
            near[s].add(w)
    for group in holes.values():
        for w in group:
            near[w].update(set(group) - {w})
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("sf", [SF_TINY, SF])
def test_query_equals_brute_force(spark, sf):
    n = brute_words((r.doc_id, r.text) for r in table(spark, "documents", sf).select("doc_id", "text").collect())
    want = brute(Counter({w: k for w, k in n.items() if k >= 2}))
    have = got(op12_spelling_variants(spark, sf))
    assert have == want
    assert any(v[0] for v in want.values())


@pytest.mark.parametrize("groups", [2, 3, 5])
def test_any_number_of_letter_groups_gives_the_same_pairs(spark, groups, monkeypatch):
    import random

    import veracity.llm.spelling as S
    r = random.Random(groups)
    words = {"".join(r.choice("abcéÿ") for _ in range(r.randrange(7, 10))) for _ in range(1500)}
    monkeypatch.setattr(S, "TILE", 50)  # several tiles a block
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = [(x.a, x.b) for x in near_pairs(df, groups).collect()]
    want = brute(Counter(dict.fromkeys(words, 2)))
    assert len(pairs) == len({frozenset(p) for p in pairs})
    near = Counter(w for p in pairs for w in p)
    assert near == Counter({w: v[3] for w, v in want.items() if v[3]})


def test_chain_tie_and_long_words(spark):
    long = "ab" * 2000
    rows = [("mistake", 3), ("mistakes", 40), ("mistakens", 500), ("counted", 4), ("counten", 40), ("countex", 40), (long, 2), (long + "c", 50)]
    have = got(variants(spark.createDataFrame(rows, "word string, n long")))
    assert have["mistake"] == ("mistakes", "mistakens", 3, 1, 40)
    assert have["mistakes"] == ("mistakens", "mistakens", 40, 2, 500)
    assert have["mistakens"] == (None, "mistakens", 500, 1, None)
    assert have["counted"][:2] == ("counten", "counten")
    assert have[long] == (long + "c", long + "c", 2, 1, 50)


def test_edge_rows_empty_table_and_clashing_columns(spark, edge_docs, no_docs):
    docs = edge_docs.union(spark.createDataFrame([(20, "Étrangère ÉTRANGÈRE étrangère " * 3, None, None, None)] * 2, edge_docs.schema))
    docs = docs.withColumn("run", F.lit("x")).withColumn("word", F.lit("y")).withColumn("n", F.lit(1)).withColumn("h", F.lit(1))
    n = brute_words((r.doc_id, r.text) for r in docs.collect())
    assert {r.word: r.n for r in damaged_words(docs).collect()} == n
    assert got(variants(damaged_words(docs).where("n >= 2"))) == brute(Counter({w: k for w, k in n.items() if k >= 2}))
    assert damaged_words(no_docs).count() == 0
    assert variants(damaged_words(no_docs)).count() == 0


def test_more_words_give_more_groups():
    assert letter_groups(10) == 2
    assert letter_groups(10 ** 6) > letter_groups(10 ** 5) >= 2
