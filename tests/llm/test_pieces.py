import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import veracity.llm.pieces as P
from tests.llm.conftest import SF, table

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def tables():
    return P.Tables(PATH)


def same(library, tables, texts):
    ids, at = P.Encoder(tables).of(pa.array(texts, pa.string()), True, True)
    want = [library.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    assert [ids[at[i]:at[i + 1]].tolist() for i in range(len(texts))] == want
    assert P.texts_of(tables, ids, at) == [library.decode(w) for w in want]


def test_spaces_bytes_and_long_runs(library, tables):
    same(library, tables, ["", " ", "  ", "a", " a", "a  b\n\tc ", "▁x▁▁", "é ﬁ", "\x00ab", "﻿x", None, "中文字符" * 300, "a" * 3000, " " * 2500,
                           "ab" * 2000, "the" * 900 + "  " + "x" * 600, "=== " * 50, "😀😀 \U0001f600x", "<s></s><unk><0x0A>", "th" * 1000])


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(library, tables, seed):
    r = random.Random(seed)
    letters = ["thea ndtoi  ▁rS.é中\n<s>0x0A", "aab ", "then hethe ", "ǅ𝒳ß́ xÿ"][seed % 4]
    same(library, tables, ["".join(r.choice(letters) for _ in range(r.choice([1, 5, 40, 300, 1500]))) for _ in range(150)])


def test_decoding_any_ids(library, tables):
    r = random.Random(5)
    for _ in range(500):
        ids = [r.choice([1, 2, 0, 3 + 0xC3, 3 + 0xA9, 28705, 259, 260, 3 + 32, r.randrange(32000)]) for _ in range(r.randrange(12))]
        assert P.texts_of(tables, np.array(ids, np.int32), np.array([0, len(ids)])) == [library.decode(ids)]


def test_small_memory_and_windows(library, tables, monkeypatch):
    monkeypatch.setattr(P, "CACHE", 20)
    monkeypatch.setattr(P, "WINDOW", 7)
    same(library, tables, [" ".join(f"w{i * k % 97}" for i in range(100)) for k in range(20)])


def test_query_over_the_whole_table(spark, library):
    docs = {r.doc_id: r.text for r in table(spark, "documents", SF).select("doc_id", "text").collect()}
    rows = P.op11_sentencepiece(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edge_rows_clashing_columns_and_null_lists(spark, library, edge_docs, no_docs):
    docs = edge_docs.withColumn("ids", F.lit("x")).withColumn("key", F.lit(1)).withColumn("decoded", F.lit(1))
    out = P.decode(P.encode(docs, PATH), PATH)
    want = [(r.doc_id, library.encode(r.text or "", add_bos=True, add_eos=True)) for r in edge_docs.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.ids) for r in out.collect()], key=key) == sorted(want, key=key)
    assert {r.decoded for r in out.collect()} == {library.decode(w) for _, w in want}
    assert P.encode(no_docs, PATH).count() == 0
    lists = spark.createDataFrame([(1, None), (2, []), (3, [1, 264, 2])], "i int, ids array<int>")
    assert [r.decoded for r in P.decode(lists, PATH).orderBy("i").collect()] == [None, "", "a"]
    bare = P.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH, bos=False, eos=False)
    assert bare.first().ids == library.encode("a")
