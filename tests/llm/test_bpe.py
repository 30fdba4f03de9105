import base64

import public_tokenizers as P
import pytest
import tiktoken

from veracity.llm import bpe as B

from .conftest import SCHEMA, table

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(df, library, **sizes):
    coded = B.decode(B.encode(df, PATH, P.PATTERN, **sizes), PATH).collect()
    texts = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in df.collect())
    got = sorted(((r.doc_id is None, r.doc_id or 0), bytes(r.decoded).decode(), list(r.ids)) for r in coded)
    assert [(k, t) for k, t, _ in got] == texts
    for _, t, ids in got:
        assert ids == library.encode_ordinary(t)


def test_edge_cases(edge_docs, library):
    check(edge_docs, library)


def test_small_chunks(spark, library):
    texts = ["it's we'll they've I'm you'd " * 30, "x" * 400 + " " * 200 + "y", "   \n\n  a  " * 60, "éè \U0001f600中文 '" * 50, "9" * 333 + "!" * 100 + "''''ll're" * 20]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)] * 2, SCHEMA)
    check(df, library, chunk=37, overlap=9)


def test_documents(spark, library):
    check(table(spark, "documents"), library, chunk=500, overlap=40)


def test_empty_table(no_docs):
    assert B.encode(no_docs, PATH, P.PATTERN).collect() == []


def test_long_pieces_merge_alike():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258, b"aa": 259}
    for piece in (b"ab" * 50, b"aab" * 40, b"a" * 101, b"ba" * 37):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert B.merge(piece, ranks) == [ranks[p] for p in parts]
