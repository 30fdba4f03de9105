"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

A text becomes words: a run of spaces and the characters up to the next space.  No piece
of such a model has a space after another character, so no merge crosses a word's start and
each distinct word is encoded once.  The characters of all new words of a chunk lie in one
flat symbol array.  In every round each segment (a stretch of a word whose neighbouring
characters occur side by side in some piece) finds its least pair rank, and the leftmost
pairs of that rank that do not overlap are merged at once; the arrays are then compacted,
and a segment leaves them when no pair remains.

One case needs care.  The library merges one pair at a time, and the new symbol may form a
pair of a still lesser rank, which comes before the further pairs of the first rank.  Pieces
of which this can be true (``Tables.alone``), or that share their rank with others, are
merged once a round, leftmost first.  A segment of more than ``LONG`` symbols that meets
such a pair is finished pair by pair with a heap instead, as a round for each would cost the
square of its length.

Characters outside the vocabulary become their UTF-8 bytes' pieces.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracity.llm.common import chunks, documents, raw, small_batches

SPACE = "▁"
#: Distinct words a task remembers; beyond it the memory starts afresh.
CACHE = 400_000
#: Words of a long text handled at once.
WINDOW = 1 << 19
#: Text bytes of a chunk: larger than elsewhere, as each chunk looks up its distinct words once.
CHUNK = 4 << 20
#: Symbols of a segment from which a pair that must be merged alone goes to the heap.
LONG = 256
NONE = np.int32(2 ** 31 - 1)


class Tables:
    """Symbols, pair ranks and piece bytes of a model, as plain arrays (its vocabulary's size)."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize("ﬁ  Ａ b ") != f"{SPACE}ﬁ{SPACE}{SPACE}Ａ{SPACE}b{SPACE}":
            raise ValueError("only models without text normalisation, with a leading space, are supported")
        size = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
        self.byte = np.full(256, -1, np.int32)
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte[int(name[1:-1], 16)] = i
        if (self.byte < 0).any():
            raise ValueError("only models with a piece for every byte are supported")
        self.bos, self.eos, self.size = model.bos_id(), model.eos_id(), size
        plain = {names[i]: i for i in range(size) if not special[i] and not model.is_byte(i)}
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("pieces that go on after a space are not supported")
        symbol = dict(plain)
        for c in sorted(set("".join(plain))):
            symbol.setdefault(c, len(symbol) + size)
        self.chars = np.array(sorted(ord(c) for c in symbol if len(c) == 1), np.uint32)
        self.char_symbol = np.array([symbol[chr(c)] for c in self.chars], np.int32)
        level = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in plain.values()}, reverse=True))}
        rank = {p: level[model.get_score(i)] for p, i in plain.items()}
        pairs, near = {}, set()
        self.width = max(symbol.values()) + 1
        alone = np.zeros(size, bool)
        shared = np.bincount([rank[p] for p in plain if len(p) > 1])
        for p, i in plain.items():
            near.update((ord(a) << 21) | ord(b) for a, b in zip(p, p[1:]))
            if len(p) > 1:
                alone[i] |= shared[rank[p]] > 1
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in symbol and b in symbol:
                    pairs[symbol[a] * self.width + symbol[b]] = (rank[p], i)
                    for part in (a, b):
                        if len(part) > 1 and rank[part] >= rank[p]:
                            alone[plain[part]] = True
        keys = sorted(pairs)
        self.pair = np.array(keys, np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in keys], np.int32)
        self.pair_piece = np.array([pairs[k][1] for k in keys], np.int32)
        self.near = np.array(sorted(near), np.int64)
        self.alone = alone
        said = [b"" if model.is_control(i) else model.decode([i]).encode() if special[i]
                else bytes([int(names[i][1:-1], 16)]) if model.is_byte(i)
                else names[i].replace(SPACE, " ").encode() for i in range(size)]
        self.control = np.array([model.is_control(i) for i in range(size)])
        self.is_byte = np.array([model.is_byte(i) for i in range(size)])
        self.spaced = np.array([not special[i] and names[i].startswith(SPACE) for i in range(size)])
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_at = np.concatenate([[0], np.cumsum([len(s) for s in said])]).astype(np.int64)
        probe = "Vectorised rounds, aaaa  bbb; the other  thing."
        if words_ids(self, [w for w in _split(" " + probe)])[0].tolist() != model.encode(probe):
            raise ValueError("only BPE models are supported")

    def symbols(self) -> np.ndarray:
        """Symbol of every code point, -1 where no piece has it; made once a task."""
        if not hasattr(self, "_symbols"):
            self._symbols = np.full(0x110000, -1, np.int32)
            self._symbols[self.chars] = self.char_symbol
        return self._symbols

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; rank ``NONE`` where they form no piece."""
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        known = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.pair_rank[at], NONE), self.pair_piece[at]


def _split(text: str) -> list[str]:
    import re
    return re.findall(r" *[^ ]+| +$", text)


def words_ids(t: Tables, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and where each word's begin (n+1)."""
    code = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), "<u4")
    length = np.fromiter(map(len, words), np.int64, len(words))
    begin = np.concatenate([[0], np.cumsum(length)])
    if not len(code):
        return np.zeros(0, np.int32), begin
    symbol = t.symbols()[code]
    alive = np.ones(len(code), bool)
    bigram = (code[:-1].astype(np.int64) << 21) | code[1:]
    spot = np.minimum(np.searchsorted(t.near, bigram), len(t.near) - 1)
    joined = t.near[spot] == bigram  # whether a character and the next can ever share a piece
    joined[begin[1:-1] - 1] = False
    first = np.concatenate([[True], ~joined])  # first symbol of a segment
    # Compact state: characters' positions, symbols and segment starts of the segments at work.
    pos = np.arange(len(code))
    sym = symbol
    rank = np.full(len(code), NONE, np.int32)
    piece = np.zeros(len(code), np.int32)
    stale = np.flatnonzero(joined)
    while True:
        if len(stale):
            rank[stale], piece[stale] = t.lookup(sym[stale], sym[stale + 1])
        starts = np.flatnonzero(first)
        least = np.minimum.reduceat(rank, starts)
        size = np.diff(np.append(starts, len(rank)))
        going = np.repeat(least != NONE, size)
        if not going.all():
            if not going.any():
                break
            pos, sym, rank, piece, first = pos[going], sym[going], rank[going], piece[going], first[going]
            live = least != NONE
            size, least = size[live], least[live]
            starts = np.cumsum(size) - size
        hit = np.flatnonzero(rank == np.repeat(least, size))
        segment = np.searchsorted(starts, hit, "right") - 1
        lone = t.alone[piece[hit]]
        new = np.concatenate([[True], segment[1:] != segment[:-1]])
        run = np.maximum.accumulate(np.where(new | np.concatenate([[True], hit[1:] != hit[:-1] + 1]),
                                             np.arange(len(hit)), 0))
        take = np.where(lone, new, (np.arange(len(hit)) - run) % 2 == 0)
        gone = np.zeros(len(sym), bool)
        many = lone & new & (size[segment] > LONG)
        for s in segment[many]:
            lo, hi = starts[s], starts[s] + size[s]
            sym[lo:hi], left = _one_by_one(t, sym[lo:hi])
            alive[pos[lo:hi][~left]] = False
            symbol[pos[lo:hi]] = sym[lo:hi]
            gone[lo:hi] = True
        take &= ~gone[hit]
        merged = hit[take]
        sym[merged] = piece[merged]
        symbol[pos[merged]] = piece[merged]
        gone[merged + 1] = True
        alive[pos[merged + 1]] = False
        keep = ~gone
        place = np.cumsum(keep) - 1
        rank[merged] = NONE  # the last of a segment keeps none
        before = place[merged] - 1
        pos, sym, rank, piece, first = pos[keep], sym[keep], rank[keep], piece[keep], first[keep]
        if not len(pos):
            break
        last = np.append(first[1:], True)
        now = place[merged]
        rank[now] = NONE
        touched = np.zeros(len(pos), bool)
        touched[now] = True
        touched[before[before >= 0]] = True
        stale = np.flatnonzero(touched & ~last)
    final = np.flatnonzero(alive)
    sym = symbol[final]
    known = (sym >= 0) & (sym < t.size)
    count = np.ones(len(final), np.int64)
    out = np.where(known, sym, 0)
    if not known.all():
        spelt = [chr(c).encode() for c in code[final[~known]].tolist()]
        count[~known] = [len(b) for b in spelt]
        out = np.repeat(out, count)
        out[np.repeat(~known, count)] = t.byte[np.frombuffer(b"".join(spelt), np.uint8)]
    ends = np.concatenate([[0], np.cumsum(count)])
    return out.astype(np.int32), ends[np.searchsorted(final, begin)]


def _one_by_one(t: Tables, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All merges of one long segment in the library's order: least rank, then leftmost."""
    sym, n = sym.copy(), len(sym)
    alive = np.ones(n, bool)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, piece = t.lookup(sym[:-1], sym[1:])
    known = {}
    heap = [(r, i, int(sym[i]), int(sym[i + 1]), p) for i, (r, p) in enumerate(zip(rank.tolist(), piece.tolist())) if r != NONE]
    heapq.heapify(heap)

    def offer(i, j):
        pair = int(sym[i]), int(sym[j])
        if pair not in known:
            r, p = t.lookup(np.array(pair[:1]), np.array(pair[1:]))
            known[pair] = int(r[0]), int(p[0])
        r, p = known[pair]
        if r != NONE:
            heapq.heappush(heap, (r, i, *pair, p))

    while heap:
        _, i, a, b, p = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], alive[j] = p, False
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            offer(i, k)
        if before[i] >= 0:
            offer(before[i], i)
    return sym, alive


class Encoder:
    """Texts to ids, with the words of a task remembered."""

    def __init__(self, tables: Tables):
        self.t = tables
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        ids, at = words_ids(self.t, words)
        base = len(self.slot)
        self.slot.update(zip(words, range(base, base + len(words))))
        self.ends = np.concatenate([self.ends, at[1:] + self.ends[-1]])
        self.flat = np.concatenate([self.flat, ids])

    def of(self, text: pa.Array, bos: bool, eos: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text one after the other, and each text's offsets (n+1)."""
        text = pc.replace_substring(pc.fill_null(text, ""), SPACE, " ")
        text = pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(" ", text, ""))
        flat, at = raw(text)
        blank = flat == 0x20
        blank[1:] &= flat[:-1] != 0x20
        full = at[:-1][np.diff(at) > 0]
        blank[full] = True
        starts = np.flatnonzero(blank)
        got, sizes = [], []
        for lo in range(0, len(starts), WINDOW):
            hi = min(lo + WINDOW, len(starts))
            begin, end = int(starts[lo]), int(starts[hi]) if hi < len(starts) else len(flat)
            offsets = np.append(starts[lo:hi], end) - begin
            words = pa.LargeStringArray.from_buffers(hi - lo, pa.py_buffer(offsets.astype(np.int64)),
                                                     pa.py_buffer(np.ascontiguousarray(flat[begin:end])))
            coded = words.dictionary_encode()
            distinct = coded.dictionary.to_pylist()
            if len(self.slot) > CACHE:
                self.forget()
            slot = list(map(self.slot.get, distinct))
            fresh = [w for w, s in zip(distinct, slot) if s is None]
            if fresh:
                known = len(self.slot)
                self.learn(fresh)
                slot = np.array(slot, float)  # None becomes nan; slots stay far below 2^53
                slot[np.isnan(slot)] = np.arange(known, known + len(fresh))
            slot = np.asarray(slot).astype(np.int32)[coded.indices.to_numpy()]
            size = self.ends[slot + 1] - self.ends[slot]
            done = np.cumsum(size)
            move = (self.ends[slot] - done + size).astype(np.int32)
            got.append(self.flat[np.arange(done[-1], dtype=np.int32) + np.repeat(move, size)])
            sizes.append(size)
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int32)
        through = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        ends = through[np.searchsorted(starts, at)]
        rows = np.arange(len(ends))
        out_at = ends + rows * (bos + eos)
        out = np.empty(int(out_at[-1]), "<i4")
        own = np.ones(len(out), bool)
        if bos:
            out[out_at[:-1]] = self.t.bos
            own[out_at[:-1]] = False
        if eos:
            out[out_at[1:] - 1] = self.t.eos
            own[out_at[1:] - 1] = False
        out[own] = np.concatenate(got) if got else 0
        return out, out_at


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", bos: bool = True,
           eos: bool = True, packed: bool = False) -> DataFrame:
    """(key, ids) for every row: the pieces of the whole text as the SentencePiece library gives them.

    ``ids`` is an array of ints, or with ``packed`` their little-endian 32-bit bytes.  A null
    text counts as empty and has begin and end ids alone.  Repeated rows, null keys and ties
    each give a row; an empty table gives none; other columns are not read, whatever their
    names.  Memory grows with a chunk of 4 MB of text or the longest text.  The model file
    must be readable on the driver; its tables are broadcast (fixed size).
    """
    spark = docs.sparkSession
    small_batches(spark)
    tables = spark.sparkContext.broadcast(Tables(model_path))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        encoder = Encoder(tables.value)
        for b in chunks(batches, "text", CHUNK):
            ids, at = encoder.of(b.column(1), bos, eos)
            yield pa.RecordBatch.from_arrays([b.column(0), _column(ids, at, packed)], ["key", "ids"])

    kind = "binary" if packed else "array<int>"
    out = rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, ids {kind}")
    return out.select(F.col("key").alias(key), "ids")


def _column(ids: np.ndarray, at: np.ndarray, packed: bool) -> pa.Array:
    if packed:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1,
                                     [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(ids)])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each id list (array of ints or packed bytes; null: null).

    Control ids say nothing, the first space is the leading one and is dropped, and bytes
    that form no character become U+FFFD each.  An id outside the vocabulary fails.
    A column named as ``out`` is replaced.
    """
    spark = df.sparkSession
    tables = spark.sparkContext.broadcast(Tables(model_path))
    df = df.drop(out)
    where = df.columns.index(ids)
    packed = isinstance(df.schema[ids].dataType, T.BinaryType)
    schema = T.StructType([*df.schema, T.StructField(out, T.StringType())])

    def run(batches):
        for b in batches:
            col = b.column(where)
            given = col.is_valid().to_numpy(zero_copy_only=False)
            if packed:
                flat, at = raw(col)
                flat, at = np.frombuffer(flat.tobytes(), "<i4"), at // 4
            else:
                size = np.where(given, pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False), 0)
                flat, at = col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
            texts = texts_of(tables.value, flat, at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(
                [x if g else None for x, g in zip(texts, given)], pa.string())], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def texts_of(t: Tables, flat: np.ndarray, at: np.ndarray) -> list[str]:
    """The texts of id lists that lie one after the other."""
    flat = flat.astype(np.int64)
    if len(flat) and (flat.min() < 0 or flat.max() >= t.size):
        raise ValueError("an id lies outside the vocabulary")
    lo = t.said_at[flat]
    size = t.said_at[flat + 1] - lo
    spoken = np.flatnonzero(~t.control[flat])
    lead = np.searchsorted(spoken, at[:-1])
    has = lead < np.searchsorted(spoken, at[1:])
    head = spoken[lead[has]]
    head = head[t.spaced[flat[head]]]
    lo[head] += 1
    size[head] -= 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    joined = t.said[np.arange(total) + np.repeat(lo - ends + size, size)].tobytes()
    cut = np.concatenate([[0], ends])[at].tolist()
    # Bytes on both sides of a control id do not belong together.
    inner = np.flatnonzero(t.control[flat[1:-1]] & (t.is_byte[flat[:-2]] | t.is_byte[flat[2:]])) + 1
    apart = set((np.searchsorted(at, inner, "right") - 1).tolist())
    out = []
    for i in range(len(at) - 1):
        piece = joined[cut[i]:cut[i + 1]]
        try:
            if i in apart:
                raise ValueError
            out.append(piece.decode())
        except ValueError:
            out.append(_mended(t, flat[at[i]:at[i + 1]], size[at[i]:at[i + 1]], piece))
    return out


def _mended(t: Tables, ids: np.ndarray, size: np.ndarray, said: bytes) -> str:
    """Runs of byte pieces are read apart from the pieces around them, wrong bytes one by one."""
    out, at, run = [], 0, b""
    for is_byte, n in zip(t.is_byte[ids].tolist() + [False], size.tolist() + [0]):
        part = said[at:at + n]
        at += n
        if is_byte:
            run += part
            continue
        while run:
            for k in (1, 2, 3, 4):
                try:
                    out.append(run[:k].decode())
                    run = run[k:]
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                run = run[1:]
        out.append(part.decode())
    return "".join(out)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, hashed, and the hash of the text decoded from them."""
    import public_tokenizers
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = decode(encode(documents(spark, sf_dir), path, packed=True), path)
    return coded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
