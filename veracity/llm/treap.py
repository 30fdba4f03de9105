"""Ranked lexical search on K2-treaps over the term-document grid.

Documents are dealt into shards (ranges of documents with a bounded amount of text).  In a
shard, rows of the grid are its terms (frequent ones first), columns its documents, and a
cell holds a term's impact in a document.  The grid is a compressed quadtree: a node stands
for the smallest square that holds its points, nodes with a single child do not exist, and
each node keeps the largest impact of its points (rounded up, so it is a bound).

An item walks down the tree with one path for each of its terms, all paths jointly: a state
is a range of documents with the nodes that its rows have there, and its bound is the sum of
weight times largest impact.  The ranges of largest bound are halved first; a range below
the item's tenth best score so far is dropped, and one whose nodes are all single points
gives exact scores.  Rounds handle the best ranges of all items at once in flat arrays.  A
task keeps its best documents from shard to shard, so later shards start with a high bar.

Impacts need only the number of documents and their mean length; the weights, which need
document frequencies, are given by each search from the term rows of the shards.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracity.llm.common import NULL_ID, Rolling, chunks, documents, given_id, known_id, lower, raw, small_batches, stored, word_hashes

#: Text bytes of a shard (or one longer document).
SHARD_BYTES = 8 << 20
#: Distinct terms, counted for each item, that one search block is meant to hold (it is sent to the tasks).
BLOCK_TERMS = 1 << 18
#: Ranges of each item that are halved in one round.
BEAM = 128
#: Unit in which a node's largest impact is stored, rounded up.
UNIT = 16

_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


class Index(NamedTuple):
    """Shards (shard, terms, tree), documents with a term, and terms with repeats of all of them."""
    shards: DataFrame
    documents: int
    length: int


def terms(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every term, and the first term's index of each text (n+1)."""
    edge = np.zeros(len(flat) + 1, bool)
    edge[at] = True
    full = np.concatenate([[False], _TERM[flat], [False]])
    starts = np.flatnonzero(full[1:-1] & (~full[:-2] | edge[:-1]))
    ends = np.flatnonzero(full[1:-1] & (~full[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def fingerprints(roll: Rolling, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprint of every term, A-Z lower-cased, and the first term's index of each text."""
    starts, ends, first = terms(flat, at)
    return word_hashes(roll, lower(flat), starts, ends), first


def _roll() -> Rolling:
    return Rolling(0x9E3779B97F4A7C15)


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What a term that occurs ``tf`` times adds for each unit of weight in a document of ``n`` terms."""
    m = 100 - 90 + (90 * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


# --- the tree of a shard -------------------------------------------------------------------------

def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers with a gap after each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


class Tree(NamedTuple):
    """Nodes in breadth-first order: square's level, children's mask (0: a point), first child, bound, a point's row and column."""
    height: int
    level: np.ndarray
    mask: np.ndarray
    child: np.ndarray
    bound: np.ndarray
    row: np.ndarray
    col: np.ndarray


def grow(row: np.ndarray, col: np.ndarray, impact: np.ndarray) -> tuple[int, list[np.ndarray], np.ndarray, np.ndarray]:
    """Height, (masks, levels, largest impacts) by depth, and the points in the order of their nodes."""
    height = max(int(max(row.max(), col.max())).bit_length(), 1)
    code = (_spread(row) << np.uint64(1)) | _spread(col)
    order = np.argsort(code)
    code, best = code[order], np.append(impact[order], 0)
    bits = np.frexp((code[1:] ^ code[:-1]).astype(float))[1]  # below 2^53, so exact
    common = np.concatenate([[-1], height - 1 - (bits - 1) // 2])  # digits shared with the point before
    lo, hi = np.array([0]), np.array([len(code)])
    depths, points = [], []
    while len(lo):
        inner = hi - lo > 1
        largest = np.maximum.reduceat(best, np.column_stack([lo, hi]).ravel())[::2]
        mask, level = np.zeros(len(lo), np.uint8), np.full(len(lo), height, np.uint8)
        points.append(order[lo[~inner]])
        lo, hi = lo[inner], hi[inner]
        if len(lo):
            size = hi - lo - 1
            first = np.cumsum(size) - size
            at = np.arange(int(size.sum())) + np.repeat(lo + 1 - first, size)
            least = np.minimum.reduceat(common[at], first)
            level[inner] = least
            cut = np.flatnonzero(common[at] == np.repeat(least, size))
            node = np.concatenate([np.arange(len(lo)), np.searchsorted(first, cut, "right") - 1])
            start = np.concatenate([lo, at[cut]])
            ahead = np.argsort(start)
            node, start = node[ahead], start[ahead]
            digit = (code[start] >> (2 * (height - 1 - least[node])).astype(np.uint64)).astype(np.int64) & 3
            new = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
            mask[inner] = np.add.reduceat(1 << digit, new)
            end = np.append(start[1:], 0)
            end[np.append(new[1:], len(node)) - 1] = hi
            lo, hi = start, end
        depths.append((mask, level, largest))
    return height, depths, np.concatenate(points)


_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, those of equal weight together, compressed."""
    import pickle
    squeezed = [(a.dtype.str, len(a), pa.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes(), "zstd", asbytes=True)
                 if len(a) else b"") for a in arrays]
    return pickle.dumps(squeezed)


def _unpack(data: bytes) -> list[np.ndarray]:
    import pickle
    out = []
    for kind, n, squeezed in pickle.loads(data):
        size = np.dtype(kind).itemsize
        flat = pa.decompress(squeezed, n * size, "zstd", asbytes=True) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(flat, np.uint8).reshape(size, n).T).view(kind).reshape(n))
    return out


def shard(gram: np.ndarray, doc: np.ndarray, ids: np.ndarray, documents: int, length: int) -> tuple[bytes, bytes]:
    """The two parts of a shard: term rows (fingerprint, documents), and the tree with its documents.

    ``gram`` has the fingerprints of all terms, ``doc`` the ascending number of each one's document.
    """
    n = np.bincount(doc, minlength=len(ids)).astype(np.int64)
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])))
    tf = np.diff(np.append(new, len(gram)))
    gram, doc = gram[new], doc[new]
    head = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    df = np.diff(np.append(head, len(gram)))
    place = np.empty(len(head), np.int64)
    place[np.argsort(-df, kind="stable")] = np.arange(len(head))
    row = np.repeat(place, df)
    height, depths, points = grow(row, doc, impacts(tf, n[doc], documents, length))
    mask, level, largest = (np.concatenate(x) for x in zip(*depths))
    inner = mask > 0
    tree = _pack(np.array([height]), np.array([len(m) for m, _, _ in depths]), mask, level[inner],
                 ((largest[inner] + UNIT - 1) // UNIT).astype(np.uint16), np.diff(row[points], prepend=0).astype(np.int32),
                 doc[points].astype(np.int32), tf[points].astype(np.int32), ids, n)
    return _pack(gram[head], df.astype(np.int32), place.astype(np.int32)), tree


def load(data: bytes, documents: int, length: int) -> tuple[Tree, np.ndarray]:
    """The tree of a shard, ready to walk, and its documents' ids."""
    height, depths, mask, inner_level, inner_bound, row, col, tf, ids, n = _unpack(data)
    inner = mask > 0
    size = len(mask)
    level, bound = np.full(size, height[0], np.int64), np.zeros(size, np.int64)
    level[inner], bound[inner] = inner_level, inner_bound.astype(np.int64) * UNIT
    bound[~inner] = impacts(tf.astype(np.int64), n[col], documents, length)
    ones = _ONES[mask]
    child = 1 + np.cumsum(ones) - ones
    at = np.zeros((2, size), np.int64)
    at[0, ~inner], at[1, ~inner] = np.cumsum(row), col
    ends = np.cumsum(depths)
    for lo, hi in zip(ends[-2::-1] - depths[-2::-1], ends[-2::-1]):  # deepest first; the last depth has points alone
        node = lo + np.flatnonzero(inner[lo:hi])
        at[:, node] = at[:, child[node]]
    return Tree(int(height[0]), level, mask.astype(np.int64), child, bound, at[0], at[1]), ids


# --- building ------------------------------------------------------------------------------------

def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """Index of every row's whole text, written to the shared folder.

    Null and empty texts have no terms and are in no result; rows that repeat a key are
    documents of their own; an empty table gives an empty index; other columns are not read.
    Memory grows with a shard's text or the longest text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(known_id(F.col(key)).alias("doc_id"), F.col(text).alias("text"))

    def count(batches):
        for part in chunks(batches, "text"):
            n = np.diff(terms(*raw(part.column(1)))[2])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], ["documents", "length"])

    total, length = rows.mapInArrow(count, "documents long, length long").agg(F.sum("documents"), F.sum("length")).first()

    def run(batches):
        roll, grams, docs_, ids, held, known = _roll(), [], [], [], 0, 0
        for part in chunks(batches, "text"):
            flat, at = raw(part.column(1))
            if held and held + len(flat) > SHARD_BYTES:
                yield made(grams, docs_, ids)
                grams, docs_, ids, held, known = [], [], [], 0, 0
            gram, first = fingerprints(roll, flat, at)
            n = np.diff(first)
            full = np.flatnonzero(n)
            grams.append(gram)
            docs_.append(np.repeat(known + np.arange(len(full)), n[full]))
            ids.append(part.column(0).to_numpy()[full])
            held, known = held + len(flat), known + len(full)
        if known:
            yield made(grams, docs_, ids)

    def made(grams, docs_, ids):
        parts = shard(*map(np.concatenate, (grams, docs_, ids)), total, length)
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["terms", "tree"])

    if not length:
        return Index(spark.createDataFrame([], "terms binary, tree binary"), 0, 0)
    return Index(stored(rows.mapInArrow(run, "terms binary, tree binary"), "treaps"), total, length)


# --- searching -----------------------------------------------------------------------------------

class Best:
    """The best documents of each item so far: ``k`` rows by score, equal scores by id."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.item, self.doc, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bar = np.ones(items, np.int64)  # a score below it cannot come in

    def offer(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        ok = score >= self.bar[item]
        if not ok.any():
            return
        item, doc, score = (np.concatenate([a, b[ok]]) for a, b in ((self.item, item), (self.doc, doc), (self.score, score)))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        keep = nth < self.k
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]
        last = nth == self.k - 1
        self.bar[item[last]] = score[last]


def descend(tree: Tree, ids: np.ndarray, item: np.ndarray, row: np.ndarray, weight: np.ndarray, best: Best, beam: int = BEAM) -> int:
    """Offer ``best`` the documents of a tree that can enter it; returns the ranges that were halved.

    ``item``, ``row`` and ``weight`` have an entry for each term of an item that the shard holds.
    """
    h, halved = tree.height, 0
    # Ranges (item, level, bound); their entries lie together in the flat arrays (range, row, weight, node).
    used, owner = np.unique(item, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    state = _ranges(tree, used, np.zeros(len(used), np.int64), owner[order], row[order], weight[order],
                    np.zeros(len(order), np.int64), ids, best)
    while True:
        who, level, bound, of, row, weight, node = state
        alive = bound >= best.bar[who]
        if not alive.any():
            return halved
        order = np.lexsort((-bound, who, ~alive))[:int(alive.sum())]
        nth = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        turn = np.zeros(len(who), np.int8)
        turn[order] = 1
        turn[order[nth < beam]] = 2
        halved += int((turn == 2).sum())
        entry = turn[of] == 2
        e_of, e_row, e_weight, e_node = of[entry], row[entry], weight[entry], node[entry]
        e_level = level[e_of]
        shift = h - 1 - e_level
        splits = tree.level[e_node] == e_level
        # A node deeper than the range lies in one half; one of the range's own square has children in both.
        deep = ~splits
        half = [(tree.col[e_node[deep]] >> shift[deep]) & 1]
        pick, to = [np.flatnonzero(deep)], [e_node[deep]]
        up = np.flatnonzero(splits)
        mask, row_bit = tree.mask[e_node[up]], (e_row[up] >> shift[up]) & 1
        for b in (0, 1):
            digit = 2 * row_bit + b
            there = np.flatnonzero((mask >> digit) & 1)
            kid = tree.child[e_node[up[there]]] + _ONES[mask[there] & ((1 << digit[there]) - 1)]
            below = h - tree.level[kid]
            same = (tree.row[kid] >> below) == (e_row[up[there]] >> below)
            pick.append(up[there[same]])
            to.append(kid[same])
            half.append(np.full(int(same.sum()), b))
        pick, to, half = np.concatenate(pick), np.concatenate(to), np.concatenate(half)
        name = 2 * e_of[pick] + half
        order = np.argsort(name, kind="stable")
        pick, to, name = pick[order], to[order], name[order]
        fresh = np.append(True, name[1:] != name[:-1]) if len(name) else np.zeros(0, bool)
        old = name[fresh] // 2
        made = _ranges(tree, who[old], level[old] + 1, np.cumsum(fresh) - 1, e_row[pick], e_weight[pick], to, ids, best)
        waits = turn == 1
        number = np.cumsum(waits) - 1
        entry = waits[of]
        kept = (who[waits], level[waits], bound[waits], number[of[entry]], row[entry], weight[entry], node[entry])
        made = (*made[:3], made[3] + int(waits.sum()), *made[4:])
        state = tuple(np.concatenate(x) for x in zip(kept, made))


def _ranges(tree, who, level, of, row, weight, node, ids, best):
    """The ranges that still need halving; those of points alone give their documents' scores to ``best``."""
    n = len(who)
    if not n:
        return who, level, np.zeros(0, np.int64), of, row, weight, node
    open_ = np.zeros(n, bool)
    open_[of[tree.mask[node] > 0]] = True
    worth = weight * tree.bound[node]
    point = ~open_[of]
    if point.any():
        # A point can belong to another row than the one sought only at the root of a one-point tree.
        point &= tree.row[node] == row
        name = who[of[point]] * (len(ids) + 1) + tree.col[node[point]]
        name, at = np.unique(name, return_inverse=True)
        score = np.zeros(len(name), np.int64)
        np.add.at(score, at, worth[point])
        best.offer(name // (len(ids) + 1), ids[name % (len(ids) + 1)], score)
    bound = np.zeros(n, np.int64)
    np.add.at(bound, of, worth)
    number = np.cumsum(open_) - 1
    entry = open_[of]
    return who[open_], level[open_], bound[open_], number[of[entry]], row[entry], weight[entry], node[entry]


def search(index: Index, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 of every row of ``items``.

    Equal scores rank by ascending doc_id, null ids last.  Items without a term that a
    document holds have no rows; rows that repeat a key are items of their own.  Items are
    searched in blocks of about ``BLOCK_TERMS`` terms, which bounds what is sent to the
    tasks; a block reads the index twice (term rows for the frequencies, then the trees).
    """
    spark = items.sparkSession
    key_type = items.schema[key].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(key).alias("key"), F.col(text).alias("text"))

    def split(batches):
        roll = _roll()
        for part in chunks(batches, "text"):
            gram, first = fingerprints(roll, *raw(part.column(2)))
            own = [np.unique(gram[i:j]).view(np.int64) for i, j in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own, pa.list_(pa.int64()))], ["item", "key", "grams"])

    small_batches(spark)
    asked = stored(rows.mapInArrow(split, f"item long, key {key_type}, grams array<long>"), "items")
    held = asked.agg(F.sum(F.size("grams"))).first()[0] or 0
    blocks = -(-held // BLOCK_TERMS)
    found = [_block(index, asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "grams"), k)
             for b in range(blocks if index.length else 0)]
    if not found:
        return spark.createDataFrame([], f"{key} {key_type}, rank int, doc_id long, score long")
    all_ = found[0]
    for more in found[1:]:
        all_ = all_.unionByName(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = all_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (ranked.join(asked.select("item", "key"), "item")
            .select(F.col("key").alias(key), "rank", given_id(F.col("doc_id")).alias("doc_id"), "score"))


def _block(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(item, doc_id, score): the best ``k`` documents of each task for every item of a block."""
    spark = asked.sparkSession
    listed = asked.toPandas()  # about BLOCK_TERMS terms
    number = listed["item"].to_numpy(np.int64)
    size = listed["grams"].map(len).to_numpy(np.int64)
    gram = np.concatenate([np.zeros(0, np.uint64), *[np.asarray(x, np.int64).view(np.uint64) for x in listed["grams"]]])
    item = np.repeat(np.arange(len(number)), size)
    distinct, at = np.unique(gram, return_inverse=True)
    wanted = spark.sparkContext.broadcast(distinct)

    def frequencies(batches):
        sums = np.zeros(len(wanted.value), np.int64)
        for batch in batches:
            for part in batch.column(0):
                known, df, _ = _unpack(part.as_py())
                spot, there = _find(known, wanted.value)
                sums[there] += df[spot]
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], ["at", "df"])

    counted = index.shards.select("terms").mapInArrow(frequencies, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(len(distinct), np.int64)
    df[counted["at"].to_numpy(np.int64)] = counted["df"].to_numpy(np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    use = df[at] > 0
    sent = spark.sparkContext.broadcast((distinct, item[use], at[use], weight, number))
    total, length = index.documents, index.length

    def run(batches):
        distinct, item, at, weight, number = sent.value
        best = Best(len(number), k)
        for batch in batches:
            for terms_, tree_ in zip(batch.column(0), batch.column(1)):
                known, _, place = _unpack(terms_.as_py())
                spot, there = _find(known, distinct)
                row = np.full(len(distinct), -1)
                row[there] = place[spot]
                mine = row[at] >= 0
                if mine.any():
                    tree, ids = load(tree_.as_py(), total, length)
                    descend(tree, ids, item[mine], row[at[mine]], weight[at[mine]], best)
        yield pa.RecordBatch.from_arrays([pa.array(number[best.item]), pa.array(best.doc), pa.array(best.score)], ["item", "doc_id", "score"])

    return index.shards.select("terms", "tree").mapInArrow(run, "item long, doc_id long, score long")


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``known`` of those ``wanted`` that it holds, and which these are."""
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    there = np.flatnonzero(known[at] == wanted)
    return at[there], there


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest score for every benchmark item."""
    return search(build(documents(spark, sf_dir)), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
full_doc AS (SELECT r, doc_id, terms, len(terms) AS n FROM doc WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n) AS length FROM full_doc),
posting AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM full_doc) GROUP BY r, term),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM posting, total GROUP BY term),
item AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL),
scored AS (
  SELECT item_id, d.doc_id, d.r,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + CAST((90 * n * docs) // length AS BIGINT))))) AS BIGINT) AS score
  FROM item JOIN weight USING (term) JOIN posting USING (term) JOIN full_doc d USING (r), total
  GROUP BY item_id, d.doc_id, d.r),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
