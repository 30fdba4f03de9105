"""Near duplicates by b-bit MinHash signatures and a multi-index Hamming join.

A document's set of shingles becomes ``POSITIONS`` values of 16 bits; the distance of two
signatures is the number of positions that differ.  The positions are split into chunks
with a number of errors allowed in each, so that by pigeonhole any two signatures within
``distance`` agree in some chunk up to its errors; enumerating which positions of a chunk
may be wrong and hashing the others turns that into equality of keys.  No pair within the
distance is missed: for sets of similarity 0.85 the default distance is 4.3 standard
deviations above the expected one.

Pairs so found are sifted by a longer signature, which tells similarities apart more
sharply; pairs at the threshold pass it with the same certainty.

Documents with equal sets are one node from the start.  Within a key only the pairs with
its first node are compared at first; the links found there join components, and then
only pairs of one key whose components still differ are looked at, in blocks.  Every link
is confirmed on the full sets.

Many sets that are all near each other by signature, but hardly one a link, have pairs with
the square of their number.  A piece with more than ``PAIRS`` pairs a row does not list them:
it says which nodes its pairs connect, and the nodes so connected (a crowd) are compared on
their full sets, each with every other, inside the tasks, which give the links that join
components alone.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracity.llm.common import (Rolling, aside, chunks, components, documents, given_id, known_id, let_go, lower, mix, raw,
                                 small_batches, stored, tie, word_hashes, words)

SHINGLE = 5
POSITIONS = 64
DISTANCE = 22
#: Further positions of 8 bits, which only sift the pairs that the first ones found.
SIFTING = 448
#: Standard deviations above the expected distance at which a pair is ruled out.
DEVIATIONS = 4.4
#: Errors enumerated within a chunk.
ERRORS = 1
#: Name of the column that numbers the rows inside the operator.
ROW = "__row"
#: Row numbers that a join sends to every task (8 bytes each) instead of moving texts.
SENT_ROWS = 4_000_000
#: Nodes of one key that are compared in one piece; larger keys are split in blocks of half of it.
BLOCK = 2_048
#: Pairs that a piece may list for each of its rows.
PAIRS = 8
#: Pairs that a task holds before it connects those of pieces with too many.
HELD_PAIRS = 1 << 18
#: Bytes of full sets, and nodes, of a crowd that are compared in one piece.
CROWD_BYTES = 16 << 20
CROWD_NODES = 8_192
#: Nodes of a block from which on a crowd is dealt in up to four blocks, so that several tasks share it.
CROWD_SHARED = 256


def plan(positions: int, distance: int, errors: int) -> list[tuple[list[int], int]]:
    """Chunks of positions with their allowed errors; the sum of (errors + 1) is distance + 1."""
    full, rest = divmod(distance + 1, errors + 1)
    allowed = [errors] * full + ([rest - 1] if rest else [])
    parts = np.array_split(np.arange(positions), len(allowed))
    return [(p.tolist(), e) for p, e in zip(parts, allowed)]


def shingle_sets(flat: np.ndarray, at: np.ndarray, roll: Rolling, seq: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every document in ascending order, and each document's range."""
    flat = lower(flat)
    starts, ends, first = words(flat, at)
    h = word_hashes(roll, flat, starts, ends)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    lo = np.arange(len(h))
    stop = np.repeat(first[1:], np.diff(first))
    use = (lo + SHINGLE <= stop) | (lo == np.repeat(first[:-1], np.diff(first)))
    lo, hi, doc = lo[use], np.minimum(lo + SHINGLE, stop)[use], doc[use]
    s = seq.of(seq.prefix(h), lo, hi) if len(lo) else np.zeros(0, np.uint64)
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    return s, np.searchsorted(doc, np.arange(len(at)))


def _rolls() -> tuple[Rolling, Rolling]:
    return Rolling(0x9E3779B97F4A7C15), Rolling(0xC2B2AE3D27D4EB4F)


def signatures(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, f1, f2, sig, sift): set size, 128-bit fingerprint of the set, signature with the size, sifting positions."""
    small_batches(docs.sparkSession)

    def run(batches):
        roll, seq = _rolls()
        seeds = mix(np.arange(1, POSITIONS + SIFTING + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for part in chunks(batches, "text"):
            s, at = shingle_sets(*raw(part.column(2)), roll, seq)
            n = np.diff(at)
            full = np.flatnonzero(n)
            f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            sig = np.zeros((len(n), POSITIONS + SIFTING), "<u2")
            if len(full):
                f1[full] = np.add.reduceat(mix(s), at[full])
                f2[full] = np.add.reduceat(mix(s ^ np.uint64(0x5851F42D4C957F2D)), at[full])
                for j, seed in enumerate(seeds):
                    least = np.minimum.reduceat((s ^ seed) * (seed | np.uint64(1)), at[full])
                    sig[full, j] = mix(least) >> np.uint64(48)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                 pa.array([x[:POSITIONS].tobytes() + k.tobytes() for x, k in zip(sig, n.astype("<u4"))], pa.binary()),
                 pa.array([x.tobytes() for x in sig[:, POSITIONS:].astype(np.uint8)], pa.binary())],
                ["row", "doc_id", "n_shingles", "f1", "f2", "sig", "sift"])

    rows = docs.select(F.col(ROW).alias("row"), known_id(F.col("doc_id")).alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, "row long, doc_id long, n_shingles long, f1 long, f2 long, sig binary, sift binary")


def key_plan(distance: int, errors: int) -> list[tuple[int, list[int]]]:
    """(number, positions that must agree) of every key of a signature, in order."""
    ways = [(c, k, sorted(set(at) - set(wrong))) for c, (at, allowed) in enumerate(plan(POSITIONS, distance, errors))
            for k, wrong in enumerate(combinations(at, allowed))]
    return [((c << 32) + (k << 8) + 1, at) for c, k, at in ways]


def _named(sig: np.ndarray) -> np.ndarray:
    """A fingerprint of each value and its position."""
    return mix(sig.astype(np.uint64) + (np.arange(POSITIONS).astype(np.uint64) << np.uint64(16)) + np.uint64(1))


def _key(each: np.ndarray, way: tuple[int, list[int]]) -> np.ndarray:
    return mix(each[:, way[1]].sum(1, dtype=np.uint64) + np.uint64(way[0]))


def _first_key(x: np.ndarray, y: np.ndarray, ways) -> np.ndarray:
    """The first key that each pair of signatures has in common (0 where there is none)."""
    same, out = x == y, np.zeros(len(x), np.uint64)
    todo = np.arange(len(x))
    for way in ways:
        hit = same[todo][:, way[1]].all(1)
        out[todo[hit]] = _key(_named(x[todo[hit]]), way)
        todo = todo[~hit]
        if not len(todo):
            break
    return out


def keys(nodes: DataFrame, distance: int = DISTANCE, errors: int = ERRORS) -> DataFrame:
    """(key, node): equal keys for all nodes whose signatures differ in at most ``distance`` positions."""
    ways = key_plan(distance, errors)

    def run(batches):
        for b in batches:
            node = b.column(0).to_numpy()
            each = _named(_signs(b.column(1))[0])
            for way in ways:
                yield pa.RecordBatch.from_arrays([pa.array(_key(each, way).view(np.int64)), pa.array(node)], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def _signs(column) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a column of signatures, and the sizes of the sets."""
    head = 2 * POSITIONS
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), head + 4)
    return (np.ascontiguousarray(flat[:, :head]).view("<u2"), np.ascontiguousarray(flat[:, head:]).view("<u4")[:, 0].astype(np.int64))


def _sifts(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), SIFTING)


def _apart(x, y, distance: int, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each pair of signatures, and whether the pair may be a link by that and by the sizes of the sets."""
    d = (x[0] != y[0]).sum(1)
    return d.astype(np.int32), (d <= distance) & (share[1] * np.minimum(x[1], y[1]) >= share[0] * np.maximum(x[1], y[1]))


def sifting(share: tuple[int, int]) -> int:
    """Largest distance over all positions at which a pair of similarity ``share`` is still expected."""
    s, n = share[0] / share[1], POSITIONS + SIFTING
    return int(np.ceil(n * (1 - s) + DEVIATIONS * np.sqrt(n * s * (1 - s))))


def _both(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """``pairs`` with the column of either node, as x and y."""
    own = nodes.select("node", column)
    return (pairs.join(own.select(F.col("node").alias("b"), F.col(column).alias("y")), "b")
            .join(own.select(F.col("node").alias("a"), F.col(column).alias("x")), "a"))


def _near(pairs: DataFrame, nodes: DataFrame, distance: int, share: tuple[int, int]) -> DataFrame:
    """(a, b, d) of the pairs whose signatures are near; the sifting positions are fetched only for pairs that pass the first ones."""

    def first(batches):
        for t in batches:
            d, ok = _apart(_signs(t.column(2)), _signs(t.column(3)), distance, share)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(d)], ["a", "b", "d"]).filter(pa.array(ok))

    def second(batches):
        for t in batches:
            d = t.column(2).to_numpy() + (_sifts(t.column(3)) != _sifts(t.column(4))).sum(1)
            yield t.select(["a", "b", "d"]).filter(pa.array(d <= sifting(share)))

    near = _both(pairs, nodes, "sig").select("a", "b", "x", "y").mapInArrow(first, "a long, b long, d int")
    return _both(near, nodes, "sift").select("a", "b", "d", "x", "y").mapInArrow(second, "a long, b long, d int")


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, own, brief) of the rows that ``needed`` (node) names: whole hashes of their shingles, and 16 bits of each."""
    texts = _matched(docs.select(F.col(ROW).alias("node"), "text"), needed, "node", "left_semi")

    def sets(batches):
        roll, seq = _rolls()
        for part in chunks(batches, "text"):
            s, at = shingle_sets(*raw(part.column(1)), roll, seq)
            brief = (s & np.uint64(0xFFFF)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([s[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary()),
                 pa.array([brief[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary())], ["node", "own", "brief"])

    return stored(texts.select("node", "text").mapInArrow(sets, "node long, own binary, brief binary"), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets have share[1] * intersection >= share[0] * union.

    Pairs first meet with 16 bits of each shingle: equal shingles agree in them, so what they
    rule out is no link, and whole hashes move only for the pairs left.
    """
    pairs = pairs.select("a", "b")
    own = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    def possible(batches):
        held = np.zeros(1 << 16, bool)
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), "<u2") for v in (x, y))
                most = min(_hits(held, x, y), _hits(held, y, x))  # never less than the intersection
                ok.append(share[1] * most >= share[0] * (len(x) + len(y) - most))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def run(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                same = int((merged[1:] == merged[:-1]).sum())
                ok.append(share[1] * same >= share[0] * (len(x) + len(y) - same))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = _both(pairs, own, "brief").select("a", "b", "x", "y").mapInArrow(possible, "a long, b long")
    return _both(left, own, "own").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _matched(rows: DataFrame, ids: DataFrame, by: str, how: str) -> DataFrame:
    """Semi or anti join of rows with texts by row numbers, which are counted first.

    Up to ``SENT_ROWS`` numbers go to every task, so that no text moves; beyond, both sides are shuffled.
    """
    ids = stored(ids, "numbers")
    return rows.join(F.broadcast(ids) if ids.count() <= SENT_ROWS else ids, by, how)


def _hits(held: np.ndarray, x: np.ndarray, y: np.ndarray) -> int:
    """How many of x's values are among y's; ``held`` is all False before and after."""
    held[y] = True
    n = int(held[x].sum())
    held[y] = False
    return n


def _across(rows: DataFrame, distance: int, share: tuple[int, int]) -> DataFrame:
    """(a, b, crowd): pairs of one key with different roots and near signatures, each given by its first common key alone.

    ``rows`` has key, n (nodes of the key), node, root, sig, sift.  A large key is dealt in blocks,
    every pair of blocks being a piece of its own, so no task holds more than ``BLOCK`` of them.
    A piece with more than ``PAIRS`` such pairs a row gives, with ``crowd``, each node of them as b
    and the least placed node that they connect it to as a.
    """
    ways = key_plan(distance, ERRORS)
    blocks = F.ceil(F.col("n") / (BLOCK // 2)).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pieces = (rows.withColumn("blocks", blocks).withColumn("own", own)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "sig", "sift"))

    def run(batches):
        held = None
        for t in batches:
            t = pa.Table.from_batches([t])
            t = t if held is None else pa.concat_tables([held, t])
            key = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            last = int(new[-1]) if len(new) else 0  # the last piece may go on in the next batch
            held = t.slice(last)
            if last:
                yield from found(t.slice(0, last))
        if held is not None and held.num_rows:
            yield from found(held)

    def found(t):
        t = t.combine_chunks()
        key, i, j, own, node, root = (t.column(c).to_numpy() for c in ("key", "i", "j", "own", "node", "root"))
        sig, sift = _signs(t.column("sig")), _sifts(t.column("sift"))
        end = np.append(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, len(key))
        size = np.diff(np.concatenate([[0], end]))
        left, piece = np.repeat(end, size) - np.arange(len(key)), np.repeat(np.arange(len(size)), size)  # rows of the piece from here on
        count, top, inside = np.zeros(len(size), np.int64), np.arange(len(key)), np.zeros(len(key), bool)
        pairs, held = [], 0

        def sparse():
            """The pairs of pieces that list theirs; those of the others are connected in ``top``."""
            x, y = (np.concatenate(v) for v in zip(*pairs))
            crowded = (count > PAIRS * size)[piece[x]]
            inside[x[crowded]] = inside[y[crowded]] = True
            tie(top, x[crowded], y[crowded])
            return x[~crowded], y[~crowded]

        for step in range(1, int(left.max())):
            x = np.flatnonzero(left > step)
            y = x + step
            ok = (root[x] != root[y]) & ((i[x] == j[x]) | (own[x] != own[y])) & (top[x] != top[y])
            x, y = x[ok], y[ok]
            if len(x):
                d, ok = _apart([v[x] for v in sig], [v[y] for v in sig], distance, share)
                x, y, d = x[ok], y[ok], d[ok]
                ok = d + (sift[x] != sift[y]).sum(1) <= sifting(share)
                x, y = x[ok], y[ok]
                ok = _first_key(sig[0][x], sig[0][y], ways) == key[x].view(np.uint64)
                x, y = x[ok], y[ok]
                count += np.bincount(piece[x], minlength=len(size))
                pairs.append((x, y))
                held += len(x)
            if held > HELD_PAIRS:
                pairs, held = [sparse()], 0
        if pairs:
            x, y = sparse()
            z = np.flatnonzero(inside)
            x, y, crowd = (np.concatenate(v) for v in ((node[x], node[top[z]]), (node[y], node[z]), (np.zeros(len(x), bool), np.ones(len(z), bool))))
            x, y = np.where(crowd, x, np.minimum(x, y)), np.where(crowd, y, np.maximum(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(crowd)], ["a", "b", "crowd"])

    return (pieces.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(run, "a long, b long, crowd boolean").distinct())


def _crowded(crowds: DataFrame, docs: DataFrame, share: tuple[int, int]) -> DataFrame:
    """(a, b): links between the nodes of each crowd that join all the components which any of its links join.

    ``crowds`` has node, crowd, root (of the links known).  A large crowd is dealt in blocks, every
    pair of blocks being a piece of its own, in which all nodes are compared on their full sets.
    """
    rows = stored(_sets(docs, crowds.select("node")).join(crowds, "node").select("crowd", "node", "root", "own"), "crowds")
    blocks = F.ceil(F.greatest(F.sum(F.length("own").cast("long")) / (CROWD_BYTES // 2), F.count("*") / (CROWD_NODES // 2),
                               F.least(F.count("*") / CROWD_SHARED, F.lit(4.0)))).cast("int")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pieces = (rows.join(rows.groupBy("crowd").agg(blocks.alias("blocks")), "crowd").withColumn("block", block)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root", "own"))

    def links(t):
        size = np.array([len(v.as_buffer()) // 8 for v in t.column("own")], np.int64)
        t, size = t.take(pa.array(np.argsort(size, kind="stable"))), np.sort(size)
        node, block, own_block = t.column("node").to_numpy(), t.column("block").to_numpy(), bool(t.column("i")[0] == t.column("j")[0])
        _, label = np.unique(t.column("root").to_numpy(), return_inverse=True)
        names, flat = np.unique(np.frombuffer(b"".join(t.column("own").to_pylist()), np.uint64), return_inverse=True)
        at, held, out = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(names), bool), []
        last = np.searchsorted(size, share[1] * size // share[0], "right")  # larger sets are no links
        for x in range(len(size)):
            y = np.arange(x + 1, last[x])
            y = y[(label[y] != label[x]) & (own_block | (block[y] != block[x]))]
            if not len(y):
                continue
            lo, hi = y[0], y[-1] + 1
            held[flat[at[x]:at[x + 1]]] = True
            same = np.add.reduceat(held[flat[at[lo]:at[hi]]], at[lo:hi] - at[lo], dtype=np.int64)[y - lo]
            held[flat[at[x]:at[x + 1]]] = False
            for k in y[share[1] * same >= share[0] * (size[x] + size[y] - same)]:
                if label[k] != label[x]:
                    out.append((node[x], node[k]))
                    label[label == label[k]] = label[x]
        a, b = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": a, "b": b})

    return pieces.groupBy("crowd", "i", "j").applyInArrow(links, "a long, b long").distinct()


def _unlinked(close: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) of the near pairs whose nodes still lie in different components."""
    of = roots.select("node", "root")
    both = (close.join(of.select(F.col("node").alias("a"), F.col("root").alias("root_a")), "a", "left")
            .join(of.select(F.col("node").alias("b"), F.col("root").alias("root_b")), "b", "left"))
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _not_of_one_crowd(pairs: DataFrame, crowds: DataFrame) -> DataFrame:
    """The pairs (a, b) but those of one crowd, whose nodes are compared there."""
    of = crowds.select("node", "crowd")
    both = (pairs.join(of.select(F.col("node").alias("a"), F.col("crowd").alias("crowd_a")), "a", "left")
            .join(of.select(F.col("node").alias("b"), F.col("crowd").alias("crowd_b")), "b", "left"))
    return both.where(~F.coalesce(F.col("crowd_a") == F.col("crowd_b"), F.lit(False))).select("a", "b")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for every row, written so that it stays the same wherever it is read."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def near_groups(docs: DataFrame, share: tuple[int, int] = (85, 100), distance: int = DISTANCE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for every row of ``docs``.

    ``component_id`` is the least doc_id of the group (itself included), ``kept`` says that
    the row is the one of its group that stays, which has that id.  Null and empty texts
    have no shingles and stay alone.  Rows with a null id rank after all others (a group of
    only such rows has a null component).  Ids only label the groups: rows under one id, or
    without one, are as different as their texts.
    """
    return _grouped(numbered(docs.select("doc_id", "text")), share, distance).drop(ROW)


def _grouped(docs: DataFrame, share: tuple[int, int], distance: int) -> DataFrame:
    """``near_groups`` of numbered rows, with their numbers.

    A node is named by the first row of its set, so different sets are different nodes.
    """
    signed = stored(signatures(docs), "signatures")
    nodes = stored(signed.where("n_shingles > 0").groupBy("f1", "f2")
                   .agg(F.min(F.struct("doc_id", "row")).alias("first"), F.min("sig").alias("sig"), F.min("sift").alias("sift"))
                   .select("f1", "f2", "first", F.col("first.row").alias("node"), "sig", "sift"), "nodes")
    one_key = Window.partitionBy("key")
    member = stored(keys(nodes, distance).withColumns({"hub": F.min("node").over(one_key), "n": F.count("*").over(one_key)})
                    .where("n > 1"), "members")
    let_go(docs.sparkSession)
    star = member.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    close = stored(_near(star, nodes, distance, share), "close")
    let_go(docs.sparkSession)
    first = close.groupBy("b").agg(F.min(F.struct("d", "a")).alias("m")).select("m.a", "b")
    links = stored(_confirmed(first, docs, share), "links")
    roots = components(links)

    # Every pair with a key's first node has been compared, so only keys with two further nodes are open.  A node's
    # pairs with its other hubs, near but not yet confirmed, are among ``close``.
    rooted = (member.where("n > 2 and hub <> node").join(roots, "node", "left")
              .select("key", F.col("n").alias("n"), "node", F.coalesce("root", "node").alias("root")))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key")
    open_rows = rooted.join(mixed, "key", "left_semi").join(nodes.select("node", "sig", "sift"), "node")
    found = stored(_across(open_rows, distance, share), "found")
    let_go(docs.sparkSession)
    rest = found.where("not crowd").select("a", "b").unionByName(_unlinked(close, roots)).distinct().join(first, ["a", "b"], "left_anti")
    tied = found.where("crowd").select("a", "b")
    if tied.isEmpty():
        more = _confirmed(stored(rest, "rest"), docs, share)
    else:
        crowds = stored(components(tied).withColumnRenamed("root", "crowd").join(roots, "node", "left")
                        .select("node", "crowd", F.coalesce("root", "node").alias("root")), "crowds")
        more = _confirmed(stored(_not_of_one_crowd(rest, crowds), "rest"), docs, share).unionByName(_crowded(crowds, docs, share))
    more = stored(more, "links")
    let_go(docs.sparkSession)
    roots = components(links.unionByName(more)) if not more.isEmpty() else roots

    linked = nodes.select("node", "first").join(roots, "node")
    labels = linked.groupBy("root").agg(F.min("first").alias("label"))
    named = (nodes.join(roots, "node", "left").join(labels, "root", "left")
             .select("f1", "f2", F.coalesce("label", "first").alias("label")))
    out = signed.select("row", "doc_id", "n_shingles", "f1", "f2").join(named, ["f1", "f2"], "left")
    alone = F.col("n_shingles") == 0
    label = F.when(alone, F.col("doc_id")).otherwise(F.col("label.doc_id"))
    return out.select(F.col("row").alias(ROW), given_id(F.col("doc_id")).alias("doc_id"), "n_shingles",
                      given_id(label).alias("component_id"), (alone | (F.col("row") == F.col("label.row"))).alias("kept"))


def op5_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents; here ``kept`` goes by the id, so rows that share the least id of a group are all kept."""
    return near_groups(documents(spark, sf_dir)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row, that with the least id, of every group of similarity 0.8 or more."""
    rows, back = aside(docs, "doc_id", "text")
    rows = numbered(rows)
    gone = _grouped(rows, (80, 100), 27).where("not kept").select(ROW)
    return _matched(rows, gone, ROW, "left_anti").select(*back)
