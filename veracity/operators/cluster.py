"""Similarity clustering of sampled responses (C1-C7) and rating roll-ups.

C1/C2 ``similar_pairs``: cosine similarity inside each question, strictly above
a threshold.  The samples of a large question are put in blocks by their angles
to a few of them (pivots); the triangle inequality excludes pairs of blocks, and
every other pair of blocks is its own join key, so the question is spread over
many tasks.  Questions with at most ``chunk`` samples (the usual case: tens of
samples) are not replicated at all.

C3 ``leader_clusters``: greedy leader clustering in sample order.  A sample's
fate depends on earlier leaders.  The samples of large questions are decided
head by head and meet leaders only, not each other.  Of the others, those with few
similar pairs are folded over their neighbour lists, one row each, and those with
more are decided in parallel rounds, sample by sample, so no row holds a whole question.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracity.functions import markers as M
from veracity.functions import parse as P
from veracity.operators.rows import computed_once, filter_once, materialize, unsent


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def quarantine_zero(samples: DataFrame, embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """C4: zero vectors make the original loop spin forever; they, null and non-finite ones are split off."""
    d = samples.withColumn("_norm", norm(F.col(embedding)))
    ok = F.coalesce((F.col("_norm") > 0) & (F.col("_norm") < float("inf")), F.lit(False))  # NaN is above all numbers
    return d.filter(ok), d.filter(~ok).drop("_norm")


#: Added to every angle limit, so that the rounding of acos excludes no pair.
ANGLE_SLACK = 1e-6


def _angle(a: Column, b: Column, na: Column, nb: Column) -> Column:
    return F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(a, b) / (na * nb))))


def _placed(s: DataFrame, large: DataFrame, key: str, limit: float, chunk: int, pivots: int) -> DataFrame:
    """The rows of large questions with ``_d`` (angles to the question's pivots) and ``_block``.

    A row belongs to its nearest pivot's cell, in it to a ring by its angle to
    that pivot, and rings of more than ``chunk`` rows are cut by hash.  A
    question's pivots and ring sizes are one row for each of its chunks, so no
    row of a question waits in one task for its tables.
    """
    picked = (s.join(large, key).groupBy(key, F.pmod(F.xxhash64("_i"), F.lit(pivots)).alias("_slot"))
              .agg(F.min_by(F.struct("_e", "_norm"), "_i").alias("_p"))
              .groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_slot", "_p"))).alias("_ps")))

    def for_each_chunk(t):
        return t.join(large, key).withColumn("_c", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")

    d = s.join(large, key).withColumn("_c", F.pmod(F.xxhash64("_i"), F.col("_k")).cast("int")).drop("_k")
    d = d.join(unsent(for_each_chunk(picked)), [key, "_c"])
    d = computed_once(d, {"_d": F.transform("_ps", lambda p: _angle(F.col("_e"), p["_p"]["_e"], F.col("_norm"), p["_p"]["_norm"]))}).drop("_ps")
    width = max(limit / 2, math.pi / 64)  # at most 65 rings
    d = computed_once(d, {"_cell": F.array_position("_d", F.array_min("_d")) * 128 + F.floor(F.array_min("_d") / width)})
    d = materialize(d, "pivot-angles")
    sizes = (d.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
             .groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_cell", "_n"))).alias("_sizes")))
    d = d.join(unsent(for_each_chunk(sizes)), [key, "_c"])
    parts = F.ceil(F.element_at("_sizes", F.col("_cell")) / chunk)
    return materialize(d.withColumn("_block", F.col("_cell") * (1 << 32) + F.pmod(F.xxhash64("_i"), parts)).drop("_sizes"), "blocks")


#: Tasks over which the pairs of blocks of one question are dealt.
PAIR_SLOTS = 32


def _partners(placed: DataFrame, key: str, limit: float, pivots: int) -> DataFrame:
    """(key, lo, hi, n_lo, n_hi): the pairs of blocks that can hold a pair of rows within the angle ``limit``.

    Two rows' angle is at least the difference of their angles to any pivot.
    A pair of blocks is left out only if for some pivot the blocks' ranges lie
    further apart than the limit.  The blocks of a question are dealt over
    ``PAIR_SLOTS`` tasks, each of which gets all of them as partners.
    """
    at = [F.get("_d", F.lit(k)) for k in range(pivots)]
    blocks = placed.groupBy(key, "_block").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(x) for x in at]).alias("near"), F.array(*[F.max(x) for x in at]).alias("far"))
    a = blocks.select(key, F.pmod(F.xxhash64("_block"), F.lit(PAIR_SLOTS)).cast("int").alias("_slot"),
                      F.col("_block").alias("lo"), F.col("n").alias("n_lo"), F.col("near").alias("near_a"), F.col("far").alias("far_a"))
    b = blocks.select(key, F.explode(F.sequence(F.lit(0), F.lit(PAIR_SLOTS - 1))).alias("_slot"),
                      F.col("_block").alias("hi"), F.col("n").alias("n_hi"), F.col("near").alias("near_b"), F.col("far").alias("far_b"))

    def gap(near, far):
        return F.exists(F.zip_with(near, far, lambda x, y: F.coalesce(x - y > limit, F.lit(False))), lambda g: g)

    apart = gap("near_a", "far_b") | gap("near_b", "far_a")
    return materialize(a.join(unsent(b), [key, "_slot"]).where((F.col("lo") <= F.col("hi")) & ~apart).select(key, "lo", "hi", "n_lo", "n_hi"), "block-pairs")


def _large(samples: DataFrame, key: str, chunk: int) -> DataFrame:
    """(key, _k): the questions of more than ``chunk`` rows and their number of chunks; no vector is read for it."""
    return materialize(samples.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("_k"))
                       .where(F.col("_k") > 1), "large-questions")


def _prepared(samples: DataFrame, threshold: float, key: str, idx: str, embedding: str, chunk: int, pivots: int):
    """Rows of small questions, blocks of large ones, their block pairs (None twice without a large question)."""
    good, _ = quarantine_zero(samples, embedding)
    s = good.where(F.col(idx).isNotNull()).select(key, F.col(idx).alias("_i"), F.col(embedding).alias("_e"), "_norm")
    large = _large(samples, key, chunk)
    if large.isEmpty():
        return s, None, None
    limit = math.acos(max(-1.0, min(1.0, threshold))) + ANGLE_SLACK
    placed = _placed(s, large, key, limit, chunk, pivots)
    return s.join(large, key, "left_anti"), placed, _partners(placed, key, limit, pivots)


def similar_pairs(samples: DataFrame, threshold: float = 0.9, key: str = "question_id",
                  idx: str = "sample_idx", embedding: str = "embedding", chunk: int = 256, pivots: int = 32) -> DataFrame:
    """Pairs (i < j) of one question with cosine similarity > threshold.

    Questions of at most ``chunk`` rows are compared whole.  Larger
    ones meet block by block, without the pairs of blocks that the angles to
    at most ``pivots`` of their rows exclude; every pair left is compared, so
    the result does not depend on ``chunk`` or ``pivots``.  Zero, null and
    non-finite vectors have no partner; neither has a row with a null key or index.
    """
    small, placed, partners = _prepared(samples, threshold, key, idx, embedding, chunk, pivots)

    def side(d, *keys):
        a = d.select(key, *keys, F.col("_i").alias("a"), F.col("_e").alias("ea"), F.col("_norm").alias("na"))
        return a, a.withColumnsRenamed({"a": "b", "ea": "eb", "na": "nb"})

    cos = dot(F.col("ea"), F.col("eb")) / (F.col("na") * F.col("nb"))

    def kept(joined):
        return joined.select(key, F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), cos.alias("cosine")).where(F.col("cosine") > threshold)

    a, b = side(small)
    out = kept(a.join(b, key).where(F.col("a") < F.col("b")))
    if placed is None:
        return out
    pairs = partners.select(key, "lo", "hi")
    a, _ = side(placed.withColumnRenamed("_block", "lo").join(unsent(pairs), [key, "lo"]), "lo", "hi")
    _, b = side(placed.withColumnRenamed("_block", "hi").join(unsent(pairs), [key, "hi"]), "lo", "hi")
    # within a block each pair once; between blocks the smaller index may be on either side
    return out.unionByName(kept(a.join(unsent(b), [key, "lo", "hi"]).where((F.col("lo") < F.col("hi")) | (F.col("a") < F.col("b")))))


def compared_pairs(samples: DataFrame, threshold: float = 0.9, key: str = "question_id", idx: str = "sample_idx",
                   embedding: str = "embedding", chunk: int = 256, pivots: int = 32) -> DataFrame:
    """(key, n_samples, n_pairs, n_compared): what ``similar_pairs`` compares of all pairs of each question.

    Counted from the sizes of the blocks and their pairs; no pair is formed.
    """
    small, placed, partners = _prepared(samples, threshold, key, idx, embedding, chunk, pivots)

    def pairs_of(n):
        return F.expr(f"{n} * ({n} - 1) div 2")

    count = F.count(F.lit(1)).alias("n_samples")
    out = small.groupBy(key).agg(count).select("*", pairs_of("n_samples").alias("n_pairs"), pairs_of("n_samples").alias("n_compared"))
    if placed is None:
        return out
    done = partners.groupBy(key).agg(F.sum(F.when(F.col("lo") == F.col("hi"), pairs_of("n_lo")).otherwise(F.col("n_lo") * F.col("n_hi"))).alias("n_compared"))
    return out.unionByName(placed.groupBy(key).agg(count).join(done, key).select(key, "n_samples", pairs_of("n_samples").alias("n_pairs"), "n_compared"))


#: Similar pairs of a question up to which its leaders are found by one fold over one row.
FOLD_PAIRS = 20_000


def _folded(pairs: DataFrame, key: str) -> DataFrame:
    """(key, leader_idx, size) of questions whose pairs fit one row: a fold over the neighbour lists in sample order."""
    adj = pairs.groupBy(key, "i").agg(F.array_sort(F.collect_list("j")).alias("js"))
    nodes = adj.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "js"))).alias("nodes"))
    init = F.struct(F.array().cast("array<int>").alias("taken"),
                    F.array().cast("array<struct<leader:int,size:int>>").alias("out"))

    def step(st, nd):
        new = F.array_except(nd["js"], st["taken"])
        skip = F.array_contains(st["taken"], nd["i"]) | (F.size(new) == 0)
        emitted = F.array_append(st["out"], F.struct(nd["i"].alias("leader"), (F.size(new) + 1).alias("size")))
        return F.when(skip, st).otherwise(
            F.struct(F.array_union(st["taken"], nd["js"]).alias("taken"), emitted.alias("out")))

    folded = nodes.select(key, F.aggregate("nodes", init, step)["out"].alias("clusters"))
    return folded.select(key, F.explode("clusters").alias("c")).select(
        key, F.col("c.leader").alias("leader_idx"), F.col("c.size").alias("size"))


def _taken(pairs: DataFrame, key: str) -> DataFrame:
    """(key, n): the samples that some earlier leader takes.

    The leaders are the first maximal independent set in sample order.  In
    every round the samples without an undecided smaller neighbour lead, their
    neighbours are taken, and both leave with their pairs.  At least the
    smallest sample of each question is decided in a round; a chain of
    neighbours in sample order needs a round for every second link.  Rounds
    are written to the shared folder, and no row holds more than one pair.
    """
    left, taken = pairs.select(key, "i", "j"), None
    while True:
        leads = left.select(key, "i").distinct().join(left.select(key, F.col("j").alias("i")).distinct(), [key, "i"], "left_anti")
        now = materialize(left.join(leads, [key, "i"], "left_semi").select(key, F.col("j").alias("n")).distinct(), "taken")
        taken = now if taken is None else taken.unionByName(now)
        if now.isEmpty():
            return taken
        left = materialize(left.join(now.withColumnRenamed("n", "i"), [key, "i"], "left_anti")
                           .join(now.withColumnRenamed("n", "j"), [key, "j"], "left_anti"), "undecided")


def _by_rounds(pairs: DataFrame, key: str) -> DataFrame:
    """(key, leader_idx, size) as ``_folded`` gives it, for questions of any size: a taken sample goes to its least leader."""
    of_leaders = pairs.select(key, "i", "j").join(_taken(pairs, key).withColumnRenamed("n", "i"), [key, "i"], "left_anti")
    return (of_leaders.groupBy(key, "j").agg(F.min("i").alias("leader_idx"))
            .groupBy(key, "leader_idx").agg((F.count(F.lit(1)) + 1).cast("int").alias("size")))


def leaders_of_pairs(pairs: DataFrame, key: str = "question_id", fold_pairs: int = FOLD_PAIRS) -> DataFrame:
    """(key, leader_idx, size) from the similar pairs (i < j) of each question.

    Questions of up to ``fold_pairs`` pairs are folded in one row each, larger
    ones take part in the rounds of ``_taken``; both give the same clusters.
    """
    pairs = materialize(pairs.select(key, "i", "j"), "similar-pairs")
    large = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > fold_pairs).select(key)
    if large.isEmpty():
        return _folded(pairs, key)
    large = materialize(large, "large-questions")
    return (_folded(pairs.join(large, key, "left_anti"), key)
            .unionByName(_by_rounds(pairs.join(large, key, "left_semi"), key)))


#: Undecided samples of a question that one round decides whole, about; rows that meet its leaders in one task.
HEAD, SLOT_ROWS = 8192, 8192
#: Cosines nearer to the threshold than this are computed as ``dot`` and ``norm`` do, term by term.
COSINE_SLACK = 1e-9


class _Vectors:
    """The ``_e`` and ``_norm`` of a table as arrays; shorter vectors are filled up with zeros."""

    def __init__(self, t: pa.Table):
        e = t.column("_e").combine_chunks()
        self.size = pc.list_value_length(e).to_numpy(zero_copy_only=False).astype(np.int64)
        self.norm = t.column("_norm").to_numpy()
        self.raw = np.zeros((len(self.size), int(self.size.max(initial=0))))
        self.raw[np.arange(self.raw.shape[1]) < self.size[:, None]] = e.flatten().to_numpy(zero_copy_only=False)
        self.unit = self.raw / self.norm[:, None]

    def like(self, rows: np.ndarray, other: "_Vectors", threshold: float) -> np.ndarray:
        """For ``rows`` of these and all of ``other``: is the cosine above the threshold."""
        d = min(self.raw.shape[1], other.raw.shape[1])
        cosine = self.unit[rows, :d] @ other.unit[:, :d].T
        hit = cosine > threshold + COSINE_SLACK
        a, b = np.nonzero(~hit & ~(cosine < threshold - COSINE_SLACK))
        if len(a):
            total = np.zeros(len(a))
            for k in range(d):
                total += self.raw[rows[a], k] * other.raw[b, k]
            hit[a, b] = ~(total / (self.norm[rows[a]] * other.norm[b]) <= threshold)
        return hit & (self.size[rows][:, None] == other.size[None, :])


def _decided(t: pa.Table, key: str, index: np.ndarray, leader: np.ndarray) -> pa.Table:
    own = pa.chunked_array([t.column(key).slice(0, 1).take(pa.array(np.zeros(len(index), np.int64))).combine_chunks()])
    kind = t.schema.field("_i").type
    return pa.Table.from_arrays([own, pa.array(index).cast(kind), pa.array(leader).cast(kind)], [key, "_i", "_l"])


def _led(rows: DataFrame, large: DataFrame, threshold: float, key: str, head: int) -> DataFrame:
    """(key, leader_idx, size) of the large questions, from their vectors; no pair of two followers is formed.

    In every round the first ``head`` undecided samples of a question, or half as many
    at least, are decided in sample order by one task; then all later undecided
    samples meet the round's leaders, spread over the question's slots, and those near
    one belong to the least.  Earlier rounds have the smaller leaders, so what a round
    decides stays.  The leaders of a question are compared with each sample left once: the work
    is samples times leaders, and no row or task holds more than a head and a slot.
    """
    left = materialize(rows.join(large, key).dropDuplicates([key, "_i", "_e"])
                       .withColumn("_s", F.pmod(F.xxhash64("_i"), F.col("_k")).cast("int")), "undecided")
    schema = T.StructType([left.schema[key], left.schema["_i"], T.StructField("_l", left.schema["_i"].dataType)])
    halves = [0.5 ** k for k in range(30)]

    def lead(t: pa.Table) -> pa.Table:
        t = t.sort_by("_i")
        v = _Vectors(t)
        index, node = np.unique(t.column("_i").to_numpy(), return_inverse=True)
        first = np.searchsorted(node, np.arange(len(index) + 1))
        leader = np.full(len(index), -1)
        for n in range(len(index)):
            if leader[n] < 0:
                leader[n] = n
                near = np.zeros(len(index), bool)
                near[node[v.like(np.arange(first[n], first[n + 1]), v, threshold).any(axis=0)]] = True
                near[:n + 1] = False
                leader[near & (leader < 0)] = n
        return _decided(t, key, index, index[leader])

    def follow(t: pa.Table, leaders: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not t.num_rows or not leaders.num_rows:
            return _decided(t if t.num_rows else leaders, key, none, none)
        leaders = leaders.sort_by("_i")
        v, w, by = _Vectors(t), _Vectors(leaders), leaders.column("_i").to_numpy()
        least = np.full(t.num_rows, len(by))
        for lo in range(0, t.num_rows, 1024):
            hit = v.like(np.arange(lo, min(lo + 1024, t.num_rows)), w, threshold)
            least[lo:lo + 1024] = np.where(hit.any(axis=1), hit.argmax(axis=1), len(by))
        index, node = np.unique(t.column("_i").to_numpy(), return_inverse=True)
        best = np.full(len(index), len(by))
        np.minimum.at(best, node, least)
        return _decided(t, key, index[best < len(by)], by[best[best < len(by)]])

    decided = None
    while not left.isEmpty():
        cuts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_i", halves, 1_000_000).alias("_q")).select(
            key, F.expr(f"get(_q, greatest(0, cast(ceil(log2(_n / {head})) as int)))").alias("_cut"))
        cuts = materialize(cuts, "cuts")
        ahead = left.join(cuts, key).where(F.col("_i") <= F.col("_cut")).drop("_cut")
        heads = materialize(ahead.groupBy(key).applyInArrow(lead, schema), "heads")
        leaders = materialize(ahead.join(unsent(heads.where("_i = _l").select(key, "_i")), [key, "_i"], "left_semi"), "leaders")
        leaders = leaders.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
        rest = left.join(cuts, key).where(F.col("_i") > F.col("_cut")).drop("_cut")
        taken = materialize(rest.groupBy(key, "_s").cogroup(leaders.groupBy(key, "_s")).applyInArrow(follow, schema), "taken")
        decided = heads.unionByName(taken) if decided is None else decided.unionByName(heads).unionByName(taken)
        left = materialize(rest.join(unsent(taken.select(key, "_i")), [key, "_i"], "left_anti"), "undecided")
    if decided is None:
        decided = rows.sparkSession.createDataFrame([], schema)
    return decided.groupBy(key, F.col("_l").alias("leader_idx")).agg(F.count(F.lit(1)).cast("int").alias("size")).where("size > 1")


def leader_clusters(samples: DataFrame, threshold: float = 0.9, key: str = "question_id",
                    idx: str = "sample_idx", embedding: str = "embedding",
                    text: str | None = None, fold_pairs: int = FOLD_PAIRS, chunk: int = 256, head: int = HEAD) -> DataFrame:
    """One row per cluster: leader index, size, rank by size (desc, stable on index).

    Samples without any later neighbour can only be singletons, which the rule
    drops, so only samples with neighbours take part.  Samples whose vector is
    zero or null are in no cluster; ``checked_clusters`` gives them back.
    Questions of at most ``chunk`` rows are decided from their similar pairs, larger
    ones from their vectors, ``head`` samples a round.
    """
    large = _large(samples, key, chunk)
    if large.isEmpty():
        out = leaders_of_pairs(similar_pairs(samples, threshold, key, idx, embedding), key, fold_pairs)
    else:
        small = samples.join(large, key, "left_anti")
        out = leaders_of_pairs(similar_pairs(small, threshold, key, idx, embedding, chunk), key, fold_pairs)
        good, _ = quarantine_zero(samples, embedding)
        rows = good.where(F.col(idx).isNotNull()).select(
            key, F.col(idx).alias("_i"), F.col(embedding).cast("array<double>").alias("_e"), "_norm")
        slots = large.select(key, F.ceil(F.col("_k") * (chunk / SLOT_ROWS)).cast("int").alias("_k"))
        out = out.unionByName(_led(rows, slots, threshold, key, head))
    place, rank = Window.partitionBy(key).orderBy("leader_idx"), Window.partitionBy(key).orderBy(F.desc("size"), "leader_idx")
    out = out.select(key, (F.row_number().over(place) - 1).alias("cluster_pos"), "leader_idx", "size",
                     (F.row_number().over(rank) - 1).alias("size_rank"))
    if text is not None:
        t = samples.select(key, F.col(idx).alias("leader_idx"), F.col(text).alias("response"))
        out = out.join(t, [key, "leader_idx"])
    return out


def checked_clusters(samples: DataFrame, threshold: float = 0.9, key: str = "question_id", idx: str = "sample_idx",
                     embedding: str = "embedding", text: str | None = None,
                     fold_pairs: int = FOLD_PAIRS) -> tuple[DataFrame, DataFrame]:
    """C3 with C4: the clusters, and the samples left out because their vector is zero or null."""
    good, bad = quarantine_zero(samples, embedding)
    return leader_clusters(good.drop("_norm"), threshold, key, idx, embedding, text, fold_pairs), bad


def group_samples(samples: DataFrame, key: str = "question_id", idx: str = "sample_idx",
                  cols=("chain", "reflection")) -> DataFrame:
    """The samples of a question as arrays in sample order."""
    g = samples.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(idx, *cols))).alias("_s"))
    def field(c):
        return F.transform("_s", lambda x: x[c]).alias(f"{c}s")

    return g.select(key, F.size("_s").alias("n_samples"), *[field(c) for c in cols])


def pair_reasons(grouped: DataFrame, clusters: DataFrame, key: str = "question_id",
                 pair: str = "position") -> DataFrame:
    """C6 + F11: pair reason k with cluster k, cut to the shorter list, drop ``N/A`` reasons.

    ``pair='position'`` is the reference rule (reason of sample k with the k-th
    cluster); ``pair='leader'`` pairs each cluster with its leader's reason.
    Questions with nothing left are dropped.
    """
    cl = clusters.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("cluster_pos", "leader_idx", "size", "response"))).alias("clusters"))
    d = grouped.join(cl, key)
    if pair == "position":
        n = F.least(F.size("reflections"), F.size("clusters"))
        zipped = F.zip_with(F.slice("reflections", 1, n), F.slice("clusters", 1, n),
                            lambda r, c: F.struct(r.alias("reason"), c.alias("cluster")))
    elif pair == "leader":
        zipped = F.transform("clusters", lambda c: F.struct(
            F.element_at("reflections", c["leader_idx"] + 1).alias("reason"), c.alias("cluster")))
    else:
        raise ValueError(f"unknown pairing {pair!r}")
    kept = F.filter(zipped, lambda z: ~z["reason"].contains(M.NOT_AVAILABLE))
    d = filter_once(d.withColumn("pairs", kept), lambda r: F.size(r["pairs"]) > 0)
    return d.select(key, F.transform("pairs", lambda z: z["reason"]).alias("reasons"),
                    F.transform("pairs", lambda z: z["cluster"]).alias("kept_clusters"),
                    F.size("clusters").alias("n_clusters"))


def min_clusters(df: DataFrame, k: int = 2, n_clusters: str = "n_clusters") -> DataFrame:
    """keep questions with at least ``k`` clusters (off in the reference run)."""
    return df.filter(F.col(n_clusters) >= k)


def first_reply(replies: DataFrame, max_tries: int, key: str = "question_id") -> DataFrame:
    """First non-null reply among the first ``max_tries`` attempts (null if none)."""
    ok = F.col("reply").isNotNull() & (F.col("attempt") < max_tries)
    return replies.groupBy(key).agg(F.min_by("reply", F.when(ok, F.col("attempt"))).alias("reply"))


def extract_ratings(replies: DataFrame, max_tries: int = 4, key: str = "question_id") -> DataFrame:
    """Rating of the first delivered reply; failed parse -> 0 with ``parsed`` false."""
    r = first_reply(replies, max_tries, key).withColumn("_v", P.rating_value("reply"))
    return r.select(key, "reply", F.coalesce("_v", F.lit(0.0)).alias("numerical_score"),
                    F.col("_v").isNotNull().alias("parsed"))


def rating_mean(ratings: DataFrame) -> DataFrame:
    """Mean over successfully parsed ratings only (null when none)."""
    return ratings.agg(F.avg(F.when(F.col("parsed"), F.col("numerical_score"))).alias("mean_score"),
                       F.count(F.when(F.col("parsed"), 1)).alias("n_parsed"),
                       F.count(F.lit(1)).alias("n_questions"))


def extract_summaries(replies: DataFrame, max_tries: int = 3, key: str = "question_id") -> DataFrame:
    """Summary reason of the first delivered reply, '' when none."""
    r = first_reply(replies, max_tries, key)
    return r.select(key, F.coalesce(P.summary_reason("reply"), F.lit("")).alias("summary"))


def cap_questions(df: DataFrame, n: int = 100, order: str = "question_id") -> DataFrame:
    """the first ``n`` questions that reached scoring (skipped ones do not count)."""
    return df.orderBy(order).limit(n)
