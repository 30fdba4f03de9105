"""Exact substring deduplication by recompression of word sequences.

Rounds of recompression give every document a hierarchy of symbols: a round first names
every run of equal symbols, then splits the alphabet by a bit of each name into left and
right symbols and names every pair of a left and a following right one.  Names are
fingerprints of what they stand for, so the same run or pair gets the same name in every
document of the corpus, and whether two neighbouring symbols stay apart depends on a known
stretch of words around them (tracked here exactly).  Hence equal passages have equal
symbols in their interior.

A window of ``WINDOW`` words is filed under the symbol boundary of the highest round whose
stretch lies inside it, which is the same boundary wherever the window occurs.  All windows
in a row that share a boundary form one entry: (boundary name, fingerprint of the whole
passage, place).  Entries of equal passages repeat as a whole, and all but the first are
removed without looking at single windows.  Only where passages with one boundary name
differ (at the ends of a repeat) are the windows of one copy of each compared themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracity.llm.common import Rolling, aside, chunks, documents, free_shuffles, known_id, mix, raw, small_batches, stored, word_hashes, words

WINDOW = 20
#: Two rounds name stretches of about four words, which leaves room to slide within a window;
#: the boundaries of later rounds need more of the window and change more often along the text.
ROUNDS = 2
#: Runs are named in the first round; between equal symbols of a later round no boundary is used.
RUN_ROUNDS = (1,)
#: A boundary name with more passages than this within a task sends its windows on at once.
HEAVY = 64
#: Up to so many repeated ids (counted first) are sent to the tasks; beyond, the join with them is shuffled.
REPEATED_IDS = 1_000_000


def boundaries(h: np.ndarray, first: np.ndarray, rounds: int = ROUNDS):
    """For each round: places, names, and words needed on the left and right of every symbol boundary.

    Needs that reach beyond the document are larger than any window.
    """
    n = len(h)
    starts_doc = np.zeros(n + 1, bool)
    starts_doc[first] = True
    st, en, name = np.arange(n), np.arange(1, n + 1), h
    lc, rc = st.copy(), en.copy()
    far = np.int64(1 << 40)
    for r in range(1, rounds + 1):
        if r in RUN_ROUNDS:
            alone = np.ones(len(st) + 1, bool)  # symbol i does not continue the run of i - 1
            alone[1:-1] = (name[1:] != name[:-1]) | starts_doc[st[1:]]
            head = np.flatnonzero(alone[:-1])
            tail = np.flatnonzero(alone[1:])
            long = tail - head + 1
            st_ = st
            name, st, en = np.where(long > 1, mix(name[head] * np.uint64(0x9FB21C651E98DF25) + long.astype(np.uint64)), name[head]), st[head], en[tail]
            wide_l, wide_r = _beside(lc, rc, starts_doc, st_, far)  # a run ends where the next symbol differs
            lc, rc = wide_l[head], wide_r[tail]
        left = mix(name + np.uint64(r * 0xA24BAED4963EE407 % (1 << 64))) >> np.uint64(63) == 1
        pair = np.zeros(len(st) + 1, bool)  # pair[i + 1]: symbols i and i + 1 join
        pair[1:-1] = left[:-1] & ~left[1:] & ~starts_doc[st[1:]]
        opens, closes = pair[1:], pair[:-1]
        wide_l, wide_r = _beside(lc, rc, starts_doc, st, far)
        lc = np.where(~left & ~closes, wide_l, lc)
        rc = np.where(left & ~opens, wide_r, rc)
        head = np.flatnonzero(~closes)
        tail = head + opens[head]
        name = np.where(opens[head], mix(name[head] * np.uint64(0xD6E8FEB86659FD93) + mix(name[tail] + np.uint64(r))), name[head])
        st, en, lc, rc = st[head], en[tail], lc[head], rc[tail]
        inner = 1 + np.flatnonzero(~starts_doc[st[1:]] & (name[1:] != name[:-1]))
        p = st[inner]
        yield (r, p, mix(name[inner - 1] * np.uint64(0x9E3779B97F4A7C15) + name[inner]),
               p - np.minimum(lc[inner - 1], lc[inner]), np.maximum(rc[inner - 1], rc[inner]) - p)


def _beside(lc, rc, starts_doc, st, far):
    """Stretches widened by the neighbouring symbols'; without a neighbour in the document, beyond any window."""
    wide_l, wide_r = np.empty_like(lc), np.empty_like(rc)
    wide_l[0], wide_r[-1] = -far, far
    wide_l[1:] = np.where(starts_doc[st[1:]], -far, np.minimum(lc[1:], lc[:-1]))
    wide_r[:-1] = np.where(starts_doc[st[1:]], far, np.maximum(rc[1:], rc[:-1]))
    return wide_l, wide_r


def filed(h: np.ndarray, first: np.ndarray, window: int = WINDOW):
    """Entries (first window, last window, place and rank of the boundary): runs of windows with one boundary.

    The boundary of a window is that of the highest round that fits, of these the one with
    the largest name, of equals the leftmost; a window without any is filed by its word of
    largest name, so every window of every document is in one entry.
    """
    n = len(h)
    if not n:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    best, off = np.zeros(n, np.uint64), np.zeros(n, np.int8)
    stop = np.repeat(first[1:], np.diff(first))
    valid = np.arange(n) + window <= stop
    found = [(0, np.arange(n), mix(h), np.zeros(n, np.int64), np.ones(n, np.int64)), *boundaries(h, first)]
    for r, p, name, a, b in reversed(found):
        lacking = valid & (best == 0)
        if not lacking.any():
            break
        near = np.concatenate([[0], np.cumsum(lacking)])
        ok = (a + b <= window) & (near[p + 1] > near[np.maximum(p - window + 1, 0)])
        p, name, a, b = p[ok], name[ok], a[ok], b[ok]
        if len(p) < n // 16:
            rank = (name >> np.uint64(4)) | np.uint64((r << 60) + 1)
            for k in range(window):
                use = (a <= k) & (k + b <= window) & (p >= k)
                at, mine = p[use] - k, rank[use]
                better = mine > best[at]
                best[at[better]], off[at[better]] = mine[better], k
            continue
        rank, least, most = np.zeros(n, np.uint64), np.full(n, 127, np.int8), np.full(n, -1, np.int8)
        rank[p], least[p], most[p] = (name >> np.uint64(4)) | np.uint64((r << 60) + 1), a, window - b
        for k in range(min(window, n)):
            to = best[:n - k]
            better = (least[k:] <= k) & (most[k:] >= k) & (rank[k:] > to)
            np.copyto(to, rank[k:], where=better)
            np.copyto(off[:n - k], np.int8(k), where=better)
    at = np.arange(n) + off
    s = np.flatnonzero(valid)
    if not len(s):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    new = np.ones(len(s), bool)
    new[1:] = (at[s[1:]] != at[s[:-1]]) | (best[s[1:]] != best[s[:-1]]) | (s[1:] != s[:-1] + 1)
    lo = s[new]
    hi = s[np.append(np.flatnonzero(new)[1:], len(s)) - 1]
    return lo, hi, at[lo], best[lo]


ENTRY, WINDOWS, REMOVED, MARK, PROBE = range(5)
_ROWS = "kind byte, key long, whole long, doc long, version long, pos long, n int"
_NAMES = ["kind", "key", "whole", "doc", "version", "pos", "n"]


def _batch(kind, key, whole, doc, version, pos, n) -> pa.RecordBatch:
    size = len(doc)
    full = [np.broadcast_to(np.asarray(x, t), size) for x, t in ((kind, np.int8), (key, None), (whole, None), (doc, np.int64), (version, np.int64), (pos, np.int64),
                                                                 (n, np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x) for x in full], _NAMES)


class _Reader:
    """Words of a chunk of documents with two independent fingerprints, and their documents' ids and versions."""

    def __init__(self):
        self.rolls = [Rolling(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]

    def read(self, part: pa.RecordBatch):
        flat, at = raw(part.column(2))
        starts, ends, self.first = words(flat, at)
        self.h = word_hashes(self.rolls[0], flat, starts, ends)
        self.prefix = [self.rolls[2].prefix(self.h), self.rolls[3].prefix(word_hashes(self.rolls[1], flat, starts, ends))]
        self.row = np.repeat(np.arange(part.num_rows), np.diff(self.first))
        self.doc, self.version = part.column(0).to_numpy(), part.column(1).to_numpy()

    def passage(self, lo, hi):
        return (self.rolls[2].of(self.prefix[0], lo, hi), self.rolls[3].of(self.prefix[1], lo, hi))

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, version of its text, and word number within it."""
        row = self.row[at]
        return self.doc[row], self.version[row], at - self.first[row]


def _firsts(key, whole, doc, version, pos):
    """Order by (key, whole, doc, pos, version); whether each is the first of its (key, whole), and whether the first's very place."""
    order = np.lexsort((version, pos, doc, whole, key))
    key, whole, doc, version, pos = key[order], whole[order], doc[order], version[order], pos[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0)) if len(key) else new
    return order, new, (doc == doc[lead]) & (pos == pos[lead]) & (version == version[lead])


def _spans(reader: _Reader, lo: np.ndarray, hi: np.ndarray):
    """Removed stretches of the windows lo..hi, touching ones joined."""
    order = np.argsort(lo)
    lo, hi = lo[order], hi[order]
    new = np.ones(len(lo), bool)
    new[1:] = (lo[1:] > hi[:-1] + 1) | (reader.row[lo[1:]] != reader.row[lo[:-1]])
    last = np.append(np.flatnonzero(new)[1:], len(lo)) - 1
    lo, hi = lo[new], hi[last] if len(lo) else hi
    doc, version, pos = reader.place(lo)
    return _batch(REMOVED, pos * 31 + doc + version, 0, doc, version, pos, hi - lo + WINDOW)


def _windows(reader: _Reader, lo: np.ndarray, hi: np.ndarray):
    """Single windows of the entries: of equal ones in this chunk the first is sent on, the others are removed."""
    n = hi - lo + 1
    w = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
    a, b = reader.passage(w, w + WINDOW)
    doc, version, pos = reader.place(w)
    order, new, same = _firsts(a, b, doc, version, pos)
    first, more = order[new], order[~new & ~same]
    yield _batch(WINDOWS, a[first], b[first], doc[first], version[first], pos[first], 1)
    yield _spans(reader, w[more], w[more])


def _entries(batches):
    """Entries of each chunk; of equal ones the first is sent on, the others are removed."""
    reader = _Reader()
    for part in chunks(batches, "text"):
        reader.read(part)
        lo, hi, at, rank = filed(reader.h, reader.first)
        if not len(lo):
            continue
        whole_a, whole_b = reader.passage(lo, hi + WINDOW)
        key = mix(rank + (rank >> np.uint64(60)))
        whole = mix((whole_b ^ (whole_a >> np.uint64(1))) + (at - lo).astype(np.uint64))
        doc, version, pos = reader.place(lo)
        order, new, same = _firsts(key, whole, doc, version, pos)
        more, first = order[~new & ~same], order[new]
        if len(more):
            yield _spans(reader, lo[more], hi[more])
        names, back, kinds = np.unique(key[first], return_inverse=True, return_counts=True)
        heavy = kinds > HEAVY
        if heavy.any():
            yield _batch(MARK, names[heavy], 0, np.zeros(heavy.sum()), 0, 0, 0)
            many = first[heavy[back]]
            yield from _windows(reader, lo[many], hi[many])
            first = first[~heavy[back]]
        yield _batch(ENTRY, key[first], whole[first], doc[first], version[first], pos[first], (hi - lo + 1)[first])


def _resolve(batches):
    """Rows sorted by kind of name, name, passage and place: repeats become removed stretches, open cases probes."""
    last = None  # (class, key, whole), its first (doc, version, pos), several passages seen, first of the only passage not sent yet
    for b in batches:
        kind, key, whole, doc, version, pos, n = (b.column(c).to_numpy() for c in range(7))
        away = kind == REMOVED
        if away.any():
            yield _batch(REMOVED, 0, 0, doc[away], version[away], pos[away], n[away])
            kind, key, whole, doc, version, pos, n = (x[~away] for x in (kind, key, whole, doc, version, pos, n))
        if not len(kind):
            continue
        single = kind == WINDOWS
        mark = kind == MARK
        new_key, new = np.ones(len(key), bool), np.ones(len(key), bool)
        new_key[1:] = (key[1:] != key[:-1]) | (single[1:] != single[:-1])
        new[1:] = new_key[1:] | (whole[1:] != whole[:-1]) | (mark[1:] != mark[:-1])
        if last is not None:
            new_key[0] = last["key"] != (bool(single[0]), int(key[0]))
            new[0] = new_key[0] or last["whole"] != (bool(mark[0]), int(whole[0]))
        lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        own = lead < 0  # goes on with the passage of the batch before
        before = last["first"] if last else (0, 0, 0)
        first = [np.where(own, x, of[lead]) for x, of in zip(before, (doc, version, pos))]
        again = ~new & ~mark & ((doc != first[0]) | (version != first[1]) | (pos != first[2]))
        if again.any():
            yield _batch(REMOVED, 0, 0, doc[again], version[again], pos[again], n[again] + WINDOW - 1)
        # Passages of each name; a mark counts as several.
        group = np.cumsum(new_key) - 1
        count = np.bincount(group + 1, weights=new + 2 * mark, minlength=int(group[-1]) + 2)
        if last is not None and not new_key[0]:
            count[0] += last["count"]
        several = count[group + 1] >= 2
        probe = new & several & ~single & ~mark
        if last is not None and last["held"] is not None and not new_key[0] and several[0]:
            d, v, p, m = last["held"]
            yield _batch(PROBE, 0, 0, [d], [v], [p], [m])
            last["held"] = None
        if probe.any():
            yield _batch(PROBE, 0, 0, doc[probe], version[probe], pos[probe], n[probe])
        send = new & single
        if send.any():
            yield _batch(WINDOWS, key[send], whole[send], doc[send], version[send], pos[send], n[send])
        i, end = len(key) - 1, group == group[-1]
        held = None
        if not single[i] and not several[i]:
            f = np.flatnonzero(end & new & ~mark)
            held = tuple(int(x[f[0]]) for x in (doc, version, pos, n)) if len(f) else last["held"]
        last = {"key": (bool(single[i]), int(key[i])), "whole": (bool(mark[i]), int(whole[i])), "first": tuple(int(x[i]) for x in first),
                "count": count[group[-1] + 1], "held": held}


def _probed(batches):
    """Single windows of the entries that the probes of each text name."""
    reader = _Reader()
    for part in chunks(batches, "text"):
        reader.read(part)
        lo, n = [], []
        for i, (pos, size) in enumerate(zip(part.column(3), part.column(4))):
            lo.append(pos.values.to_numpy() + reader.first[i])
            n.append(size.values.to_numpy())
        lo, n = np.concatenate(lo), np.concatenate(n).astype(np.int64)
        if len(lo):
            yield from _windows(reader, lo, lo + n - 1)


def _ordered(df: DataFrame) -> DataFrame:
    return df.repartition("key").sortWithinPartitions(F.col("kind") == WINDOWS, "key", F.col("kind") == ENTRY, "whole", "doc", "pos", "version")


def repeated(docs: DataFrame) -> DataFrame:
    """(doc, version, pos, n): stretches of n words to remove, from word ``pos`` of that version of the document's text."""
    seen = stored(_ordered(docs.select("doc", "version", "text").mapInArrow(_entries, _ROWS)).mapInArrow(_resolve, _ROWS), "entries")
    free_shuffles(docs.sparkSession)
    probes = seen.where(F.col("kind") == PROBE).groupBy("doc", "version").agg(F.collect_list("pos").alias("at"), F.collect_list("n").alias("sizes"))
    single = docs.join(probes, ["doc", "version"]).select("doc", "version", "text", "at", "sizes").mapInArrow(_probed, _ROWS)
    single = _ordered(single.unionByName(seen.where(F.col("kind") == WINDOWS))).mapInArrow(_resolve, _ROWS)
    removed = stored(seen.where(F.col("kind") == REMOVED).unionByName(single.where(F.col("kind") == REMOVED)).select("doc", "version", "pos", "n"), "removed")
    free_shuffles(docs.sparkSession)
    return removed


def _versioned(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` (``__doc``) with ``__version``: 0 where the id has one row, else the text's fingerprint of 64 bits.

    So lists and joins by (id, version) hold one text, however many rows have one id or none.
    """
    many = stored(rows.groupBy("__doc").count().where("count > 1").select("__doc", F.lit(True).alias("__many")), "repeated-ids")
    n = many.count()
    if not n:
        return rows.withColumn("__version", F.lit(0).cast("long"))
    rows = rows.join(F.broadcast(many) if n <= REPEATED_IDS else many, "__doc", "left")
    return rows.withColumn("__version", F.when(F.col("__many"), F.xxhash64(text)).otherwise(F.lit(0))).drop("__many")


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with kept, n_words and n_removed (replacing such columns) for every row.

    A word goes if a window of ``WINDOW`` consecutive words covers it whose words also start
    earlier: in a document with a smaller doc_id, or further left in the same one.  Null and
    empty texts have no words.  Null ids rank last and count as one document; rows that
    repeat an id count as one document too, equal texts being the same place.
    """
    small_batches(docs.sparkSession, 500)
    free_shuffles(docs.sparkSession)
    rows = docs.drop("kept", "n_words", "n_removed")
    kept = rows.columns
    rows = _versioned(rows.withColumn("__doc", known_id(F.col("doc_id"))), text)
    cuts = (repeated(rows.select(F.col("__doc").alias("doc"), F.col("__version").alias("version"), F.col(text).alias("text")))
            .groupBy(F.col("doc").alias("__doc"), F.col("version").alias("__version"))
            .agg(F.collect_list("pos").alias("__at"), F.collect_list("n").alias("__sizes")))
    rows = rows.join(cuts, ["__doc", "__version"], "left").select(*kept, "__at", "__sizes")
    i = [rows.columns.index(c) for c in (text, "__at", "__sizes")]

    def run(batches):
        for b in batches:
            out, total, gone = [], [], []
            for t, at, sizes in zip(*(b.column(k) for k in i)):
                w = (t.as_py() or "").encode().split()
                total.append(len(w))
                if at.is_valid:
                    at, sizes = at.values.to_numpy(), sizes.values.to_numpy()
                    left, order, end = [], np.argsort(at), 0
                    for lo, n in zip(at[order].tolist(), sizes[order].tolist()):
                        left += w[end:lo] if lo > end else []
                        end = max(end, lo + n)
                    w = left + w[end:]
                out.append(b" ".join(w).decode())
                gone.append(total[-1] - len(w))
            cols = [b.column(k) for k in range(b.num_columns) if b.schema.names[k] not in ("__at", "__sizes")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                                             [*kept, "kept", "n_words", "n_removed"])

    schema = T.StructType([*docs.select(*kept).schema, T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType())])
    return rows.mapInArrow(run, schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; n_chars follows.  Texts that lose nothing stay as they are."""
    rows, back = aside(docs, "doc_id", "text", "n_chars")
    got = remove_repeats(rows)
    changed = F.col("n_removed") > 0
    columns = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return got.withColumns(columns).select(*back)
