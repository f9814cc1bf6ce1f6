"""Substring deduplication by level-wise doubling.

A word goes if it lies in a window of ``window`` consecutive words that also starts in a
document with a smaller id. Windows of the full length are looked at only where their parts
repeat:

1. Windows of a quarter of the length. Of those inside a full window the one with the least hash is
   the full window's own, and only own quarters are registered (content decides, so equal full
   windows have equal own quarters at equal places). Those found in one document alone are dropped.
2. Windows of half the length that begin or end with a surviving quarter, if they repeat.
3. Full windows whose own quarter survived, and the halves beside it too. The smallest document that
   holds one decides.

Every full window has an own quarter, so no repeat is missed. Rows that only copy a whole
text of a smaller document are settled by a digest of the text and take no part in the levels, nor do repeated rows
of one document. Hashes of quarters and halves only preselect; full windows are compared by 128 bits, two polynomials
over two independent word hashes.

What decides on a hash (does it repeat, who holds it first) is counted with partial aggregation and written before it
is joined, so that the join is with a table of known size and Spark can split the partition of a passage that
very many documents share. Texts are shuffled only for documents that have something to look at or to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import cut, in_worker, pick, release, ship

WINDOW = 50
#: Ids are broadcast up to this many (25 bytes each), beyond it joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Odd multipliers of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space, unchanged."""
    return text.encode().split() if text else []


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words) if seed else (digest(w) for w in words), dtype=np.uint64, count=len(words))


def window_hashes(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each run of n word hashes: a polynomial modulo 2^64 by doubling, then mixed."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    span, at, power = h, 1, base  # span: runs of `at` words
    out, done = None, 0
    bits, mask = n, (1 << 64) - 1
    while bits:
        if bits & 1:
            if out is None:
                out, done = span, at
            else:
                m = len(h) - done - at + 1
                out = out[:m] * np.uint64(power) + span[done : done + m]
                done += at
        bits >>= 1
        if bits:
            m = len(h) - 2 * at + 1
            span = span[:m] * np.uint64(power) + span[at : at + m]
            at, power = 2 * at, power * power & mask
    out = out[: len(h) - n + 1]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(BASES[1])
    return out ^ (out >> np.uint64(29))


def own_quarters(q: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` neighbouring hashes the position of the least, of equal ones the first."""
    if len(q) < span:
        return np.zeros(0, dtype=np.int64)
    best, at = np.arange(len(q)), 1
    while at < span:  # over `at` neighbours, doubling
        step = min(at, span - at)
        here, there = best[: len(best) - step], best[step:]
        best = np.where(q[there] < q[here], there, here)
        at += step
    return best


class Levels:
    """Positions and hashes of one text of at least ``window`` words."""

    def __init__(self, words: list[bytes], window: int):
        self.window, self.quarter, self.half = window, max(1, window // 4), max(1, window // 2)
        self.words, self.h = words, word_hashes(words)
        q = window_hashes(self.h, self.quarter, BASES[0])
        self.own = own_quarters(q, window - self.quarter + 1)
        self.at = np.unique(self.own)
        self.q = q[self.at]
        halves = window_hashes(self.h, self.half, BASES[0])
        back = self.at + self.quarter - self.half
        side = lambda at: np.where((at >= 0) & (at < len(halves)), halves[np.clip(at, 0, len(halves) - 1)], 0)
        self.ahead, self.back = side(self.at), side(back)

    def full(self, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and both hashes of the full windows that may repeat, equal ones together. alive: for each registered
        quarter, bit 0 if it repeats, 1 and 2 if the half ahead and the half back do. A window's own
        quarter must repeat, and so must the halves beside it that lie inside the window."""
        start = np.arange(len(self.own))
        state = alive[np.searchsorted(self.at, self.own)]
        offset = self.own - start
        ahead_in, back_in = offset + self.half <= self.window, offset + self.quarter >= self.half
        start = start[(state & 1 > 0) & (~ahead_in | (state & 2 > 0)) & (~back_in | (state & 4 > 0))]
        if not len(start):
            return start, self.h[:0], self.h[:0]
        first, second = window_hashes(self.h, self.window, BASES[0])[start], window_hashes(word_hashes(self.words, 1), self.window, BASES[1])[start]
        order = np.lexsort((start, second, first))
        return start[order], first[order], second[order]


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64))


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer rows at once: what is made of a text is several times as large."""
    for b in batches:
        for part in range(0, b.num_rows, 1024):
            yield b.slice(part, 1024)


def _quarters(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            keys, at, q, ahead, back = [], [], [], [], []
            for i, text in enumerate(b.column(4)):
                words = words_of(text.as_py())
                if len(words) < window:
                    continue
                lv = Levels(words, window)
                keys.append((i, len(lv.at)))
                at.append(lv.at), q.append(lv.q), ahead.append(lv.ahead), back.append(lv.back)
            if keys:
                i = pa.array(np.repeat([k for k, _ in keys], [n for _, n in keys]))
                ids = [b.column(k).take(i) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.concatenate(at).astype(np.int32)), *(_signed(np.concatenate(x)) for x in (q, ahead, back))], names=["doc_id", "z", "h1", "h2", "at", "q", "ahead", "back"])

    return run


def _windows(window: int):
    names = ["doc_id", "z", "h1", "starts", "w1", "w2"]

    def rows(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        heads = [np.flatnonzero(np.concatenate(([True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])))) for _, _, w1, w2 in found]
        i = pa.array(np.repeat([f[0] for f in found], [len(h) for h in heads]))
        base = np.cumsum([0, *(len(f[1]) for f in found)])
        offsets = np.concatenate([h + n for h, n in zip(heads, base, strict=False)] + [base[-1:]])
        starts = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate([f[1] for f in found]).astype(np.int32)))
        return pa.RecordBatch.from_arrays([*(b.column(k).take(i) for k in range(3)), starts, *(_signed(np.concatenate([f[k][h] for f, h in zip(found, heads, strict=True)])) for k in (2, 3))], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            ats, alives, found, size = b.column(4), b.column(5), [], 0
            for i, text in enumerate(b.column(3)):
                lv = Levels(words_of(text.as_py()), window)
                alive = np.zeros(len(lv.at), dtype=np.int64)
                known = np.array(ats[i].as_py(), dtype=np.int64)
                alive[np.searchsorted(lv.at, known)] = np.array(alives[i].as_py(), dtype=np.int64)
                start, first, second = lv.full(alive)
                if len(start):
                    found.append((i, start, first, second))
                    size += len(start)
                if size > 200_000:
                    yield rows(b, found)
                    found, size = [], 0
            if found:
                yield rows(b, found)

    return run


def _remove(window: int, with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            out: list[list] = [[], [], [], []]
            texts: list[str] = []
            for doc, text, copy, starts in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
                words = words_of(text.as_py())
                n = len(words)
                if copy and n >= window:
                    kept = []
                elif (s := starts.as_py()) and n >= window:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    s = np.unique(np.array(s, dtype=np.int64))
                    edge[s] += 1
                    np.add.at(edge, s + window, -1)
                    kept = [w for w, c in zip(words, np.cumsum(edge[:n]).tolist(), strict=True) if not c]
                else:
                    kept = words
                left = b" ".join(kept)
                for col, v in zip(out, (doc, n, n - len(kept), hashlib.sha256(left).hexdigest()), strict=True):
                    col.append(v)
                texts.append(left.decode())
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.string())] * with_text, names=names + ["kept_text"] * with_text)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Remove words of repeated windows; one row per input row: ``doc_id, n_words, n_removed,
    kept_sha256`` and, on request, ``kept_text``.

    Null and empty texts have no words and keep the digest of the empty string. Texts below the window
    lose nothing. Rows with the same ``doc_id`` do not remove each other's words; a null ``doc_id`` is
    larger than any other and its own words go if another document has them. An empty table gives an
    empty result. Other columns are not looked at."""
    spark = docs.sparkSession
    ship(spark)
    # The order of documents: null ids, marked by z, come after the largest.
    last = F.lit(2**63 - 1)
    keyed = pick(docs, "doc_id", "text").select(F.coalesce("doc_id", last).alias("doc_id"), F.col("doc_id").isNull().cast("int").alias("z"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "z", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("text"), F.col("text")).alias("h2"), "text")
    ids = ["doc_id", "z", "h1"]

    def spread(df: DataFrame, *key: str) -> DataFrame:
        """Of each key the first document, and whether there is another."""
        ends = df.groupBy(*key).agg(*[f(c).alias(f"_{n}_{c}") for c in ("doc_id", "z") for n, f in (("lo", F.min), ("hi", F.max))])
        return ends.select(*key, F.col("_lo_doc_id").alias("first"), F.col("_lo_z").alias("first_z"), ((F.col("_lo_doc_id") < F.col("_hi_doc_id")) | (F.col("_lo_z") < F.col("_hi_z"))).alias("several"))

    is_first = (F.col("doc_id") == F.col("first")) & (F.col("z") == F.col("first_z"))

    def repeated(df: DataFrame, key: str, label: str) -> DataFrame:
        return cut(spread(df, key).where("several").select(key), label)

    def touched(found: DataFrame) -> DataFrame:
        """The documents of a written table, without the others' texts going through a shuffle."""
        few = found.select(*ids).distinct()
        return keyed.join(F.broadcast(few) if found.count() <= BROADCAST_IDS else few, ids, "left_semi")

    # Level 1, without the rows that copy a whole text.
    copies = cut(spread(keyed, "h1", "h2").where("several"), "copies")
    quarters = keyed.mapInArrow(in_worker("substrings", _quarters(window)), "doc_id long, z int, h1 long, h2 long, at int, q long, ahead long, back long")
    marked = quarters.join(copies.select("h1", "h2", "first", "first_z"), ["h1", "h2"], "left")
    columns = [*ids, "at", "q", "ahead", "back"]
    quarters = cut(marked.where(F.col("first").isNull() | is_first).select(*columns), "quarters")

    # Level 2: halves next to the quarters that repeat.
    fourths = repeated(quarters, "q", "repeated-quarters")
    level = cut(quarters.join(fourths, "q", "left_semi").drop("q"), "halves")
    release(quarters, fourths)
    again = repeated(level.select("doc_id", "z", F.explode(F.array("ahead", "back")).alias("half")).where("half != 0"), "half", "repeated-halves")
    ahead = level.join(again.withColumnRenamed("half", "ahead").withColumn("_a", F.lit(2)), "ahead", "left")
    both = ahead.join(again.withColumnRenamed("half", "back").withColumn("_b", F.lit(4)), "back", "left")
    alive = both.select(*ids, "at", (F.lit(1) + F.coalesce("_a", F.lit(0)) + F.coalesce("_b", F.lit(0))).alias("alive")).where("alive > 1")
    per_doc = alive.groupBy(*ids).agg(F.collect_set(F.struct("at", "alive")).alias("s"))  # repeated rows once
    per_doc = cut(per_doc.select(*ids, F.col("s.at").alias("at"), F.col("s.alive").alias("alive")), "alive")
    release(level, again)

    # Level 3: full windows, one row for each window of a document.
    texts = touched(per_doc).select(*ids, "text").join(per_doc, ids).dropDuplicates(ids)
    full = cut(texts.select(*ids, "text", "at", "alive").mapInArrow(in_worker("substrings", _windows(window)), "doc_id long, z int, h1 long, starts array<int>, w1 long, w2 long"), "windows")
    release(per_doc)
    least = cut(spread(full, "w1", "w2").where("several").drop("several"), "least")
    gone = full.join(least, ["w1", "w2"]).where(~is_first).groupBy(*ids).agg(F.flatten(F.collect_list("starts")).alias("starts"))

    whole = keyed.select(*ids, "h2").join(copies, ["h1", "h2"]).where(~is_first).select(*ids).distinct()
    verdict = gone.select(*ids, F.lit(False).alias("copy"), "starts").unionByName(whole.select(*ids, F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("starts")))
    verdict = cut(verdict, "verdict")
    release(full, least, copies)
    some = touched(verdict).select(*ids, "text").join(verdict, ids).select(*ids, "text", "copy", "starts")
    few = verdict.select(*ids)
    rest = keyed.join(F.broadcast(few) if verdict.count() <= BROADCAST_IDS else few, ids, "left_anti").select(*ids, "text", F.lit(False).alias("copy"), F.lit(None).cast("array<int>").alias("starts"))
    judged = some.unionByName(rest).select(F.when(F.col("z") == 0, F.col("doc_id")).alias("doc_id"), "text", "copy", "starts")
    return judged.mapInArrow(in_worker("substrings", _remove(window, with_text)), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
