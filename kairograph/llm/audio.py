"""Chroma audio fingerprints.

A recording's energy is folded into twelve pitch classes, in frames that overlap by three quarters. Over
that image, sums of rectangles come from an integral image; sixteen contrasts of rectangles inside a sliding window
are quantised to two bits each and packed into one 32-bit integer for each place of the window.

Two recordings are aligned if at some offset

* they share a key: two equal integers ``SPAN`` places apart, selected by their hash, and
* the best stretch at that offset, the one whose integers have the fewest bit errors against the allowance of ``max_errors``
  of all bits, holds ``min_hits`` equal integers or more.

A key is selected if it has the least hash of some ``WINNOW`` neighbours, so that ``MIN_HITS`` equal integers in a row always
share one, or if its hash is divisible by ``OFTEN``, so that recordings cut inside a frame, whose equal integers are scattered,
nearly always do. Keys that exactly two recordings hold give a pair, which is aligned before it ties them; other shared keys
tie all that hold them. Within the resulting clusters the histogram of offsets between equal keys gives the places to judge.
Clusters are compared in blocks of bounded size, whose tasks return link counts and a spanning forest, so output grows with
recordings. Recordings with equal fingerprints are one class and compared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import cut, in_worker, release, ship
from kairograph.llm.components import components, linked

RATE, FRAME, HOP = 4096, 256, 256
#: Fingerprints take frames a quarter of a frame apart, so that any cut lies within an eighth of a frame of one.
STEP = 4
#: Frames of the sliding window, and contrasts in it.
WINDOW, CONTRASTS = 8, 16
#: Bounds of the four levels of a contrast, which lies between -1 and 1; the levels' two bits are a
#: Gray code, so neighbouring levels differ in one.
LEVELS, GRAY = (-0.2, 0.0, 0.2), (0, 1, 3, 2)
#: Equal integers (four frames of them) that the best stretch of an alignment needs, and the share of bits that may differ.
MIN_HITS, MAX_ERRORS = 4 * STEP, 0.2
#: Places between the two integers of a key, and which keys are selected (see above).
SPAN, WINNOW, OFTEN = 2 * STEP, STEP, 4
#: Integers in a block of a cluster, and pairs of integers looked at at once.
BLOCK, AT_ONCE = 1_000_000, 2_000_000
LOW_C = 523.2511306


def rectangles() -> list[tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int, int]]]]:
    """The contrasts: rectangles (first frame, first class, frames, classes) that add and that subtract.
    Four shapes take turns over sixteen places: high against low, early against late, both crossed, and
    middle against sides."""
    out = []
    for k in range(CONTRASTS):
        y, h = (5 * k) % 7, 4 if k % 8 < 4 else 6
        y = min(y, 12 - h)
        x, w = (3 * (k // 4)) % 5, 4
        half = h // 2
        low, high = (x, y, w, half), (x, y + half, w, half)
        if k % 4 == 0:
            out.append(([high], [low]))
        elif k % 4 == 1:
            out.append(([(x, y, w // 2, h)], [(x + w // 2, y, w // 2, h)]))
        elif k % 4 == 2:
            out.append(([(x, y, w // 2, half), (x + w // 2, y + half, w // 2, half)], [(x, y + half, w // 2, half), (x + w // 2, y, w // 2, half)]))
        else:
            out.append(([(x + 1, y, 2, h)], [(x, y, 1, h), (x + 3, y, 1, h)]))
    return out


_RECTANGLES = rectangles()


def _fold(rate: int, frame: int) -> np.ndarray:
    """Frequency bins -> pitch classes, three octaves from the C below the low C (half a semitone less) on."""
    f = np.fft.rfftfreq(frame, 1 / rate)
    m = np.zeros((len(f), 12))
    used = (f > LOW_C / 2 ** (25 / 24)) & (f < LOW_C * 4)
    m[used, np.rint(12 * np.log2(f[used] / LOW_C)).astype(int) % 12] = 1
    return m


def chroma(pcm: np.ndarray, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> np.ndarray:
    """Frames x 12: share of each pitch class in the energy of a frame; silent frames are zero."""
    if len(pcm) < frame:
        return np.zeros((0, 12))
    shape = ((len(pcm) - frame) // hop + 1, frame)
    frames = np.lib.stride_tricks.as_strided(pcm, shape, (pcm.strides[0] * hop, pcm.strides[0]))
    out, fold = np.zeros((shape[0], 12)), _fold(rate, frame)
    window = np.hanning(frame)
    for s in range(0, shape[0], 2048):
        out[s : s + 2048] = (np.abs(np.fft.rfft(frames[s : s + 2048] * window, axis=1)) ** 2) @ fold
    total = out.sum(axis=1, keepdims=True)
    return np.where(total > 1e-6 * frame, out / np.maximum(total, 1e-12), 0.0)


def fingerprint(image: np.ndarray, step: int = 1) -> np.ndarray:
    """Packed integers of a chroma image, one for each place of the window. A window takes every ``step``-th frame."""
    n = len(image) - (WINDOW - 1) * step
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    rows = -(-len(image) // step)
    padded = np.zeros((rows * step, 12))
    padded[: len(image)] = image
    integral = np.zeros((rows + 1, step, 13))
    integral[1:, :, 1:] = padded.reshape(rows, step, 12).cumsum(axis=0).cumsum(axis=2)
    places = rows - WINDOW + 1

    def area(r: tuple[int, int, int, int]) -> np.ndarray:
        x, y, w, h = r
        return integral[x + w : x + w + places, :, y + h] - integral[x : x + places, :, y + h] - integral[x + w : x + w + places, :, y] + integral[x : x + places, :, y]

    out = np.zeros((places, step), dtype=np.uint32)
    gray = np.array(GRAY, dtype=np.uint32)
    for plus, minus in _RECTANGLES:
        a, b = sum(map(area, plus)), sum(map(area, minus))
        level = np.searchsorted(LEVELS, np.round((a - b) / (a + b + 1e-9), 6), side="right")
        out = (out << np.uint32(2)) | gray[level]
    return out.ravel()[:n]


_WAVES = np.sin(2 * np.pi * LOW_C * 2 ** (np.arange(12) / 12)[:, None] * np.arange(FRAME)[None] / RATE)


def render(text: str | None) -> np.ndarray:
    """A text as a recording: one chord of four notes a word, picked by the word's hash. It stands in
    for a media column where the tables hold none."""
    words = text.encode().split() if text else []
    if not words:
        return np.zeros(0)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    notes = np.zeros((len(words), 12))
    for voice in range(4):
        notes[np.arange(len(words)), 3 * voice + (h >> np.uint64(8 * voice)).astype(np.int64) % 3] = 1 + (h >> np.uint64(40 + 2 * voice)).astype(np.int64) % 4
    return (notes @ _WAVES).ravel() * 1000


def decode_pcm(raw: bytes | None) -> np.ndarray:
    """16-bit little-endian mono samples."""
    return np.frombuffer(raw, dtype="<i2").astype(np.float64) if raw else np.zeros(0)


def _print(load: Callable):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 1024):
                held = b.slice(part, 1024)
                prints, keys = [], []
                for v in held.column(1):
                    image = chroma(load(v.as_py()), hop=FRAME // STEP)
                    p = fingerprint(image, STEP)
                    prints.append(p.view(np.int32))
                    # too short for an integer: the chroma itself, if there is any sound
                    keys.append(xxhash.xxh3_128_digest(p.tobytes()) if len(p) else xxhash.xxh3_128_digest(b"chroma" + (np.round(image, 6) + 0.0).tobytes()) if image.any() else None)
                yield pa.RecordBatch.from_arrays([held.column(0), pa.array(prints, pa.list_(pa.int32())), pa.array(keys, pa.binary())], names=["rec_id", "ints", "digest"])

    return run


def fingerprints(recordings: DataFrame, load: Callable = decode_pcm) -> DataFrame:
    """``rec_id, ints, digest`` from two columns: an id of any orderable type, and what ``load`` turns into samples. Recordings
    too short for an integer have none, and a digest of their chroma; null, silent and empty ones have a null digest
    if they have no integer."""
    ship(recordings.sparkSession)
    return recordings.mapInArrow(in_worker("audio", _print(load)), f"rec_id {recordings.schema[0].dataType.simpleString()}, ints array<int>, digest binary")


def selected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the keys of one recording's integers."""
    if len(x) <= SPAN:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    w = x.astype(np.uint64)
    h = (w[:-SPAN] * np.uint64(0x9E3779B97F4A7C15)) ^ (w[SPAN:] * np.uint64(0xD6E8FEB86659FD93))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    keep = h % np.uint64(OFTEN) == 0
    if len(h) >= WINNOW:
        runs = np.lib.stride_tricks.sliding_window_view(h, WINNOW)
        keep[np.arange(len(runs)) + runs.argmin(axis=1)] = True
    return np.flatnonzero(keep), h[keep]


def _selected(ints: pa.ListScalar) -> np.ndarray:
    return np.unique(selected(np.asarray(ints.values, dtype=np.int32).view(np.uint32))[1]).view(np.int64)


def _codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in range(0, b.num_rows, 1024):
            found = [_selected(x) for x in b.column(0).slice(part, 1024)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["code"])


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in range(0, b.num_rows, 1024):
            found = [_selected(x) for x in b.column(1).slice(part, 1024)]
            at = np.repeat(np.arange(part, part + len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.concatenate(found))], names=["node", "code"])


def best_stretch(x: np.ndarray, y: np.ndarray, starts: np.ndarray, max_errors: float) -> np.ndarray:
    """x, y: integers to compare one by one, in segments that begin at ``starts``. Per segment the equal integers in its best
    stretch (greatest sum of allowed less found bit errors)."""
    n = len(x)
    errors = np.bitwise_count(x ^ y).astype(np.int64)
    head = np.zeros(n, dtype=bool)
    head[starts] = True
    seg, place = head.cumsum() - 1, np.arange(n)
    # in hundredths of a bit, so that sums are exact
    total = np.concatenate(([0], (round(max_errors * 3200) - 100 * errors).cumsum()))
    # lowest sum before each end, segment by segment: each segment is moved below all before it
    drop = 3200 * (n + 1)
    low = np.minimum.accumulate(total[:-1] - seg * drop) + seg * drop
    gain = total[1:] - low
    best = np.maximum.reduceat(gain, starts)
    end = np.minimum.reduceat(np.where(gain == best[seg], place, n), starts)
    # the stretch begins at the last place up to its end whose sum is the lowest
    begin = np.maximum.reduceat(np.where((place <= end[seg]) & (total[:-1] == low[end][seg]), place, -1), starts)
    same = np.concatenate(([0], (errors == 0).cumsum()))
    return same[end + 1] - same[begin]


def align(a: list[np.ndarray], b: list[np.ndarray], same: bool, min_hits: int = MIN_HITS, max_errors: float = MAX_ERRORS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, offset) of aligned recordings of two lists; with ``same``, of one list, i < j. The offset is the one with
    most equal keys of those that hold an alignment. Memory is bounded by the lists and ``AT_ONCE``."""
    keyed = [selected(x) for x in b]
    key, rec, at = np.concatenate([k for _, k in keyed]), np.repeat(np.arange(len(b)), [len(k) for _, k in keyed]), np.concatenate([p for p, _ in keyed])
    order = np.argsort(key, kind="stable")
    key, rec, at = key[order], rec[order], at[order]
    length, first = np.array([len(x) for x in b], dtype=np.int64), np.concatenate(([0], np.cumsum([len(x) for x in b])))
    flat = np.concatenate(b)
    out: list[np.ndarray] = []
    for i, x in enumerate(a):
        mine, keys = keyed[i] if same else selected(x)
        lo, hi = np.searchsorted(key, keys, "left"), np.searchsorted(key, keys, "right")
        places, votes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        s = 0
        while s < len(keys):  # the histogram of offsets, some keys at a time
            e = max(s + 1, int(np.searchsorted((hi - lo)[s:].cumsum(), AT_ONCE, "right")) + s)
            n = (hi - lo)[s:e]
            hit = np.repeat(lo[s:e] - np.concatenate(([0], n.cumsum()[:-1])), n) + np.arange(n.sum())
            offset, j = at[hit] - np.repeat(mine[s:e], n), rec[hit]
            code = (j * (1 << 32) + offset + (1 << 31))[j > i] if same else j * (1 << 32) + offset + (1 << 31)
            code, n = np.unique(code, return_counts=True)
            if len(places):
                places, back = np.unique(np.concatenate((places, code)), return_inverse=True)
                votes = np.bincount(back, np.concatenate((votes, n))).astype(np.int64)
            else:
                places, votes = code, n
            s = e
        where, offset = places >> 32, (places & 0xFFFFFFFF) - (1 << 31)
        order = np.lexsort((places, -votes, where))
        where, offset = where[order], offset[order]
        while len(where):  # the offset with most votes of every pair, then the next of those that failed
            turn = np.unique(where, return_index=True)[1]
            j, o = where[turn], offset[turn]
            begin, end = np.maximum(0, -o), np.minimum(len(x), length[j] - o)
            good = np.zeros(len(j), dtype=bool)
            s = 0
            while s < len(j):
                e = max(s + 1, int(np.searchsorted((end - begin)[s:].cumsum(), AT_ONCE, "right")) + s)
                size = (end - begin)[s:e]
                starts = np.concatenate(([0], size.cumsum()[:-1]))
                inside = np.arange(size.sum()) - np.repeat(starts, size)
                left = x[inside + np.repeat(begin[s:e], size)]
                right = flat[inside + np.repeat((first[j] + begin + o)[s:e], size)]
                good[s:e] = best_stretch(left, right, starts, max_errors) >= min_hits
                s = e
            if good.any():
                out.append(np.stack((np.full(good.sum(), i), j[good], o[good]), axis=1))
            rest = np.ones(len(where), dtype=bool)
            rest[turn] = False
            rest &= ~np.isin(where, j[good])
            where, offset = where[rest], offset[rest]
    m = np.concatenate(out) if out else np.zeros((0, 3), dtype=np.int64)
    return m[:, 0], m[:, 1], m[:, 2]


def _aligned(min_hits: int, max_errors: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ints = [[np.asarray(x.values, dtype=np.int32).view(np.uint32) for x in b.column(k)] for k in (2, 3)]
            keep = [len(align([x], [y], False, min_hits, max_errors)[0]) > 0 for x, y in zip(*ints, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(min_hits: int, max_errors: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = [int(pdf[k].iloc[0]) for k in ("i", "j")]
        parts = [pdf[pdf["block"] == k] for k in blocks]
        pairs = []
        if all(map(len, parts)):
            i, j, _ = align(*[[np.asarray(x, dtype=np.int32).view(np.uint32) for x in p["ints"]] for p in parts], blocks[0] == blocks[1], min_hits, max_errors)
            pairs = [(i, j)]
        return linked([p["node"].tolist() for p in parts], [p["copies"].to_numpy() for p in parts], pairs)

    return run


def align_recordings(prints: DataFrame, min_hits: int = MIN_HITS, max_errors: float = MAX_ERRORS) -> DataFrame:
    """prints: ``rec_id, ints, digest`` as ``fingerprints`` gives them, a written table. Per row ``rec_id,
    n_ints, class_id, n_links, component_id``.

    ``class_id`` is the smallest recording with the same digest; ``n_links`` counts the other recordings that it is
    equal to or aligned with; ``component_id`` is the smallest one reachable by links. Recordings without digest link
    with nothing, and neither does a row without id, whose other columns but ``n_ints`` are null or 0. Repeated rows are one
    recording; rows of one id with different sounds are recordings of their own, counted each. No rows give no rows."""
    spark = prints.sparkSession
    ship(spark)
    named = prints.where("rec_id is not null and digest is not null")
    classes = cut(named.groupBy("digest").agg(F.min("rec_id").alias("class_id"), F.count_distinct("rec_id").alias("copies"), F.count(F.lit(1)).alias("n")), "classes")
    several = cut(classes.where("n > 1").select("digest", F.col("class_id").alias("first"), "copies"), "several")
    # one row of each class: rows of a digest that is held once need no grouping
    marked = named.where(F.size("ints") > 0).join(several, "digest", "left")
    alone = marked.where("copies is null").select(F.col("digest").alias("node"), F.lit(1).cast("long").alias("copies"), "ints")
    of_many = marked.where("rec_id = first").dropDuplicates(["digest"]).select(F.col("digest").alias("node"), "copies", "ints")
    reps = alone.unionByName(of_many)
    codes = reps.select("ints").mapInArrow(in_worker("audio", _codes), "code long")
    shared = cut(codes.groupBy("code").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "shared")
    keyed = reps.select("node", "ints").mapInArrow(in_worker("audio", _keys), "node binary, code long")
    postings = cut(keyed.join(shared, "code"), "postings")
    ends = cut(postings.groupBy("code", "held").agg(F.min("node").alias("hub"), F.max("node").alias("last")), "ends")
    pairs = ends.where("held = 2").select("hub", "last").distinct()
    side = lambda id_, ints: reps.select(F.col("node").alias(id_), F.col("ints").alias(ints))
    pairs = pairs.join(side("hub", "x"), "hub").join(side("last", "y"), "last").select("hub", "last", "x", "y")
    pairs = pairs.mapInArrow(in_worker("audio", _aligned(min_hits, max_errors)), "a binary, b binary")
    many = postings.join(ends.where("held > 2").select("code", "hub"), "code").where("node <> hub").select("node", "hub")
    clusters = components(pairs.union(many))
    release(shared, postings, ends)
    held = reps.join(clusters.withColumnRenamed("root", "cluster"), "node")
    sizes = cut(held.groupBy("cluster").agg(F.ceil(F.sum(F.size("ints")) / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "sizes")
    held = held.join(sizes, "cluster", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    held = held.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = held.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")).select("node", "copies", "ints", "cluster", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    found = cut(dealt.groupBy("cluster", "i", "j").applyInPandas(_blocks(min_hits, max_errors), "node binary, links long, root binary"), "links")
    release(clusters, sizes, several)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select("node", "root"))
    first = cut(groups.join(classes, groups["node"] == classes["digest"]).groupBy("root").agg(F.min("class_id").alias("component_id")), "first")
    linked = links.join(groups.join(first, "root").select("node", "component_id"), "node", "left").withColumnRenamed("node", "digest")
    verdict = cut(classes.where("n > 1").select("digest", "class_id", "copies").join(linked, "digest", "full"), "verdict")
    release(found, groups, classes, first)
    out = prints.join(verdict, "digest", "left")
    plain = F.col("rec_id").isNull()
    n = F.when(plain, F.lit(0)).otherwise(F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0)))
    near = lambda *c: F.when(~plain, F.coalesce(*c, "rec_id"))
    return out.select("rec_id", F.size("ints").cast("long").alias("n_ints"), near("class_id").alias("class_id"), n.cast("long").alias("n_links"), near("component_id", "class_id").alias("component_id"))
