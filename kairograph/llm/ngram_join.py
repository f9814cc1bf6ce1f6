"""N-gram Jaccard self-join: word shingles, MinHash, Bayesian pruning, exact verification.

1. Each text gives the set of hashes of its shingles, a digest of the set, MinHash values and band
   keys. Texts with one set are one class, known by that digest; its smallest document stands for it.
2. Classes that share a band key are compared by their MinHash values, in steps; a pair goes once the posterior
   probability that its similarity reaches the threshold (uniform prior) falls below the tolerance. Of a
   bucket of up to ``BUCKET`` classes all pairs are looked at. Of a larger one each is compared with the smallest first,
   and only where that leaves the bucket in several pieces all are compared with all, in blocks: the same
   test decides on every pair, and copies of one text by the thousand cost one comparison each.
3. What is left falls into clusters. Within a cluster all pairs are compared, again in steps, and
   those not dropped are verified on the whole sets. A cluster is dealt over pairs of blocks, bounded in
   members and in bytes and at least as many as the session has partitions, so that no task holds more than two blocks
   and a large cluster keeps all tasks busy. Tasks return link counts and a spanning forest, never the pairs, so
   output grows with members and not with their square.

Bands follow from the threshold: a pair at it shares no band with probability ``MISS`` at most (5e-8 for 32 bands of
4 values at 0.8).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import cut, in_worker, parallelism, pick, release, ship
from kairograph.llm.components import components, contracted, linked
from kairograph.llm.substring_dedup import BASES, window_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
HASHES, MISS = 128, 1e-7
#: Values compared at each step, and the posterior probability below which a pair is dropped.
STEPS, TOLERANCE = (32, 64, 128), 1e-9
#: Buckets up to this many classes give all their pairs at once.
BUCKET = 32
#: Members and bytes of shingles in a block, and the members below which a block isn't split to keep tasks busy.
BLOCK, BLOCK_BYTES, SMALL = 512, 8 << 20, 64
#: Ids are broadcast up to this many (16 bytes each), beyond it joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Columns of the incidence matrices multiplied at once.
COLUMNS = 8192

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]


def shape_for(threshold: float) -> tuple[int, int]:
    """Bands and values a band: as many values as ``MISS`` allows at the threshold."""
    for rows in range(4, 0, -1):
        if (1 - threshold**rows) ** (HASHES // rows) <= MISS:
            return HASHES // rows, rows
    raise ValueError(f"{HASHES} hashes do not find pairs at a similarity of {threshold}")


def shingle_set(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the runs of n words (ASCII white space, lower case). A text of fewer words has
    one shingle of them all; an empty one has none."""
    words = text.lower().encode().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    return np.unique(window_hashes(word_hashes(words), min(n, len(words)), BASES[0]))


def minhash(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(x), 4096):
        v = x[i : i + 4096] * _MUL
        v += _ADD
        v ^= v >> np.uint32(15)
        np.minimum(out, v.min(axis=1), out=out)
    return out


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The least m of n equal values at which P(similarity >= threshold | m of n) reaches the tolerance:
    under a uniform prior it is the probability of at most m successes in n + 1 trials."""
    p = 0.0
    for m in range(n + 1):
        p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if p >= tolerance:
            return m
    return n


def survivors(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the rows of a and b (bytes of MinHash values) that no step drops."""
    i, j, done, equal = None, None, 0, None
    for n in STEPS:
        need = least_matches(n, threshold)
        if i is None:
            equal = np.zeros((len(a), len(b)), dtype=np.int16)
            for k in range(n):
                equal += a[:, k, None] == b[None, :, k]
            i, j = np.nonzero(equal >= need)
            equal = equal[i, j]
        else:
            step = 1 << 16
            more = [(a[i[s : s + step], done:n] == b[j[s : s + step], done:n]).sum(axis=1) for s in range(0, len(i), step)]
            equal = equal + (np.concatenate(more) if more else 0)
            i, j, equal = i[equal >= need], j[equal >= need], equal[equal >= need]
        done = n
    return i, j


def intersections(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of left[i] and right[j]."""
    if len(i) < 4 * (len(left) + len(right)):
        return np.array([len(np.intersect1d(left[x], right[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)
    # Many pairs: products of incidence matrices, some columns at a time.
    names, at = np.unique(np.concatenate(left + right), return_inverse=True)
    sizes = [len(s) for s in left + right]
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, len(names), COLUMNS):
        lo, hi = np.searchsorted(at, [c, c + COLUMNS])
        m = np.zeros((len(sizes), min(COLUMNS, len(names) - c)), dtype=np.float32)
        m[row[lo:hi], at[lo:hi] - c] = 1
        total += m[: len(left)] @ m[len(left) :].T
    return np.rint(total[i, j]).astype(np.int64)


def _sketch(bands_n: int, rows: int):
    mix = np.uint64(BASES[1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, values, bands = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py())
                if not len(s):
                    digests.append(None), sizes.append(0), values.append(None), bands.append(None)
                    continue
                m = minhash(s)
                key = np.arange(1, bands_n + 1, dtype=np.uint64)
                for col in m[: bands_n * rows].reshape(bands_n, rows).astype(np.uint64).T:
                    key = (key ^ col) * mix
                    key ^= key >> np.uint64(31)
                digests.append(xxhash.xxh3_128_digest(s.tobytes())), sizes.append(len(s))
                values.append((m >> np.uint32(24)).astype(np.uint8).tobytes()), bands.append(key.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(values, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "digest", "n", "values", "bands"])

    return run


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in range(0, b.num_rows, 1024):
            sets = [shingle_set(t.as_py()).tobytes() for t in b.column(0).slice(part, 1024)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["node", "set"])


def _likely(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for k in (2, 3))
            keep = np.ones(len(x), dtype=bool)
            for n in STEPS:
                keep[keep] = (x[keep, :n] == y[keep, :n]).sum(axis=1) >= least_matches(n, threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _parts(pdf: pd.DataFrame) -> list[pd.DataFrame]:
    pdf = pdf.drop_duplicates("node")
    return [pdf[pdf["block"] == int(pdf[k].iloc[0])] for k in ("i", "j")]


def _near(parts: list[pd.DataFrame], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks, or of one with itself, that no step drops."""
    i, j = survivors(*[np.frombuffer(b"".join(p["values"]), dtype=np.uint8).reshape(-1, HASHES) for p in parts], threshold)
    return (i[i < j], j[i < j]) if parts[0]["block"].iloc[0] == parts[1]["block"].iloc[0] else (i, j)


def _ties(threshold: float):
    """The pairs of blocks of a bucket that the posterior leaves, as a forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = _parts(pdf)
        near = _near(parts, threshold) if all(map(len, parts)) else (np.zeros(0, dtype=np.int64),) * 2
        return linked([p["node"].tolist() for p in parts], [np.ones(len(p)) for p in parts], [near])[["node", "root"]]

    return run


def _verify(threshold: float):
    ratio = Fraction(str(threshold))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = _parts(pdf)
        pairs = []
        if all(map(len, parts)):
            sets = [[np.frombuffer(s, dtype=np.uint64) for s in p["set"]] for p in parts]
            i, j = _near(parts, threshold)
            both = intersections(*sets, i, j)
            sizes = [np.array([len(s) for s in x], dtype=np.int64) for x in sets]
            # |A & B| / |A | B| >= threshold, in integers
            good = both * ratio.denominator >= ratio.numerator * (sizes[0][i] + sizes[1][j] - both)
            pairs = [(i[good], j[good])]
        return linked([p["node"].tolist() for p in parts], [p["copies"].to_numpy() for p in parts], pairs)

    return run


def _dealt(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Every row once for each pair of blocks that its block is part of; adds block, i, j."""
    rows = rows.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o"))
    return rows.withColumn("i", F.least("block", "_o")).withColumn("j", F.greatest("block", "_o")).drop("_o", "_blocks")


def _candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """reps: node, values, bands. node, root of the clusters that candidate pairs make."""
    spark = reps.sparkSession
    bands = reps.select("node", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).where("size > 1")
    members = cut(bands.join(buckets, "band"), "members")
    lists = members.where(F.col("size") <= BUCKET).groupBy("band").agg(F.array_sort(F.collect_set("node")).alias("m"))
    pairs = lists.select(F.explode(F.flatten(F.transform("m", lambda x, k: F.transform(F.slice("m", k + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.a", "p.b")
    large = members.where(F.col("size") > BUCKET)
    pairs = cut(pairs.unionByName(large.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))).distinct(), "pairs")
    values = reps.select("node", "values")
    edges = pairs.join(values.toDF("a", "va"), "a").join(values.toDF("b", "vb"), "b").select("a", "b", "va", "vb").mapInArrow(in_worker("ngrams", _likely(threshold)), "a binary, b binary")
    # a node has an edge for each band, or for each other member of a small bucket; one will do where they lead to the same
    edges = cut(contracted(edges.select(F.col("b").alias("node"), F.col("a").alias("root"))), "edges")
    release(pairs)
    clusters = components(edges)
    # Large buckets that are still in several pieces.
    pieces = large.select("band", "size", "node").join(clusters, "node", "left").groupBy("band").agg(F.min(F.coalesce("root", "node")).alias("lo"), F.max(F.coalesce("root", "node")).alias("hi"))
    torn = cut(pieces.where("lo < hi").select("band"), "torn")
    if not torn.isEmpty():
        # one of the buckets with the same members
        same = large.join(torn, "band", "left_semi").groupBy("band", "size").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"))
        same = cut(same.groupBy("size", "sum").agg(F.min("band").alias("band")).select("band"), "same")
        held = large.select("band", "size", "node").join(same, "band", "left_semi").join(values, "node")
        blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.least(F.ceil(F.col("size") / SMALL), F.lit(busy(spark)))).cast("int")
        more = cut(_dealt(held, "band", blocks).select("band", "i", "j", "block", "node", "values").groupBy("band", "i", "j").applyInPandas(_ties(threshold), "node binary, root binary"), "ties")
        release(clusters, same)
        clusters = components(edges.union(contracted(more)))
        release(more)
    release(members, edges, torn)
    return clusters


def busy(spark: SparkSession) -> int:
    """Blocks of which all pairs are about two tasks for each partition of the session."""
    return isqrt(4 * parallelism(spark))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_links, component_id, kept``.

    ``class_id`` is the smallest document with the same shingles, ``n_links`` counts the other documents
    at the threshold or above (copies included), ``component_id`` is the smallest document reachable by
    links, and ``kept`` marks it. Null and empty texts link with nothing, and so does a row without
    ``doc_id``. Repeated rows are one document; rows of one ``doc_id`` with different shingles are documents of their
    own, each counted by its id. An empty table gives an empty result. Other columns are not looked at. A threshold too
    low for the hashes raises ValueError."""
    return _joined(docs, threshold).select("doc_id", "class_id", "n_links", "component_id", "kept")


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("text"), F.col("text")).alias("k2"))


def _joined(docs: DataFrame, threshold: float) -> DataFrame:
    """The result of ``jaccard_join`` with two hashes of the text."""
    spark = docs.sparkSession
    ship(spark)
    plain = _keyed(docs)
    id_type = plain.schema["doc_id"].dataType.simpleString()
    sketches = cut(plain.mapInArrow(in_worker("ngrams", _sketch(*shape_for(threshold))), f"doc_id {id_type}, k1 long, k2 long, digest binary, n int, values binary, bands array<long>"), "sketches")
    named = sketches.where("doc_id is not null and digest is not null")
    classes = cut(named.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.count_distinct("doc_id").alias("copies"), F.count(F.lit(1)).alias("rows")), "classes")
    # A row of each class: those of a digest that is held once need no grouping.
    marked = named.join(classes.where("rows > 1").select("digest", F.col("class_id").alias("first"), "copies"), "digest", "left")
    columns = [F.col("digest").alias("node"), F.col("doc_id").alias("first"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), "n", "values", "bands"]
    reps = cut(marked.where("first is null").select(*columns).unionByName(marked.where("doc_id = first").dropDuplicates(["digest"]).select(*columns)), "reps")
    clusters = _candidates(reps, threshold)

    held = reps.select("node", "first", "copies", "n", "values").join(clusters.withColumnRenamed("root", "cluster"), "node")
    ids = held.select(F.col("first").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if clusters.count() <= BROADCAST_IDS else ids
    sets = plain.join(ids, "doc_id", "left_semi").select("text").mapInArrow(in_worker("ngrams", _sets), "node binary, set binary")
    members, size = F.count(F.lit(1)), F.sum(F.col("n").cast("long") * 8)
    blocks = F.greatest(F.ceil(size / BLOCK_BYTES), F.ceil(members / BLOCK), F.least(F.ceil(members / SMALL), F.lit(busy(spark)))).cast("int")
    sizes = cut(held.groupBy("cluster").agg(blocks.alias("blocks")).where("blocks > 1"), "sizes")
    dealt = _dealt(held.join(sizes, "cluster", "left").join(sets, "node"), "cluster", F.coalesce("blocks", F.lit(1)))
    found = cut(dealt.select("cluster", "i", "j", "block", "node", "copies", "values", "set").groupBy("cluster", "i", "j").applyInPandas(_verify(threshold), "node binary, links long, root binary"), "links")
    release(reps, clusters, sizes)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # a node comes from as many tasks as there are blocks
    groups = components(contracted(found.select("node", "root")))
    least = cut(groups.join(classes.select("digest", "class_id"), groups["node"] == classes["digest"]).groupBy("root").agg(F.min("class_id").alias("component_id")), "least")
    linked = links.join(groups.join(least, "root").select("node", "component_id"), "node").withColumnRenamed("node", "digest")
    verdict = cut(classes.where("rows > 1").select("digest", "class_id", "copies").join(linked, "digest", "full"), "verdict")
    release(found, groups, classes, least)
    result = sketches.select("doc_id", "k1", "k2", "digest").join(verdict, "digest", "left")
    named = F.col("doc_id").isNotNull()
    near = F.when(named, F.coalesce("component_id", "class_id", "doc_id"))
    n = F.when(named, F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).otherwise(0)
    return result.select("doc_id", "k1", "k2", F.when(named, F.coalesce("class_id", "doc_id")).alias("class_id"), n.cast("long").alias("n_links"), near.alias("component_id"), F.coalesce(F.col("doc_id") == near, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without those whose text is linked to that of a smaller document, in any number of
    steps. Rows without ``doc_id`` stay."""
    gone = cut(_joined(docs, threshold).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct(), "gone")
    named = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    key, text = (F.col(f"_c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    twin = (key == F.col("_gone")) & (F.xxhash64(text) == F.col("_k1")) & (F.xxhash64(F.lit("text"), text) == F.col("_k2"))
    return named.join(gone, twin, "left_anti").toDF(*docs.columns)
