"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells.

Two unit vectors x and y with homes c and c' (their nearest centroids) and u = (c - c')/|c - c'| have
margins x.u >= 0 and -y.u >= 0 whose sum is at most |x - y|. So one of the margins is at most half
the distance that the threshold allows, and a vector that is copied into every cell to which its
margin is that small meets all its partners: the search is exact, not only likely. Cells are fitted on a
bounded sample; every vector is indexed.

Within a cell, blocks of home vectors are compared with each other and with blocks of guests in double
precision. Blocks are bounded in bytes and as large as a task can hold, as each row goes to every pair of blocks that its
block is part of; for the same reason cells hold thousands. A task returns link counts and a spanning forest, never
the pairs. Equal vectors are one vector with a count. Components come from the forest. Vectors without any structure visit
more cells the more cells there are; then the work is that of comparing all with all, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import cut, pick, release, ship
from kairograph.llm.components import components, linked

THRESHOLD = 0.95
#: Vectors that the cells of a dimension are fitted on at most (the smallest hashes), in rows and in bytes, and vectors a cell should hold.
SAMPLE, SAMPLE_BYTES, PER_CELL, MAX_CELLS = 20_000, 32 << 20, 4096, 2048
ROUNDS = 8
#: Bytes of vectors in a block, and vectors handled at once.
BLOCK_BYTES, AT_ONCE = 8 << 20, 512
SEED = 20240229


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, dim, key = [], [], []
        for v in b.column(1):
            v = v.as_py()
            x = np.array(v, dtype=np.float64) if v and None not in v else np.zeros(0)
            ok = x.any() and np.isfinite(x).all()
            raw.append(x.tobytes() if ok else None), dim.append(len(x) if ok else 0)
            key.append(xxhash.xxh3_128_digest((x + 0.0).tobytes()) if ok else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array(dim, pa.int32()), pa.array(key, pa.binary())], names=["vec_id", "raw", "dim", "key"])


def _scaled(raw: Iterable[bytes], dim: int) -> np.ndarray:
    """Vectors divided by a power of two, which keeps their digits, so that no square overflows or vanishes."""
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _matrix(raw: Iterable[bytes], dim: int) -> np.ndarray:
    x = _scaled(raw, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centroids of unit vectors; fewer than k where vectors coincide."""
    c = np.unique(x[np.random.default_rng(seed).permutation(len(x))[:k]], axis=0)
    for _ in range(rounds):
        home = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-300), c)
    return np.unique(c, axis=0)


def reach(threshold: float) -> float:
    """Half the greatest distance of two unit vectors at the threshold."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + 1e-9)


def places(x: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each vector, and which cells it visits."""
    dots = x @ c.T
    home = dots.argmax(axis=1)
    gaps = np.sqrt(np.maximum(2 - 2 * c @ c.T, 0))[home]
    guest = dots[np.arange(len(x)), home][:, None] - dots <= reach(threshold) * gaps
    guest[np.arange(len(x)), home] = False
    return home, guest


def _assign(c: np.ndarray, threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, AT_ONCE):
                held = b.slice(part, AT_ONCE)
                home, guest = places(_matrix(held.column(2).to_pylist(), c.shape[1]), c, threshold)
                visits = [np.flatnonzero(g).astype(np.int32) for g in guest]
                yield pa.RecordBatch.from_arrays([*held.columns, pa.array(home.astype(np.int32)), pa.array(visits, pa.list_(pa.int32()))], names=["node", "copies", "raw", "dim", "home", "visits"])

    return run


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, cell, left_at, right_at, guests = (int(pdf[n].iloc[0]) for n in ("dim", "cell", "i", "j", "guests"))
        left = pdf[(pdf["role"] == 0) & (pdf["block"] == left_at)]
        right = pdf[(pdf["role"] == 1) & (pdf["block"] == right_at)] if guests else pdf[(pdf["role"] == 0) & (pdf["block"] == right_at)]

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            x, y = _matrix(left["raw"], dim), _matrix(right["raw"], dim)
            other = right["home"].to_numpy()
            visits = np.zeros((len(left), int(other.max()) + 1 if guests else 0), dtype=bool)
            for k, v in enumerate(left["visits"] if guests else ()):
                v = np.asarray(v)
                visits[k, v[v < visits.shape[1]]] = True
            plain = None
            for s in range(0, len(x), AT_ONCE):
                cos = x[s : s + AT_ONCE] @ y.T
                i, j = np.nonzero(cos >= threshold - 1e-9)
                close = cos[i, j] < threshold + 1e-9
                i = i + s
                if close.any():  # near the threshold by the plain formula
                    plain = plain or [_scaled(p["raw"], dim) for p in (left, right)]
                    a, b = plain[0][i[close]], plain[1][j[close]]
                    good = np.ones(len(i), dtype=bool)
                    good[close] = (a * b).sum(axis=1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)) >= threshold
                    i, j = i[good], j[good]
                if guests:  # a pair that also meets in the guest's home counts in the smaller cell
                    keep = ~visits[i, other[j]] | (cell < other[j])
                    i, j = i[keep], j[keep]
                elif left_at == right_at:
                    i, j = i[i < j], j[i < j]
                yield i, j

        copies = [p["copies"].to_numpy() for p in (left, right)]
        return linked([p["node"].tolist() for p in (left, right)], copies, pairs() if len(left) and len(right) else [])

    return run


def _placed(vectors: DataFrame, dim: int, n: int, threshold: float) -> DataFrame:
    """Vectors of one dimension (node, copies, raw, dim) with home and visits."""
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))).select("raw").toPandas()
    x = _matrix(sample["raw"], dim)
    c = spherical_kmeans(x, int(min(MAX_CELLS, max(1, n // PER_CELL), max(1, len(x) // 4))))
    return vectors.mapInArrow(_assign(c, threshold), "node binary, copies long, raw binary, dim int, home int, visits array<int>")


def _links(vectors: DataFrame, threshold: float) -> DataFrame:
    """node, links, root of each task over unique vectors (node, copies, raw, dim)."""
    none = F.array().cast("array<int>")
    sizes = cut(vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dimensions")
    at = vectors.join(sizes.where(F.col("n") <= PER_CELL).select("dim"), "dim", "left_semi").select("node", "copies", "raw", "dim", F.lit(0).alias("home"), none.alias("visits"))
    for r in sizes.where(F.col("n") > PER_CELL).collect():  # no more than rows / PER_CELL
        at = at.unionByName(_placed(vectors.where(F.col("dim") == r["dim"]).select("node", "copies", "raw", "dim"), r["dim"], r["n"], threshold))
    at = cut(at, "cells")
    release(sizes)
    home = at.select("*", F.col("home").alias("cell"), F.lit(0).alias("role"))
    guest = at.select("node", "copies", "raw", "dim", "home", none.alias("visits"), F.explode("visits").alias("cell"), F.lit(1).alias("role"))
    blocks = lambda r: F.ceil(F.sum((F.col("role") == r).cast("long") * 8 * F.col("dim")) / BLOCK_BYTES).cast("int").alias(f"blocks{r}")
    held = cut(home.select("dim", "cell", "role").unionByName(guest.select("dim", "cell", "role")).groupBy("dim", "cell").agg(blocks(0), blocks(1)).where("blocks0 > 0"), "blocks")
    rows = home.unionByName(guest).join(held, ["dim", "cell"])
    own = F.when(F.col("role") == 0, F.col("blocks0")).otherwise(F.col("blocks1"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), own).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(none)
    key = lambda i, j, g: F.struct(i.alias("i"), j.alias("j"), F.lit(g).alias("guests"))
    b = F.col("block")
    homes = F.transform(upto(F.col("blocks0")), lambda o: key(F.least(b, o), F.greatest(b, o), 0))
    meets = F.transform(upto(F.col("blocks1")), lambda o: key(b, o, 1))
    visited = F.transform(upto(F.col("blocks0")), lambda o: key(o, b, 1))
    columns = ["node", "copies", "raw", "dim", "home", "visits", "cell", "role", "block"]
    dealt = rows.select(*columns, F.explode(F.when(F.col("role") == 0, F.concat(homes, meets)).otherwise(visited)).alias("t")).select(*columns, "t.i", "t.j", "t.guests")
    out = cut(dealt.groupBy("dim", "cell", "i", "j", "guests").applyInPandas(_compare(threshold), "node binary, links long, root binary"), "links")
    release(at, held)
    return out


def dedup_embeddings(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors`` (``vec_id``, ``embedding``).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so
    does a row without ``vec_id``. Vectors of different dimension do not link. Repeated rows are one vector; rows
    of one ``vec_id`` with different vectors are vectors of their own, which may link with each other. An empty table gives an
    empty result. Other columns are not looked at."""
    ship(vectors.sparkSession)
    plain = pick(vectors, "vec_id", "embedding")
    read = cut(plain.mapInArrow(_read, f"vec_id {plain.schema['vec_id'].dataType.simpleString()}, raw binary, dim int, key binary"), "vectors")
    valid = read.where("key is not null and vec_id is not null")
    unique = cut(valid.groupBy("key", "dim").agg(F.min("vec_id").alias("class_id"), F.count_distinct("vec_id").alias("copies"), F.first("raw").alias("raw")).withColumnRenamed("key", "node"), "unique")
    found = _links(unique.select("node", "copies", "raw", "dim"), threshold)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select("node", "root"))
    least = cut(groups.join(unique.select("node", "class_id"), "node").groupBy("root").agg(F.min("class_id").alias("component_id")), "least")
    linked_to = links.join(groups.join(least, "root").select("node", "component_id"), "node")
    verdict = cut(unique.select("node", "class_id", "copies").join(linked_to, "node", "left").withColumnRenamed("node", "key"), "verdict")
    release(unique, found, groups, least)
    out = read.select("vec_id", "key").join(verdict, "key", "left")
    named = F.col("vec_id").isNotNull()
    near = F.when(named, F.coalesce("component_id", "class_id", "vec_id"))
    n = F.when(named, F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).otherwise(0)
    return out.select("vec_id", n.cast("long").alias("n_links"), near.alias("component_id"), F.coalesce(F.col("vec_id") == near, F.lit(True)).alias("kept"))
