"""Connected components by alternating large and small stars.

A list of few edges is solved on the driver, as rounds take as long for few edges as for many. The edge list never grows, and rounds grow with the logarithm of the largest component. Of each star only
the nodes that have something to move are joined; these are few after the first rounds, and written first, so
that Spark knows their size: it broadcasts few and splits the partition of a hub when there are many.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from kairograph.llm.common import cut, release

MAX_ROUNDS = 60
#: Edges up to this many (32 bytes each) are solved on the driver, more in rounds; only for ids of these types, which Python orders as Spark does.
FEW = 50_000
PLAIN = (BinaryType, LongType)


class Labels:
    """Groups of 0..n-1 under links that come in batches; ``at`` holds the least member of each one's group."""

    def __init__(self, n: int):
        self.at = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        at = self.at
        while len(i):
            a, b = at[i], at[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(at, np.maximum(a, b), np.minimum(a, b))
            while (at[at] != at).any():
                at = at[at]
        self.at = at


def linked(nodes: list[list[bytes]], copies: list[np.ndarray], pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """What a task returns of the links between two lists of nodes, or of one list with itself: of each linked node the
    number of copies that it links to, and the least node it reaches. pairs: batches of positions in both lists."""
    names = sorted({*nodes[0], *nodes[1]})
    place = {x: k for k, x in enumerate(names)}
    at = [np.array([place[x] for x in part], dtype=np.int64) for part in nodes]
    links, labels = np.zeros(len(names)), Labels(len(names))
    for i, j in pairs:
        a, b = at[0][i], at[1][j]
        links += np.bincount(a, copies[1][j], len(names)) + np.bincount(b, copies[0][i], len(names))
        labels.join(a, b)
    found = np.flatnonzero(links).tolist()
    return pd.DataFrame({"node": pd.Series([names[k] for k in found], dtype="object"), "links": links[found].astype(np.int64), "root": pd.Series([names[k] for k in labels.at[found].tolist()], dtype="object")})


def contracted(edges: DataFrame) -> DataFrame:
    """edges: node, root; nodes of few roots each, as these are gathered in a row. The same components from one edge of each node, to
    the least of its roots, and one from each other root to that, which nodes with the same roots share."""
    of = edges.groupBy("node").agg(F.collect_set("root").alias("roots")).select("node", "roots", F.array_min("roots").alias("least"))
    others = of.where(F.size("roots") > 1).select(F.explode("roots").alias("node"), "least").where("node <> least").distinct()
    return of.select("node", F.col("least").alias("root")).unionByName(others.withColumnRenamed("least", "root"))


def _falling(e: DataFrame) -> DataFrame:
    """Nodes with smaller and larger neighbours, and the least of them."""
    both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x")).where("m < a and a < x").select(F.col("a").alias("u"), "m")


def _large_star(e: DataFrame, falling: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the least of u's neighbourhood, u included. e: a > b."""
    return e.join(falling, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _torn(e: DataFrame) -> DataFrame:
    """Nodes with several smaller neighbours, and the least of these."""
    return e.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x")).where("m < x").select(F.col("a").alias("u"), "m")


def _small_star(e: DataFrame, torn: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the least of them. e: a > b."""
    moved = e.join(torn, F.col("a") == F.col("u"), "left")
    own = F.struct(F.col("a"), F.coalesce("m", "b").alias("b"))
    other = F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.select(F.explode(F.when(F.col("m") < F.col("b"), F.array(own, other)).otherwise(F.array(own))).alias("s")).select("s.a", "s.b").distinct()


def _solved(e: DataFrame) -> DataFrame:
    """What ``components`` gives, found on the driver."""
    kind = e.schema["a"].dataType.simpleString()
    pairs = e.toArrow()
    a, b = (pairs.column(k).to_pylist() for k in (0, 1))
    names = sorted({*a, *b})
    place = {x: k for k, x in enumerate(names)}
    labels = Labels(len(names))
    labels.join(*[np.array([place[x] for x in side], dtype=np.int64) for side in (a, b)])
    own = pairs.schema.field(0).type
    roots = pa.array([names[k] for k in labels.at.tolist()], own)
    return e.sparkSession.createDataFrame(pa.table({"node": pa.array(names, own), "root": roots}), f"node {kind}, root {kind}")


def components(edges: DataFrame) -> DataFrame:
    """edges: two columns of ids of one orderable type, in any order and direction, repeated or not. Returns
    ``node, root`` for every id on an edge between different ids; root is the least id reachable. Edges with
    a null end are left out. No edges: no rows. The result is a written table."""
    a, b = (F.col(c) for c in edges.columns)
    e = cut(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    if isinstance(e.schema["a"].dataType, PLAIN) and e.count() <= FEW:
        out = cut(_solved(e), "components")
        release(e)
        return out
    for _ in range(MAX_ROUNDS):
        falling = cut(_falling(e), "falling")
        large = e if falling.isEmpty() else cut(_large_star(e, falling), "edges")
        torn = cut(_torn(large), "torn")
        small = large if torn.isEmpty() else cut(_small_star(large, torn), "edges")
        release(falling, torn, *{id(x): x for x in (e, large) if x is not small}.values())
        if small is e:
            out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
            out = cut(out, "components")
            release(e)
            return out
        e = small
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
