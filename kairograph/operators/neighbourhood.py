"""Neighbourhoods: breadth-first trees around centres, type coverage, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.model import Graph


def _steps(g: Graph, types: list[str]) -> DataFrame:
    """Edges walked either way to a vertex of these types: t, here, label, dir (0 along, 1 against), next."""
    v = g.vertices.where(F.col("vtype").isin(types)).select("t", F.col("uri").alias("next"), F.col("vtype").alias("next_type"))
    along = g.edges.select("t", F.col("src").alias("here"), "label", F.lit(0).alias("dir"), F.col("dst").alias("next"))
    against = g.edges.select("t", F.col("dst").alias("here"), "label", F.lit(1).alias("dir"), F.col("src").alias("next"))
    return along.unionByName(against).where("here <> next").join(v, ["t", "next"])


def khop(g: Graph, center_type: str, hops: int, types: list[str] | None = None) -> DataFrame:
    """Per centre of a type the vertices within ``hops`` undirected steps, each with the one edge that reaches
    it first: fewer hops, then along before against the edge, then the smaller previous vertex and label.
    Columns t, center, uri, vtype, hop, prev, label, dir. A centre does not reach itself."""
    types = types or [r[0] for r in g.vertices.select("vtype").distinct().collect()]
    steps = _steps(g, types)
    centers = g.vertices.where(F.col("vtype") == center_type).select("t", F.col("uri").alias("center"))
    frontier = centers.select("t", "center", F.col("center").alias("here"))
    seen = None
    order = Window.partitionBy("t", "center", "uri").orderBy("hop", "dir", "prev", "label")
    for hop in range(1, hops + 1):
        found = frontier.join(steps, ["t", "here"]).where("next <> center").select("t", "center", F.col("next").alias("uri"), F.col("next_type").alias("vtype"), F.lit(hop).alias("hop"), F.col("here").alias("prev"), "label", "dir")
        seen = found if seen is None else seen.unionByName(found)
        seen = seen.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
        frontier = seen.where(F.col("hop") == hop).select("t", "center", F.col("uri").alias("here"))
    return seen


def edges_within(g: Graph, center_type: str, hops: int, types: list[str] | None = None) -> DataFrame:
    """All edges between vertices of the neighbourhood, the centre among them: t, center, src, dst, label."""
    near = khop(g, center_type, hops, types).select("t", "center", "uri")
    near = near.unionByName(near.select("t", "center", F.col("center").alias("uri")).distinct())
    src, dst = near.withColumnRenamed("uri", "src"), near.withColumnRenamed("uri", "dst")
    return g.edges.join(src, ["t", "src"]).join(dst, ["t", "center", "dst"]).select("t", "center", "src", "dst", "label")


def covering_centers(g: Graph, center_type: str, hops: int, needed: list[str]) -> DataFrame:
    """Centres (t, center) whose neighbourhood holds every needed type."""
    near = khop(g, center_type, hops, needed)
    return near.groupBy("t", "center").agg(F.count_distinct("vtype").alias("n")).where(F.col("n") == len(set(needed))).select("t", "center")


def signatures(g: Graph, center_type: str, hops: int, types: list[str]) -> DataFrame:
    """Per centre the sorted distinct (source type, label, target type) of its breadth-first tree."""
    v = g.vertices.select("t", F.col("uri").alias("prev"), F.col("vtype").alias("prev_type"))
    tree = khop(g, center_type, hops, types).join(v, ["t", "prev"])
    along = F.col("dir") == 0
    sig = F.concat_ws(" ", F.when(along, F.col("prev_type")).otherwise(F.col("vtype")), "label", F.when(along, F.col("vtype")).otherwise(F.col("prev_type")))
    return tree.groupBy("t", "center").agg(F.array_sort(F.collect_set(sig)).alias("signature"))


def fragment_jobs(g: Graph, fragments: DataFrame, center_type: str) -> DataFrame:
    """fragments: uri, fragment. The centres that each fragment's job starts from: t, uri, fragment."""
    return g.vertices.where(F.col("vtype") == center_type).select("t", "uri").join(fragments.select("uri", "fragment"), "uri").select("t", "uri", "fragment")
