"""Histogram of a graph and the search space it leaves: counts, top-k, active attributes, edge clean-up.

All aggregates combine before they shuffle; what follows a top-k is small."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.model import Graph


def typed_edges(g: Graph) -> DataFrame:
    """Edges with the types of both ends: t, src, label, dst, src_type, dst_type. Ends that are not
    vertices of the snapshot drop the edge."""
    v = g.vertices.select("t", "uri", "vtype")
    src, dst = v.toDF("t", "src", "src_type"), v.toDF("t", "dst", "dst_type")
    return g.edges.join(src, ["t", "src"]).join(dst, ["t", "dst"]).select("t", "src", "label", "dst", "src_type", "dst_type")


def vertex_type_counts(g: Graph) -> DataFrame:
    return g.vertices.groupBy("vtype").agg(F.count(F.lit(1)).alias("n"))


def type_attributes(g: Graph) -> DataFrame:
    """Distinct (vtype, attr); the name ``uri`` is no attribute."""
    return g.vertices.select("vtype", F.explode(F.map_keys("attrs")).alias("attr")).where("attr <> 'uri'").distinct()


def attribute_spread(g: Graph) -> DataFrame:
    """attr -> number of types that carry it."""
    return type_attributes(g).groupBy("attr").agg(F.count(F.lit(1)).alias("n"))


def edge_type_counts(g: Graph) -> DataFrame:
    return typed_edges(g).groupBy("src_type", "label", "dst_type").agg(F.count(F.lit(1)).alias("n"))


def rank_attributes(attrs: DataFrame, gamma: int) -> DataFrame:
    """attrs: (vtype, attr). The gamma attributes that most types carry: attr, n."""
    return attrs.groupBy("attr").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "attr").limit(gamma)


def select_active(attrs: DataFrame, gamma: int) -> DataFrame:
    return attrs.join(F.broadcast(rank_attributes(attrs, gamma).select("attr")), "attr", "left_semi").select("vtype", "attr")


def rank_edges(counts: DataFrame, n: int) -> DataFrame:
    """counts: edge types with n. The n most frequent, with their rank from 1."""
    top = counts.orderBy(F.desc("n"), "src_type", "label", "dst_type").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "src_type", "label", "dst_type")))


def rank_types(counts: DataFrame, top: DataFrame) -> DataFrame:
    """counts: vertex types with n. Those at an end of a top edge type, before its clean-up, most frequent first
    by ``rank``."""
    touched = top.select(F.explode(F.array("src_type", "dst_type")).alias("vtype")).distinct()
    kept = counts.join(F.broadcast(touched), "vtype", "left_semi")
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "vtype")))


def top_attributes(g: Graph, gamma: int) -> DataFrame:
    return rank_attributes(type_attributes(g), gamma)


def active_attributes(g: Graph, gamma: int) -> DataFrame:
    """(vtype, attr) for the top attributes; types without one are absent."""
    return select_active(type_attributes(g), gamma)


def top_edges(g: Graph, n: int) -> DataFrame:
    return rank_edges(edge_type_counts(g), n)


def frequent_vertex_types(g: Graph, n: int) -> DataFrame:
    return rank_types(vertex_type_counts(g), top_edges(g, n))


def clean_edges(top: DataFrame, active: DataFrame) -> DataFrame:
    """Of ranked edge types the first of each label, if its ends differ in type and both types have active
    attributes. A label is used up by its first edge type even if that one is rejected."""
    first = top.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy("rank"))).where("_k = 1").drop("_k")
    types = F.broadcast(active.select("vtype").distinct())
    return first.where("src_type <> dst_type").join(types.withColumnRenamed("vtype", "src_type"), "src_type", "left_semi").join(types.withColumnRenamed("vtype", "dst_type"), "dst_type", "left_semi").select("src_type", "label", "dst_type", "n", "rank")


def presence(g: Graph) -> DataFrame:
    """(vtype, uri, t, n): how often an entity occurs in a snapshot."""
    return g.vertices.groupBy("vtype", "uri", "t").agg(F.count(F.lit(1)).alias("n"))
