"""Supports of vertex types and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.functions import pair_count, pattern_support
from kairograph.model import Graph


def recurring(counts: DataFrame, by: list[str]) -> DataFrame:
    """counts: ``by``, an entity column, t, n. Per ``by`` the numerator of a support: for each entity the pairs
    of snapshots that hold it, and one for each snapshot that holds it more than once."""
    entity = [c for c in counts.columns if c not in (*by, "t", "n")]
    per = counts.groupBy(*by, *entity).agg(F.sum((F.col("n") > 0).cast("long")).alias("p"), F.sum((F.col("n") > 1).cast("long")).alias("w"))
    return per.select(*by, (pair_count(F.col("p")) + F.col("w")).alias("_k")).groupBy(*by).agg(F.sum("_k").cast("long").alias("numerator"))


def seed_support(g: Graph, timestamps: int) -> DataFrame:
    """vtype, numerator, centers, support; types that are not in the first snapshot have support 0."""
    counts = g.vertices.groupBy("vtype", "uri", "t").agg(F.count(F.lit(1)).alias("n"))
    start = g.vertices.where("t = 0").groupBy("vtype").agg(F.count_distinct("uri").alias("centers"))
    out = recurring(counts, ["vtype"]).join(start, "vtype", "left").withColumn("centers", F.coalesce("centers", F.lit(0)).cast("long"))
    return out.withColumn("support", pattern_support(F.col("numerator"), F.col("centers"), timestamps))


def support_of_patterns(counts: DataFrame, centers: DataFrame, timestamps: int) -> DataFrame:
    """counts: pattern_id, center_uri, t, n. centers: pattern_id, centers (of the first snapshot). One row a
    pattern of ``centers``: pattern_id, numerator, centers, support."""
    return support_of(recurring(counts, ["pattern_id"]), centers, timestamps)


def support_of(numerators: DataFrame, centers: DataFrame, timestamps: int) -> DataFrame:
    """As ``support_of_patterns``, from pattern_id, numerator."""
    out = F.broadcast(centers).join(numerators, "pattern_id", "left").withColumn("numerator", F.coalesce("numerator", F.lit(0)).cast("long"))
    return out.select("pattern_id", "numerator", "centers", pattern_support(F.col("numerator"), F.col("centers"), timestamps).alias("support"))
