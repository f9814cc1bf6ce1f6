"""Change files: JSON arrays of typed changes, one file for each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File names of change logs, and the fields of a change.
FILE = "changes_t{0}_t{1}_noSpecificTGFDs_full.json"
_VERTEX = "struct<vertexURI:string,types:array<string>,allAttributesList:array<struct<attrName:string,attrValue:string>>>"
CHANGE = f"typeOfChange string, id int, types array<string>, src string, dst string, label string, uri string, attribute struct<attrName:string,attrValue:string>, vertex {_VERTEX}, previousVertex {_VERTEX}, newVertex {_VERTEX}"
EDGE_OPS = ("insertEdge", "deleteEdge")


def typed(raw: DataFrame, edges: bool = True) -> DataFrame:
    """raw: t, seq and the fields of ``CHANGE``. The type of a vertex is the first of its types. A change of type
    concerns the previous vertex. Of several values of one attribute name the least counts. Without ``edges``, changes of
    edges are left out."""
    first = lambda c: F.try_element_at(F.col(f"{c}.types"), F.lit(1))
    pairs = F.col("vertex.allAttributesList")
    named = F.array_distinct(F.transform(F.filter(pairs, lambda a: a["attrName"].isNotNull()), lambda a: a["attrName"]))
    least = lambda n: F.array_min(F.transform(F.filter(pairs, lambda a: a["attrName"] == n), lambda a: a["attrValue"]))
    attrs = F.map_from_entries(F.transform(named, lambda n: F.struct(n, least(n))))
    uri: Column = F.coalesce(F.col("uri"), F.col("vertex.vertexURI"), F.col("previousVertex.vertexURI"))
    out = raw.select("t", "seq", "id", F.col("typeOfChange").alias("op"), "src", "dst", "label", uri.alias("uri"), F.col("attribute.attrName").alias("attr"), F.col("attribute.attrValue").alias("val"), F.coalesce(first("vertex"), first("previousVertex")).alias("vtype"), first("newVertex").alias("new_vtype"), attrs.alias("attrs"))
    return out if edges else out.where(~F.col("op").isin(*EDGE_OPS))


def read_changes(spark: SparkSession, folder: str, timestamps: int, edges: bool = True) -> DataFrame:
    """The change log of T snapshots: files for steps 1..T-1, all of which must be there and whole: one that is no JSON
    array of changes ends the run with an error. ``seq`` is the place in the file."""
    paths = [f"{folder}/{FILE.format(t - 1, t)}" for t in range(1, timestamps)]
    raw = spark.read.format("binaryFile").load(paths)
    # Spark passes over files without a byte. The test reads an aggregate, as a filter on one side of a join may run before the join.
    lost = F.array_except(F.array(*[F.lit(t) for t in range(1, timestamps)]), "found")
    whole = F.assert_true(F.size(lost) == 0, F.concat(F.lit("no JSON array of changes: step "), F.array_join(lost, ", ")))
    empty = raw.agg(F.collect_set(_step()).alias("found")).where(whole.isNotNull()).select(F.lit(None).cast("int").alias("t"))
    each = steps_of(raw)
    return typed(each.unionByName(empty, allowMissingColumns=True), edges)


def _step() -> Column:
    return F.regexp_extract("path", r"changes_t\d+_t(\d+)_", 1).cast("int")


def steps_of(raw: DataFrame) -> DataFrame:
    """raw: path, content of change files. t, seq and the fields of ``CHANGE``."""
    each = raw.select(_step().alias("t"), F.posexplode(changes_of(F.col("content").cast("string"))).alias("seq", "c"))
    return each.select("t", F.col("seq").cast("long").alias("seq"), "c.*")


def changes_of(text: Column) -> Column:
    """The array of changes of a file; anything else fails, lest a step be lost."""
    whole = F.from_json(text, f"array<struct<{_ddl(CHANGE)}>>", {"mode": "FAILFAST"})
    return F.coalesce(whole, F.raise_error(F.concat(F.lit("no JSON array of changes: "), F.substring(text, 1, 80))).cast(f"array<struct<{_ddl(CHANGE)}>>"))


def _ddl(columns: str) -> str:
    """``a int, b struct<c:int>`` -> ``a:int,b:struct<c:int>``."""
    out, depth, part = [], 0, ""
    for c in columns + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, _, kind = part.strip().partition(" ")
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return ",".join(out)


def parse_changes(lines: DataFrame, edges: bool = True) -> DataFrame:
    """lines: t, seq, value (JSON text of one change)."""
    return typed(lines.select("t", "seq", F.from_json("value", CHANGE).alias("c")).select("t", "seq", "c.*"), edges)
