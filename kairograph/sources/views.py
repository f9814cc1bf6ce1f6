"""Temporal graphs over the relational tables: orders by year, and users by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.model import Graph

FIRST_YEAR, YEARS = 1995, 7
DAYS = 30
#: Characters before <type>/<id> in the resources of ``resources``.
RESOURCE_PREFIX = "http://imdb.org/"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _uri(key: str, vtype: str) -> Column:
    return F.concat(F.col(key).cast("string"), F.lit(f"-{vtype}"))


def _attrs(**values: Column) -> Column:
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), v)])


def _tier(balance: str) -> Column:
    return F.when(F.col(balance) < 0, "debit").when(F.col(balance) < 5000, "low").otherwise("high")


#: Vertex types of ``commerce`` in the order of their numbers.
NUMBERED = ("customer", "nation", "region", "part", "supplier")


def _number(key: str, vtype: str) -> Column:
    return F.col(key).cast("long") * 8 + NUMBERED.index(vtype)


def commerce(spark: SparkSession, folder: str, only: int | None = None, first_year: int = FIRST_YEAR, years: int = YEARS, numbers: bool = False) -> Graph:
    """Snapshots are years, from ``first_year`` on, or ``only`` one of them, for which the scan of orders skips the rest. Customers
    are there in the years in which they order; nations, regions, parts and suppliers always. Edges: in_nation, in_region,
    based_in, and by year bought (customer to part) and supplies (supplier to part). With ``numbers`` uris are numbers, eight
    times the key and the type's, which take less room where nobody sees them."""
    named = _number if numbers else _uri
    lo, hi = (0, years - 1) if only is None else (only, only)
    # joined, as Spark counts the rows that a join may give, but not those of an exploded array, and would broadcast large tables
    every = spark.range(lo, hi + 1).select(F.col("id").cast("int").alias("t"))
    dated = _table(spark, folder, "orders").where((F.col("o_orderdate") >= F.lit(f"{first_year + lo}-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit(f"{first_year + hi + 1}-01-01").cast("timestamp")))
    orders = dated.select("o_orderkey", "o_custkey", (F.year("o_orderdate") - first_year).cast("int").alias("t"))
    active = orders.select("t", F.col("o_custkey").alias("c_custkey")).distinct()
    customer, nation, region = (_table(spark, folder, n) for n in ("customer", "nation", "region"))
    part, supplier = (_table(spark, folder, n) for n in ("part", "supplier"))
    buyers = active.join(customer, "c_custkey")
    v = buyers.select("t", named("c_custkey", "customer").alias("uri"), F.lit("customer").alias("vtype"), _attrs(seg=F.lower("c_mktsegment"), tier=_tier("c_acctbal")).alias("attrs"))
    for df, key, vtype, attrs in (
        (nation, "n_nationkey", "nation", _attrs(name=F.lower("n_name"), code=F.col("n_nationkey").cast("string"))),
        (region, "r_regionkey", "region", _attrs(name=F.lower("r_name"), code=F.col("r_regionkey").cast("string"))),
        (part, "p_partkey", "part", _attrs(brand=F.lower("p_brand"), ptype=F.lower("p_type"))),
        (supplier, "s_suppkey", "supplier", _attrs(tier=_tier("s_acctbal"), digit=(F.col("s_suppkey") % 10).cast("string"))),
    ):
        v = v.unionByName(df.crossJoin(every).select("t", named(key, vtype).alias("uri"), F.lit(vtype).alias("vtype"), attrs.alias("attrs")))
    e = buyers.select("t", named("c_custkey", "customer").alias("src"), named("c_nationkey", "nation").alias("dst"), F.lit("in_nation").alias("label"))
    e = e.unionByName(nation.crossJoin(every).select("t", named("n_nationkey", "nation").alias("src"), named("n_regionkey", "region").alias("dst"), F.lit("in_region").alias("label")))
    e = e.unionByName(supplier.crossJoin(every).select("t", named("s_suppkey", "supplier").alias("src"), named("s_nationkey", "nation").alias("dst"), F.lit("based_in").alias("label")))
    lines = _table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    # keys are shorter than names
    e = e.unionByName(lines.select("t", "o_custkey", "l_partkey").distinct().select("t", named("o_custkey", "customer").alias("src"), named("l_partkey", "part").alias("dst"), F.lit("bought").alias("label")))
    e = e.unionByName(lines.select("t", "l_suppkey", "l_partkey").distinct().select("t", named("l_suppkey", "supplier").alias("src"), named("l_partkey", "part").alias("dst"), F.lit("supplies").alias("label")))
    return Graph(v, e)


def _change(rows: DataFrame, op: str, **fields: Column) -> DataFrame:
    none = lambda kind="string": F.lit(None).cast(kind)
    blank = {"src": none(), "dst": none(), "label": none(), "uri": none(), "attr": none(), "val": none(), "vtype": none(), "new_vtype": none(), "attrs": none("map<string,string>")}
    return rows.select("t", "seq", F.col("seq").cast("int").alias("id"), F.lit(op).alias("op"), *[c.alias(n) for n, c in (blank | fields).items()])


def _events(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return _table(spark, folder, "events").select(F.col("event_id").alias("seq"), F.dayofmonth("ts").cast("int").alias("t"), F.concat(F.col("user_id").cast("string"), F.lit("-user")).alias("user"), "event_type", k.alias("k"))


def lives(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a change log in which users come, change type and go: signup and click insert the user, error deletes it, purchase
    makes it a buyer, view inserts the edge to the item ``k``."""
    e = _events(spark, folder)
    user, item = F.col("user"), F.concat("k", F.lit("-item"))
    kinds = lambda *names: e.where(F.col("event_type").isin(*names))
    out = _change(kinds("signup", "click"), "insertVertex", uri=user, vtype=F.lit("user"), attrs=F.create_map(F.lit("start"), F.col("k")))
    out = out.unionByName(_change(kinds("error"), "deleteVertex", uri=user, vtype=F.lit("user")))
    out = out.unionByName(_change(kinds("purchase"), "changeType", uri=user, vtype=F.lit("user"), new_vtype=F.lit("buyer")))
    return out.unionByName(_change(kinds("view"), "insertEdge", src=user, dst=item, label=F.lit("viewed")))


def user_changes(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a change log, steps by day from 1: signup inserts the user, click and view change ``last``,
    purchase inserts ``first``, error deletes ``last``; view also inserts the edge to the item ``k``, and
    error deletes it."""
    e = _events(spark, folder)
    user, item = F.col("user"), F.concat("k", F.lit("-item"))
    kinds = lambda *names: e.where(F.col("event_type").isin(*names))
    out = _change(kinds("signup"), "insertVertex", uri=user, vtype=F.lit("user"), attrs=F.create_map(F.lit("start"), F.col("k")))
    out = out.unionByName(_change(kinds("click", "view"), "changeAttr", uri=user, attr=F.lit("last"), val=F.col("k")))
    out = out.unionByName(_change(kinds("purchase"), "insertAttr", uri=user, attr=F.lit("first"), val=F.col("k")))
    out = out.unionByName(_change(kinds("error"), "deleteAttr", uri=user, attr=F.lit("last")))
    out = out.unionByName(_change(kinds("view"), "insertEdge", src=user, dst=item, label=F.lit("viewed")))
    out = out.unionByName(_change(kinds("error"), "deleteEdge", src=user, dst=item, label=F.lit("viewed")))
    return out


def items(spark: SparkSession) -> Graph:
    """The first graph of ``user_changes``: a hundred items, no edges."""
    v = spark.range(100).select(F.lit(0).alias("t"), F.concat(F.col("id").cast("string"), F.lit("-item")).alias("uri"), F.lit("item").alias("vtype"), F.create_map(F.lit("name"), F.col("id").cast("string")).alias("attrs"))
    return Graph(v, spark.createDataFrame([], "t int, src string, dst string, label string"))
