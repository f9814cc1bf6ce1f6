"""Snapshots from a first graph and a log of changes.

The order of application makes each key's history its own: edge deletions, then deletions and changes of
attributes, types and vertices, then new vertices, then new attributes and edges. So a vertex folds
over its own events, and an edge over its own, given which vertices live at the end of a step.
Snapshots are not built one from another; all come from one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.model import Graph

# Order in which the kinds of changes of one step apply.
RANKS = {"deleteEdge": 0, "deleteAttr": 1, "changeAttr": 1, "changeType": 1, "deleteVertex": 1, "insertVertex": 2, "insertAttr": 3, "insertEdge": 3}


def rank_of(op: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in RANKS.items():
        out = F.when(op == name, rank).otherwise(out)
    return out


def ordered(changes: DataFrame) -> DataFrame:
    """Adds ``rank`` and ``pos``, the place of a change within its step from 1; unknown kinds are left out."""
    known = changes.withColumn("rank", rank_of(F.col("op"))).where("rank is not null")
    return known.withColumn("pos", F.row_number().over(Window.partitionBy("t").orderBy("rank", "seq")))


_PAIRS = "array<struct<key:string,value:string>>"
_STATE = "struct<alive:boolean,vtype:string,attrs:array<struct<key:string,value:string>>>"


def vertex_histories(vertices0: DataFrame, changes: DataFrame) -> DataFrame:
    """uri and ``states``: its state (alive, vtype, attrs as pairs) after each of its events, with the step."""
    none = F.lit(None).cast("string")
    first = vertices0.select("uri", F.struct(F.lit(0).alias("t"), F.lit(-1).alias("rank"), F.lit(0).cast("long").alias("seq"), F.lit("insertVertex").alias("op"), none.alias("attr"), none.alias("val"), F.col("vtype").alias("vtype"), F.array_sort(F.map_entries("attrs")).cast(_PAIRS).alias("attrs")).alias("e"))
    kept = changes.where(F.col("op").isin("insertVertex", "deleteVertex", "changeType", "insertAttr", "deleteAttr", "changeAttr"))
    later = kept.select("uri", F.struct(F.col("t").cast("int").alias("t"), rank_of(F.col("op")).alias("rank"), F.col("seq").cast("long").alias("seq"), "op", "attr", "val", F.when(F.col("op") == "changeType", F.col("new_vtype")).otherwise(F.col("vtype")).alias("vtype"), F.coalesce(F.array_sort(F.map_entries("attrs")), F.array()).cast(_PAIRS).alias("attrs")).alias("e"))
    events = first.unionByName(later).groupBy("uri").agg(F.array_sort(F.collect_list("e")).alias("events"))

    start = F.struct(F.lit(False).alias("alive"), F.lit(None).cast("string").alias("vtype"), F.array().cast(_PAIRS).alias("attrs"))

    def step(acc: Column, e: Column) -> Column:
        s, op = acc["now"], e["op"]
        on = s["alive"]
        rest = F.filter(s["attrs"], lambda p: p["key"] != e["attr"])
        has = F.exists(s["attrs"], lambda p: p["key"] == e["attr"])
        put = F.concat(rest, F.array(F.struct(e["attr"].alias("key"), e["val"].alias("value"))))
        state = lambda alive, vtype, attrs: F.struct(alive.alias("alive"), vtype.alias("vtype"), attrs.alias("attrs")).cast(_STATE)
        now = (
            F.when((op == "insertVertex") & ~on, state(F.lit(True), e["vtype"], e["attrs"]))
            .when((op == "deleteVertex") & on, start.cast(_STATE))
            .when((op == "changeType") & on, state(on, e["vtype"], s["attrs"]))
            .when((op == "changeAttr") & on, state(on, s["vtype"], put))
            .when((op == "insertAttr") & on & ~has, state(on, s["vtype"], put))
            .when((op == "deleteAttr") & on, state(on, s["vtype"], rest))
            .otherwise(s.cast(_STATE))
        )
        # Of one step only the last state is kept.
        past = F.filter(acc["past"], lambda p: p["t"] < e["t"])
        return F.struct(now.alias("now"), F.concat(past, F.array(F.struct(e["t"].alias("t"), now.alias("s")))).alias("past"))

    kind = f"struct<now:{_STATE},past:array<struct<t:int,s:{_STATE}>>>"
    zero = F.struct(start.alias("now"), F.array().alias("past")).cast(kind)
    return events.select("uri", F.aggregate("events", zero, lambda a, e: step(a, e).cast(kind))["past"].alias("states"))


def _each_step(timestamps: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(timestamps - 1))).alias("t")


def vertex_snapshots(vertices0: DataFrame, changes: DataFrame, timestamps: int) -> DataFrame:
    """Vertices of all snapshots: t, uri, vtype, attrs."""
    each = vertex_histories(vertices0, changes).select("uri", "states", _each_step(timestamps))
    last = F.try_element_at(F.filter("states", lambda p: p["t"] <= F.col("t")), F.lit(-1))
    return each.select("t", "uri", last["s"].alias("s")).where("s.alive").select("t", "uri", "s.vtype", F.map_from_entries("s.attrs").alias("attrs"))


def edge_snapshots(edges0: DataFrame, changes: DataFrame, vertices: DataFrame, timestamps: int) -> DataFrame:
    """Edges of all snapshots: t, src, dst, label. An edge needs both ends alive when it comes, and a free
    (src, dst); it goes by its own deletion or that of an end."""
    alive = vertices.select("t", "uri")
    ends = lambda df: df.join(alive.toDF("t", "src"), ["t", "src"], "left_semi").join(alive.toDF("t", "dst"), ["t", "dst"], "left_semi")
    event = lambda t, rank, seq, op, label: F.struct(t.cast("int").alias("t"), rank.alias("rank"), seq.cast("long").alias("seq"), op.alias("op"), label.alias("label")).alias("e")
    first = ends(edges0.select(F.lit(0).alias("t"), "src", "dst", "label")).groupBy("src", "dst").agg(F.min("label").alias("label"))
    base = first.select("src", "dst", event(F.lit(0), F.lit(-1), F.lit(0), F.lit("insertEdge"), F.col("label")))
    come = ends(changes.where("op = 'insertEdge'").select(F.col("t").cast("int").alias("t"), "src", "dst", "label", "seq")).select("src", "dst", event(F.col("t"), F.lit(RANKS["insertEdge"]), F.col("seq"), F.lit("insertEdge"), F.col("label")))
    go = changes.where("op = 'deleteEdge'").select("src", "dst", event(F.col("t"), F.lit(RANKS["deleteEdge"]), F.col("seq"), F.lit("deleteEdge"), F.col("label")))
    known = base.select("src", "dst").unionByName(come.select("src", "dst")).distinct()
    dead = changes.where("op = 'deleteVertex'").select("t", "seq", "uri")
    kill = lambda end: known.join(dead.withColumnRenamed("uri", end), end).select("src", "dst", event(F.col("t"), F.lit(RANKS["deleteVertex"]), F.col("seq"), F.lit("kill"), F.lit(None).cast("string")))
    events = base.unionByName(come).unionByName(go).unionByName(kill("src")).unionByName(kill("dst")).groupBy("src", "dst").agg(F.array_sort(F.collect_list("e")).alias("events"))
    kind = "struct<now:string,past:array<struct<t:int,label:string>>>"

    def step(acc: Column, e: Column) -> Column:
        now = F.when((e["op"] == "insertEdge") & acc["now"].isNull(), e["label"]).when((e["op"] == "deleteEdge") & (acc["now"] == e["label"]), F.lit(None).cast("string")).when(e["op"] == "kill", F.lit(None).cast("string")).otherwise(acc["now"])
        past = F.filter(acc["past"], lambda p: p["t"] < e["t"])
        return F.struct(now.alias("now"), F.concat(past, F.array(F.struct(e["t"].alias("t"), now.alias("label")))).alias("past")).cast(kind)

    zero = F.struct(F.lit(None).cast("string").alias("now"), F.array().alias("past")).cast(kind)
    each = events.select("src", "dst", F.aggregate("events", zero, step)["past"].alias("past")).select("src", "dst", "past", _each_step(timestamps))
    last = F.try_element_at(F.filter("past", lambda p: p["t"] <= F.col("t")), F.lit(-1))
    return each.select("t", "src", "dst", last["label"].alias("label")).where("label is not null")


def build_snapshots(first: Graph, changes: DataFrame, timestamps: int) -> Graph:
    """All snapshots of a first graph (t = 0) under changes (t from 1)."""
    v = vertex_snapshots(first.vertices.select("uri", "vtype", "attrs"), changes, timestamps)
    return Graph(v, edge_snapshots(first.edges.select("src", "dst", "label"), changes, v, timestamps))


def upsert_merge(base: Graph, other: Graph) -> Graph:
    """Union of two graphs: types and attributes of ``other`` win, attributes that it lacks stay; an edge of
    ``other`` is added where (src, dst) is free."""
    a = base.vertices.select("t", "uri", F.col("vtype").alias("_v"), F.col("attrs").alias("_a"))
    v = a.join(other.vertices, ["t", "uri"], "full_outer")
    empty = F.expr("cast(map() as map<string,string>)")
    mine, theirs = F.coalesce("_a", empty), F.coalesce("attrs", empty)
    attrs = F.map_concat(F.map_filter(mine, lambda k, _: ~F.map_contains_key(theirs, k)), theirs)
    v = v.select("t", "uri", F.coalesce("vtype", "_v").alias("vtype"), attrs.alias("attrs"))
    new = other.edges.join(base.edges.select("t", "src", "dst"), ["t", "src", "dst"], "left_anti")
    return Graph(v, base.edges.select("t", "src", "dst", "label").unionByName(new.select("t", "src", "dst", "label")))


def extract(g: Graph, edges: DataFrame) -> Graph:
    """The subgraph of listed edges (t, src, dst) with the vertices at their ends."""
    kept = g.edges.join(edges.select("t", "src", "dst"), ["t", "src", "dst"], "left_semi")
    ends = kept.select("t", F.explode(F.array("src", "dst")).alias("uri")).distinct()
    return Graph(g.vertices.join(ends, ["t", "uri"], "left_semi"), kept)


def rebind(g: Graph, changed: Graph) -> Graph:
    """The part of a graph that an update speaks of: its vertices that ``changed`` has too, by uri and type, with the attributes that
    it gives them, and the edges between them."""
    v = g.vertices.select("t", "uri", "vtype").join(changed.vertices.select("t", "uri", "vtype", "attrs"), ["t", "uri", "vtype"])
    ends = v.select("t", "uri")
    e = g.edges.join(ends.withColumnRenamed("uri", "src"), ["t", "src"], "left_semi").join(ends.withColumnRenamed("uri", "dst"), ["t", "dst"], "left_semi")
    return Graph(v, e)
