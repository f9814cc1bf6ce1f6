"""Matching of tree patterns whose vertices differ little: a class is the values of all active attributes of a vertex, and its number
moves in their place. What reaches vertices from a subtree is written once, with counts, for the supports and the values of all
patterns, and dealt out by vertex, so that nothing moves where it is joined at a centre."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.model import Edge, Graph, Pattern, column
from kairograph.operators.matching import HASHED, Active, _under
from kairograph.tables import cut, release

#: Classes of a type that the driver numbers, and combinations of the classes of a pattern's types; beyond them patterns are matched by values.
MOST_CLASSES, MOST_COMBINATIONS = 1024, 1 << 20
#: Edges a vertex from which on what reaches it is folded before it moves.
HUB = 256
#: What a row that moves costs, in rows that are joined where they are.
MOVED = 3
#: Joins keep tables where they are dealt out by vertex alone; a task writes one bucket, so it needs no sort.
DEALT = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.maxConcurrentOutputFileWriters": "2"}
#: Snapshots in a long.
BITS = 62


@dataclass
class Classes:
    """vertices: type -> t, uri, code, dealt out by uri; ``code // width`` is the place of the vertex' values in ``values`` of its type, and
    ``code % width`` how many are there. Types of more than ``MOST_CLASSES`` classes are absent. sizes: type -> vertices, and fan: (edge, end) ->
    edges a vertex, both about."""

    g: Graph
    active: Active
    width: int
    last: int
    buckets: int
    vertices: dict[str, DataFrame] = field(default_factory=dict)
    values: dict[str, list[list[str | None]]] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    fan: dict[tuple[Edge, str], float] = field(default_factory=dict)
    held: dict[tuple, DataFrame] = field(default_factory=dict)

    def fits(self, p: Pattern) -> bool:
        return all(v in self.values for v in p.vertices) and prod(len(self.values[v]) for v in p.vertices) <= MOST_COMBINATIONS

    def _rows(self, p: Pattern, v: str, came: Edge | None) -> tuple[float, float, int]:
        """Of the subtree at a type: rows a vertex, rows that its hops move, combinations."""
        rows, moved, most = 1.0, 0.0, len(self.values[v])
        for e in p.incident(v):
            if e != came:
                below, under, combinations = self._rows(p, e.other(v), e)
                come = self.fan.get((e, v), 1.0) * below
                rows, moved, most = rows * min(come, combinations), moved + under + come * self.sizes.get(v, 1), most * combinations
        return rows, moved, most

    def root(self, p: Pattern) -> str:
        """The type at which the values of a pattern are joined with the fewest rows. The same sets of values are found at each, as only counts
        belong to the centre."""

        def cost(v: str) -> float:
            rows, moved, _ = self._rows(p, v, None)
            return MOVED * moved + rows * self.sizes.get(v, 1)

        return min((p.center, *(v for v in p.vertices if v != p.center)), key=cost)

    def drop(self) -> None:
        release(*self.held.values(), *self.vertices.values())


def _values(attrs: list[str]) -> Column:
    return F.array(*[F.col("attrs")[a] for a in attrs]).cast("array<string>")


def classes_of(g: Graph, types: list[str], active: Active, counts: dict[str, int] | None = None, fan: dict[tuple[Edge, str], float] | None = None) -> Classes:
    spark = g.vertices.sparkSession
    each = reduce(lambda c, v: c.when(F.col("vtype") == v, _values(active.get(v, []))), types, F.when(F.lit(False), F.array().cast("array<string>")))
    found = cut(g.vertices.where(F.col("vtype").isin(types)).groupBy("vtype", each.alias("vals")).agg(F.max("t").alias("t")), "classes")
    sizes = {r["vtype"]: (r["n"], r["t"]) for r in found.groupBy("vtype").agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("t")).collect()}
    few = sorted(v for v, (n, _) in sizes.items() if n <= MOST_CLASSES)
    out = Classes(g, active, 1 + max((len(active.get(v, [])) for v in types), default=0), max((t for _, t in sizes.values()), default=0), int(spark.conf.get("spark.sql.shuffle.partitions")), sizes=counts or {}, fan=fan or {})
    for r in found.where(F.col("vtype").isin(few)).collect():
        out.values.setdefault(r["vtype"], []).append(r["vals"])
    release(found)
    for v, vals in out.values.items():
        numbered = spark.createDataFrame([(x, k * out.width + sum(y is not None for y in x)) for k, x in enumerate(vals)], "vals array<string>, code int")
        own = g.vertices.where(F.col("vtype") == v).select("t", "uri", _values(active.get(v, [])).alias("vals")).join(F.broadcast(numbered), "vals").select("t", "uri", "code")
        out.vertices[v] = cut(own.repartition(out.buckets, "uri"), "class", "zstd", DEALT, ("uri", out.buckets))
    return out


def _filled(c: Classes, columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"`{x}`") % c.width for x in columns])


def _shown(df: DataFrame) -> list[str]:
    return [x for x in df.columns if x.startswith("v__")]


def _hop(c: Classes, p: Pattern, vtype: str, e: Edge, told: bool) -> DataFrame:
    """t, uri of a vertex type, what is in the subtree under it by an edge, and n: how many combinations of vertices have that. It is the
    classes if ``told``, else how many values are there (v__)."""
    child = e.other(vtype)
    key = (e, vtype, _under(p, child, e), told)
    if key not in c.held:
        below = _joined(c, p, child, e, told)
        near, far = ("src", "dst") if e.src == vtype else ("dst", "src")
        edges = c.g.edges.where(F.col("label") == e.label).select("t", F.col(near).alias("_near"), F.col(far).alias("uri"))
        own = [F.col(f"`{x}`") for x in _shown(below)]
        part = edges.join(below.hint("shuffle_hash"), ["t", "uri"]).select("t", F.col("_near").alias("uri"), *own, "n")
        part = _fold(part, own) if c.fan.get((e, vtype), 0) > HUB else part
        c.held[key] = cut(_fold(part.repartition(c.buckets, "uri"), own), "hop", "zstd", HASHED | DEALT, ("uri", c.buckets))
    return c.held[key]


def _fold(df: DataFrame, own: list[Column]) -> DataFrame:
    return df.groupBy("t", "uri", *own).agg(F.sum("n").alias("n"))


def _joined(c: Classes, p: Pattern, vtype: str, came: Edge | None, told: bool) -> DataFrame:
    """Vertices of a type with what is in the subtrees under them."""
    own = F.col("code").alias(f"v__{vtype}") if told else (F.col("code") % c.width).alias("v__")
    out = c.vertices[vtype].select("t", "uri", own, F.lit(1).cast("long").alias("n"))
    for e in p.incident(vtype):
        if e == came:
            continue
        if told:
            part = _hop(c, p, vtype, e, True).withColumnRenamed("n", "_n")
            out = out.hint("shuffle_hash").join(part, ["t", "uri"]).withColumn("n", F.col("n") * F.col("_n")).drop("_n")
        else:
            part = _counted(c, p, vtype, e)
            out = out.hint("shuffle_hash").join(part, ["t", "uri"]).select("t", "uri", (F.col("v__") + F.col("_v")).alias("v__"), (F.col("n") * F.col("_n")).alias("n"))
    return out


def _counted(c: Classes, p: Pattern, vtype: str, e: Edge) -> DataFrame:
    """t, uri, _v (values there in the subtree), _n. From the classes where they are written or will be: a single vertex, or the root's."""
    told = (e, vtype, _under(p, e.other(vtype), e), True) in c.held or len(p.incident(e.other(vtype))) == 1 or vtype == p.center == c.root(p)
    part = _hop(c, p, vtype, e, told)
    if told:
        return part.groupBy("t", "uri", _filled(c, _shown(part)).alias("_v")).agg(F.sum("n").alias("_n"))
    return part.withColumnsRenamed({"v__": "_v", "n": "_n"})


def class_counts(c: Classes, p: Pattern, at_least: int | None = None) -> DataFrame:
    """``entity_counts`` of the structural matches of a pattern that fits: center_uri, t, n."""
    at_least = len(p.vertices) + 1 if at_least is None else at_least
    out = _joined(c, p, p.center, None, False)
    return out.where(F.col("v__") >= at_least).groupBy(F.col("uri").alias("center_uri"), "t").agg(F.sum("n").alias("n"))


def class_choices(c: Classes, p: Pattern, at_least: int | None = None) -> DataFrame:
    """``match_choices`` of a pattern that fits, each once: cells, ts (the snapshots that have it). Values of several attributes of a vertex
    are told apart only where the classes of all vertices are there once."""
    at_least = len(p.vertices) + 1 if at_least is None else at_least
    spark, order = c.g.vertices.sparkSession, sorted(p.vertices, key=lambda v: column(v, ""))
    longs = range(c.last // BITS + 1)
    ored = lambda df, by: df.groupBy(*by).agg(*[F.bit_or(f"_m{k}").alias(f"_m{k}") for k in longs])
    rows = _joined(c, p, c.root(p), None, True)
    rows = rows.where(_filled(c, _shown(rows)) >= at_least)
    masks = [F.expr(f"CASE WHEN t DIV {BITS} = {k} THEN shiftleft(1L, t - {BITS * k}) ELSE 0L END").alias(f"_m{k}") for k in longs]
    rows = ored(rows.select(*[F.col(f"`v__{v}`").alias(f"_c{i}") for i, v in enumerate(order)], *masks), [f"_c{i}" for i in range(len(order))])
    cells = {}  # (type, attribute, value) -> number
    for i, v in enumerate(order):
        told = []
        for k, vals in enumerate(c.values[v]):
            code = k * c.width + sum(x is not None for x in vals)
            told += [(code, cells.setdefault((v, a, x), len(cells))) for a, x in zip(c.active.get(v, []), vals, strict=True) if x is not None]
        rows = rows.join(F.broadcast(spark.createDataFrame(told, f"_c{i} int, _v{i} int")), f"_c{i}").drop(f"_c{i}")
    rows = ored(rows, [f"_v{i}" for i in range(len(order))])
    for i in range(len(order)):
        named = spark.createDataFrame([(n, x) for x, n in cells.items()], f"_v{i} int, _x{i} struct<vtype:string,attr:string,val:string>")
        rows = rows.join(F.broadcast(named), f"_v{i}")
    times = [F.expr(f"filter(sequence({BITS * k}, {min(c.last, BITS * k + BITS - 1)}), t -> getbit(_m{k}, t - {BITS * k}) = 1)") for k in longs]
    return rows.select(F.array(*[f"_x{i}" for i in range(len(order))]).alias("cells"), F.concat(*times).alias("ts"))
