"""Matching of tree patterns in all snapshots at once.

A pattern has one vertex per type, so a match is a row with a column per (type, attribute). Matching works
up from the leaves: at each vertex, equal attribute values under one parent are folded into a row with a
count before anything is joined, so hubs move distinct values and not edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.model import Edge, Graph, Pattern, column
from kairograph.operators.neighbourhood import khop, signatures
from kairograph.tables import cut

Active = dict[str, list[str]]


def columns_of(pattern: Pattern, active: Active) -> list[str]:
    """Active (type, attribute) columns of a pattern."""
    return [column(v, a) for v in pattern.vertices for a in active.get(v, [])]


def literals(g: Graph, vtype: str, attrs: list[str]) -> DataFrame:
    """t, uri and one column for each active attribute of the vertices of a type."""
    return g.vertices.where(F.col("vtype") == vtype).select("t", "uri", *[F.col("attrs")[a].alias(column(vtype, a)) for a in attrs])


def valid(names: list[str], at_least: int) -> Column:
    """Enough attribute values are there."""
    return (reduce(lambda a, b: a + b, [F.col(f"`{n}`").isNotNull().cast("int") for n in names]) if names else F.lit(0)) >= at_least


def _folded(g: Graph, pattern: Pattern, vtype: str, came: Edge | None, active: Active) -> DataFrame:
    out = literals(g, vtype, active.get(vtype, [])).withColumn("n", F.lit(1).cast("long"))
    for e in pattern.incident(vtype):
        if e == came:
            continue
        child = e.other(vtype)
        below = _folded(g, pattern, child, e, active)
        near, far = ("src", "dst") if e.src == vtype else ("dst", "src")
        hop = g.edges.where(F.col("label") == e.label).select("t", F.col(near).alias("_near"), F.col(far).alias("uri"))
        names = [c for c in below.columns if c not in ("t", "uri", "n")]
        part = hop.join(below, ["t", "uri"]).groupBy(F.col("t"), F.col("_near").alias("uri"), *[F.col(f"`{c}`") for c in names]).agg(F.sum("n").alias("_n"))
        out = out.join(part, ["t", "uri"]).withColumn("n", F.col("n") * F.col("_n")).drop("_n")
    return out


def match(g: Graph, pattern: Pattern, active: Active, mode: str = "structural", at_least: int | None = None) -> DataFrame:
    """t, center_uri, the pattern's columns, and ``n``: how many combinations of vertices have these values.
    Only rows with ``at_least`` values count, by default one more than the pattern has vertices."""
    names = columns_of(pattern, active)
    at_least = len(pattern.vertices) + 1 if at_least is None else at_least
    if mode == "structural":
        rows = _folded(g, pattern, pattern.center, None, active)
    elif mode == "signature":
        rows = _crossed(g, pattern, active)
    else:
        raise ValueError(f"no match mode {mode!r}")
    return rows.select("t", F.col("uri").alias("center_uri"), *[F.col(f"`{c}`") for c in names], "n").where(valid(names, at_least))


#: What reaches vertices from the subtrees under them, written once: (edge, upper vertex type, edges below) -> table.
Held = dict[tuple[Edge, str, frozenset[Edge]], DataFrame]
#: Few columns a vertex: where each partition of them is small they are hashed, and the edges need no sort.
HASHED = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(32 << 20)}


def _under(pattern: Pattern, vtype: str, came: Edge) -> frozenset[Edge]:
    """Edges of the subtree under a vertex type, as reached by an edge."""
    return frozenset(x for e in pattern.incident(vtype) if e != came for x in (e, *_under(pattern, e.other(vtype), e)))


def _below(g: Graph, pattern: Pattern, vtype: str, came: Edge | None, rows, by: list[str], folded, held: Held | None = None) -> DataFrame:
    """Rows of a vertex type joined with those of the subtrees under it. rows: vertex type -> t, uri, columns; what
    reaches a parent is grouped by ``by`` and the subtree's own columns and folded by ``folded``, and taken from or written to ``held``."""
    out = rows(vtype)
    for e in pattern.incident(vtype):
        if e == came:
            continue
        key = (e, vtype, _under(pattern, e.other(vtype), e))
        if held is None or key not in held:
            below = _below(g, pattern, e.other(vtype), e, rows, by, folded, held)
            near, far = ("src", "dst") if e.src == vtype else ("dst", "src")
            hop = g.edges.where(F.col("label") == e.label).select("t", F.col(near).alias("_near"), F.col(far).alias("uri"))
            own = [c for c in below.columns if c.startswith("v__")]
            part = hop.join(below, ["t", "uri"]).groupBy(F.col("t"), F.col("_near").alias("uri"), *own, *by).agg(folded)
            if held is not None:
                part = held[key] = cut(part, "hop", "zstd", HASHED)
        else:
            part = held[key]
        part = part.withColumnsRenamed({c: f"_{c}" for c in ("filled", "n") if c in part.columns})
        out = out.join(part, ["t", "uri"]).withColumn("filled", F.col("filled") + F.col("_filled"))
        out = out.withColumn("n", F.col("n") * F.col("_n")) if "_n" in out.columns else out
        out = out.drop("_filled", "_n")
    return out


def _filled(attrs: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col("attrs")[a].isNotNull().cast("int") for a in attrs], F.lit(0)).alias("filled")


def match_counts(g: Graph, pattern: Pattern, active: Active, at_least: int | None = None, held: Held | None = None) -> DataFrame:
    """``entity_counts`` of the structural matches, without their values: center_uri, t, n. What moves is how many combinations
    below a vertex hold how many values. Patterns of one graph and its active attributes may share ``held``."""
    at_least = len(pattern.vertices) + 1 if at_least is None else at_least
    rows = lambda v: g.vertices.where(F.col("vtype") == v).select("t", "uri", _filled(active.get(v, [])), F.lit(1).cast("long").alias("n"))
    out = _below(g, pattern, pattern.center, None, rows, ["filled"], F.sum("n").alias("n"), held)
    return out.where(F.col("filled") >= at_least).groupBy(F.col("uri").alias("center_uri"), "t").agg(F.sum("n").alias("n"))


def match_choices(g: Graph, pattern: Pattern, active: Active, at_least: int | None = None) -> DataFrame:
    """Of the structural matches, all sets of values with one attribute of every vertex: t, cells (one (vtype, attr,
    val) for each vertex type, in order of their names), each once a snapshot. Choosing at the leaves keeps the values of several
    attributes of a vertex from multiplying with those of all others."""
    at_least = len(pattern.vertices) + 1 if at_least is None else at_least

    def rows(v: str) -> DataFrame:
        attrs = active.get(v, [])
        each = F.array(*[F.struct(F.lit(v).alias("vtype"), F.lit(a).alias("attr"), F.col("attrs")[a].alias("val")) for a in attrs])
        own = g.vertices.where(F.col("vtype") == v).select("t", "uri", _filled(attrs), F.explode(each).alias(f"v__{v}"))
        return own.where(F.col(f"`v__{v}`")["val"].isNotNull())

    if not all(active.get(v) for v in pattern.vertices):
        return g.vertices.where("false").select("t", F.array(F.struct(F.lit("").alias("vtype"), F.lit("").alias("attr"), F.lit("").alias("val"))).alias("cells"))
    out = _below(g, pattern, pattern.center, None, rows, [], F.max("filled").alias("filled"))
    order = sorted(pattern.vertices, key=lambda v: column(v, ""))
    return out.where(F.col("filled") >= at_least).select("t", F.array(*[F.col(f"`v__{v}`") for v in order]).alias("cells")).distinct()


def _crossed(g: Graph, pattern: Pattern, active: Active) -> DataFrame:
    """Centres whose neighbourhood has exactly the edge types of the pattern; every combination of neighbours,
    one of each type, counts."""
    hops = max(1, min(2, pattern.depth()))
    wanted = sorted(f"{e.src} {e.label} {e.dst}" for e in pattern.edges)
    types = list(pattern.vertices)
    good = signatures(g, pattern.center, hops, types).where(F.col("signature") == F.array(*[F.lit(w) for w in wanted])).select("t", F.col("center").alias("uri"))
    out = literals(g, pattern.center, active.get(pattern.center, [])).join(good, ["t", "uri"]).withColumn("n", F.lit(1).cast("long"))
    tree = khop(g, pattern.center, hops, types).select("t", "center", "uri", "vtype")
    for v in pattern.vertices:
        if v == pattern.center:
            continue
        own = literals(g, v, active.get(v, []))
        names = [c for c in own.columns if c not in ("t", "uri")]
        part = tree.where(F.col("vtype") == v).join(own, ["t", "uri"]).groupBy(F.col("t"), F.col("center").alias("uri"), *[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_n"))
        out = out.join(part, ["t", "uri"]).withColumn("n", F.col("n") * F.col("_n")).drop("_n")
    return out


def distinct_matches(matches: DataFrame) -> DataFrame:
    """Matches as sets of values: equal ones within a snapshot are one, whatever their centres."""
    return matches.drop("center_uri", "n").distinct()


def entity_counts(matches: DataFrame) -> DataFrame:
    """center_uri, t, n: combinations at a centre in a snapshot."""
    return matches.groupBy("center_uri", "t").agg(F.sum("n").alias("n"))


def match_induced(g: Graph, edges: list[tuple[str, str, str]], types: dict[str, str]) -> DataFrame:
    """Induced subgraph isomorphism. edges: (variable, label or ``*``, variable); types: variable -> vertex type, ``*`` for any.
    One row per match with the uri of each variable: distinct vertices, all pattern edges there, and no other
    edge between matched vertices. The pattern must be connected."""
    label_of = lambda label: F.lit(True) if label == "*" else (F.col("label") == label)
    pairs = g.edges.select("t", "src", "dst", "label")
    out, bound = None, []
    rest = list(edges)
    while rest:
        k = next((i for i, (a, _, b) in enumerate(rest) if out is None or a in bound or b in bound), None)
        if k is None:
            raise ValueError("the pattern is not connected")
        a, label, b = rest.pop(k)
        e = pairs.where(label_of(label)).select("t", F.col("src").alias(a), F.col("dst").alias(b))
        out = e if out is None else out.join(e, ["t", *[v for v in (a, b) if v in bound]])
        bound += [v for v in (a, b) if v not in bound]
    for i, a in enumerate(bound):
        for b in bound[:i]:
            out = out.where(F.col(a) != F.col(b))
        if types.get(a, "*") != "*":
            own = g.vertices.where(F.col("vtype") == types[a]).select("t", F.col("uri").alias(a))
            out = out.join(own, ["t", a], "left_semi")
    drawn = {(a, b) for a, _, b in edges}
    for a in bound:
        for b in bound:
            if a != b and (a, b) not in drawn:
                out = out.join(pairs.select("t", F.col("src").alias(a), F.col("dst").alias(b)), ["t", a, b], "left_anti")
    return out.select("t", *bound)


def compatible(vtype: Column, attrs: Column, wanted_type: str, wanted_attrs: list[str]) -> Column:
    """A vertex fits a pattern vertex: the type is equal, and if the pattern names attributes, the vertex has
    just these."""
    same = vtype == wanted_type
    return same & (F.array_sort(F.map_keys(attrs)) == F.array(*[F.lit(a) for a in sorted(wanted_attrs)])) if wanted_attrs else same


def concerns(uris: list[str], *columns: Column) -> Column:
    """One of the columns is one of the uris."""
    return reduce(lambda a, b: a | b, [F.coalesce(c.isin(uris), F.lit(False)) for c in columns])
