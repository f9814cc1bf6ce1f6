"""Registered queries: one for each operator, over the graph views of the tables, each with the same query
as DuckDB SQL. Aliases and arithmetic agree on both sides."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.functions import parse_resource_uri
from kairograph.model import Dependency, Edge, Graph, Pattern
from kairograph.operators import histogram, neighbourhood, rules, snapshots, support
from kairograph.operators.matching import distinct_matches, entity_counts, match, match_counts, match_induced
from kairograph.plans import lattice
from kairograph.sources import sinks, views
from kairograph.sources.changes import parse_changes

T = views.YEARS
PAIRS_OF_T = T * (T + 1) // 2
ACTIVE = {"customer": ["seg", "tier"], "nation": ["name", "code"], "region": ["name", "code"], "supplier": ["tier", "digit"], "part": ["brand", "ptype"]}
IN_NATION, IN_REGION, BASED_IN = Edge("customer", "in_nation", "nation"), Edge("nation", "in_region", "region"), Edge("supplier", "based_in", "nation")
BOUGHT, SUPPLIES = Edge("customer", "bought", "part"), Edge("supplier", "supplies", "part")
SINGLE = Pattern(("customer", "nation"), (IN_NATION,), "customer")
PATH = Pattern(("customer", "nation", "region"), (IN_NATION, IN_REGION), "nation")
STAR = Pattern(("customer", "nation", "region", "supplier"), (IN_NATION, IN_REGION, BASED_IN), "nation")
TREE = Pattern(("customer", "nation", "part"), (IN_NATION, BOUGHT), "customer")
FORK = Pattern(("customer", "nation", "supplier"), (IN_NATION, BASED_IN), "nation")
DEPENDENCIES = [
    Dependency(("customer__seg", "nation__name"), "region__name"),
    Dependency(("nation__name", "region__name"), "customer__seg"),
    Dependency(("customer__tier", "region__name"), "nation__code"),
]
THETA = 1e-4
TOP_ATTRIBUTES, TOP_EDGES = 3, 4


def _g(spark: SparkSession, d: str) -> Graph:
    return views.commerce(spark, d)


def _first(spark: SparkSession, d: str) -> Graph:
    return views.commerce(spark, d, only=0)


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return rules.value_groups(distinct_matches(match(_g(spark, d), PATH, ACTIVE)), DEPENDENCIES)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return rules.candidates(_groups(spark, d), T, THETA)


def pattern_support_query(spark: SparkSession, d: str) -> DataFrame:
    g = _g(spark, d)
    patterns = [SINGLE, PATH, FORK]
    counts = None
    for k, p in enumerate(patterns):
        part = match_counts(g, p, ACTIVE).withColumn("pattern_id", F.lit(k))
        counts = part if counts is None else counts.unionByName(part)
    start = g.vertices.where("t = 0").groupBy("vtype").agg(F.count_distinct("uri").alias("centers"))
    ids = spark.createDataFrame([(k, p.center) for k, p in enumerate(patterns)], "pattern_id int, vtype string").join(start, "vtype").select("pattern_id", "centers")
    return support.support_of_patterns(counts, ids, T)


def uri_parse_query(spark: SparkSession, d: str) -> DataFrame:
    part = spark.read.parquet(f"{d}/part.parquet")
    uri = F.concat(F.lit(views.RESOURCE_PREFIX + "Part/"), F.replace(F.col("p_name"), F.lit(" "), F.lit("%20")))
    u = part.select("p_partkey", parse_resource_uri(uri).alias("u"))
    return u.select("p_partkey", "u.vtype", "u.id", "u.vertex_uri")


def change_json_parse_query(spark: SparkSession, d: str) -> DataFrame:
    """Events written as changes of JSON, read back as typed changes."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("seq"), F.dayofmonth("ts").cast("int").alias("t"), F.concat(F.col("user_id").cast("string"), F.lit("-user")).alias("u"), "event_type", F.get_json_object("props", "$.k").alias("k"))
    attr = F.struct(F.lit("last").alias("attrName"), F.col("k").alias("attrValue"))
    vertex = F.struct(F.col("u").alias("vertexURI"), F.array(F.lit("user"), F.lit("agent")).alias("types"), F.array(F.struct(F.lit("start").alias("attrName"), F.col("k").alias("attrValue"))).alias("allAttributesList"))
    op = F.when(F.col("event_type") == "signup", "insertVertex").when(F.col("event_type") == "error", "deleteEdge").otherwise("changeAttr")
    body = F.struct(op.alias("typeOfChange"), F.col("seq").cast("int").alias("id"), F.when(op == "deleteEdge", F.col("u")).alias("src"), F.when(op == "deleteEdge", F.concat("k", F.lit("-item"))).alias("dst"), F.when(op == "deleteEdge", "viewed").alias("label"), F.when(op == "changeAttr", F.col("u")).alias("uri"), F.when(op == "changeAttr", attr).alias("attribute"), F.when(op == "insertVertex", vertex).alias("vertex"))
    out = parse_changes(e.select("t", "seq", F.to_json(body).alias("value")))
    return out.select("t", "seq", "id", "op", "src", "dst", "label", "uri", "attr", "val", "vtype", F.try_element_at("attrs", F.lit("start")).alias("start"))


def _users(spark: SparkSession, d: str) -> Graph:
    return snapshots.build_snapshots(views.items(spark), views.user_changes(spark, d), views.DAYS + 1)


def snapshot_attrs_query(spark: SparkSession, d: str) -> DataFrame:
    v = snapshots.vertex_snapshots(views.items(spark).vertices.select("uri", "vtype", "attrs"), views.user_changes(spark, d), views.DAYS + 1)
    return v.select("t", "uri", F.explode("attrs").alias("attr", "val"))


def snapshot_vertices_query(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.vertex_snapshots(views.items(spark).vertices.select("uri", "vtype", "attrs"), views.user_changes(spark, d), views.DAYS + 1).select("t", "uri", "vtype")


def _merged(spark: SparkSession, d: str) -> Graph:
    g = _g(spark, d)
    later = g.at(1)
    again = Graph(later.vertices.select(F.lit(0).alias("t"), "uri", "vtype", F.create_map(F.lit("tier"), F.lit("again")).alias("attrs")), later.edges.select(F.lit(0).alias("t"), "src", "dst", "label"))
    return snapshots.upsert_merge(g.at(0), again)


def graph_upsert_merge_query(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).vertices.select("uri", "vtype", F.explode("attrs").alias("attr", "val"))


def dependency_table(spark: SparkSession, found: list[Dependency]) -> DataFrame:
    return spark.createDataFrame([(",".join(x.lhs), x.rhs) for x in found], "lhs string, rhs string")


MINIMAL = [Dependency(("customer__seg", "nation__name"), "region__name"), Dependency(("nation__code",), "region__code")]


def result_lines_query(spark: SparkSession, d: str) -> DataFrame:
    """Rules written as lines and read back."""
    kept = rules.without_conflicts(_candidates(spark, d)).withColumn("level", F.lit(3))
    return rules.flat(sinks.parse_rule_lines(sinks.rule_lines(kept)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "hist_vertex_types": lambda s, d: histogram.vertex_type_counts(_first(s, d)),
    "hist_type_attrs": lambda s, d: histogram.type_attributes(_first(s, d)),
    "hist_attr_spread": lambda s, d: histogram.attribute_spread(_first(s, d)),
    "hist_edge_types": lambda s, d: histogram.edge_type_counts(_first(s, d)),
    "hist_all_snapshots": lambda s, d: histogram.edge_type_counts(_g(s, d)),
    "topk_attrs": lambda s, d: histogram.top_attributes(_first(s, d), TOP_ATTRIBUTES),
    "active_attrs": lambda s, d: histogram.active_attributes(_first(s, d), TOP_ATTRIBUTES),
    "topk_edges": lambda s, d: histogram.top_edges(_first(s, d), TOP_EDGES),
    "frequent_vertex_types": lambda s, d: histogram.frequent_vertex_types(_first(s, d), TOP_EDGES),
    "clean_edges": lambda s, d: histogram.clean_edges(histogram.top_edges(_first(s, d), TOP_EDGES), histogram.active_attributes(_first(s, d), TOP_ATTRIBUTES)),
    "typed_edges": lambda s, d: histogram.typed_edges(_g(s, d)),
    "presence": lambda s, d: histogram.presence(_g(s, d)),
    "seed_support": lambda s, d: support.seed_support(_g(s, d), T),
    "khop_1": lambda s, d: neighbourhood.khop(_g(s, d), "nation", 1, ["customer", "nation", "region", "supplier"]),
    "khop_2": lambda s, d: neighbourhood.khop(_g(s, d), "region", 2, ["customer", "nation", "region", "supplier"]),
    "khop_edges": lambda s, d: neighbourhood.edges_within(_g(s, d), "region", 1, ["nation", "region"]),
    "neighbour_type_coverage": lambda s, d: neighbourhood.covering_centers(_g(s, d), "nation", 1, ["customer", "supplier"]),
    "match_single_edge": lambda s, d: distinct_matches(match(_g(s, d), SINGLE, ACTIVE)),
    "match_star": lambda s, d: distinct_matches(match(_g(s, d), STAR, ACTIVE)),
    "match_path": lambda s, d: match(_g(s, d), PATH, ACTIVE),
    "match_tree": lambda s, d: distinct_matches(match(_g(s, d), TREE, ACTIVE)),
    "match_signature": lambda s, d: match(_g(s, d), FORK, ACTIVE, "signature"),
    "match_induced": lambda s, d: match_induced(_g(s, d), [("a", "*", "b"), ("b", "in_region", "c")], {"a": "customer", "b": "nation", "c": "region"}),
    "pattern_entity_counts": lambda s, d: entity_counts(match(_g(s, d), PATH, ACTIVE)),
    "pattern_support": pattern_support_query,
    "entity_groups": lambda s, d: rules.flat(_groups(s, d)),
    "entity_count": lambda s, d: rules.entity_counts(_groups(s, d)),
    "rhs_rank": lambda s, d: rules.flat(rules.ranked_values(_groups(s, d))),
    "delta_minmax": lambda s, d: rules.flat(rules.intervals(_groups(s, d))).drop("p"),
    "pair_count": lambda s, d: rules.flat(rules.candidates(_groups(s, d), T, 0.0)).select("dep", "x", "y", "pairs"),
    "rule_support": lambda s, d: rules.flat(rules.candidates(_groups(s, d), T, 0.0)).select("dep", "x", "y", "entities", "support"),
    "constant_candidates": lambda s, d: rules.flat(_candidates(s, d)),
    "constant_rules": lambda s, d: rules.flat(rules.without_conflicts(_candidates(s, d))),
    "conflict_pairs": lambda s, d: rules.flat(rules.conflict_pairs(_candidates(s, d))),
    "conflict_removed": lambda s, d: rules.flat(_candidates(s, d)).select("dep", "x", "y", "dmin", "dmax").exceptAll(rules.flat(rules.without_conflicts(_candidates(s, d))).select("dep", "x", "y", "dmin", "dmax")),
    "delta_merge": lambda s, d: rules.flat(rules.folded_intervals(_candidates(s, d), ["dep", "y"])),
    "general_rules": lambda s, d: rules.general_rules(_candidates(s, d)),
    "dependency_enumeration": lambda s, d: dependency_table(s, lattice.dependencies(PATH, ACTIVE)),
    "dependency_superset_prune": lambda s, d: dependency_table(s, lattice.unpruned(lattice.dependencies(STAR, ACTIVE), MINIMAL)),
    "change_order": lambda s, d: snapshots.ordered(views.user_changes(s, d)).select("t", "seq", "op", "rank", "pos"),
    "snapshot_vertices": snapshot_vertices_query,
    "snapshot_edges": lambda s, d: _users(s, d).edges.select("t", "src", "dst", "label"),
    "snapshot_attrs": snapshot_attrs_query,
    "graph_upsert_merge": graph_upsert_merge_query,
    "graph_upsert_edges": lambda s, d: _merged(s, d).edges.select("src", "dst", "label"),
    "rule_overlap": lambda s, d: rules.compare(_candidates(s, d), rules.without_conflicts(_candidates(s, d))),
    "rule_diff": lambda s, d: rules.flat(_candidates(s, d)).select("x", "y", "dmin", "dmax").subtract(rules.flat(rules.without_conflicts(_candidates(s, d))).select("x", "y", "dmin", "dmax")),
    "result_lines": result_lines_query,
    "uri_parse": uri_parse_query,
    "change_json_parse": change_json_parse_query,
}

# ---------------------------------------------------------------------------------------------------------
# The same in SQL.

_TIER = "CASE WHEN {0} < 0 THEN 'debit' WHEN {0} < 5000 THEN 'low' ELSE 'high' END"
_VIEW = f"""
o AS (SELECT o_orderkey, o_custkey, (year(o_orderdate) - {views.FIRST_YEAR})::INT AS t FROM orders),
ts AS (SELECT unnest(range({T}))::INT AS t),
c AS (SELECT DISTINCT t, c_custkey || '-customer' AS uri, lower(c_mktsegment) AS customer__seg, {_TIER.format("c_acctbal")} AS customer__tier, c_nationkey || '-nation' AS nation_uri FROM o JOIN customer ON o_custkey = c_custkey),
n AS (SELECT t, n_nationkey || '-nation' AS uri, lower(n_name) AS nation__name, n_nationkey::VARCHAR AS nation__code, n_regionkey || '-region' AS region_uri FROM nation, ts),
r AS (SELECT t, r_regionkey || '-region' AS uri, lower(r_name) AS region__name, r_regionkey::VARCHAR AS region__code FROM region, ts),
s AS (SELECT t, s_suppkey || '-supplier' AS uri, {_TIER.format("s_acctbal")} AS supplier__tier, (s_suppkey % 10)::VARCHAR AS supplier__digit, s_nationkey || '-nation' AS nation_uri FROM supplier, ts),
p AS (SELECT t, p_partkey || '-part' AS uri, lower(p_brand) AS part__brand, lower(p_type) AS part__ptype FROM part, ts),
bought AS (SELECT DISTINCT t, o_custkey || '-customer' AS src, l_partkey || '-part' AS dst FROM lineitem JOIN o ON l_orderkey = o_orderkey),
supplies AS (SELECT DISTINCT t, l_suppkey || '-supplier' AS src, l_partkey || '-part' AS dst FROM lineitem JOIN o ON l_orderkey = o_orderkey),
vs AS (SELECT t, uri, 'customer' AS vtype FROM c UNION ALL SELECT t, uri, 'nation' FROM n UNION ALL SELECT t, uri, 'region' FROM r UNION ALL SELECT t, uri, 'supplier' FROM s),
v AS (SELECT * FROM vs UNION ALL SELECT t, uri, 'part' FROM p UNION ALL SELECT t, uri, vtype FROM vs WHERE false),
es AS (SELECT t, uri AS src, nation_uri AS dst, 'in_nation' AS label FROM c UNION ALL SELECT t, uri, region_uri, 'in_region' FROM n UNION ALL SELECT t, uri, nation_uri, 'based_in' FROM s),
e AS (SELECT * FROM es UNION ALL SELECT t, src, dst, 'bought' FROM bought UNION ALL SELECT t, src, dst, 'supplies' FROM supplies),
types(vtype, attr) AS (VALUES {", ".join(f"('{k}', '{a}')" for k, v in ACTIVE.items() for a in v)}),
te AS (SELECT e.t, src, label, dst, a.vtype AS src_type, b.vtype AS dst_type FROM e JOIN v a ON a.t = e.t AND a.uri = src JOIN v b ON b.t = e.t AND b.uri = dst),
vt AS (SELECT vtype, count(*) AS n FROM v WHERE t = 0 GROUP BY vtype),
ta AS (SELECT vtype, attr FROM types WHERE vtype IN (SELECT vtype FROM vt)),
spread AS (SELECT attr, count(DISTINCT vtype) AS n FROM ta GROUP BY attr),
top_attr AS (SELECT attr, n FROM spread ORDER BY n DESC, attr LIMIT {TOP_ATTRIBUTES}),
act AS (SELECT vtype, attr FROM ta WHERE attr IN (SELECT attr FROM top_attr)),
et AS (SELECT src_type, label, dst_type, count(*) AS n FROM te WHERE t = 0 GROUP BY ALL),
top_edge AS (SELECT *, row_number() OVER (ORDER BY n DESC, src_type, label, dst_type)::INT AS rank FROM (SELECT * FROM et ORDER BY n DESC, src_type, label, dst_type LIMIT {TOP_EDGES}))"""

_SELECTS = {
    SINGLE: ("c.uri", "c JOIN n ON n.t = c.t AND n.uri = c.nation_uri", "c.t"),
    PATH: ("n.uri", "n JOIN c ON c.t = n.t AND c.nation_uri = n.uri JOIN r ON r.t = n.t AND r.uri = n.region_uri", "n.t"),
    STAR: ("n.uri", "n JOIN c ON c.t = n.t AND c.nation_uri = n.uri JOIN r ON r.t = n.t AND r.uri = n.region_uri JOIN s ON s.t = n.t AND s.nation_uri = n.uri", "n.t"),
    FORK: ("n.uri", "n JOIN c ON c.t = n.t AND c.nation_uri = n.uri JOIN s ON s.t = n.t AND s.nation_uri = n.uri", "n.t"),
    TREE: ("c.uri", "c JOIN n ON n.t = c.t AND n.uri = c.nation_uri JOIN bought b ON b.t = c.t AND b.src = c.uri JOIN p ON p.t = b.t AND p.uri = b.dst", "c.t"),
}
_SUPPLY = Pattern(("supplier", "nation", "region"), (BASED_IN, IN_REGION), "nation")
_SELECTS[_SUPPLY] = ("n.uri", "n JOIN s ON s.t = n.t AND s.nation_uri = n.uri JOIN r ON r.t = n.t AND r.uri = n.region_uri", "n.t")


def _columns(p: Pattern) -> list[str]:
    return [f"{v}__{a}" for v in p.vertices for a in ACTIVE[v]]


def _matches(p: Pattern) -> str:
    center, source, t = _SELECTS[p]
    return f"SELECT {t} AS t, {center} AS center_uri, {', '.join(_columns(p))}, count(*) AS n FROM {source} GROUP BY ALL"


def _distinct(p: Pattern) -> str:
    _, source, t = _SELECTS[p]
    return f"SELECT DISTINCT {t} AS t, {', '.join(_columns(p))} FROM {source}"


def _show(c: str) -> str:
    return f"'{c.replace('__', '.')}=' || {c}"


def _group(d: Dependency, source: str) -> str:
    return f"SELECT '{d.name}' AS dep, {''' || '|' || '''.join(_show(c) for c in sorted(d.lhs))} AS x, {_show(d.rhs)} AS y, t, count(*) AS n FROM {source} GROUP BY ALL"


def _rule_steps(groups: str, theta: float, by: str = "dep") -> str:
    return f"""
g AS ({groups}),
ents AS (SELECT {by}, count(DISTINCT x) AS entities FROM g GROUP BY {by}),
iv AS (SELECT {by}, x, y, count(*) AS p, min(gap)::INT AS dmin, (max(t) - min(t))::INT AS dmax FROM (SELECT {by}, x, y, t, t - lag(t) OVER (PARTITION BY {by}, x, y ORDER BY t) AS gap FROM g) GROUP BY {by}, x, y HAVING count(*) >= 2),
al AS (SELECT {by}, x, y, dmin, dmax, p * (p - 1) // 2 AS pairs, entities, CASE WHEN p * (p - 1) // 2 > entities * {PAIRS_OF_T} THEN 0.0 ELSE (p * (p - 1) // 2)::DOUBLE / (entities * {PAIRS_OF_T})::DOUBLE END AS support FROM iv JOIN ents USING ({by})),
cand AS (SELECT * FROM al WHERE support >= {theta!r}),
kept AS (SELECT * FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE {" AND ".join(f"a.{k} = b.{k}" for k in by.split(", "))} AND a.x = b.x AND a.y <> b.y AND a.dmax >= b.dmin AND a.dmin <= b.dmax))"""


_GROUPS = " UNION ALL ".join(_group(x, "dm") for x in DEPENDENCIES)
_RULES = f"{_VIEW}, dm AS ({_distinct(PATH)}), {_rule_steps(_GROUPS, THETA)}"


def _fold(by: str, source: str = "cand") -> str:
    """Distinct intervals by group, folded: the list of one-element lists gives the accumulator its type."""
    last, new = "acc[len(acc)]", "x[1]"
    step = f"CASE WHEN {last}.dmax >= {new}.dmin THEN list_concat(acc[1:len(acc) - 1], [{{'dmin': greatest({last}.dmin, {new}.dmin), 'dmax': least({last}.dmax, {new}.dmax)}}]) ELSE list_concat(acc, x) END"
    return f"""SELECT {by}, d.dmin AS dmin, d.dmax AS dmax FROM (
        SELECT {by}, unnest(list_reduce(list_transform(list_sort(list(DISTINCT {{'dmin': dmin, 'dmax': dmax}})), lambda s: [s]), lambda acc, x: {step})) AS d FROM {source} GROUP BY {by})"""


_EVENTS = """
ev AS (SELECT event_id AS seq, day(ts)::INT AS t, user_id || '-user' AS u, event_type, json_extract_string(props, '$.k') AS k FROM events),
ch AS (
    SELECT t, seq, 'insertVertex' AS op, 2 AS rank FROM ev WHERE event_type = 'signup'
    UNION ALL SELECT t, seq, 'changeAttr', 1 FROM ev WHERE event_type IN ('click', 'view')
    UNION ALL SELECT t, seq, 'insertAttr', 3 FROM ev WHERE event_type = 'purchase'
    UNION ALL SELECT t, seq, 'deleteAttr', 1 FROM ev WHERE event_type = 'error'
    UNION ALL SELECT t, seq, 'insertEdge', 3 FROM ev WHERE event_type = 'view'
    UNION ALL SELECT t, seq, 'deleteEdge', 0 FROM ev WHERE event_type = 'error'),
""" + f"""
ds AS (SELECT unnest(range({views.DAYS + 1}))::INT AS t),
items AS (SELECT unnest(range(100))::VARCHAR AS k),
born AS (SELECT u, t AS b, k FROM ev WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY u ORDER BY t, seq) = 1),
lasts AS (SELECT ds.t, ev.u, CASE WHEN event_type = 'error' THEN NULL ELSE ev.k END AS val FROM ds JOIN ev ON ev.t <= ds.t AND event_type IN ('click', 'view', 'error') JOIN born ON born.u = ev.u AND b < ev.t QUALIFY row_number() OVER (PARTITION BY ds.t, ev.u ORDER BY ev.t DESC, ev.seq DESC) = 1),
firsts AS (SELECT ev.u, ev.t, ev.k FROM ev JOIN born ON born.u = ev.u AND b <= ev.t WHERE event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY ev.u ORDER BY ev.t, ev.seq) = 1),
ee AS (SELECT ev.t, ev.u, ev.k, seq, CASE WHEN event_type = 'view' THEN 3 ELSE 0 END AS rank FROM ev JOIN born ON born.u = ev.u AND b <= ev.t WHERE event_type = 'view' UNION ALL SELECT t, u, k, seq, 0 FROM ev WHERE event_type = 'error'),
el AS (SELECT ds.t, u, k, rank FROM ds JOIN ee ON ee.t <= ds.t QUALIFY row_number() OVER (PARTITION BY ds.t, u, k ORDER BY ee.t DESC, rank DESC, seq DESC) = 1)"""

_STEPS = """
st AS (SELECT t, src AS here, label, 0 AS dir, dst AS next FROM e UNION ALL SELECT t, dst, label, 1, src FROM e),
h1 AS (SELECT a.t, a.uri AS center, next AS uri, b.vtype, 1 AS hop, here AS prev, label, dir FROM vs a JOIN st ON st.t = a.t AND here = a.uri JOIN vs b ON b.t = a.t AND b.uri = next WHERE a.vtype = '{0}' QUALIFY row_number() OVER (PARTITION BY a.t, a.uri, next ORDER BY dir, here, label) = 1),
h2 AS (SELECT * FROM h1 UNION ALL (SELECT h.t, h.center, next, b.vtype, 2, here, st.label, st.dir FROM h1 h JOIN st ON st.t = h.t AND here = h.uri JOIN vs b ON b.t = h.t AND b.uri = next
    WHERE next <> h.center AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.t = h.t AND x.center = h.center AND x.uri = next) QUALIFY row_number() OVER (PARTITION BY h.t, h.center, next ORDER BY st.dir, here, st.label) = 1))"""


def _numerators(counts: str, by: str) -> str:
    """From (by, entity, t, n): the numerator of the support."""
    return f"SELECT {by}, sum(p * (p - 1) // 2 + w)::BIGINT AS numerator FROM (SELECT {by}, entity, count(*) FILTER (n > 0) AS p, count(*) FILTER (n > 1) AS w FROM ({counts}) GROUP BY ALL) GROUP BY {by}"


def _support(numerator: str = "numerator", centers: str = "centers") -> str:
    return f"CASE WHEN {centers} <= 0 OR {numerator} > {centers} * {PAIRS_OF_T} THEN 0.0 ELSE {numerator}::DOUBLE / ({centers} * {PAIRS_OF_T})::DOUBLE END"


def _dependency_sql(p: Pattern) -> str:
    lists = [[f"{v}__{a}" for a in ACTIVE[v]] for v in p.vertices]
    rows = [(c, r) for c in product(*lists) for r in c]
    return "VALUES " + ", ".join(f"('{','.join(sorted(x for x in c if x != r))}', '{r}')" for c, r in rows)


_SUPPORT_COUNTS = " UNION ALL ".join(f"SELECT {k} AS pattern_id, center_uri AS entity, t, sum(n) AS n FROM ({_matches(p)}) GROUP BY ALL" for k, p in enumerate((SINGLE, PATH, FORK)))
_CENTERS = "SELECT * FROM (VALUES (0, 'customer'), (1, 'nation'), (2, 'nation')) x(pattern_id, vtype) JOIN vt USING (vtype)"


def _view(sql: str) -> str:
    return f"WITH {_VIEW} {sql}"


ORACLE_SQL: dict[str, str] = {
    "hist_vertex_types": _view("SELECT vtype, n FROM vt"),
    "hist_type_attrs": _view("SELECT vtype, attr FROM ta"),
    "hist_attr_spread": _view("SELECT attr, n FROM spread"),
    "hist_edge_types": _view("SELECT src_type, label, dst_type, n FROM et"),
    "hist_all_snapshots": _view("SELECT src_type, label, dst_type, count(*) AS n FROM te GROUP BY ALL"),
    "topk_attrs": _view("SELECT attr, n FROM top_attr"),
    "active_attrs": _view("SELECT vtype, attr FROM act"),
    "topk_edges": _view("SELECT src_type, label, dst_type, n, rank FROM top_edge"),
    "frequent_vertex_types": _view("SELECT vtype, n, row_number() OVER (ORDER BY n DESC, vtype)::INT AS rank FROM vt WHERE vtype IN (SELECT src_type FROM top_edge UNION SELECT dst_type FROM top_edge)"),
    "clean_edges": _view("SELECT src_type, label, dst_type, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rank) AS k FROM top_edge) WHERE k = 1 AND src_type <> dst_type AND src_type IN (SELECT vtype FROM act) AND dst_type IN (SELECT vtype FROM act)"),
    "typed_edges": _view("SELECT t, src, label, dst, src_type, dst_type FROM te"),
    "presence": _view("SELECT vtype, uri, t, count(*) AS n FROM v GROUP BY ALL"),
    "seed_support": _view(f"SELECT vtype, numerator, centers, {_support()} AS support FROM ({_numerators('SELECT vtype, uri AS entity, t, count(*) AS n FROM v GROUP BY ALL', 'vtype')}) JOIN (SELECT vtype, n AS centers FROM vt) USING (vtype)"),
    "khop_1": _view("," + _STEPS.format("nation") + " SELECT * FROM h1"),
    "khop_2": _view("," + _STEPS.format("region") + " SELECT * FROM h2"),
    "khop_edges": _view("SELECT t, dst AS center, src, dst, label FROM e WHERE label = 'in_region'"),
    "neighbour_type_coverage": _view("SELECT DISTINCT n.t, n.uri AS center FROM n SEMI JOIN c ON c.t = n.t AND c.nation_uri = n.uri SEMI JOIN s ON s.t = n.t AND s.nation_uri = n.uri"),
    "match_single_edge": _view(_distinct(SINGLE)),
    "match_star": _view(_distinct(STAR)),
    "match_path": _view(_matches(PATH)),
    "match_tree": _view(_distinct(TREE)),
    "match_signature": _view(_matches(FORK)),
    "match_induced": _view("SELECT x.t, x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.t = x.t AND y.src = x.dst AND y.label = 'in_region' JOIN v a ON a.t = x.t AND a.uri = x.src AND a.vtype = 'customer' WHERE NOT EXISTS (SELECT 1 FROM e z WHERE z.t = x.t AND ((z.src, z.dst) IN ((x.dst, x.src), (y.dst, y.src), (x.src, y.dst), (y.dst, x.src))))"),
    "pattern_entity_counts": _view(f"SELECT center_uri, t, sum(n)::BIGINT AS n FROM ({_matches(PATH)}) GROUP BY ALL"),
    "pattern_support": _view(f"SELECT pattern_id, coalesce(numerator, 0) AS numerator, centers, {_support('coalesce(numerator, 0)')} AS support FROM (SELECT pattern_id, n AS centers FROM ({_CENTERS})) LEFT JOIN ({_numerators(_SUPPORT_COUNTS, 'pattern_id')}) USING (pattern_id)"),
    "entity_groups": f"WITH {_RULES} SELECT * FROM g",
    "entity_count": f"WITH {_RULES} SELECT * FROM ents",
    "rhs_rank": f"WITH {_RULES} SELECT dep, x, y, sum(n)::BIGINT AS n, row_number() OVER (PARTITION BY dep, x ORDER BY sum(n) DESC, y)::INT AS rank FROM g GROUP BY dep, x, y",
    "delta_minmax": f"WITH {_RULES} SELECT dep, x, y, dmin, dmax FROM iv",
    "pair_count": f"WITH {_RULES} SELECT dep, x, y, pairs FROM al",
    "rule_support": f"WITH {_RULES} SELECT dep, x, y, entities, support FROM al",
    "constant_candidates": f"WITH {_RULES} SELECT * FROM cand",
    "constant_rules": f"WITH {_RULES} SELECT * FROM kept",
    "conflict_pairs": f"WITH {_RULES} SELECT a.dep, a.x, a.y AS y1, b.y AS y2 FROM cand a JOIN cand b ON a.dep = b.dep AND a.x = b.x AND a.y < b.y AND a.dmax >= b.dmin AND a.dmin <= b.dmax",
    "conflict_removed": f"WITH {_RULES} SELECT dep, x, y, dmin, dmax FROM cand EXCEPT ALL SELECT dep, x, y, dmin, dmax FROM kept",
    "delta_merge": f"WITH {_RULES} {_fold('dep, y')}",
    "general_rules": f"WITH {_RULES} {_fold('dep')}",
    "dependency_enumeration": f"SELECT * FROM ({_dependency_sql(PATH)}) x(lhs, rhs)",
    "dependency_superset_prune": f"SELECT * FROM ({_dependency_sql(STAR)}) x(lhs, rhs) WHERE NOT (rhs = 'region__name' AND list_has_all(string_split(lhs, ','), ['customer__seg', 'nation__name'])) AND NOT (rhs = 'region__code' AND list_has_all(string_split(lhs, ','), ['nation__code']))",
    "change_order": f"WITH {_EVENTS} SELECT t, seq, op, rank, row_number() OVER (PARTITION BY t ORDER BY rank, seq)::INT AS pos FROM ch",
    "snapshot_vertices": f"WITH {_EVENTS} SELECT ds.t, u AS uri, 'user' AS vtype FROM ds JOIN born ON b <= ds.t UNION ALL SELECT t, k || '-item', 'item' FROM ds, items",
    "snapshot_edges": f"WITH {_EVENTS} SELECT t, u AS src, k || '-item' AS dst, 'viewed' AS label FROM el WHERE rank = 3",
    "snapshot_attrs": f"""WITH {_EVENTS} SELECT ds.t, u AS uri, 'start' AS attr, k AS val FROM ds JOIN born ON b <= ds.t
        UNION ALL SELECT t, k || '-item', 'name', k FROM ds, items
        UNION ALL SELECT t, u, 'last', val FROM lasts WHERE val IS NOT NULL
        UNION ALL SELECT ds.t, u, 'first', k FROM ds JOIN firsts ON firsts.t <= ds.t""",
    "graph_upsert_merge": _view("""SELECT uri, vtype, attr, val FROM (
        SELECT uri, 'customer' AS vtype, unnest(['seg', 'tier']) AS attr, unnest([customer__seg, CASE WHEN uri IN (SELECT uri FROM c WHERE t = 1) THEN 'again' ELSE customer__tier END]) AS val FROM c WHERE t = 0
        UNION ALL SELECT uri, 'customer', 'tier', 'again' FROM c WHERE t = 1 AND uri NOT IN (SELECT uri FROM c WHERE t = 0)
        UNION ALL SELECT uri, 'nation', unnest(['name', 'code', 'tier']), unnest([nation__name, nation__code, 'again']) FROM n WHERE t = 0
        UNION ALL SELECT uri, 'region', unnest(['name', 'code', 'tier']), unnest([region__name, region__code, 'again']) FROM r WHERE t = 0
        UNION ALL SELECT uri, 'supplier', unnest(['tier', 'digit']), unnest(['again', supplier__digit]) FROM s WHERE t = 0
        UNION ALL SELECT uri, 'part', unnest(['brand', 'ptype', 'tier']), unnest([part__brand, part__ptype, 'again']) FROM p WHERE t = 0)"""),
    "graph_upsert_edges": _view("SELECT DISTINCT src, dst, label FROM e WHERE t IN (0, 1)"),
    "rule_overlap": f"WITH {_RULES}, a AS (SELECT DISTINCT x, y, dmin, dmax FROM cand), b AS (SELECT DISTINCT x, y, dmin, dmax FROM kept) SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS n_both, (SELECT count(*) FROM (FROM a EXCEPT FROM b)) AS n_left_only, (SELECT count(*) FROM (FROM b EXCEPT FROM a)) AS n_right_only",
    "rule_diff": f"WITH {_RULES} SELECT x, y, dmin, dmax FROM cand EXCEPT SELECT x, y, dmin, dmax FROM kept",
    "result_lines": f"WITH {_RULES} SELECT x, y, dmin, dmax, support, 3 AS level FROM kept",
    "uri_parse": "SELECT p_partkey, 'part' AS vtype, lower(p_name) AS id, lower(p_name) || '-part' AS vertex_uri FROM part",
    "change_json_parse": f"""WITH {_EVENTS}, c AS (SELECT *, CASE event_type WHEN 'signup' THEN 'insertVertex' WHEN 'error' THEN 'deleteEdge' ELSE 'changeAttr' END AS op FROM ev)
        SELECT t, seq, seq::INT AS id, op, CASE WHEN op = 'deleteEdge' THEN u END AS src, CASE WHEN op = 'deleteEdge' THEN k || '-item' END AS dst, CASE WHEN op = 'deleteEdge' THEN 'viewed' END AS label,
               CASE WHEN op <> 'deleteEdge' THEN u END AS uri, CASE WHEN op = 'changeAttr' THEN 'last' END AS attr, CASE WHEN op = 'changeAttr' THEN k END AS val, CASE WHEN op = 'insertVertex' THEN 'user' END AS vtype, CASE WHEN op = 'insertVertex' THEN k END AS start FROM c""",
}
