"""Registered queries over files that the engine writes and reads: graph files, change files, rule files; and over change logs in which
vertices go and change their type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.model import Graph
from kairograph.operators import rules, snapshots
from kairograph.operators.matching import compatible, concerns
from kairograph.queries import _EVENTS, _RULES, _candidates, _first, _fold
from kairograph.sources import changes, rdf, sinks, views
from kairograph.tables import fresh_path

# Names of the graph files that the queries write.
MOVIE, ONTOLOGY, RESOURCE = "http://imdb.org/", "http://dbpedia.org/ontology/", "http://dbpedia.org/resource/"
INT = "http://www.w3.org/2001/XMLSchema#int"
BAD_LINES = ('_:b1 <http://x/name> "blank" .', '<http://imdb.org/Supplier/1> <http://x/name> "unclosed .', "no triple at all")
BAD_TURTLE = ('res:Supplier_1 ont:part [ ont:name "x" ] .', "_:b2 a ont:Company .", "res:Supplier_2 ont:list ( 1 2 ) .")


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark: SparkSession, rows: list[DataFrame], label: str) -> str:
    """The text file of some one-column tables."""
    out = rows[0].toDF("value")
    for r in rows[1:]:
        out = out.union(r.toDF("value"))
    path = fresh_path(spark, label)
    out.write.text(path)
    return path


def _named(c: str) -> Column:
    """A name inside a movie resource: blanks are percent signs and figures there."""
    return F.replace(F.col(c), F.lit(" "), F.lit("%20"))


def ntriples_file(spark: SparkSession, d: str, even: bool = False) -> str:
    """Suppliers, nations and regions as N-Triples; with ``even`` only suppliers of even keys."""
    nation, region = _table(spark, d, "nation"), _table(spark, d, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = _table(spark, d, "supplier").where("s_suppkey % 2 = 0" if even else "true").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    s, n = F.concat(F.lit(f"<{MOVIE}Supplier/"), F.col("s_suppkey").cast("string"), F.lit(">")), F.concat(F.lit(f"<{MOVIE}Nation/"), _named("n_name"), F.lit(">"))
    fact = lambda subject, name, o: F.concat(subject, F.lit(f" <http://x/{name}> "), o, F.lit(" ."))
    text = lambda c, tail="": F.concat(F.lit('"'), c, F.lit(f'"{tail}'))
    return _lines(
        spark,
        [
            supplier.select(fact(s, "Name", text(F.concat(F.col("s_name"), F.lit('\\\\n\\t\\u00e9\\"')), "@en"))),
            supplier.select(fact(s, "Based_In", n)),
            places.select(fact(n, "Code", text(F.col("n_nationkey").cast("string"), f"^^<{INT}>"))),
            places.select(fact(n, "In_Region", F.concat(F.lit(f"<{MOVIE}Region/"), _named("r_name"), F.lit(">")))),
            spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("# a comment", "", *BAD_LINES)]))),
        ],
        "ntriples",
    )


def turtle_file(spark: SparkSession, d: str) -> str:
    """Suppliers, nations and regions as Turtle, each statement under its own prefixes, so that the file may be written in parts."""
    nation, region = _table(spark, d, "nation"), _table(spark, d, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = _table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    name = lambda c: F.concat(F.lit("res:"), F.replace(F.col(c), F.lit(" "), F.lit("_")))
    head = f"@prefix res: <{RESOURCE}> . @prefix ont: <{ONTOLOGY}> . "
    say = lambda *parts: F.concat(F.lit(head), *parts)
    key = F.concat(F.lit("res:Supplier_"), F.col("s_suppkey").cast("string"))
    return _lines(
        spark,
        [
            supplier.select(say(key, F.lit(" a ont:Company ; ont:label '"), F.col("s_name"), F.lit("\\\\u0041\\''@en ; ont:nation "), name("n_name"), F.lit(" , "), key, F.lit(" , res:Unknown ; ont:rank "), (F.col("s_suppkey") % 10).cast("string"), F.lit(" ."))),
            places.select(say(name("n_name"), F.lit(" a ont:Country ; ont:region "), name("r_name"), F.lit(" ."))),
            region.select(say(name("r_name"), F.lit(' a ont:Region ; ont:label """'), F.col("r_name"), F.lit('"""@en .'))),
            spark.range(1).select(F.explode(F.array(*[F.lit(head + x) for x in BAD_TURTLE]))),
        ],
        "turtle",
    )


def _movies(spark: SparkSession, d: str) -> Graph:
    return rdf.load_snapshots(spark, [ntriples_file(spark, d), ntriples_file(spark, d, even=True)])


def _encyclopedia(spark: SparkSession, d: str) -> Graph:
    return rdf.encyclopedia_graph(rdf.read_turtle(spark, turtle_file(spark, d)), types=["company", "country"])


def _pairs(g: Graph) -> DataFrame:
    return g.vertices.select("t", "uri", F.explode("attrs").alias("attr", "val"))


def rdf_skipped(spark: SparkSession, d: str) -> DataFrame:
    """What both readers skip, counted."""
    lines = rdf.skipped_ntriples(spark, ntriples_file(spark, d)).unionByName(rdf.skipped_turtle(spark, turtle_file(spark, d)))
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def _each_event(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events").select("event_id", (F.floor((F.dayofmonth("ts") - 1) / 10) + 1).cast("int").alias("t"), F.concat(F.col("user_id").cast("string"), F.lit("-user")).alias("u"), "event_type", F.get_json_object("props", "$.k").alias("k"))
    pair = lambda name: F.struct(F.lit(name).alias("attrName"), F.col("k").alias("attrValue"))
    kind = lambda *types: F.struct(F.col("u").alias("vertexURI"), F.array(*[F.lit(x) for x in types]).alias("types"), F.array(pair("start"), F.struct(F.lit("start").alias("attrName"), F.lit("~").alias("attrValue"))).alias("allAttributesList"))
    op = F.when(F.col("event_type") == "signup", "insertVertex").when(F.col("event_type") == "error", "deleteVertex").when(F.col("event_type") == "purchase", "changeType").when(F.col("event_type") == "view", "insertEdge").otherwise("changeAttr")
    on = lambda name, c: F.when(op == name, c)
    vertex = F.when(op.isin("insertVertex", "deleteVertex"), kind("user", "agent"))
    body = F.struct(op.alias("typeOfChange"), F.col("event_id").cast("int").alias("id"), on("insertEdge", F.col("u")).alias("src"), on("insertEdge", F.concat("k", F.lit("-item"))).alias("dst"), on("insertEdge", F.lit("viewed")).alias("label"), on("changeAttr", F.col("u")).alias("uri"), on("changeAttr", pair("last")).alias("attribute"), vertex.alias("vertex"), on("changeType", kind("user")).alias("previousVertex"), on("changeType", kind("buyer", "user")).alias("newVertex"))
    return e.select("t", "event_id", F.to_json(body).alias("j"))


def change_files(spark: SparkSession, d: str) -> DataFrame:
    """The events of three stretches of ten days as change files, read back with all kinds of changes."""
    folder, rows = fresh_path(spark, "changes"), _each_event(spark, d)
    for t in (1, 2, 3):  # a file is one array, so one task writes it
        whole = rows.where(F.col("t") == t).agg(F.array_sort(F.collect_list(F.struct("event_id", "j"))).alias("e"))
        whole.select(F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["j"]), ","), F.lit("]"))).write.text(f"{folder}/{changes.FILE.format(t - 1, t)}")
    out = changes.read_changes(spark, folder, 4)
    return out.select("t", "seq", "id", "op", "src", "dst", "label", "uri", "attr", "val", "vtype", "new_vtype", F.try_element_at("attrs", F.lit("start")).alias("start"))


def _lives(spark: SparkSession, d: str) -> Graph:
    return snapshots.build_snapshots(views.items(spark), views.lives(spark, d), views.DAYS + 1)


def _variables(df: DataFrame) -> DataFrame:
    """Sides of general rules as text."""
    show = lambda s: F.concat(s["vtype"], F.lit("."), s["attr"])
    return df.withColumns({"x": F.array_join(F.transform("x", show), "|"), "y": show(F.col("y"))})


def _general(found: DataFrame, pattern: str) -> DataFrame:
    return rules.general_rules(found).select(F.lit(pattern).alias("pattern_id"), F.lit(3).alias("level"), "dep", "dmin", "dmax")


def _two_runs(spark: SparkSession, d: str) -> DataFrame:
    """General rules as two patterns would give them: of all candidates, and of those with a gap of two or more."""
    found = _candidates(spark, d)
    return _general(found, "p").unionByName(_general(found.where("dmin > 1"), "q"))


def rule_files(spark: SparkSession, d: str) -> DataFrame:
    """Constant and general rules written as lines, and read back."""
    folder = fresh_path(spark, "rules")
    found = _candidates(spark, d)
    sinks.write_rules(rules.without_conflicts(found).withColumn("level", F.lit(3)), folder, "constant")
    sinks.write_rules(rules.with_variables(_general(found, "p")), folder, "general")
    constant = rules.flat(sinks.read_rules(spark, folder, "constant")).withColumn("kind", F.lit("constant"))
    general = _variables(sinks.read_rules(spark, folder, "general")).withColumn("kind", F.lit("general"))
    return constant.unionByName(general).select("kind", "x", "y", "dmin", "dmax", "support", "level")


def extract_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """The vertices at the ends of the edges of suppliers."""
    g = _first(spark, d)
    return snapshots.extract(g, g.edges.where("label = 'based_in'")).vertices.select("t", "uri", "vtype")


def vertex_compatibility(spark: SparkSession, d: str) -> DataFrame:
    """Vertices of the first year that fit a pattern vertex: the same type, and just these attributes, if any are named."""
    v, out = _first(spark, d).vertices, None
    for k, (vtype, attrs) in enumerate((("customer", ["tier", "seg"]), ("nation", ["name"]), ("supplier", []))):
        part = v.where(compatible(F.col("vtype"), F.col("attrs"), vtype, attrs)).select(F.lit(k).alias("wanted"), "uri")
        out = part if out is None else out.unionByName(part)
    return out


URIS = ["1-user", "2-user", "7-item"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ntriples_scan": lambda s, d: rdf.read_ntriples(s, ntriples_file(s, d)),
    "turtle_scan": lambda s, d: rdf.read_turtle(s, turtle_file(s, d)),
    "rdf_skipped": rdf_skipped,
    "movie_vertices": lambda s, d: _movies(s, d).vertices.select("t", "uri", "vtype"),
    "movie_attributes": lambda s, d: _pairs(_movies(s, d)),
    "movie_edges": lambda s, d: _movies(s, d).edges.select("t", "src", "dst", "label"),
    "encyclopedia_vertices": lambda s, d: _encyclopedia(s, d).vertices.select("uri", "vtype"),
    "encyclopedia_attributes": lambda s, d: _pairs(_encyclopedia(s, d)).drop("t"),
    "encyclopedia_edges": lambda s, d: _encyclopedia(s, d).edges.select("src", "dst", "label"),
    "split_graph": lambda s, d: rdf.fragments(s, [ntriples_file(s, d), ntriples_file(s, d, even=True)]),
    "change_files": change_files,
    "life_vertices": lambda s, d: snapshots.vertex_snapshots(views.items(s).vertices.select("uri", "vtype", "attrs"), views.lives(s, d), views.DAYS + 1).select("t", "uri", "vtype"),
    "life_edges": lambda s, d: _lives(s, d).edges.select("t", "src", "dst", "label"),
    "concerned_changes": lambda s, d: views.user_changes(s, d).where(concerns(URIS, F.col("uri"), F.col("src"), F.col("dst"))).select("t", "seq", "op"),
    "rule_files": rule_files,
    "general_rule_sides": lambda s, d: _variables(rules.with_variables(_general(_candidates(s, d), "p"))).select("level", "dep", "x", "y", "dmin", "dmax", "support"),
    "general_finalised": lambda s, d: rules.finalise_general(_two_runs(s, d)),
    "extract_subgraph": extract_subgraph,
    "vertex_compatibility": vertex_compatibility,
}

_ITEMS = "SELECT t, k || '-item' AS uri, 'item' AS vtype FROM ds, items"
_LIVES = f"""{_EVENTS},
lv AS (
    SELECT t, seq, u, 2 AS rank, 'in' AS what FROM ev WHERE event_type IN ('signup', 'click')
    UNION ALL SELECT t, seq, u, 1, 'out' FROM ev WHERE event_type = 'error'
    UNION ALL SELECT t, seq, u, 1, 'type' FROM ev WHERE event_type = 'purchase'),
lo AS (SELECT *, coalesce(sum(CASE WHEN what = 'out' THEN 1 END) OVER (PARTITION BY u ORDER BY t, rank, seq), 0) AS life FROM lv),
lb AS (SELECT *, max(CASE WHEN what = 'in' THEN 1 ELSE 0 END) OVER (PARTITION BY u, life ORDER BY t, rank, seq) AS born FROM lo),
ld AS (SELECT ds.t, lb.u, arg_max(life, (lb.t, rank, seq)) AS life, arg_max(born, (lb.t, rank, seq)) AS alive FROM ds JOIN lb ON lb.t <= ds.t GROUP BY ds.t, lb.u),
av AS (SELECT ld.t, ld.u, CASE WHEN EXISTS (SELECT 1 FROM lb WHERE lb.u = ld.u AND lb.life = ld.life AND lb.t <= ld.t AND lb.born = 1 AND what = 'type') THEN 'buyer' ELSE 'user' END AS vtype FROM ld WHERE alive = 1)"""

_S, _N = f"'{MOVIE}Supplier/' || s_suppkey", f"'{MOVIE}Nation/' || replace(n_name, ' ', '%20')"
_BASE = "supplier JOIN nation ON s_nationkey = n_nationkey"
_NR = "nation JOIN region ON n_regionkey = r_regionkey"
_MOVIE_ROWS = f"""
snaps AS (SELECT 0 AS t, 1 AS step UNION ALL SELECT 1, 2),
sn AS (SELECT t, s_suppkey, s_name, n_name FROM snaps JOIN (SELECT * FROM {_BASE}) ON s_suppkey % step = 0)"""
_FLAT_SIDE = "array_to_string(list_transform(string_split(split_part(dep, '->', 1), ','), lambda c: replace(c, '__', '.')), '|')"
#: What follows a name in the graph files, as it is read.
_TAIL, _QUOTED = "chr(92) || 'n' || chr(9) || 'é\"'", "chr(92) || 'u0041' || chr(39)"


def _res(c: str) -> str:
    return f"'{RESOURCE}' || replace({c}, ' ', '_')"


def _bad(rows: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS value, 1 AS n" for r in rows)


ORACLE_SQL: dict[str, str] = {
    "ntriples_scan": f"""SELECT {_S} AS subject, 'http://x/Name' AS predicate, s_name || {_TAIL} AS object, true AS is_literal FROM {_BASE}
        UNION ALL SELECT {_S}, 'http://x/Based_In', {_N}, false FROM {_BASE}
        UNION ALL SELECT {_N}, 'http://x/Code', n_nationkey::VARCHAR, true FROM nation
        UNION ALL SELECT {_N}, 'http://x/In_Region', '{MOVIE}Region/' || replace(r_name, ' ', '%20'), false FROM {_NR}""",
    "turtle_scan": f"""
        WITH s AS (SELECT '{RESOURCE}Supplier_' || s_suppkey AS id, s_name, s_suppkey, n_name FROM {_BASE})
        SELECT id AS subject, '{rdf.RDF_TYPE}' AS predicate, '{ONTOLOGY}Company' AS object, false AS is_literal FROM s
        UNION ALL SELECT id, '{ONTOLOGY}label', s_name || {_QUOTED}, true FROM s
        UNION ALL SELECT id, '{ONTOLOGY}nation', unnest([{_res("n_name")}, id, '{RESOURCE}Unknown']), false FROM s
        UNION ALL SELECT id, '{ONTOLOGY}rank', (s_suppkey % 10)::VARCHAR, true FROM s
        UNION ALL SELECT {_res("n_name")}, '{rdf.RDF_TYPE}', '{ONTOLOGY}Country', false FROM nation
        UNION ALL SELECT {_res("n_name")}, '{ONTOLOGY}region', {_res("r_name")}, false FROM {_NR}
        UNION ALL SELECT {_res("r_name")}, '{rdf.RDF_TYPE}', '{ONTOLOGY}Region', false FROM region
        UNION ALL SELECT {_res("r_name")}, '{ONTOLOGY}label', r_name, true FROM region""",
    "rdf_skipped": f"{_bad(BAD_LINES)} UNION ALL {_bad(tuple(x.removesuffix(' .') for x in BAD_TURTLE))}",
    "movie_vertices": f"""WITH {_MOVIE_ROWS} SELECT t, s_suppkey || '-supplier' AS uri, 'supplier' AS vtype FROM sn
        UNION ALL SELECT t, lower(n_name) || '-nation', 'nation' FROM nation, snaps UNION ALL SELECT t, lower(r_name) || '-region', 'region' FROM region, snaps""",
    "movie_attributes": f"""WITH {_MOVIE_ROWS} SELECT t, s_suppkey || '-supplier' AS uri, 'name' AS attr, lower(s_name) || {_TAIL} AS val FROM sn
        UNION ALL SELECT t, lower(n_name) || '-nation', 'code', n_nationkey::VARCHAR FROM nation, snaps""",
    "movie_edges": f"""WITH {_MOVIE_ROWS} SELECT t, s_suppkey || '-supplier' AS src, lower(n_name) || '-nation' AS dst, 'based_in' AS label FROM sn
        UNION ALL SELECT t, lower(n_name) || '-nation', lower(r_name) || '-region', 'in_region' FROM snaps, {_NR}""",
    "encyclopedia_vertices": "SELECT 'supplier_' || s_suppkey AS uri, 'company' AS vtype FROM supplier UNION ALL SELECT lower(replace(n_name, ' ', '_')), 'country' FROM nation",
    "encyclopedia_attributes": f"SELECT 'supplier_' || s_suppkey AS uri, unnest(['label', 'rank']) AS attr, unnest([lower(s_name) || {_QUOTED}, (s_suppkey % 10)::VARCHAR]) AS val FROM supplier",
    "encyclopedia_edges": f"SELECT 'supplier_' || s_suppkey AS src, lower(replace(n_name, ' ', '_')) AS dst, 'nation' AS label FROM {_BASE}",
    "split_graph": "SELECT s_suppkey || '-supplier' AS uri, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS fragment FROM supplier UNION ALL SELECT lower(n_name) || '-nation', 1 FROM nation",
    "change_files": f"""WITH {_EVENTS}, e3 AS (SELECT seq AS event_id, (t - 1) // 10 + 1 AS t, u, event_type, k FROM ev WHERE (t - 1) // 10 < 3),
        c AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY event_id) - 1 AS seq, CASE event_type WHEN 'signup' THEN 'insertVertex' WHEN 'error' THEN 'deleteVertex' WHEN 'purchase' THEN 'changeType' WHEN 'view' THEN 'insertEdge' ELSE 'changeAttr' END AS op FROM e3)
        SELECT t::INT AS t, seq, event_id::INT AS id, op, CASE WHEN op = 'insertEdge' THEN u END AS src, CASE WHEN op = 'insertEdge' THEN k || '-item' END AS dst, CASE WHEN op = 'insertEdge' THEN 'viewed' END AS label,
               CASE WHEN op <> 'insertEdge' THEN u END AS uri, CASE WHEN op = 'changeAttr' THEN 'last' END AS attr, CASE WHEN op = 'changeAttr' THEN k END AS val, CASE WHEN op IN ('insertVertex', 'deleteVertex', 'changeType') THEN 'user' END AS vtype,
               CASE WHEN op = 'changeType' THEN 'buyer' END AS new_vtype, CASE WHEN op IN ('insertVertex', 'deleteVertex') THEN k END AS start FROM c""",
    "life_vertices": f"WITH {_LIVES} SELECT t, u AS uri, vtype FROM av UNION ALL {_ITEMS}",
    "life_edges": f"""WITH {_LIVES}, come AS (SELECT ev.t AS b, ev.u, ev.k FROM ev JOIN av ON av.t = ev.t AND av.u = ev.u WHERE event_type = 'view')
        SELECT DISTINCT ds.t, come.u AS src, k || '-item' AS dst, 'viewed' AS label FROM ds JOIN come ON b <= ds.t
        WHERE NOT EXISTS (SELECT 1 FROM lv WHERE lv.u = come.u AND what = 'out' AND lv.t > b AND lv.t <= ds.t)""",
    "concerned_changes": f"WITH {_EVENTS} SELECT ch.t, ch.seq, op FROM ch JOIN ev USING (seq) WHERE u IN ('1-user', '2-user') OR k = '7' AND op IN ('insertEdge', 'deleteEdge')",
    "rule_files": f"WITH {_RULES}, folded AS ({_fold('dep')}) SELECT 'constant' AS kind, x, y, dmin, dmax, support, 3 AS level FROM kept UNION ALL SELECT 'general', {_FLAT_SIDE}, replace(split_part(dep, '->', 2), '__', '.'), dmin, dmax, 0.0, 3 FROM folded",
    "general_rule_sides": f"WITH {_RULES}, folded AS ({_fold('dep')}) SELECT 3 AS level, dep, {_FLAT_SIDE} AS x, replace(split_part(dep, '->', 2), '__', '.') AS y, dmin, dmax, 0.0::DOUBLE AS support FROM folded",
    "general_finalised": f"WITH {_RULES}, wide AS (SELECT * FROM cand WHERE dmin > 1), both_runs AS ({_fold('dep')} UNION {_fold('dep', 'wide')}) SELECT dep, 3 AS level, dmin, dmax FROM ({_fold('dep', 'both_runs')})",
    "extract_subgraph": "SELECT 0 AS t, s_suppkey || '-supplier' AS uri, 'supplier' AS vtype FROM supplier UNION SELECT 0, s_nationkey || '-nation', 'nation' FROM supplier",
    "vertex_compatibility": f"SELECT DISTINCT 0 AS wanted, o_custkey || '-customer' AS uri FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) = {views.FIRST_YEAR} UNION ALL SELECT 2, s_suppkey || '-supplier' FROM supplier",
}
