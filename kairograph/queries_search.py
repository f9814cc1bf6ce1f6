"""Registered queries of the search: growth of patterns, the whole miner, and what becomes of the rules of several runs. The SQL of the miner
searches itself: it knows all trees of edge types, and finds which are made, barred and pruned."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations, product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.config import MinerConfig
from kairograph.functions import choose
from kairograph.model import Dependency, Edge, Graph, Pattern, split_column
from kairograph.operators import neighbourhood, rules, snapshots, support
from kairograph.operators.matching import distinct_matches, match
from kairograph.plans import lattice
from kairograph.plans.miner import mine, numerators
from kairograph.queries import ACTIVE, BASED_IN, BOUGHT, DEPENDENCIES, IN_NATION, IN_REGION, PAIRS_OF_T, PATH, SINGLE, SUPPLIES, THETA, TREE, T, _candidates, _first, _g, _group, _groups, _numerators, _rule_steps, _RULES, _support, _SUPPORT_COUNTS, _CENTERS, _VIEW, _distinct, _view, pattern_support_query
from kairograph.sources.views import commerce
from kairograph.tables import cut, release

#: Edge types and vertex types of the commerce graph by how often its first year has them.
EDGES = [BOUGHT, SUPPLIES, IN_NATION, BASED_IN, IN_REGION]
TYPES = ["part", "customer", "supplier", "nation", "region"]
#: The five attributes that most types carry: of seven names code, name and tier are on two types, and brand and digit come first of the others.
MINER = MinerConfig(timestamps=T, k=3, gamma=5, n_edges=10, theta_pattern=1e-6, theta_rule=THETA)
MINED = {"customer": ["tier"], "nation": ["code", "name"], "region": ["code", "name"], "supplier": ["digit", "tier"], "part": ["brand"]}


def flagship_miner(spark: SparkSession, d: str) -> DataFrame:
    """All constant rules of patterns up to three edges over the whole commerce graph."""
    return rules.flat(mine(commerce(spark, d, numbers=True), MINER).constant).select("pattern_id", "level", "dep", "x", "y", "dmin", "dmax", "pairs", "entities", "support")


def lattice_patterns(spark: SparkSession, d: str) -> DataFrame:
    """All patterns of up to three edges, as they grow without pruning, with their shapes and how many of the level before they hold."""
    level, rows = lattice.seeds(TYPES), []
    for _ in range(3):
        level = lattice.grow(level, EDGES)
        rows += [(n.level, n.pattern.name, n.pattern.shape.value, len(n.parents)) for n in level]
    return spark.createDataFrame(rows, "level int, pattern string, shape string, parents int")


def _known_edges() -> list[Edge]:
    return [*EDGES, Edge("customer", "IN_NATION", "nation"), Edge("nation", "in_nation", "customer"), Edge("nation", "borders", "nation")]


def redundant_edges(spark: SparkSession, d: str) -> DataFrame:
    """Which edges some patterns hold already."""
    rows = [(p.name, e.src, e.label, e.dst, lattice.has_edge(p, e)) for p in (SINGLE, PATH, TREE) for e in _known_edges()]
    return spark.createDataFrame(rows, "pattern string, src string, label string, dst string, held boolean")


def covering_paths(spark: SparkSession, d: str) -> DataFrame:
    """Whether the attributes of a dependency touch every vertex type of a pattern."""
    rows = [(p.name, x.name, lattice.covers_types([split_column(c) for c in (*x.lhs, x.rhs)], p)) for p in (SINGLE, PATH, TREE) for x in DEPENDENCIES]
    return spark.createDataFrame(rows, "pattern string, dep string, covers boolean")


def total_support(spark: SparkSession, d: str) -> DataFrame:
    nodes = lattice.seeds(["a", "b", "c"])
    for node, r in zip(nodes, pattern_support_query(spark, d).orderBy("pattern_id").collect(), strict=True):
        node.support = r["support"]
    return spark.createDataFrame([(round(lattice.total_support(nodes), 12),)], "total double")


def _level_support(spark: SparkSession, d: str) -> DataFrame:
    """Supports of the patterns of three edges from their counts alone."""
    g, trees, held = commerce(spark, d, numbers=True), [p for p in _trees() if len(p.edges) == 3], {}
    g = Graph(cut(g.vertices, "vertices"), cut(g.edges, "edges", "zstd"))
    start = g.vertices.where("t = 0").groupBy("vtype").agg(F.count_distinct("uri").alias("centers"))
    sizes = {r["vtype"]: r["centers"] for r in start.collect()}
    found = {r["pattern_id"]: r["numerator"] for r in numerators(g, trees, MINED, held).collect()}
    release(g.vertices, g.edges, *held.values())
    ids = spark.createDataFrame([(p.name, sizes[p.center]) for p in trees if p.center in sizes], "pattern_id string, centers long")
    return support.support_of(spark.createDataFrame([(trees[k].name, n) for k, n in found.items()], "pattern_id string, numerator long"), ids, T)


SMALL = Dependency(("nation__name",), "region__name")


def minimal_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules without those that one of fewer literals covers."""
    groups = rules.value_groups(distinct_matches(match(_g(spark, d), PATH, ACTIVE)), [SMALL, *DEPENDENCIES])
    return rules.flat(rules.minimal_rules(rules.candidates(groups, T, THETA))).select("dep", "x", "y", "dmin", "dmax")


def rules_union(spark: SparkSession, d: str) -> DataFrame:
    found = _candidates(spark, d)
    return rules.flat(rules.gather([found, rules.without_conflicts(found), found.where("dmin > 1")])).select("dep", "x", "y", "dmin", "dmax")


def gathered_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entities of two runs over different years, summed."""
    groups = _groups(spark, d)
    return rules.gather_counts([rules.entity_counts(groups.where("t < 3")), rules.entity_counts(groups.where("t >= 3"))])


def _two_runs(spark: SparkSession, d: str) -> DataFrame:
    """Rules as two runs would give them: the second has all intervals start at one."""
    found = _candidates(spark, d)
    return found.unionByName(found.withColumn("dmin", F.lit(1)))


def rules_by_right_value(spark: SparkSession, d: str) -> DataFrame:
    out = rules.by_right_value(_two_runs(spark, d))
    x = F.array_join(F.transform("key.x", lambda s: F.concat(s["vtype"], F.lit("."), s["attr"], F.lit("="), s["val"])), "|")
    return out.select(x.alias("x"), F.col("key.y").alias("y"), "val", "rules")


def finalised_constants(spark: SparkSession, d: str) -> DataFrame:
    return rules.flat(rules.finalise_constants(_two_runs(spark, d), T, THETA)).select("dep", "x", "y", "dmin", "dmax", "pairs", "entities", "support")


def rebound_vertices(spark: SparkSession, d: str) -> DataFrame:
    """The first year's vertices with the attributes that the second year's say, of those there in both."""
    g = _g(spark, d)
    later = g.at(1).vertices.where("vtype <> 'part'").select(F.lit(0).alias("t"), "uri", "vtype", F.create_map(F.lit("later"), F.col("vtype")).alias("attrs"))
    return snapshots.rebind(g.at(0), Graph(later, g.edges.where("false"))).vertices.select("uri", "vtype", F.explode("attrs").alias("attr", "val"))


def fragment_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The customers of the first year by fragment, of which the last digit of the key stands for."""
    g = _first(spark, d)
    parts = g.vertices.select("uri", (F.regexp_extract("uri", r"^(\d+)", 1).cast("int") % 10).alias("fragment"))
    return neighbourhood.fragment_jobs(g, parts, "customer")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lattice_patterns": lattice_patterns,
    "redundant_edges": redundant_edges,
    "covering_paths": covering_paths,
    "total_support": total_support,
    "level_support": _level_support,
    "n_choose_k": lambda s, d: s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("n"), choose(F.col("n_nationkey"), 3).alias("k3"), choose(F.col("n_nationkey"), 5).alias("k5")),
    "induced_hop": lambda s, d: neighbourhood.edges_within(_first(s, d), "nation", 1),
    "minimal_rules": minimal_rules,
    "rules_union": rules_union,
    "gathered_counts": gathered_counts,
    "rules_by_right_value": rules_by_right_value,
    "finalised_constants": finalised_constants,
    "rebound_vertices": rebound_vertices,
    "fragment_jobs": fragment_jobs,
    "flagship_miner": flagship_miner,
}

# ---------------------------------------------------------------------------------------------------------
# The same in SQL.


def _trees() -> list[Pattern]:
    """All trees of up to three edge types, centred on the first vertex of the largest degree in the order of ``TYPES``."""
    out = []
    for n in (1, 2, 3):
        for edges in combinations(EDGES, n):
            types = {v for e in edges for v in (e.src, e.dst)}
            if len(types) == n + 1 and _connected(edges):
                vertices = tuple(sorted(types))
                degree = {v: sum(v in (e.src, e.dst) for e in edges) for v in vertices}
                out.append(Pattern(vertices, edges, max(TYPES, key=lambda v: (degree.get(v, 0), -TYPES.index(v)))))
    return out


def _connected(edges: tuple[Edge, ...]) -> bool:
    seen, rest = {edges[0].src, edges[0].dst}, list(edges[1:])
    while rest:
        near = next((e for e in rest if e.src in seen or e.dst in seen), None)
        if near is None:
            return False
        rest.remove(near)
        seen |= {near.src, near.dst}
    return True


_ATTRIBUTES = {"customer": "c", "nation": "n", "region": "r", "supplier": "s", "part": "p"}


def _edge_tables() -> str:
    """The edges of each type with keys of both ends, which hold the snapshot too, and the mined attributes of both."""
    out = []
    for e in EDGES:
        ends = [(side, v, f"{v}__{a}") for side, v in (("src", e.src), ("dst", e.dst)) for a in MINED[v]]
        keyed = lambda v: f"(SELECT uri || '@' || t AS key, * EXCLUDE (t, uri) FROM {_ATTRIBUTES[v]})"
        out.append(f"k_{e.label} AS MATERIALIZED (SELECT t, src AS src_uri, dst AS dst_uri, src || '@' || t AS src, dst || '@' || t AS dst FROM e WHERE label = '{e.label}')")
        out.append(f"edges_of_{e.label} AS MATERIALIZED (SELECT x.*, {', '.join(f'{side}_end.{c}' for side, _, c in ends)} FROM k_{e.label} x JOIN {keyed(e.src)} src_end ON src_end.key = x.src JOIN {keyed(e.dst)} dst_end ON dst_end.key = x.dst)")
    return ", ".join(out)


def _joined(edges: tuple[Edge, ...]) -> tuple[str, dict[str, str]]:
    """FROM clause of the edge types joined on their common ends, and the column of each vertex type's key."""
    first, rest = edges[0], list(edges[1:])
    at = {first.src: "e0.src", first.dst: "e0.dst"}
    source, k = "edges_of_" + first.label + " e0", 0
    while rest:
        e = next(x for x in rest if x.src in at or x.dst in at)
        rest.remove(e)
        k += 1
        inside, outside = ("src", "dst") if e.src in at else ("dst", "src")
        source += f" JOIN edges_of_{e.label} e{k} ON e{k}.{inside} = {at[getattr(e, inside)]}"
        at[getattr(e, outside)] = f"e{k}.{outside}"
    return source, at


def _quoted(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def _labels(edges: tuple[Edge, ...]) -> str:
    return ",".join(sorted(e.label for e in edges))


def _flagship_sql() -> str:
    trees = _trees()
    by_key = {p.key: p for p in trees}
    # Ways in which a tree may be made: order, what it is made from, and the centre that it gets.
    rank = {(): 0}
    ways: dict[int, list[tuple[str, int, str, str]]] = {1: [], 2: [], 3: []}
    order: dict[int, list[str]] = {0: list(TYPES)}
    for n in (1, 2, 3):
        for p in [p for p in trees if len(p.edges) == n]:
            for i, e in enumerate(EDGES):
                if e not in p.edges:
                    continue
                if n == 1:
                    ways[n] += [(_labels(p.edges), order[0].index(v) * 10 + i, v, v) for v in (e.src, e.dst)]
                    continue
                small = by_key.get(frozenset(x for x in p.edges if x != e))
                if small is None:
                    continue
                degree = {v: p.degree(v) for v in p.vertices}
                # with more than two vertices the centre is the one of strictly largest degree, else it stays
                center = max(p.vertices, key=lambda v: degree[v]) if n == 2 else small.center if degree[small.center] == max(degree.values()) else max(p.vertices, key=lambda v: degree[v])
                ways[n].append((_labels(p.edges), order[n - 1].index(_labels(small.edges)) * 10 + i, _labels(small.edges), center))
        first = {}
        for name, at, _, _ in ways[n]:
            first[name] = min(first.get(name, at), at)
        order[n] = sorted(first, key=first.get)
    del rank
    # Supports of all (tree, centre) that may come about.
    supports = [f"SELECT vtype AS tree, vtype AS center, {_support()} AS support FROM ({_numerators('SELECT vtype, uri AS entity, t, count(*) AS n FROM v GROUP BY ALL', 'vtype')}) JOIN (SELECT vtype, n AS centers FROM vt) USING (vtype)"]
    for name, center in sorted({(w[0], w[3]) for n in ways for w in ways[n]}):
        p = next(p for p in trees if _labels(p.edges) == name)
        source, at = _joined(p.edges)
        enough = sum(len(MINED[v]) for v in p.vertices) > len(p.vertices)
        counts = f"SELECT ''{name}'' AS tree, {at[center]}_uri AS entity, e0.t, count(*) AS n FROM {source} WHERE {str(enough).lower()} GROUP BY ALL".replace("''", "'")
        centers = f"(SELECT n FROM vt WHERE vtype = '{center}')"
        supports.append(f"SELECT '{name}' AS tree, '{center}' AS center, {_support('coalesce(max(numerator), 0)', centers)} AS support FROM ({_numerators(counts, 'tree')})")
    steps = [_edge_tables()]
    steps.append(f"supports AS MATERIALIZED ({' UNION ALL '.join(supports)})")
    theta = MINER.theta_pattern
    steps.append(f"level0 AS MATERIALIZED (SELECT tree, center, []::VARCHAR[] AS labels, support >= {theta!r} AS alive FROM supports WHERE tree = center)")
    for n in (1, 2, 3):
        above = " UNION ALL ".join(f"SELECT * FROM level{k}" for k in range(n))
        steps.append(f"""made{n} AS (
            SELECT w.tree, w.center, string_split(w.tree, ',') AS labels, w.ord FROM {_quoted(ways[n])} w(tree, ord, small, center) JOIN level{n - 1} p ON p.tree = w.small AND p.alive
            WHERE NOT EXISTS (SELECT 1 FROM ({above}) q WHERE NOT q.alive AND q.center = w.center AND list_has_all(string_split(w.tree, ','), q.labels))
            QUALIFY row_number() OVER (PARTITION BY w.tree ORDER BY w.ord) = 1)""")
        steps.append(f"level{n} AS MATERIALIZED (SELECT tree, center, labels, support >= {theta!r} AS alive FROM made{n} JOIN supports USING (tree, center))")
    # Rules of all trees of two edges or more; those of trees that are not alive, and of dependencies that a smaller one covers, go at the end.
    groups, names = [], []
    for k, p in enumerate(trees):
        if len(p.edges) < 2:
            continue
        source, at = _joined(p.edges)
        cells = [f"{at[v].partition('.')[0]}.{v}__{a}" for v in p.vertices for a in MINED[v]]
        steps.append(f"dm{k} AS MATERIALIZED (SELECT DISTINCT e0.t, {', '.join(cells)} FROM {source})")
        names.append((_labels(p.edges), p.name, len(p.edges)))
        for chosen in product(*[[f"{v}__{a}" for a in MINED[v]] for v in p.vertices]):
            for rhs in chosen:
                x = Dependency(tuple(sorted(c for c in chosen if c != rhs)), rhs)
                groups.append(_group(x, f"dm{k}").replace("SELECT ", f"SELECT '{p.name}' AS pattern_id, {len(p.vertices)} AS level, ", 1))
    steps.append(_rule_steps(" UNION ALL ".join(groups), THETA, "pattern_id, level, dep").replace("AS (", "AS MATERIALIZED (", 1))
    steps.append(f"named AS (SELECT * FROM {_quoted(names)} x(tree, pattern_id, edges)), found AS (SELECT pattern_id, string_split(tree, ',') AS labels, edges FROM named WHERE tree IN (SELECT tree FROM level2 WHERE alive UNION ALL SELECT tree FROM level3 WHERE alive))")
    steps.append("minimal AS (SELECT DISTINCT labels, split_part(dep, '->', 2) AS rhs, string_split(split_part(dep, '->', 1), ',') AS lhs FROM cand JOIN found USING (pattern_id) WHERE edges = 2)")
    return f"""WITH {_VIEW}, {", ".join(steps)}
        SELECT pattern_id, level, dep, x, y, dmin, dmax, pairs, entities, support FROM kept JOIN found f USING (pattern_id)
        WHERE f.edges = 2 OR NOT EXISTS (SELECT 1 FROM minimal m WHERE list_has_all(f.labels, m.labels) AND m.rhs = split_part(dep, '->', 2) AND list_has_all(string_split(split_part(dep, '->', 1), ','), m.lhs))"""


_GROWN = f"""WITH RECURSIVE ed(src, label, dst) AS {_quoted([(e.src, e.label, e.dst) for e in EDGES])},
    grown AS (
        SELECT 1 AS level, [src || '-' || label || '->' || dst] AS edges, list_sort([src, dst]) AS types FROM ed
        UNION SELECT level + 1, list_sort(list_append(edges, src || '-' || label || '->' || dst)), list_sort(list_append(types, CASE WHEN list_contains(types, src) THEN dst ELSE src END))
        FROM grown, ed WHERE level < 3 AND list_contains(types, src) <> list_contains(types, dst)),
    degrees AS (SELECT edges, max(n) AS most FROM (SELECT edges, t, len(list_filter(edges, lambda x: starts_with(x, t || '-') OR ends_with(x, '>' || t))) AS n FROM (SELECT edges, unnest(types) AS t FROM grown)) GROUP BY edges)"""


def _level_support_sql() -> str:
    parts = []
    for p in _trees():
        if len(p.edges) == 3:
            source, at = _joined(p.edges)
            enough = sum(len(MINED[v]) for v in p.vertices) > len(p.vertices)
            parts.append(f"SELECT '{p.name}' AS pattern_id, {at[p.center]}_uri AS entity, e0.t, count(*) AS n FROM {source} WHERE {str(enough).lower()} GROUP BY ALL")
    centers = _quoted([(p.name, p.center) for p in _trees() if len(p.edges) == 3])
    return f"WITH {_VIEW}, {_edge_tables()} SELECT pattern_id, coalesce(numerator, 0) AS numerator, n AS centers, {_support('coalesce(numerator, 0)', 'n')} AS support FROM {centers} w(pattern_id, vtype) JOIN vt USING (vtype) LEFT JOIN ({_numerators(' UNION ALL '.join(parts), 'pattern_id')}) USING (pattern_id)"


_PATTERNS = [(p.name, ",".join(sorted(p.vertices))) for p in (SINGLE, PATH, TREE)]
_HELD = [(p.name, e.label, ",".join(sorted((e.src, e.dst)))) for p in (SINGLE, PATH, TREE) for e in p.edges]
_TWICE = "cand2 AS (SELECT dep, x, y, dmin, dmax, pairs, entities FROM cand UNION SELECT dep, x, y, 1, dmax, pairs, entities FROM cand)"
_SMALL_GROUPS = " UNION ALL ".join(_group(x, "dm") for x in (SMALL, *DEPENDENCIES))

ORACLE_SQL: dict[str, str] = {
    "lattice_patterns": f"""{_GROWN} SELECT level, array_to_string(edges, ';') AS pattern,
        CASE WHEN level = 1 THEN 'single edge' WHEN level = 2 THEN 'double edge' WHEN most = level THEN 'star' WHEN most <= 2 THEN 'line' ELSE 'complex' END AS shape,
        CASE WHEN level = 1 THEN 2 ELSE (SELECT count(*) FROM grown s WHERE s.level = g.level - 1 AND list_has_all(g.edges, s.edges)) END AS parents
        FROM grown g JOIN degrees USING (edges)""",
    "redundant_edges": f"""WITH p(pattern, types) AS {_quoted(_PATTERNS)}, h(pattern, label, ends) AS {_quoted(_HELD)}, x(src, label, dst) AS {_quoted([(e.src, e.label, e.dst) for e in _known_edges()])}
        SELECT p.pattern, src, label, dst, EXISTS (SELECT 1 FROM h WHERE h.pattern = p.pattern AND lower(h.label) = lower(x.label) AND h.ends = least(src, dst) || ',' || greatest(src, dst)) AS held FROM p, x""",
    "covering_paths": f"""WITH p(pattern, types) AS {_quoted(_PATTERNS)}, x(dep) AS {_quoted([(x.name,) for x in DEPENDENCIES])}
        SELECT pattern, dep, list_has_all(list_transform(string_split(replace(dep, '->', ','), ','), lambda c: split_part(c, '__', 1)), string_split(types, ',')) AS covers FROM p, x""",
    "total_support": _view(f"SELECT round(sum({_support('coalesce(numerator, 0)')}), 12) AS total FROM (SELECT pattern_id, n AS centers FROM ({_CENTERS})) LEFT JOIN ({_numerators(_SUPPORT_COUNTS, 'pattern_id')}) USING (pattern_id)"),
    "level_support": _level_support_sql(),
    "n_choose_k": "SELECT n_nationkey AS n, CASE WHEN n_nationkey < 3 THEN 0 ELSE (factorial(n_nationkey) / (factorial(3) * factorial(n_nationkey - 3)))::BIGINT END AS k3, CASE WHEN n_nationkey < 5 THEN 0 ELSE (factorial(n_nationkey) / (factorial(5) * factorial(n_nationkey - 5)))::BIGINT END AS k5 FROM nation",
    "induced_hop": _view("SELECT t, dst AS center, src, dst, label FROM e WHERE t = 0 AND label IN ('in_nation', 'based_in') UNION ALL SELECT t, src, src, dst, label FROM e WHERE t = 0 AND label = 'in_region'"),
    "minimal_rules": f"""WITH {_VIEW}, dm AS ({_distinct(PATH)}), {_rule_steps(_SMALL_GROUPS, THETA)}
        SELECT dep, x, y, dmin, dmax FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.y = a.y AND len(string_split(b.x, '|')) < len(string_split(a.x, '|')) AND list_has_all(string_split(a.x, '|'), string_split(b.x, '|')) AND b.dmin <= a.dmin AND b.dmax >= a.dmax)""",
    "rules_union": f"WITH {_RULES} SELECT dep, x, y, dmin, dmax FROM cand",
    "gathered_counts": f"WITH {_RULES} SELECT dep, sum(n)::BIGINT AS entities FROM (SELECT dep, t < 3, count(DISTINCT x) AS n FROM g GROUP BY dep, t < 3) GROUP BY dep",
    "rules_by_right_value": f"WITH {_RULES}, {_TWICE} SELECT x, split_part(y, '=', 1) AS y, split_part(y, '=', 2) AS val, count(DISTINCT (dmin, dmax)) AS rules FROM cand2 GROUP BY ALL",
    "finalised_constants": f"""WITH {_RULES}, {_TWICE},
        -- an interval and the same from one on always overlap, so two fold into what both share
        m AS (SELECT dep, x, y, max(dmin) AS dmin, min(dmax) AS dmax, sum(pairs)::BIGINT AS pairs, max(entities) AS entities FROM cand2 GROUP BY dep, x, y),
        ms AS (SELECT *, CASE WHEN pairs > entities * {PAIRS_OF_T} THEN 0.0 ELSE pairs::DOUBLE / (entities * {PAIRS_OF_T})::DOUBLE END AS support FROM m),
        mc AS (SELECT * FROM ms WHERE support >= {THETA!r})
        SELECT dep, x, y, dmin, dmax, pairs, entities, support FROM mc a WHERE NOT EXISTS (SELECT 1 FROM mc b WHERE a.dep = b.dep AND a.x = b.x AND a.y <> b.y AND a.dmax >= b.dmin AND a.dmin <= b.dmax)""",
    "rebound_vertices": _view("SELECT uri, vtype, 'later' AS attr, vtype AS val FROM vs WHERE t = 0 AND uri IN (SELECT uri FROM vs WHERE t = 1)"),
    "fragment_jobs": _view("SELECT t, uri, (regexp_extract(uri, '^([0-9]+)', 1)::INT % 10)::INT AS fragment FROM c WHERE t = 0"),
    "flagship_miner": _flagship_sql(),
}
