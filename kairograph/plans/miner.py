"""The mining run: histogram, pattern growth level by level, rules.

The driver holds patterns and supports, and the classes of types that have few. The graph is written once. The candidates of a level are counted
one by one, from what reaches a vertex from each subtree, which is written once for all. Where the types of a pattern have few classes, their values are
found in the same tables; else counts move without values, and the values are matched anew. What is found is written once for both kinds of rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kairograph.config import MinerConfig
from kairograph.model import Dependency, Edge, Graph, Pattern, PatternNode
from kairograph.operators import histogram, rules, support
from kairograph.operators.classes import DEALT, Classes, class_choices, class_counts, classes_of
from kairograph.operators.matching import HASHED, Active, Held, distinct_matches, entity_counts, match, match_choices, match_counts
from kairograph.plans import lattice
from kairograph.tables import cut, holding, release


@dataclass
class SearchSpace:
    types: list[str]
    edges: list[Edge]
    active: Active
    counts: dict[str, int]
    fan: dict[tuple[Edge, str], float] = field(default_factory=dict)


def search_space(g: Graph, config: MinerConfig) -> SearchSpace:
    """From the first snapshot: seed types in order, cleaned edge types in order, active attributes, counts. The
    three aggregates have a row for each type, edge type, or type and attribute, never for data; they are
    computed once and ranked from memory."""
    spark, first = g.vertices.sparkSession, g.at(0)
    held = lambda df: spark.createDataFrame(df.collect(), df.schema)
    attrs, edge_counts, counts = (held(f(first)) for f in (histogram.type_attributes, histogram.edge_type_counts, histogram.vertex_type_counts))
    active_rows = held(histogram.select_active(attrs, config.gamma))
    top = held(histogram.rank_edges(edge_counts, config.n_edges))
    edges = [Edge(r["src_type"], r["label"], r["dst_type"]) for r in histogram.clean_edges(top, active_rows).orderBy("rank").collect()]
    types = [(r["vtype"], r["n"]) for r in histogram.rank_types(counts, top).orderBy("rank").collect()]
    active: Active = {}
    for vtype, attr in sorted((r["vtype"], r["attr"]) for r in active_rows.collect()):
        active.setdefault(vtype, []).append(attr)
    sizes = dict(types)
    number = {Edge(r["src_type"], r["label"], r["dst_type"]): r["n"] for r in edge_counts.collect()}
    return SearchSpace([t for t, _ in types], edges, active, sizes, {(e, v): number[e] / sizes[v] for e in edges for v in (e.src, e.dst)})


@dataclass
class Result:
    """Rules, and the tables that they read, which ``drop`` removes."""

    constant: DataFrame | None = None
    general: DataFrame | None = None
    levels: list[list[PatternNode]] = field(default_factory=list)
    tables: list[DataFrame] = field(default_factory=list)

    @property
    def patterns(self) -> list[PatternNode]:
        return [n for level in self.levels for n in level]

    def drop(self) -> None:
        release(*self.tables)


def numerators(g: Graph, patterns: list[Pattern], active: Active, held: Held) -> DataFrame:
    """pattern_id (the place in ``patterns``), numerator. A pattern at a time, so that the disk holds the shuffles of one; the subtrees
    that patterns share are counted once."""
    each = [cut(support.recurring(match_counts(g, p, active, held=held).withColumn("pattern_id", F.lit(k)), ["pattern_id"]), "numerators", settings=HASHED) for k, p in enumerate(patterns)]
    rows = [tuple(r) for e in each for r in e.collect()]
    release(*each)
    return g.vertices.sparkSession.createDataFrame(rows, "pattern_id int, numerator long")


def seed_supports(g: Graph, space: SearchSpace, config: MinerConfig, classes: Classes | None) -> dict[str, float]:
    """Supports of the types: of those that have few classes from the vertices dealt out, else as ``seed_support``."""
    if classes is None or any(v not in classes.vertices for v in space.types):
        return {r["vtype"]: r["support"] for r in support.seed_support(g, config.timestamps).collect()}
    spark, rows = g.vertices.sparkSession, []
    with holding(spark, DEALT):
        for v, df in classes.vertices.items():
            rows += [tuple(r) for r in support.recurring(df.groupBy("uri", "t").agg(F.count(F.lit(1)).alias("n")).withColumn("pattern_id", F.lit(v)), ["pattern_id"]).collect()]
    centers = spark.createDataFrame([(v, space.counts[v]) for v in space.types], "pattern_id string, centers long")
    return {r["pattern_id"]: r["support"] for r in support.support_of(spark.createDataFrame(rows, "pattern_id string, numerator long"), centers, config.timestamps).collect()}


def class_numerators(g: Graph, patterns: list[Pattern], active: Active, held: Held, classes: Classes) -> DataFrame:
    """As ``numerators``, by classes where a pattern fits."""
    spark, rows = g.vertices.sparkSession, []
    other = [k for k, p in enumerate(patterns) if not classes.fits(p)]
    if other:
        rows = [(other[r["pattern_id"]], r["numerator"]) for r in numerators(g, [patterns[k] for k in other], active, held).collect()]
    with holding(spark, DEALT):
        for k, p in enumerate(patterns):
            if classes.fits(p):
                rows += [tuple(r) for r in support.recurring(class_counts(classes, p).withColumn("pattern_id", F.lit(k)), ["pattern_id"]).collect()]
    return spark.createDataFrame(rows, "pattern_id int, numerator long")


def score_level(g: Graph, nodes: list[PatternNode], space: SearchSpace, config: MinerConfig, held: Held, classes: Classes | None = None) -> None:
    """Supports of all patterns of a level; those below the threshold are pruned."""
    if not nodes:
        return
    spark = g.vertices.sparkSession
    if config.match_mode == "structural":
        patterns = [n.pattern for n in nodes]
        found = numerators(g, patterns, space.active, held) if classes is None else class_numerators(g, patterns, space.active, held, classes)
    else:
        counts = [entity_counts(match(g, n.pattern, space.active, config.match_mode)).withColumn("pattern_id", F.lit(k)) for k, n in enumerate(nodes)]
        found = support.recurring(reduce(DataFrame.unionByName, counts), ["pattern_id"])
    centers = spark.createDataFrame([(k, int(space.counts.get(n.pattern.center, 0))) for k, n in enumerate(nodes)], "pattern_id int, centers long")
    for r in support.support_of(found, centers, config.timestamps).collect():
        node = nodes[r["pattern_id"]]
        node.support = r["support"]
        node.pruned = node.support < config.theta_pattern


def _redundant(nodes: list[PatternNode], groups: DataFrame) -> DataFrame:
    """Groups without those of dependencies that a minimal one of the pattern or its ancestors covers."""
    rows = [(n.pattern.name, m.rhs, list(m.lhs)) for n in nodes for m in n.inherited()]
    if not rows:
        return groups
    small = groups.sparkSession.createDataFrame(rows, "pattern_id string, _rhs string, _lhs array<string>")
    names = F.split(F.substring_index("dep", "->", 1), ",")
    covered = (F.substring_index("dep", "->", -1) == F.col("_rhs")) & (F.size(F.array_except("_lhs", names)) == 0)
    return groups.join(F.broadcast(small.withColumnRenamed("pattern_id", "_pattern")), (F.col("pattern_id") == F.col("_pattern")) & covered, "left_anti")


def _times(g: Graph, p: Pattern, active: Active, classes: Classes | None) -> DataFrame:
    """cells, ts: the sets of values of a pattern with the snapshots that hold them. The cells give each group of each dependency once, so the
    groups need no sorting of their own."""
    if classes is not None and classes.fits(p):
        return class_choices(classes, p)
    return match_choices(g, p, active).groupBy("cells").agg(F.collect_set("t").alias("ts"))


def level_occurrences(g: Graph, nodes: list[PatternNode], space: SearchSpace, config: MinerConfig, classes: Classes | None = None) -> DataFrame:
    """pattern_id, level, dep, x, y, ts of all dependencies of the patterns, without those that minimal ones cover."""
    mark = lambda df, n: df.withColumns({"pattern_id": F.lit(n.pattern.name), "level": F.lit(len(n.pattern.vertices))})
    for n in nodes:  # refuses patterns of too many dependencies
        lattice.dependencies(n.pattern, space.active, config.max_dependencies)
    if config.match_mode == "structural":
        parts = [_times(g, n.pattern, space.active, classes) for n in nodes]
        groups = rules.choice_groups(reduce(DataFrame.unionByName, [mark(df.withColumnRenamed("ts", "t"), n) for df, n in zip(parts, nodes, strict=True)]))
        return _redundant(nodes, groups).withColumnRenamed("t", "ts")
    parts = []
    for n in nodes:
        found = distinct_matches(match(g, n.pattern, space.active, config.match_mode))
        parts.append(mark(rules.value_groups(found, lattice.dependencies(n.pattern, space.active)).drop("n"), n))
    groups = reduce(DataFrame.unionByName, parts)
    return rules.occurrences(_redundant(nodes, groups), BY)


BY = ("pattern_id", "level", "dep")


def mine(g: Graph, config: MinerConfig) -> Result:
    """Constant rules (pattern_id, level, dep, x, y, dmin, dmax, pairs, entities, support) and general rules
    (pattern_id, level, dep, x, y, dmin, dmax, support), x and y of the latter without values. level counts vertices. The graph
    and what is matched are written to the shared folder."""
    result = Result()

    def held(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
        result.tables.append(cut(df, label, codec))
        return result.tables[-1]

    g = Graph(held(g.vertices, "vertices"), held(g.edges, "edges", "zstd"))
    hops: Held = {}
    space = search_space(g, config)
    level = lattice.seeds(space.types)
    classes = classes_of(g, space.types, space.active, space.counts, space.fan) if config.match_mode == "structural" and space.types else None
    seeds = seed_supports(g, space, config, classes)
    for node in level:
        node.support = seeds.get(node.pattern.center, 0.0)
        node.pruned = node.support < config.theta_pattern
    result.levels.append(level)
    above: list[PatternNode] = []
    for step in range(1, config.k + 1):
        new = lattice.grow(level, space.edges, above)
        if not new:
            break
        score_level(g, new, space, config, hops, classes)
        result.levels.append(new)
        # Left sides of two attributes or more that give a rule make larger ones redundant in patterns to
        # come; nothing needs them after the last step.
        asked = [n for n in new if not n.pruned and all(space.active.get(v) for v in n.pattern.vertices) and (len(n.pattern.edges) >= config.min_level or step < config.k and len(n.pattern.vertices) > 2)]
        if asked:
            with holding(g.vertices.sparkSession, DEALT):
                times = held(level_occurrences(g, asked, space, config, classes), "occurrences")
            found = rules.candidates_of(times, config.timestamps, config.theta_rule, BY)
            if step < config.k and step > 1:
                by = {n.pattern.name: n for n in asked}
                for r in found.select("pattern_id", "dep").distinct().collect():
                    lhs, _, rhs = r["dep"].partition("->")
                    by[r["pattern_id"]].minimal.append(Dependency(tuple(lhs.split(",")), rhs))
            if step >= config.min_level:
                kept = rules.without_conflicts(found, [*BY, "x"])
                general = rules.with_variables(rules.general_rules(found, list(BY)))
                result.constant = kept if result.constant is None else result.constant.unionByName(kept)
                result.general = general if result.general is None else result.general.unionByName(general)
        above, level = [*above, *level], new
    release(*hops.values())
    if classes is not None:
        classes.drop()
    return result
