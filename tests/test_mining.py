"""Hand-computed cases: a small temporal graph, conflicts, interval folds, edge clean-up."""

import pytest
from pyspark.sql import functions as F

from kairograph.config import MinerConfig
from kairograph.functions import choose, delta_of, fold_intervals
from kairograph.model import EDGES, VERTICES, Dependency, Edge, Graph, Pattern
from kairograph.operators import histogram, rules, support
from kairograph.operators.matching import compatible, concerns, distinct_matches, entity_counts, match, match_choices, match_counts
from kairograph.operators.neighbourhood import khop
from kairograph.plans import lattice
from kairograph.plans.miner import mine, search_space
from kairograph.sources import sinks

ATTRS = {
    "c1": ("customer", {"seg": "A", "tier": "gold"}),
    "c2": ("customer", {"seg": "A", "tier": "silver"}),
    "c3": ("customer", {"seg": "B", "tier": "gold"}),
    "n1": ("nation", {"name": "N1", "iso": "I1"}),
    "n2": ("nation", {"name": "N2", "iso": "I2"}),
    "r1": ("region", {"name": "R1", "code": "K1"}),
    "r2": ("region", {"name": "R2", "code": "K2"}),
}
PRESENT = {"c1": (0, 1, 3), "c2": (0,), "c3": (0, 2), **{u: (0, 1, 2, 3) for u in ("n1", "n2", "r1", "r2")}}
PATH = Pattern(("customer", "nation", "region"), (Edge("customer", "in_nation", "nation"), Edge("nation", "in_region", "region")), "nation")
ACTIVE = {"customer": ["seg", "tier"], "nation": ["name", "iso"], "region": ["name", "code"]}


def small_graph(spark, extra=()):
    v = [(t, u, ATTRS[u][0], ATTRS[u][1]) for u, ts in PRESENT.items() for t in ts]
    e = [(t, c, n, "in_nation") for c, n in (("c1", "n1"), ("c2", "n1"), ("c3", "n2")) for t in PRESENT[c]]
    e += [(t, "n1", "r1", "in_region") for t in range(4)] + [(t, "n2", "r1" if t < 2 else "r2", "in_region") for t in range(4)]
    for t, s, d, label, vtype in extra:
        v.append((t, d, vtype, {"name": d, "code": d}))
        e.append((t, s, d, label))
    return Graph(spark.createDataFrame(v, VERTICES), spark.createDataFrame(e, EDGES))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_histogram_and_seed_support(spark):
    g = small_graph(spark)
    assert rows(histogram.vertex_type_counts(g.at(0))) == [("customer", 3), ("nation", 2), ("region", 2)]
    assert rows(histogram.edge_type_counts(g.at(0))) == [("customer", "in_nation", "nation", 3), ("nation", "in_region", "region", 2)]
    got = {r["vtype"]: r["support"] for r in support.seed_support(g, 4).collect()}
    assert got == {"customer": 4 / 30, "nation": 12 / 20, "region": 12 / 20}


def test_path_counts_support_and_rules(spark):
    g = small_graph(spark)
    found = match(g, PATH, ACTIVE)
    counts = entity_counts(found)
    assert rows(counts) == [("n1", 0, 2), ("n1", 1, 1), ("n1", 3, 1), ("n2", 0, 1), ("n2", 2, 1)]
    centers = spark.createDataFrame([(0, 2)], "pattern_id int, centers long")
    assert support.support_of_patterns(counts.withColumn("pattern_id", F.lit(0)), centers, 4).first()["support"] == 0.25
    three = distinct_matches(found).select("t", "customer__seg", "nation__name", "region__name").distinct()
    assert rows(three) == [(0, "A", "N1", "R1"), (0, "B", "N2", "R1"), (1, "A", "N1", "R1"), (2, "B", "N2", "R2"), (3, "A", "N1", "R1")]
    for lhs, rhs, entities, s in (
        (("customer__seg", "nation__name"), "region__name", 2, 3 / 20),
        (("nation__name", "region__name"), "customer__seg", 3, 3 / 30),
        (("customer__seg", "region__name"), "nation__name", 3, 3 / 30),
    ):
        groups = rules.value_groups(three, [Dependency(lhs, rhs)])
        assert rules.entity_counts(groups).first()["entities"] == entities
        kept = rules.without_conflicts(rules.candidates(groups, 4, 0.0)).collect()
        assert [(r["dmin"], r["dmax"], r["pairs"], r["support"]) for r in kept] == [(1, 3, 3, s)]
        assert rows(rules.general_rules(rules.candidates(groups, 4, 0.0)).select("dmin", "dmax")) == [(1, 3)]
    assert len(lattice.dependencies(PATH, ACTIVE)) == 24


def test_signature_mode_drops_a_centre_with_an_extra_edge_type(spark):
    g = small_graph(spark, [(0, "n1", "r9", "borders", "region")])
    centers = lambda mode: {(r["center_uri"], r["t"]) for r in match(g, PATH, ACTIVE, mode).collect()}
    assert ("n1", 0) in centers("structural") and ("n1", 0) not in centers("signature")
    assert ("n1", 1) in centers("signature")
    with pytest.raises(ValueError):
        match(g, PATH, ACTIVE, "other")


def test_breadth_first_tree_prefers_edges_along(spark):
    v = spark.createDataFrame([(0, u, "x", {}) for u in "abc"], VERTICES)
    e = spark.createDataFrame([(0, "a", "b", "q"), (0, "b", "a", "p"), (0, "b", "c", "r"), (0, "c", "c", "self")], EDGES)
    got = {(r["center"], r["uri"]): (r["hop"], r["prev"], r["label"], r["dir"]) for r in khop(Graph(v, e), "x", 2).collect()}
    assert got["a", "b"] == (1, "a", "q", 0) and got["a", "c"] == (2, "b", "r", 0) and got["c", "a"] == (2, "b", "p", 0)
    assert ("c", "c") not in got


def test_conflicts_remove_both_and_the_fold_precedes_them(spark):
    seen = {("x1", "y1"): (0, 1), ("x1", "y2"): (2, 3), ("x2", "y1"): (0, 1), ("x2", "y2"): (0, 3), ("x3", "y1"): (0, 1, 3)}
    m = spark.createDataFrame([(t, x, y) for (x, y), ts in seen.items() for t in ts], "t int, a__x string, b__y string")
    groups = rules.value_groups(m, [Dependency(("a__x",), "b__y")])
    found = rules.candidates(groups, 4, 0.0)
    got = {(r["x"], r["y"]): (r["dmin"], r["dmax"], r["support"]) for r in rules.flat(found).collect()}
    assert got["a.x=x1", "b.y=y1"] == (1, 1, 1 / 30) and got["a.x=x2", "b.y=y2"] == (3, 3, 1 / 30) and got["a.x=x3", "b.y=y1"] == (1, 3, 3 / 30)
    kept = lambda theta: sorted((r["x"], r["y"]) for r in rules.flat(rules.without_conflicts(rules.candidates(groups, 4, theta))).collect())
    assert kept(0.0) == [("a.x=x2", "b.y=y1"), ("a.x=x2", "b.y=y2"), ("a.x=x3", "b.y=y1")]
    assert kept(0.05) == [("a.x=x3", "b.y=y1")]
    assert rows(rules.general_rules(found).select("dmin", "dmax")) == [(1, 1), (3, 3)]
    assert [(r["y1"]["val"], r["y2"]["val"]) for r in rules.conflict_pairs(found).collect()] == [("y1", "y2")]
    ranked = rules.ranked_values(groups).where("rank = 1").collect()
    assert {(r["x"][0]["val"], r["y"]["val"]) for r in ranked} == {("x1", "y1"), ("x2", "y1"), ("x3", "y1")}


def test_fold_delta_and_binomials(spark):
    cases = [([(1, 3), (2, 5), (4, 6), (1, 2)], [(2, 2), (4, 6)]), ([(1, 1), (2, 2)], [(1, 1), (2, 2)]), ([], [])]
    df = spark.createDataFrame(cases, "i array<struct<dmin:int,dmax:int>>, e array<struct<dmin:int,dmax:int>>")
    for r in df.select(fold_intervals(F.col("i")).alias("f"), "e").collect():
        assert r["f"] == r["e"]
    times = spark.createDataFrame([([3, 0, 1],), ([2],), ([],)], "t array<int>").select(delta_of(F.col("t")).alias("d")).collect()
    assert [tuple(r["d"]) if r["d"] else None for r in times] == [(1, 3), None, None]
    assert [r[0] for r in spark.range(6).select(choose(F.col("id"), 3)).collect()] == [0, 0, 0, 1, 4, 10]


def test_edge_clean_up_in_rank_order(spark):
    top = spark.createDataFrame([("a", "p", "b", 9, 1), ("b", "p", "c", 8, 2), ("d", "q", "d", 7, 3), ("a", "q", "b", 6, 4), ("b", "r", "e", 5, 5), ("c", "s", "a", 4, 6)], "src_type string, label string, dst_type string, n long, rank int")
    active = spark.createDataFrame([(v, "m") for v in "abcd"], "vtype string, attr string")
    assert rows(histogram.clean_edges(top, active).select("src_type", "label", "dst_type")) == [("a", "p", "b"), ("c", "s", "a")]


def test_merging_rules_of_several_runs(spark):
    lit = {"vtype": "a", "attr": "x", "val": "1"}
    data = [("d", [lit], lit, 1, 3, 3, 1, 0.3), ("d", [lit], lit, 2, 2, 1, 1, 0.1), ("e", [lit], lit, 1, 1, 1, 1, 0.1), ("e", [lit], lit, 3, 3, 1, 1, 0.1)]
    kind = f"dep string, x array<{rules.LITERAL}>, y {rules.LITERAL}, dmin int, dmax int, pairs long, entities long, support double"
    got = rows(rules.merge_rules(spark.createDataFrame(data, kind), 4).select("dep", "dmin", "dmax", "pairs", "support"))
    assert got == [("d", 2, 2, 4, 0.4), ("e", 1, 1, 1, 0.1), ("e", 3, 3, 1, 0.1)]


def test_miner_end_to_end(spark):
    g = small_graph(spark)
    config = MinerConfig(timestamps=4, k=2, theta_rule=0.0)
    space = search_space(g, config)
    assert space.types == ["customer", "nation", "region"] and [e.label for e in space.edges] == ["in_nation", "in_region"]
    result = mine(g, config)
    assert [len(level) for level in result.levels] == [3, 2, 1] and result.patterns[-1].support == 0.25
    got = {(r["x"], r["y"]): (r["dmin"], r["dmax"], r["level"]) for r in rules.flat(result.constant).collect()}
    assert got["customer.seg=A|nation.name=N1", "region.name=R1"] == (1, 3, 3)
    for r in result.constant.collect():
        assert 0 <= r["support"] <= 1 and 1 <= r["dmin"] <= r["dmax"] <= 3
    assert result.general.where("dep = 'customer__seg,nation__name->region__name'").count() == 1
    crossed = mine(g, MinerConfig(timestamps=4, k=2, theta_rule=0.0, match_mode="signature"))
    assert rows(rules.flat(crossed.constant)) == rows(rules.flat(result.constant))
    crossed.drop()
    # A larger threshold leaves no pattern, and so no rules.
    none = mine(g, MinerConfig(timestamps=4, k=2, theta_pattern=0.9))
    assert none.constant is None and all(n.pruned for n in none.levels[0])


def test_counts_and_choices_agree_with_the_matches(spark):
    g = small_graph(spark, [(1, "n1", "r9", "in_region", "region")])
    hole = g.vertices.withColumn("attrs", F.when((F.col("uri") == "c1") & (F.col("t") == 1), F.create_map(F.lit("tier"), F.lit("gold"))).otherwise(F.col("attrs")))
    g = Graph(hole, g.edges)
    for at_least in (None, 6):
        full = match(g, PATH, ACTIVE, at_least=at_least)
        assert rows(match_counts(g, PATH, ACTIVE, at_least)) == rows(entity_counts(full))
        deps = lattice.dependencies(PATH, ACTIVE)
        want = {tuple(r) for r in rules.flat(rules.value_groups(distinct_matches(full), deps)).select("dep", "x", "y", "t").collect()}
        got = [tuple(r) for r in rules.flat(rules.choice_groups(match_choices(g, PATH, ACTIVE, at_least))).select("dep", "x", "y", "t").collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_classes_give_the_counts_and_choices_of_the_matches(spark, monkeypatch):
    from kairograph.operators import classes
    from kairograph.operators.classes import class_choices, class_counts, classes_of

    g = small_graph(spark, [(1, "n1", "r9", "in_region", "region")])
    hole = g.vertices.withColumn("attrs", F.when((F.col("uri") == "c1") & (F.col("t") == 1), F.create_map(F.lit("tier"), F.lit("gold"))).otherwise(F.col("attrs")))
    g = Graph(hole.unionByName(spark.createDataFrame([(t, "c1", "customer", ATTRS["c1"][1]) for t in (70, 100)], VERTICES)).unionByName(spark.createDataFrame([(t, u, *ATTRS[u]) for t in (70, 100) for u in ("n1", "r1")], VERTICES)), g.edges.unionByName(spark.createDataFrame([(t, a, b, e) for t in (70, 100) for a, b, e in (("c1", "n1", "in_nation"), ("n1", "r1", "in_region"))], EDGES)))
    hubs = {(e, v): 10.0**9 for e in PATH.edges[:1] for v in (e.src, e.dst)}
    c = classes_of(g, list(PATH.vertices), ACTIVE, {"customer": 3, "nation": 2, "region": 2}, hubs)
    for center in PATH.vertices:
        p = Pattern(PATH.vertices, PATH.edges, center)
        for at_least in (None, 6):
            assert rows(class_counts(c, p, at_least)) == rows(match_counts(g, p, ACTIVE, at_least))
            want = {(tuple(map(tuple, r["cells"])), r["t"]) for r in match_choices(g, p, ACTIVE, at_least).collect()}
            got = [(tuple(map(tuple, r["cells"])), t) for r in class_choices(c, p, at_least).collect() for t in r["ts"]]
            assert len(got) == len(set(got)) and set(got) == want and want
    assert len(c.held) < 12  # of the 24 that centres and values would need
    c.drop()
    # Types of many classes are matched by values, with the same rules.
    config = MinerConfig(timestamps=4, k=2, theta_rule=0.0)
    by_class, small = mine(small_graph(spark), config), small_graph(spark)
    monkeypatch.setattr(classes, "MOST_CLASSES", 2)
    by_value = mine(small, config)
    assert not classes_of(small, list(PATH.vertices), ACTIVE).fits(PATH)
    assert rows(rules.flat(by_class.constant)) == rows(rules.flat(by_value.constant)) and rows(by_class.general) == rows(by_value.general)


def test_values_are_joined_where_few_rows_meet_and_written_once(spark, monkeypatch):
    """Matched anew for each pattern, in wide rows, the miner wrote no such table and failed by time at 1 GB."""
    from kairograph.operators import classes

    written, whole = [], classes.cut
    monkeypatch.setattr(classes, "cut", lambda df, *more: written.append(more[0]) or whole(df, *more))
    mine(small_graph(spark), MinerConfig(timestamps=4, k=2, theta_rule=0.0)).drop()
    assert written.count("hop") == 3  # both ways between customer and nation, and from region to nation
    e, f = PATH.edges
    counts, fan = {"customer": 10**6, "nation": 25, "region": 5}, {(e, "customer"): 1.0, (e, "nation"): 4.0e4, (f, "nation"): 1.0, (f, "region"): 5.0}
    c = classes.Classes(small_graph(spark), ACTIVE, 3, 3, 4, values={v: [[]] * 30 for v in PATH.vertices}, sizes=counts, fan=fan)
    assert c.root(Pattern(PATH.vertices, PATH.edges, "customer")) in ("nation", "region")


def test_general_rules_are_folded_over_patterns_and_written(spark, tmp_path):
    data = [("p", 3, "a__x,b__z->c__y", 1, 3), ("q", 3, "a__x,b__z->c__y", 2, 5), ("q", 3, "a__x,b__z->c__y", 7, 8), ("q", 3, "a__x->b_c__y__z", 1, 1)]
    general = rules.with_variables(spark.createDataFrame(data, "pattern_id string, level int, dep string, dmin int, dmax int"))
    assert {(r["dep"], tuple(map(tuple, r["x"])), tuple(r["y"])) for r in general.collect()} == {("a__x,b__z->c__y", (("a", "x"), ("b", "z")), ("c", "y")), ("a__x->b_c__y__z", (("a", "x"),), ("b_c", "y__z"))}
    final = rules.with_variables(rules.finalise_general(general))
    assert rows(final.select("dep", "dmin", "dmax")) == [("a__x,b__z->c__y", 2, 3), ("a__x,b__z->c__y", 7, 8), ("a__x->b_c__y__z", 1, 1)]
    sinks.write_rules(final, str(tmp_path), "general")
    lines = sorted(r["value"] for r in spark.read.text(f"{tmp_path}/General-TGFD").collect())
    assert lines[-1] == "TGFD{dependency=DataDependency{x=[VariableLiteral(vertexType=a, attrName=x)], y=[VariableLiteral(vertexType=b_c, attrName=y__z)]}, delta=Pair(min=1, max=1), tgfdSupport=0.0, level=3}"
    back = sinks.read_rules(spark, str(tmp_path), "general")
    assert sorted((tuple(map(tuple, r["x"])), tuple(r["y"]), r["dmin"], r["dmax"], r["support"], r["level"]) for r in back.collect()) == sorted((tuple(map(tuple, r["x"])), tuple(r["y"]), r["dmin"], r["dmax"], 0.0, 3) for r in final.collect())


def test_smaller_rules_cover_larger_ones_and_keys(spark):
    a, b, y = ("a", "x", "1"), ("b", "x", "2"), ("c", "z", "3")
    kind = f"dep string, x array<{rules.LITERAL}>, y {rules.LITERAL}, dmin int, dmax int"
    data = [("s", [a], y, 1, 3), ("l", [a, b], y, 2, 3), ("m", [a, b], y, 1, 4), ("o", [b], y, 2, 2)]
    found = spark.createDataFrame(data, kind)
    assert sorted(r["dep"] for r in rules.minimal_rules(found).collect()) == ["m", "o", "s"]
    assert rules.gather([found, found]).count() == 4
    counts = spark.createDataFrame([("d", 2), ("e", 1)], "dep string, entities long")
    assert rows(rules.gather_counts([counts, counts.where("dep = 'd'")])) == [("d", 4), ("e", 1)]
    assert rules.with_keys(found).select("key").distinct().count() == 3
    assert rules.with_keys(found, general=True).select("key").distinct().count() == 3


def test_vertex_compatibility(spark):
    df = spark.createDataFrame([("x", {"a": "1", "b": "2"}), ("x", {"a": "1"}), ("y", {})], "vtype string, attrs map<string,string>")
    count = lambda *a: df.where(compatible(F.col("vtype"), F.col("attrs"), *a)).count()
    assert count("x", []) == 2 and count("x", ["b", "a"]) == 1 and count("y", ["a"]) == 0
    assert df.where(concerns(["y", "z"], F.col("vtype"))).count() == 1
    node = lattice.seeds(["a", "b"])
    node[0].support, node[1].support, node[1].pruned = 0.5, 0.1, True
    assert lattice.total_support(node) == 0.5


def test_vertices_of_all_years_are_not_taken_for_a_small_table(spark, tmp_path):
    from kairograph.sources import views

    spark.range(2000).selectExpr("id p_partkey", "concat('Brand#', id % 7) p_brand", "concat('t', id) p_type").write.parquet(f"{tmp_path}/part.parquet")
    for name, columns in {
        "customer": "id c_custkey, int(id) c_nationkey, 1.0D c_acctbal, 'x' c_mktsegment",
        "supplier": "id s_suppkey, int(id) s_nationkey, 1.0D s_acctbal",
        "nation": "int(id) n_nationkey, 'n' n_name, int(id) n_regionkey",
        "region": "int(id) r_regionkey, 'r' r_name",
        "orders": "id o_orderkey, id o_custkey, timestamp '1996-02-01' o_orderdate",
        "lineitem": "id l_orderkey, id l_partkey, id l_suppkey",
    }.items():
        twice = 2 if name == "lineitem" else 1
        spark.range(3 * twice).selectExpr("id % 3 id").selectExpr(*columns.split(", ")).write.parquet(f"{tmp_path}/{name}.parquet")
    size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    g = views.commerce(spark, str(tmp_path))
    assert size(g.vertices.where("vtype = 'part'")) >= views.YEARS * size(spark.read.parquet(f"{tmp_path}/part.parquet"))
    assert g.vertices.where("vtype = 'part'").groupBy("t").count().where("count = 2000").count() == views.YEARS
    assert sorted(map(tuple, g.edges.where("label = 'bought'").collect())) == [(1, f"{k}-customer", f"{k}-part", "bought") for k in range(3)]


def test_subtrees_that_patterns_share_are_counted_once(spark, monkeypatch):
    from kairograph.operators import matching
    from kairograph.plans.miner import numerators

    written, whole = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df, *more: written.append(more[0]) or whole(df, *more))
    g, edges = small_graph(spark), PATH.edges
    patterns = [PATH, Pattern(PATH.vertices, edges, "region"), Pattern(PATH.vertices[:2], edges[:1], "nation"), Pattern(PATH.vertices, edges, "customer")]
    got = {r["pattern_id"]: r["numerator"] for r in numerators(g, patterns, ACTIVE, {}).collect()}
    alone = [support.recurring(match_counts(g, p, ACTIVE).withColumn("pattern_id", F.lit(0)), ["pattern_id"]).first()["numerator"] for p in patterns]
    assert got == dict(enumerate(alone))
    assert written == ["hop"] * 4  # of seven that the patterns hold


def test_numbers_name_the_same_vertices_as_uris(spark):
    from kairograph.sources import views

    text, number = (views.commerce(spark, "/root/testdata/sf0.001", numbers=n) for n in (False, True))
    key = lambda c: F.concat((F.col(c) / 8).cast("long").cast("string"), F.lit("-"), F.element_at(F.array(*[F.lit(v) for v in views.NUMBERED]), (F.col(c) % 8 + 1).cast("int"))).alias(c)
    assert rows(number.edges.select("t", key("src"), key("dst"), "label")) == rows(text.edges)
    assert rows(number.vertices.select("t", key("uri"), "vtype")) == rows(text.vertices.select("t", "uri", "vtype"))
