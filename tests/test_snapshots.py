"""Change logs, sources, sinks and the stream of change files."""

import json

import pytest

from kairograph.model import CHANGES, EDGES, VERTICES, Graph
from kairograph.operators import snapshots
from kairograph.operators.matching import match_induced
from kairograph.operators.neighbourhood import fragment_jobs
from kairograph.sources import changes, rdf, sinks
from kairograph.streaming.change_stream import ingest


def change_files(folder):
    step1 = [
        {"id": 1, "typeOfChange": "insertEdge", "src": "u3", "dst": "u2", "label": "lives", "types": []},
        {"id": 2, "typeOfChange": "insertVertex", "types": ["person"], "vertex": {"vertexURI": "u3", "types": ["person", "agent"], "allAttributesList": [{"attrName": "name", "attrValue": "bob"}]}},
        {"id": 3, "typeOfChange": "changeAttr", "uri": "u1", "attribute": {"attrName": "name", "attrValue": "anna"}, "types": []},
        {"id": 4, "typeOfChange": "insertAttr", "uri": "u2", "attribute": {"attrName": "name", "attrValue": "bergen"}, "types": []},
        {"id": 5, "typeOfChange": "changeAttr", "uri": "u3", "attribute": {"attrName": "name", "attrValue": "x"}, "types": []},
    ]
    step2 = [
        {"id": 6, "typeOfChange": "deleteVertex", "vertex": {"vertexURI": "u1", "types": ["person"], "allAttributesList": []}},
        {"id": 7, "typeOfChange": "insertEdge", "src": "u1", "dst": "u3", "label": "knows"},
        {"id": 8, "typeOfChange": "deleteEdge", "src": "u3", "dst": "u2", "label": "wrong"},
        {"id": 9, "typeOfChange": "changeType", "uri": "u2", "previousVertex": {"vertexURI": "u2", "types": ["city"], "allAttributesList": []}, "newVertex": {"vertexURI": "u2", "types": ["town"], "allAttributesList": []}},
        {"id": 10, "typeOfChange": "deleteAttr", "uri": "u2", "attribute": {"attrName": "name", "attrValue": "oslo"}},
    ]
    for t, step in ((1, step1), (2, step2)):
        (folder / changes.FILE.format(t - 1, t)).write_text(json.dumps(step))


def first_graph(spark):
    return Graph(spark.createDataFrame([(0, "u1", "person", {"name": "ann"}), (0, "u2", "city", {"name": "oslo"})], VERTICES), spark.createDataFrame([(0, "u1", "u2", "lives")], EDGES))


def check_snapshots(g):
    v = {(r["t"], r["uri"]): (r["vtype"], r["attrs"]) for r in g.vertices.collect()}
    assert v == {
        (0, "u1"): ("person", {"name": "ann"}),
        (0, "u2"): ("city", {"name": "oslo"}),
        (1, "u1"): ("person", {"name": "anna"}),
        (1, "u2"): ("city", {"name": "oslo"}),
        (1, "u3"): ("person", {"name": "bob"}),
        (2, "u2"): ("town", {}),
        (2, "u3"): ("person", {"name": "bob"}),
    }
    assert sorted(tuple(r) for r in g.edges.select("t", "src", "dst", "label").collect()) == [(0, "u1", "u2", "lives"), (1, "u1", "u2", "lives"), (1, "u3", "u2", "lives"), (2, "u3", "u2", "lives")]


def test_snapshots_from_change_files(spark, tmp_path):
    change_files(tmp_path)
    log = changes.read_changes(spark, str(tmp_path), 3)
    order = [(r["t"], r["op"]) for r in snapshots.ordered(log).orderBy("t", "pos").collect()]
    assert order[:5] == [(1, "changeAttr"), (1, "changeAttr"), (1, "insertVertex"), (1, "insertEdge"), (1, "insertAttr")]
    check_snapshots(snapshots.build_snapshots(first_graph(spark), log, 3))
    assert {r["op"] for r in changes.read_changes(spark, str(tmp_path), 3, edges=False).collect()}.isdisjoint(changes.EDGE_OPS)


def test_change_files_as_a_stream(spark, tmp_path):
    change_files(tmp_path)
    query = ingest(spark, str(tmp_path), str(tmp_path / "log"), str(tmp_path / "state"))
    query.awaitTermination(120)
    check_snapshots(snapshots.build_snapshots(first_graph(spark), spark.read.parquet(str(tmp_path / "log")), 3))


def test_no_changes_repeat_the_first_graph(spark):
    g = snapshots.build_snapshots(first_graph(spark), spark.createDataFrame([], CHANGES), 3)
    assert g.vertices.count() == 6 and g.edges.count() == 3


def test_a_vertex_that_comes_back_has_lost_its_edges(spark):
    rows = [(1, 0, 1, "deleteVertex", None, None, None, "u1", None, None, None, None, None), (1, 1, 2, "insertVertex", None, None, None, "u1", None, None, "robot", None, {"k": "v"})]
    g = snapshots.build_snapshots(first_graph(spark), spark.createDataFrame(rows, CHANGES), 2)
    assert {(r["t"], r["uri"], r["vtype"]) for r in g.vertices.collect()} == {(0, "u1", "person"), (0, "u2", "city"), (1, "u1", "robot"), (1, "u2", "city")}
    assert [r["t"] for r in g.edges.collect()] == [0]


def test_merge_and_extract(spark):
    a = first_graph(spark)
    b = Graph(spark.createDataFrame([(0, "u2", "town", {"size": "big"}), (0, "u4", "person", {})], VERTICES), spark.createDataFrame([(0, "u1", "u2", "works"), (0, "u4", "u2", "lives")], EDGES))
    m = snapshots.upsert_merge(a, b)
    assert {r["uri"]: (r["vtype"], r["attrs"]) for r in m.vertices.collect()} == {"u1": ("person", {"name": "ann"}), "u2": ("town", {"name": "oslo", "size": "big"}), "u4": ("person", {})}
    assert sorted((r["src"], r["label"]) for r in m.edges.collect()) == [("u1", "lives"), ("u4", "lives")]
    part = snapshots.extract(m, m.edges.where("src = 'u4'"))
    assert {r["uri"] for r in part.vertices.collect()} == {"u4", "u2"} and part.edges.count() == 1


def test_movie_and_encyclopedia_graphs(spark, tmp_path):
    nt = tmp_path / "m.nt"
    nt.write_text(
        '<http://imdb.org/movie/tt1> <http://xmlns.com/foaf/0.1/genre> "Drama" .\n'
        '<http://imdb.org/movie/tt1> <http://xmlns.com/foaf/0.1/genre> "Action"@en .\n'
        "<http://imdb.org/movie/tt1> <http://xmlns.com/foaf/0.1/country_of_origin> <http://imdb.org/country/New%20Zealand> .\n"
        "<http://imdb.org/movie/tt1> <http://xmlns.com/foaf/0.1/broken> <http://imdb.org/country> .\n# a comment\n\n"
    )
    g = rdf.load_snapshots(spark, [str(nt), str(nt)])
    v = {(r["t"], r["uri"]): (r["vtype"], r["attrs"]) for r in g.vertices.collect()}
    assert v[0, "tt1-movie"] == ("movie", {"genre": "action"}) and v[1, "new zealand-country"] == ("country", {}) and len(v) == 4
    assert {(r["src"], r["dst"], r["label"]) for r in g.edges.collect()} == {("tt1-movie", "new zealand-country", "country_of_origin")}
    assert {r["fragment"] for r in rdf.fragments(spark, [str(nt), str(nt)]).collect()} == {1}

    ttl = tmp_path / "d.ttl"
    ttl.write_text(
        "@prefix dbr: <http://dbpedia.org/resource/> .\n@prefix dbo: <http://dbpedia.org/ontology/> .\n"
        'dbr:Oslo a dbo:City ; dbo:motto "Tiger \\"Town\\""@en ; dbo:country dbr:Norway , dbr:Oslo , dbr:Unknown .\n'
        "dbr:Norway a dbo:Country ; dbo:population 5 .\n"
    )
    g = rdf.load_snapshots(spark, [str(ttl)], "dbpedia")
    assert {r["uri"]: (r["vtype"], r["attrs"]) for r in g.vertices.collect()} == {"oslo": ("city", {"motto": 'tiger "town"'}), "norway": ("country", {"population": "5"})}
    assert [(r["src"], r["dst"], r["label"]) for r in g.edges.collect()] == [("oslo", "norway", "country")]
    only = rdf.load_snapshots(spark, [str(ttl)], "dbpedia", ["city"])
    assert [r["uri"] for r in only.vertices.collect()] == ["oslo"] and only.edges.count() == 0


def test_bad_statements_are_skipped_and_told(spark, tmp_path):
    nt = tmp_path / "x.nt"
    nt.write_text('<http://imdb.org/a/1> <http://x/p> "C:\\\\new \\u00e9\\U0001F600 \\t\\"q\\"" .\n_:b <http://x/p> "v" .\n\n# note\nnonsense\n<http://imdb.org/a/2> <http://x/p> <http://imdb.org/b/3> .\n')
    got = sorted((r["subject"], r["object"], r["is_literal"]) for r in rdf.read_ntriples(spark, str(nt)).collect())
    assert got == [("http://imdb.org/a/1", 'C:\\new \u00e9\U0001f600 \t"q"', True), ("http://imdb.org/a/2", "http://imdb.org/b/3", False)]
    skipped = rdf.skipped_ntriples(spark, str(nt)).collect()
    assert [r["value"] for r in skipped] == ['_:b <http://x/p> "v" .', "nonsense"] and all(r["path"].endswith("x.nt") for r in skipped)
    ttl = tmp_path / "x.ttl"
    ttl.write_text("""@prefix r: <http://dbpedia.org/resource/> .
        r:One r:p 'single \\\\n \\u0041' , \"\"\"long "quoted"
line\"\"\" ; r:q 1.5e3 , true , r:Two .
        r:Bad r:p [ r:q "x" ] ; r:r r:Two .
        _:x r:p r:One . r:List r:p (1 2) . r:Junk ~ r:p .
        r:Two a r:Kind .
        r:Open r:p "never ends""")
    got = sorted((r["subject"].rsplit("/", 1)[1], r["object"], r["is_literal"]) for r in rdf.read_turtle(spark, str(ttl)).collect())
    assert got == sorted([("One", "single \\n A", True), ("One", 'long "quoted"\nline', True), ("One", "1.5e3", True), ("One", "true", True), ("One", "http://dbpedia.org/resource/Two", False), ("Two", "http://dbpedia.org/resource/Kind", False)])
    assert rdf.skipped_turtle(spark, str(ttl)).count() == 5
    empty = tmp_path / "e.ttl"
    empty.write_text("")
    assert rdf.read_turtle(spark, str(empty)).count() == 0


def test_broken_change_files_and_repeated_attributes(spark, tmp_path):
    pairs = [{"attrName": "n", "attrValue": "b"}, {"attrName": "n", "attrValue": "a"}, {"attrName": "m", "attrValue": None}, {"attrName": None, "attrValue": "x"}]
    (tmp_path / changes.FILE.format(0, 1)).write_text(json.dumps([{"id": 1, "typeOfChange": "insertVertex", "vertex": {"vertexURI": "u", "types": ["x"], "allAttributesList": pairs}}]))
    assert changes.read_changes(spark, str(tmp_path), 2).first()["attrs"] == {"n": "a", "m": None}
    for k, text in enumerate(('[{"id": 1, "typeOfChange": "insertEdge"}, {"id"', "", "no json")):
        folder = tmp_path / str(k)
        folder.mkdir()
        (folder / changes.FILE.format(0, 1)).write_text(text)
        with pytest.raises(Exception, match="no JSON array of changes|MALFORMED"):
            changes.read_changes(spark, str(folder), 2).collect()


def test_change_files_that_the_engine_wrote_are_whole(spark, tmp_path):
    for t in (1, 2, 3):  # folders of one text file
        rows = json.dumps([{"id": t, "typeOfChange": "insertEdge", "src": "a", "dst": f"b{k}", "label": "l"} for k in range(t)])
        spark.createDataFrame([(rows,)], "value string").write.text(f"{tmp_path}/{changes.FILE.format(t - 1, t)}")
    out = str(tmp_path / "read")
    changes.read_changes(spark, str(tmp_path), 4).write.parquet(out)
    assert {r["t"]: r["count"] for r in spark.read.parquet(out).groupBy("t").count().collect()} == {1: 1, 2: 2, 3: 3}
    part = next((tmp_path / changes.FILE.format(1, 2)).glob("part-*"))
    part.write_text("")
    with pytest.raises(Exception, match="no JSON array of changes: step 2"):
        changes.read_changes(spark, str(tmp_path), 4).write.parquet(str(tmp_path / "again"))


def test_rebinding_and_jobs(spark):
    a = first_graph(spark)
    b = Graph(spark.createDataFrame([(0, "u1", "person", {"age": "5"}), (0, "u2", "town", {}), (0, "u9", "person", {})], VERTICES), a.edges)
    g = snapshots.rebind(a, b)
    assert {(r["uri"], r["vtype"]): r["attrs"] for r in g.vertices.collect()} == {("u1", "person"): {"age": "5"}} and g.edges.count() == 0
    jobs = fragment_jobs(a, spark.createDataFrame([("u1", 3), ("u2", 4)], "uri string, fragment int"), "person")
    assert [tuple(r) for r in jobs.collect()] == [(0, "u1", 3)]


def test_rule_lines_round_trip(spark, tmp_path):
    lit = "struct<vtype:string,attr:string,val:string>"
    rule = spark.createDataFrame([([("film", "genre", "drama"), ("actor", "name", "x")], ("country", "name", "usa"), 1, 3, 0.15, 3)], f"x array<{lit}>, y {lit}, dmin int, dmax int, support double, level int")
    line = sinks.rule_lines(rule).first()["value"]
    assert line == "TGFD{dependency=DataDependency{x=[ConstantLiteral{vertexType='film', attrName='genre', attrValue='drama'}, ConstantLiteral{vertexType='actor', attrName='name', attrValue='x'}], y=[ConstantLiteral{vertexType='country', attrName='name', attrValue='usa'}]}, delta=Pair(min=1, max=3), tgfdSupport=0.15, level=3}"
    years = "TGFD{dependency=DataDependency{x=[ConstantLiteral{vertexType='b', attrName='n', attrValue='1'}, ConstantLiteral{vertexType='a', attrName='n', attrValue='2'}], y=[ConstantLiteral{vertexType='c', attrName='m', attrValue='3'}]}, delta=Delta{min=P2Y, max=P11Y}, support=8.0E-5}"
    other = sinks.parse_rule_lines(spark.createDataFrame([(years,), ("no rule",)], "value string")).collect()
    assert [([tuple(x) for x in r["x"]], tuple(r["y"]), r["dmin"], r["dmax"], r["support"], r["level"]) for r in other] == [([("a", "n", "2"), ("b", "n", "1")], ("c", "m", "3"), 2, 11, 8e-5, 0)]
    sinks.write_rules(rule, str(tmp_path))
    back = sinks.read_rules(spark, str(tmp_path)).first()
    assert [tuple(x) for x in back["x"]] == [("actor", "name", "x"), ("film", "genre", "drama")] and tuple(back["y"]) == ("country", "name", "usa")
    assert (back["dmin"], back["dmax"], back["support"], back["level"]) == (1, 3, 0.15, 3)


def test_induced_matches(spark):
    v = spark.createDataFrame([(0, u, "x", {}) for u in "abcd"], VERTICES)
    e = spark.createDataFrame([(0, "a", "b", "p"), (0, "b", "c", "q"), (0, "b", "d", "q"), (0, "a", "d", "r")], EDGES)
    got = match_induced(Graph(v, e), [("i", "*", "j"), ("j", "q", "k")], {"i": "x"}).collect()
    assert [(r["i"], r["j"], r["k"]) for r in got] == [("a", "b", "c")]  # a-d is an edge that the pattern lacks
