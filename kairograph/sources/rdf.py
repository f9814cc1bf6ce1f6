"""RDF graphs: statements of N-Triples or Turtle files, and the two mappings to property graphs.

N-Triples is line-based and read as text, so files split. Turtle is not; each file is one task."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.functions import parse_resource_uri
from kairograph.functions.expressions import ENCYCLOPEDIA_PREFIX, MOVIE_PREFIX
from kairograph.model import Graph
from kairograph.tables import ship

# Fixed value: the property that states the type of a resource.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
STATEMENTS = "subject string, predicate string, object string, is_literal boolean"
_LINE = r'^\s*<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


_ESCAPE = r"\\(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|[tbnrf\"'\\])"
# What follows a backslash, and what both stand for.
ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _unescaped(c: Column) -> Column:
    """Escapes undone from left to right, each once."""
    pieces, found = F.split(c, _ESCAPE, -1), F.regexp_extract_all(c, F.lit(_ESCAPE), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])
    code = lambda e: F.decode(F.unhex(F.lpad(F.substring(e, 3, 8), 8, "0")), "UTF-32")
    meant = lambda e: F.coalesce(F.try_element_at(table, F.substring(e, 2, 1)), code(e))
    rest = F.zip_with(found, F.slice(pieces, F.lit(2), F.size(found)), lambda e, p: F.concat(meant(e), p))
    return F.when(c.contains("\\"), F.concat(pieces[0], F.array_join(rest, ""))).otherwise(c)


def skipped_ntriples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines that ``read_ntriples`` skips though they are neither empty nor comments: path, value."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value")
    return lines.where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def read_ntriples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """subject, predicate, object, is_literal. Lines that are no triple between resources and literals (blank
    nodes, comments, errors) are skipped; ``skipped_ntriples`` gives them."""
    lines = spark.read.text(path).where(F.col("value").rlike(_LINE))
    part = lambda k: F.regexp_extract("value", _LINE, k)
    resource = part(3) != ""
    return lines.select(part(1).alias("subject"), part(2).alias("predicate"), F.when(resource, part(3)).otherwise(_unescaped(part(4))).alias("object"), (~resource).alias("is_literal"))


_STRINGS = r'''(?P<long>"""(?:[^\\]|\\.)*?"""|''' + r"""'''(?:[^\\]|\\.)*?''')|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
_TOKEN = re.compile(r"""\s+|\#[^\n]*|(?P<iri><[^>\s]*>)|""" + _STRINGS + r"""|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)|(?P<type>\^\^)|(?P<blank>_:[\w.-]*\w)|(?P<name>[A-Za-z][\w.-]*?:[\w.%/-]*[\w%/-]|[A-Za-z][\w-]*:|:[\w%/-]+|:)|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<word>a\b|true\b|false\b)|(?P<punct>[;,.\[\]()])""", re.S)
_ESCAPED = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)


def _plain(text: str) -> str:
    return _ESCAPED.sub(lambda e: chr(int(e[1] or e[2], 16)) if e[1] or e[2] else ESCAPES.get(e[3], e[3]), text)


def _statements(text: str) -> Iterator[list[tuple[str, str]]]:
    """Tokens (kind, text) up to each full stop; what is no token is one of kind ``error``."""
    at, out = 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        kind, token = (m.lastgroup, m.group()) if m else ("error", text[at])
        at += len(token)
        if kind == "punct" and token == ".":
            yield out
            out = []
        elif kind is not None:
            out.append((kind, token))
    if out:
        yield [*out, ("error", "")]  # a last statement without its stop


def turtle_statements(text: str) -> Iterator[tuple[str | None, str | None, str, bool]]:
    """Statements of the part of Turtle that data sets use: prefixes, ``a``, lists by ; and , ; literals lose
    language and type. A statement with blank nodes, collections or errors is skipped; it gives one row without subject, whose
    object is its text."""
    prefixes: dict[str, str] = {}
    for tokens in _statements(text):
        if tokens and tokens[0] in (("lang", "@prefix"), ("lang", "@base")):
            if len(tokens) == 3:
                prefixes[tokens[1][1]] = tokens[2][1][1:-1]
            continue
        found, subject, predicate, skip, bad = [], None, None, False, False
        for kind, token in tokens:
            if kind in ("blank", "error") or kind == "punct" and token in "[]()":
                bad = True
                break
            if kind == "type":
                skip = True
            elif skip or kind == "lang":
                skip = False
            elif token == ";" and kind == "punct":
                predicate = None
            elif kind != "punct":
                literal = kind in ("str", "long", "num") or token in ("true", "false")
                if kind == "iri":
                    value = _plain(token[1:-1])
                elif kind == "long":
                    value = _plain(token[3:-3])
                elif kind == "str":
                    value = _plain(token[1:-1])
                elif kind == "name":
                    prefix, _, rest = token.partition(":")
                    value = prefixes.get(prefix + ":", prefix + ":") + rest
                else:
                    value = RDF_TYPE if token == "a" else token
                if subject is None:
                    subject, bad = value, bad or literal
                elif predicate is None:
                    predicate, bad = value, bad or literal
                else:
                    found.append((subject, predicate, value, literal))
        if bad:
            yield None, None, " ".join(token for _, token in tokens), False
        else:
            yield from found


def _turtle(spark: SparkSession, path: str | list[str]) -> DataFrame:
    ship(spark)
    return spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("path")).mapInPandas(_parse_turtle, f"path string, {STATEMENTS}")


def _parse_turtle(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for text, path in zip(pdf["value"], pdf["path"], strict=True):
            rows = turtle_statements(text)
            while part := list(islice(rows, 50_000)):
                out = pd.DataFrame(part, columns=["subject", "predicate", "object", "is_literal"])
                out.insert(0, "path", path)
                yield out


def read_turtle(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``read_ntriples``; one file is parsed by one task. Statements that are not read are skipped; ``skipped_turtle`` gives them."""
    return _turtle(spark, path).where("subject is not null").drop("path")


def skipped_turtle(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The statements that ``read_turtle`` skips: path, value."""
    return _turtle(spark, path).where("subject is null").select("path", F.col("object").alias("value"))


def _one_each(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst): the smallest label."""
    return edges.groupBy("src", "dst").agg(F.min("label").alias("label"))


def _attributes(rows: DataFrame) -> DataFrame:
    """uri -> map; of several values of a name the least."""
    least = rows.groupBy("uri", "attr").agg(F.min("val").alias("val"))
    return least.groupBy("uri").agg(F.map_from_entries(F.collect_list(F.struct("attr", "val"))).alias("attrs"))


def _graph(vertices: DataFrame, attributes: DataFrame, edges: DataFrame, t: int) -> Graph:
    empty = F.expr("cast(map() as map<string,string>)")
    v = vertices.join(attributes, "uri", "left").select(F.lit(t).alias("t"), "uri", "vtype", F.coalesce("attrs", empty).alias("attrs"))
    return Graph(v, _one_each(edges).select(F.lit(t).alias("t"), "src", "dst", "label"))


def movie_graph(statements: DataFrame, t: int = 0, prefix: int = MOVIE_PREFIX) -> Graph:
    """Resources ``<type>/<id>`` become vertices ``<id>-<type>``; literals become attributes, resources edges to
    vertices that need no statements of their own. Names are local and in lower case. Statements with a
    resource that lacks either part are skipped."""
    s = statements.select(parse_resource_uri(F.col("subject"), prefix).alias("s"), F.lower(F.substring_index("predicate", "/", -1)).alias("name"), F.col("object"), "is_literal", parse_resource_uri(F.col("object"), prefix).alias("o")).where("s is not null")
    facts = s.where("is_literal").select(F.col("s.vertex_uri").alias("uri"), F.col("name").alias("attr"), F.lower("object").alias("val"))
    links = s.where("not is_literal and o is not null")
    ends = s.select(F.col("s.vertex_uri").alias("uri"), F.col("s.vtype").alias("vtype")).unionByName(links.select(F.col("o.vertex_uri").alias("uri"), F.col("o.vtype").alias("vtype")))
    edges = links.select(F.col("s.vertex_uri").alias("src"), F.col("o.vertex_uri").alias("dst"), F.col("name").alias("label"))
    return _graph(ends.groupBy("uri").agg(F.min("vtype").alias("vtype")), _attributes(facts), edges, t)


def encyclopedia_graph(statements: DataFrame, t: int = 0, types: list[str] | None = None, prefix: int = ENCYCLOPEDIA_PREFIX) -> Graph:
    """``rdf:type`` statements make vertices (the least type, of those asked for); of the others, literals become attributes
    and resources edges, where both ends are vertices and differ. Subjects and objects lose the same prefix."""
    name = lambda c: F.lower(F.substring(c, prefix + 1, 1 << 30))
    last = lambda c: F.lower(F.regexp_extract(c, r"([^/#]*)$", 1))
    kinds = statements.where(F.col("predicate") == RDF_TYPE).select(name("subject").alias("uri"), last("object").alias("vtype"))
    if types is not None:
        kinds = kinds.where(F.col("vtype").isin(types))
    vertices = kinds.groupBy("uri").agg(F.min("vtype").alias("vtype"))
    rest = statements.where(F.col("predicate") != RDF_TYPE).select(name("subject").alias("uri"), last("predicate").alias("attr"), "object", "is_literal")
    known = vertices.select("uri")
    facts = rest.where("is_literal").join(known, "uri", "left_semi").select("uri", "attr", F.lower("object").alias("val"))
    edges = rest.where("not is_literal").select(F.col("uri").alias("src"), name("object").alias("dst"), F.col("attr").alias("label")).where("src <> dst")
    edges = edges.join(known.withColumnRenamed("uri", "src"), "src", "left_semi").join(known.withColumnRenamed("uri", "dst"), "dst", "left_semi")
    return _graph(vertices, _attributes(facts), edges, t)


def load_snapshots(spark: SparkSession, paths: list[str], dataset: str = "imdb", types: list[str] | None = None) -> Graph:
    """One graph file for each snapshot, in order. dataset: ``imdb`` (movie mapping) or ``dbpedia`` (encyclopedia
    mapping). Files that end in .ttl are Turtle, others N-Triples."""
    out = None
    for t, path in enumerate(paths):
        rows = read_turtle(spark, path) if path.endswith(".ttl") else read_ntriples(spark, path)
        if dataset == "imdb":
            g = movie_graph(rows, t)
        elif dataset == "dbpedia":
            g = encyclopedia_graph(rows, t, types)
        else:
            raise ValueError(f"no data set {dataset!r}")
        out = g if out is None else Graph(out.vertices.unionByName(g.vertices), out.edges.unionByName(g.edges))
    return out


def fragments(spark: SparkSession, paths: list[str]) -> DataFrame:
    """uri -> number of the fragment file that holds it as a subject; of several the last."""
    out = None
    for k, path in enumerate(paths):
        part = read_ntriples(spark, path).select(parse_resource_uri(F.col("subject")).alias("s")).where("s is not null").select(F.col("s.vertex_uri").alias("uri"), F.lit(k).alias("fragment"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("uri").agg(F.max("fragment").alias("fragment"))
