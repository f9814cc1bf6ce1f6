"""Graphs as DataFrames, patterns and dependencies as small driver-side values."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import DataFrame

VERTICES = "t int, uri string, vtype string, attrs map<string,string>"
EDGES = "t int, src string, dst string, label string"
CHANGES = "t int, seq long, id int, op string, src string, dst string, label string, uri string, attr string, val string, vtype string, new_vtype string, attrs map<string,string>"


@dataclass(frozen=True)
class Graph:
    """Snapshots 0..T-1 in two tables: ``vertices`` (t, uri, vtype, attrs), one row per (t, uri), and ``edges``
    (t, src, dst, label), one row per (t, src, dst)."""

    vertices: DataFrame
    edges: DataFrame

    def at(self, t: int) -> Graph:
        return Graph(self.vertices.where(f"t = {t}"), self.edges.where(f"t = {t}"))


@dataclass(frozen=True, order=True)
class Edge:
    src: str
    label: str
    dst: str

    def other(self, vtype: str) -> str:
        return self.dst if vtype == self.src else self.src


class Shape(Enum):
    SINGLE_NODE = "single node"
    SINGLE_EDGE = "single edge"
    DOUBLE_EDGE = "double edge"
    STAR = "star"
    LINE = "line"
    CIRCLE = "circle"
    COMPLEX = "complex"


@dataclass(frozen=True)
class Pattern:
    """A tree of distinct vertex types around a centre type; ``vertices`` in the order of joining."""

    vertices: tuple[str, ...]
    edges: tuple[Edge, ...] = ()
    center: str = ""

    def __post_init__(self) -> None:
        if not self.center:
            object.__setattr__(self, "center", self.vertices[0])

    @property
    def key(self) -> frozenset[Edge]:
        return frozenset(self.edges)

    @property
    def name(self) -> str:
        return ";".join(f"{e.src}-{e.label}->{e.dst}" for e in sorted(self.edges)) or self.vertices[0]

    def degree(self, vtype: str) -> int:
        return sum((e.src == vtype) + (e.dst == vtype) for e in self.edges)

    def incident(self, vtype: str) -> list[Edge]:
        return [e for e in self.edges if vtype in (e.src, e.dst)]

    def depth(self) -> int:
        """Edges from the centre to the farthest vertex."""
        seen, frontier, n = {self.center}, [self.center], 0
        while True:
            frontier = [e.other(v) for v in frontier for e in self.incident(v) if e.other(v) not in seen]
            if not frontier:
                return n
            seen.update(frontier)
            n += 1

    @property
    def shape(self) -> Shape:
        """By degrees. A pattern with as many edges as vertices, all of degree two, is a circle."""
        n, degrees = len(self.edges), [self.degree(v) for v in self.vertices]
        if n == 0:
            return Shape.SINGLE_NODE
        if n == 1:
            return Shape.SINGLE_EDGE
        if n == 2:
            return Shape.DOUBLE_EDGE
        if max(degrees) == n and len(degrees) == n + 1:
            return Shape.STAR
        if n == len(degrees) and set(degrees) == {2}:
            return Shape.CIRCLE
        if n == len(degrees) - 1 and max(degrees) <= 2:
            return Shape.LINE
        return Shape.COMPLEX


@dataclass(frozen=True)
class Dependency:
    """lhs -> rhs over columns ``vtype__attr``."""

    lhs: tuple[str, ...]
    rhs: str

    @property
    def name(self) -> str:
        return f"{','.join(self.lhs)}->{self.rhs}"

    def covers(self, other: Dependency) -> bool:
        """Same right side, and a left side that holds all of the other's."""
        return self.rhs == other.rhs and set(self.lhs) >= set(other.lhs)


@dataclass
class PatternNode:
    """A pattern in the lattice."""

    pattern: Pattern
    level: int
    support: float | None = None
    parents: list[PatternNode] = field(default_factory=list)
    center_parent: PatternNode | None = None
    pruned: bool = False
    minimal: list[Dependency] = field(default_factory=list)
    minimal_constant: list[Dependency] = field(default_factory=list)

    def inherited(self, constant: bool = False) -> list[Dependency]:
        """Minimal dependencies, or minimal constant ones, of this pattern and all its ancestors."""
        out = list(self.minimal_constant if constant else self.minimal)
        for p in self.parents:
            out += [d for d in p.inherited(constant) if d not in out]
        return out


def column(vtype: str, attr: str) -> str:
    return f"{vtype}__{attr}"


def split_column(name: str) -> tuple[str, str]:
    vtype, _, attr = name.partition("__")
    return vtype, attr
