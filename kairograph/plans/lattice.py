"""Growth of patterns and dependencies: small driver-side values, no data."""

from __future__ import annotations

from itertools import product

from kairograph.model import Dependency, Edge, Pattern, PatternNode, column, split_column
from kairograph.operators.matching import Active


def seeds(types: list[str]) -> list[PatternNode]:
    """One pattern of a single vertex for each frequent type."""
    return [PatternNode(Pattern((v,)), 0) for v in types]


def recentred(p: Pattern) -> Pattern:
    """With more than two vertices the centre moves to the first vertex of strictly larger degree; its type
    is the centre type everywhere."""
    if len(p.vertices) <= 2:
        return p
    best = p.center
    for v in p.vertices:
        if p.degree(v) > p.degree(best):
            best = v
    return Pattern(p.vertices, p.edges, best)


def extend(p: Pattern, e: Edge) -> Pattern | None:
    """The pattern with one more edge and vertex; None unless exactly one end is inside. So patterns stay
    trees of distinct types."""
    inside = [v for v in (e.src, e.dst) if v in p.vertices]
    if len(inside) != 1:
        return None
    return recentred(Pattern((*p.vertices, e.other(inside[0])), (*p.edges, e), p.center))


def has_edge(p: Pattern, e: Edge) -> bool:
    """The pattern already joins these types by this label, whatever its case."""
    return any(x.label.lower() == e.label.lower() and {x.src, x.dst} == {e.src, e.dst} for x in p.edges)


def grow(level: list[PatternNode], edges: list[Edge], above: list[PatternNode] = ()) -> list[PatternNode]:
    """Patterns one edge larger than the unpruned ones of a level: each once, none that holds a pruned
    pattern of the same centre type, with all patterns of the level that they hold as parents."""
    out: list[PatternNode] = []
    made: set[frozenset[Edge]] = set()
    pruned = [n for n in (*above, *level) if n.pruned]
    for node in level:
        if node.pruned:
            continue
        for e in edges:
            if has_edge(node.pattern, e):
                continue
            new = extend(node.pattern, e)
            if new is None or new.key in made:
                continue
            if any(barred(new, n.pattern) for n in pruned):
                continue
            made.add(new.key)
            kept = [n for n in level if not n.pruned]
            out.append(PatternNode(new, node.level + 1, parents=[n for n in kept if holds(new, n.pattern)], center_parent=center_parent(new, kept)))
    return out


def barred(new: Pattern, pruned: Pattern) -> bool:
    """Supports count centres, so they say nothing across centre types; a pruned single vertex bars all that is centred on it."""
    return new.center == pruned.center and pruned.key <= new.key


def center_parent(new: Pattern, level: list[PatternNode]) -> PatternNode | None:
    """The node with the same edges and centre type, else the first with the same centre type."""
    same = [n for n in level if n.pattern.center == new.center]
    return next((n for n in same if n.pattern.key == new.key), same[0] if same else None)


def holds(large: Pattern, small: Pattern) -> bool:
    """By edges, or for a single vertex by its type."""
    return small.vertices[0] in large.vertices if not small.edges else small.key <= large.key


def dependencies(p: Pattern, active: Active, most: int | None = None) -> list[Dependency]:
    """One active attribute of every vertex type, each of them in turn on the right."""
    out = []
    for chosen in product(*[[column(v, a) for a in sorted(active.get(v, []))] for v in p.vertices]):
        for rhs in chosen:
            out.append(Dependency(tuple(sorted(c for c in chosen if c != rhs)), rhs))
            if most is not None and len(out) > most:
                raise ValueError(f"more than {most} dependencies; fewer active attributes or a larger bound are needed")
    return out


def unpruned(found: list[Dependency], minimal: list[Dependency]) -> list[Dependency]:
    """Dependencies that no minimal one makes redundant."""
    return [d for d in found if not any(d.covers(m) for m in minimal)]


def attributes_of(p: Pattern, d: Dependency) -> dict[str, list[str]]:
    """The pattern's vertices with the attributes that a dependency names on them."""
    named = [split_column(c) for c in (*d.lhs, d.rhs)]
    return {v: sorted(a for u, a in named if u == v) for v in p.vertices}


def covers_types(path: list[tuple[str, str]], p: Pattern) -> bool:
    """The (type, attribute) pairs of a path touch every vertex type."""
    return set(p.vertices) <= {v for v, _ in path}


def total_support(nodes: list[PatternNode]) -> float:
    """Sum of the supports of unpruned patterns."""
    return sum(n.support or 0.0 for n in nodes if not n.pruned)
