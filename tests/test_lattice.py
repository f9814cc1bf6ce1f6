"""Patterns and dependencies, without Spark."""

import pytest

from kairograph.model import Dependency, Edge, Pattern, Shape
from kairograph.plans import lattice

AB, BC, CD, AD, XB = Edge("a", "p", "b"), Edge("b", "q", "c"), Edge("c", "r", "d"), Edge("a", "s", "d"), Edge("x", "w", "b")


def test_growth_by_one_edge_with_exactly_one_end_inside():
    level = lattice.seeds(["a", "b"])
    first = lattice.grow(level, [AB, BC, Edge("x", "u", "y")])
    assert [n.pattern.name for n in first] == ["a-p->b", "b-q->c"]
    assert [p.pattern.name for p in first[0].parents] == ["a", "b"]
    second = lattice.grow(first, [AB, BC])
    assert [n.pattern.name for n in second] == ["a-p->b;b-q->c"]
    assert second[0].pattern.center == "b" and len(second[0].parents) == 2
    assert lattice.grow(second, [AB, BC, Edge("c", "z", "a")]) == []  # no cycles


def test_pruned_patterns_do_not_grow_and_bar_larger_ones_of_their_centre():
    level = lattice.seeds(["a", "b", "c"])
    first = lattice.grow(level, [AB, BC])
    first[0].pruned = True  # a-p->b, centred on a
    second = lattice.grow(first, [AB, BC, CD])
    assert [(n.pattern.name, n.pattern.center) for n in second] == [("a-p->b;b-q->c", "b"), ("b-q->c;c-r->d", "c")]
    first[0].pruned, first[1].pruned = False, True  # b-q->c, centred on b
    assert [n.pattern.name for n in lattice.grow(first, [AB, BC, AD])] == ["a-p->b;a-s->d"]
    # a pruned type bars what is centred on it, and only that
    level[1].pruned = True
    assert [n.pattern.center for n in lattice.grow(level, [AB, BC])] == ["a", "c"]
    assert lattice.grow(lattice.grow(level, [AB]), [BC], level) == []


def test_parents_of_the_same_centre():
    level = lattice.seeds(["a", "b", "c"])
    first = lattice.grow(level, [AB, BC])
    assert [n.center_parent.pattern.name for n in first] == ["a", "b"]
    second = lattice.grow(first, [AB, BC])
    assert second[0].pattern.center == "b" and second[0].center_parent is first[1]
    d = Dependency(("a__m",), "b__n")
    assert lattice.attributes_of(second[0].pattern, d) == {"a": ["m"], "b": ["n"], "c": []}
    second[0].minimal_constant, first[0].minimal_constant = [d], [Dependency(("b__n",), "a__m")]
    assert second[0].inherited(constant=True) == [d, Dependency(("b__n",), "a__m")] and second[0].inherited() == []


def test_edges_already_there_ignore_case_of_labels():
    assert lattice.has_edge(Pattern(("a", "b"), (AB,)), Edge("a", "P", "b"))


@pytest.mark.parametrize(
    ("vertices", "edges", "shape"),
    [
        (("a",), (), Shape.SINGLE_NODE),
        (("a", "b"), (AB,), Shape.SINGLE_EDGE),
        (("a", "b", "c"), (AB, BC), Shape.DOUBLE_EDGE),
        (("a", "b", "c", "x"), (AB, BC, XB), Shape.STAR),
        (("a", "b", "c", "d"), (AB, BC, CD), Shape.LINE),
        (("a", "b", "c", "d"), (AB, BC, CD, AD), Shape.CIRCLE),
        (("a", "b", "c", "d", "x"), (AB, BC, CD, XB), Shape.COMPLEX),
    ],
)
def test_shapes(vertices, edges, shape):
    assert Pattern(vertices, edges).shape == shape


def test_dependencies_take_one_attribute_of_each_type():
    p = Pattern(("a", "b", "c"), (AB, BC))
    found = lattice.dependencies(p, {v: ["m", "n"] for v in "abc"})
    assert len(found) == 3 * 2 * 2 * 2 and len(set(found)) == 24
    with pytest.raises(ValueError):
        lattice.dependencies(p, {v: ["m", "n"] for v in "abc"}, most=10)
    assert lattice.dependencies(p, {"a": ["m"], "b": ["m"]}) == []


def test_minimal_dependencies_cover_larger_ones_of_descendants():
    small, large, other = Dependency(("a__m",), "b__m"), Dependency(("a__m", "c__m"), "b__m"), Dependency(("a__m",), "c__m")
    assert lattice.unpruned([small, large, other], [small]) == [other]
    parent, child = lattice.seeds(["a", "b"])
    parent.minimal, child.parents = [small], [parent]
    assert child.inherited() == [small]
    assert lattice.covers_types([("a", "m"), ("b", "m")], Pattern(("a", "b"), (AB,)))
    assert not lattice.covers_types([("a", "m")], Pattern(("a", "b"), (AB,)))
