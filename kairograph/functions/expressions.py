"""Scalar expressions: counts of pairs, supports, intervals, names."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters before <type>/<id> in resources of the movie data set, and before the name in those of the
#: encyclopedia data set.
MOVIE_PREFIX, ENCYCLOPEDIA_PREFIX = 16, 28


def choose(n: Column, k: int) -> Column:
    """n over k, as bigint; 0 where n < k."""
    out = F.lit(1).cast("long")
    for i in range(k):
        out = out * (n.cast("long") - i)
    bottom = 1
    for i in range(2, k + 1):
        bottom *= i
    return F.when(n >= k, (out / bottom).cast("long")).otherwise(F.lit(0).cast("long"))


def pair_count(n: Column) -> Column:
    """Pairs of n snapshots."""
    return choose(n, 2)


def _ratio(numerator: Column, denominator: Column) -> Column:
    """0 where the numerator exceeds the denominator, by the documented rule, or nothing is there."""
    return F.when((denominator <= 0) | (numerator > denominator), F.lit(0.0)).otherwise(numerator.cast("double") / denominator.cast("double"))


def pattern_support(numerator: Column, centers: Column, timestamps: int) -> Column:
    """Pairs over those possible for the centre vertices of the first snapshot."""
    return _ratio(numerator, centers * F.lit(comb(timestamps + 1, 2)).cast("long"))


def rule_support(pairs: Column, entities: Column, timestamps: int) -> Column:
    return _ratio(pairs, entities * F.lit(comb(timestamps + 1, 2)).cast("long"))


def delta_of(times: Column) -> Column:
    """Array of distinct snapshots -> struct(dmin, dmax): least gap between neighbours, and last less
    first; null below two snapshots."""
    s = F.array_sort(times)
    gaps = F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(1))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1))), lambda b, a: b - a)
    return F.when(F.size(s) >= 2, F.struct(F.array_min(gaps).cast("int").alias("dmin"), (F.element_at(s, -1) - F.element_at(s, 1)).cast("int").alias("dmax")))


def overlaps(amin: Column, amax: Column, bmin: Column, bmax: Column) -> Column:
    """Closed intervals that share a point."""
    return (amax >= bmin) & (amin <= bmax)


def fold_intervals(intervals: Column) -> Column:
    """array<struct<dmin,dmax>> -> the same type: in order, an interval that overlaps the last one shrinks
    it to what both share, any other starts anew."""
    kind = "array<struct<dmin:int,dmax:int>>"
    empty = F.array().cast(kind)

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        both = F.struct(F.greatest(last["dmin"], x["dmin"]).alias("dmin"), F.least(last["dmax"], x["dmax"]).alias("dmax"))
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        joined = F.when(last["dmax"] >= x["dmin"], F.concat(head, F.array(both))).otherwise(F.concat(done, F.array(x)))
        return F.when(F.size(done) == 0, F.array(x)).otherwise(joined).cast(kind)

    return F.aggregate(F.array_sort(intervals.cast(kind)), empty, step)


def local_name(uri: Column) -> Column:
    """What follows the last slash, in lower case."""
    return F.lower(F.substring_index(uri, "/", -1))


def parse_resource_uri(uri: Column, prefix: int = MOVIE_PREFIX) -> Column:
    """Movie resource -> struct(vtype, id, vertex_uri): lower case, without the prefix, ``<type>/<id>`` with the id
    URL-decoded; the vertex is ``<id>-<type>``. Null for anything without both parts."""
    parts = F.split(F.substring(F.lower(uri), prefix + 1, 1 << 30), "/", -1)
    vtype, name = F.try_element_at(parts, F.lit(1)), F.try_url_decode(F.try_element_at(parts, F.lit(2)))
    whole = vtype.isNotNull() & (vtype != "") & name.isNotNull() & (name != "")
    return F.when(whole, F.struct(vtype.alias("vtype"), name.alias("id"), F.concat(name, F.lit("-"), vtype).alias("vertex_uri")))
