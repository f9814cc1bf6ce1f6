"""From matches to rules: groups of values, intervals, supports, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kairograph.functions import delta_of, fold_intervals, overlaps, pair_count, rule_support
from kairograph.model import Dependency, split_column

LITERAL = "struct<vtype:string,attr:string,val:string>"
#: Dependencies spelt out in one expression; more are handled in several plans that share the matches.
AT_ONCE = 48


def _literal(name: str) -> str:
    vtype, attr = (part.replace("'", "\\'") for part in split_column(name))
    return f"named_struct('vtype', '{vtype}', 'attr', '{attr}', 'val', `{name}`)"


def _row(d: Dependency) -> str:
    full = " AND ".join(f"`{c}` IS NOT NULL" for c in (*d.lhs, d.rhs))
    x = ", ".join(_literal(c) for c in sorted(d.lhs))
    name = d.name.replace("'", "\\'")
    return f"CASE WHEN {full} THEN named_struct('dep', '{name}', 'x', array({x}), 'y', {_literal(d.rhs)}) END"


def value_groups(matches: DataFrame, dependencies: list[Dependency]) -> DataFrame:
    """matches: t and columns ``vtype__attr``. Per dependency the groups (dep, x, y, t, n): how many matches
    of a snapshot have these values left and right; rows that lack one of them do not count. One pass
    over the matches serves ``AT_ONCE`` dependencies, and counts are combined before the shuffle."""
    out = None
    for s in range(0, len(dependencies), AT_ONCE):
        each = ", ".join(_row(d) for d in dependencies[s : s + AT_ONCE])
        part = matches.select("t", F.explode(F.expr(f"array({each})")).alias("r")).where("r is not null").select("r.dep", "r.x", "r.y", "t").groupBy("dep", "x", "y", "t").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def choice_groups(choices: DataFrame) -> DataFrame:
    """choices: t and cells, as ``match_choices`` gives them, and more columns. Every cell in turn is the right side of the
    others: those columns, dep, x, y, t. Each group comes from one row, so nothing is shuffled."""
    name = lambda s: F.concat(s["vtype"], F.lit("__"), s["attr"])
    others = lambda y: F.filter("cells", lambda s: s["vtype"] != y["vtype"])
    sides = F.transform("cells", lambda y: F.struct(F.concat(F.array_join(F.transform(others(y), name), ","), F.lit("->"), name(y)).alias("dep"), others(y).alias("x"), y.alias("y")))
    rest = [c for c in choices.columns if c not in ("t", "cells")]
    return choices.select(*rest, "t", F.explode(sides).alias("s")).select(*rest, "s.dep", "s.x", "s.y", "t")


def entity_counts(groups: DataFrame, by: tuple[str, ...] = ("dep",)) -> DataFrame:
    """dep -> number of distinct left sides."""
    return groups.select(*by, "x").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("entities"))


def ranked_values(groups: DataFrame) -> DataFrame:
    """Right sides of an entity by how often they occur: dep, x, y, n, rank."""
    total = groups.groupBy("dep", "x", "y").agg(F.sum("n").alias("n"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("dep", "x").orderBy(F.desc("n"), "y")))


def occurrences(groups: DataFrame, by: tuple[str, ...] = ("dep",)) -> DataFrame:
    """``by``, x, y, ts: the snapshots (at most T) that hold these values."""
    return groups.groupBy(*by, "x", "y").agg(F.collect_set("t").alias("ts"))


def intervals(groups: DataFrame) -> DataFrame:
    """dep, x, y, p (snapshots), dmin, dmax; pairs of values seen in one snapshot only are absent."""
    return _intervals(occurrences(groups))


def _intervals(times: DataFrame) -> DataFrame:
    rest = [c for c in times.columns if c != "ts"]
    return times.select(*rest, F.size("ts").alias("p"), delta_of(F.col("ts")).alias("d")).where("d is not null").select(*rest, "p", "d.dmin", "d.dmax")


def candidates(groups: DataFrame, timestamps: int, theta: float) -> DataFrame:
    """Constant rules at the threshold, before conflicts: dep, x, y, dmin, dmax, pairs, entities, support."""
    return candidates_of(occurrences(groups), timestamps, theta)


def candidates_of(times: DataFrame, timestamps: int, theta: float, by: tuple[str, ...] = ("dep",)) -> DataFrame:
    """As ``candidates``, from ``occurrences``."""
    out = _intervals(times).withColumn("pairs", pair_count(F.col("p"))).join(entity_counts(times, by), list(by))
    out = out.withColumn("support", rule_support(F.col("pairs"), F.col("entities"), timestamps))
    return out.where(F.col("support") >= theta).select(*by, "x", "y", "dmin", "dmax", "pairs", "entities", "support")


def without_conflicts(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rules of one left side and right attribute whose intervals share a point contradict each other, and
    all go. In order of their starts a rule conflicts if an earlier one reaches it or the next one
    starts within it, so one sort per group does it, without pairs."""
    by = by or ["dep", "x"]
    order = Window.partitionBy(*by).orderBy("dmin", "dmax", "y")
    reached = F.max("dmax").over(order.rowsBetween(Window.unboundedPreceding, -1))
    clash = F.coalesce(reached >= F.col("dmin"), F.lit(False)) | F.coalesce(F.lead("dmin").over(order) <= F.col("dmax"), F.lit(False))
    return found.withColumn("_clash", clash).where("not _clash").drop("_clash")


def conflict_pairs(found: DataFrame) -> DataFrame:
    """The contradicting pairs themselves: dep, x, y1 < y2."""
    a, b = (found.select("dep", "x", F.col("y").alias(f"y{k}"), F.col("dmin").alias(f"dmin{k}"), F.col("dmax").alias(f"dmax{k}")) for k in (1, 2))
    return a.join(b, ["dep", "x"]).where("y1 < y2").where(overlaps(F.col("dmin1"), F.col("dmax1"), F.col("dmin2"), F.col("dmax2"))).select("dep", "x", "y1", "y2")


def folded_intervals(found: DataFrame, by: list[str]) -> DataFrame:
    """Distinct intervals of each group, folded: ``by``, dmin, dmax. At most T squared intervals a group."""
    sets = found.groupBy(*by).agg(F.collect_set(F.struct(F.col("dmin").cast("int").alias("dmin"), F.col("dmax").cast("int").alias("dmax"))).alias("i"))
    return sets.select(*by, F.explode(fold_intervals(F.col("i"))).alias("d")).select(*by, "d.dmin", "d.dmax")


def general_rules(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One variable rule for each folded interval of a dependency's candidates."""
    return folded_intervals(found, by or ["dep"])


def with_variables(general: DataFrame) -> DataFrame:
    """Adds the sides of a rule between attributes, from the name of its dependency: x (array of (vtype, attr)), y, and support 0."""
    pair = lambda s: F.struct(F.substring_index(s, "__", 1).alias("vtype"), F.substring(s, F.length(F.substring_index(s, "__", 1)) + 3, F.lit(1 << 30)).alias("attr"))
    left, right = F.substring_index("dep", "->", 1), F.substring_index("dep", "->", -1)
    return general.withColumns({"x": F.transform(F.filter(F.split(left, ","), lambda s: s != ""), pair), "y": pair(right), "support": F.lit(0.0)})


def finalise_general(general: DataFrame, by: tuple[str, ...] = ("dep", "level")) -> DataFrame:
    """General rules of all patterns, folded by what they say: intervals of one dependency, found in several patterns,
    become one rule where they overlap. ``by``, dmin, dmax."""
    return folded_intervals(general, list(by))


def finalise_constants(found: DataFrame, timestamps: int, theta: float) -> DataFrame:
    """Constant rules of several runs as the result of one: equal ones merged, those below the threshold dropped,
    contradicting ones removed."""
    return without_conflicts(merge_rules(found, timestamps).where(F.col("support") >= theta))


def by_right_value(found: DataFrame) -> DataFrame:
    """Rules of one key grouped by the value on the right: key, val, rules (how many intervals)."""
    return with_keys(found).select("key", F.col("y.val").alias("val"), "dmin", "dmax").distinct().groupBy("key", "val").agg(F.count(F.lit(1)).alias("rules"))


def merge_rules(rules: DataFrame, timestamps: int) -> DataFrame:
    """Rules from several runs: equal (x, y) have their intervals folded. A left side and value whose fold is no
    shorter than its intervals keeps them; else the folded intervals take the sum of the pairs that
    went into it, and the support follows. Columns dep, x, y, dmin, dmax, pairs, entities, support."""
    by = ["dep", "x", "y"]
    own = rules.groupBy(*by, "dmin", "dmax").agg(F.max("pairs").alias("pairs"), F.max("entities").alias("entities"))
    sets = own.groupBy(*by).agg(F.collect_set(F.struct("dmin", "dmax", "pairs")).alias("i"), F.sum("pairs").alias("all_pairs"), F.max("entities").alias("entities"))
    folded = fold_intervals(F.transform("i", lambda s: F.struct(s["dmin"].alias("dmin"), s["dmax"].alias("dmax"))))
    out = sets.withColumn("f", folded)
    kept = F.size("f") == F.size("i")
    merged = F.transform("f", lambda d: F.struct(d["dmin"].alias("dmin"), d["dmax"].alias("dmax"), F.col("all_pairs").cast("long").alias("pairs")))
    as_is = F.transform("i", lambda s: F.struct(s["dmin"].cast("int").alias("dmin"), s["dmax"].cast("int").alias("dmax"), s["pairs"].cast("long").alias("pairs")))
    out = out.select(*by, "entities", F.explode(F.when(kept, as_is).otherwise(merged)).alias("d")).select(*by, "d.dmin", "d.dmax", "d.pairs", "entities")
    return out.withColumn("support", rule_support(F.col("pairs"), F.col("entities"), timestamps))


def flat(rules: DataFrame) -> DataFrame:
    """x and y as text: ``type.attr=value``, literals joined by a bar."""
    show = lambda s: F.concat(s["vtype"], F.lit("."), s["attr"], F.lit("="), s["val"])
    out = rules
    for c in rules.columns:
        kind = dict(rules.dtypes)[c]
        if kind == f"array<{LITERAL}>":
            out = out.withColumn(c, F.array_join(F.transform(c, show), "|"))
        elif kind == LITERAL:
            out = out.withColumn(c, show(F.col(c)))
    return out


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rules in both, only left, only right. Rules are equal if x, y and interval are."""
    key = lambda df: flat(df).select("x", "y", "dmin", "dmax").distinct()
    both = key(left).withColumn("l", F.lit(1)).join(key(right).withColumn("r", F.lit(1)), ["x", "y", "dmin", "dmax"], "full_outer")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()
    return both.agg(n(l & r).alias("n_both"), n(l & ~r).alias("n_left_only"), n(~l & r).alias("n_right_only"))


def minimal_rules(found: DataFrame) -> DataFrame:
    """Without rules that a smaller one covers: same right side, a left side that is a proper part of theirs, and
    an interval that contains theirs."""
    small = found.select("y", F.col("x").alias("_x"), F.col("dmin").alias("_min"), F.col("dmax").alias("_max")).distinct()
    inside = (F.size("_x") < F.size("x")) & (F.size(F.array_except("_x", "x")) == 0) & (F.col("_min") <= F.col("dmin")) & (F.col("_max") >= F.col("dmax"))
    return found.join(small, (found["y"] == small["y"]) & inside, "left_anti")


def gather(parts: list[DataFrame]) -> DataFrame:
    """Rules of several runs as one set."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def gather_counts(parts: list[DataFrame]) -> DataFrame:
    """Entity counts (dep, entities) of runs over disjoint data, summed."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("dep").agg(F.sum("entities").cast("long").alias("entities"))


def with_keys(rules: DataFrame, general: bool = False) -> DataFrame:
    """Adds ``key``: what rules must share to be merged or to contradict each other. Constant rules: the left
    literals and the right attribute; general ones: the attributes only. Values are compared, not hashes."""
    names = F.array_sort(F.transform("x", lambda s: F.concat_ws(".", s["vtype"], s["attr"])))
    right = F.concat_ws(".", F.col("y.vtype"), F.col("y.attr"))
    return rules.withColumn("key", F.struct(names.alias("x"), right.alias("y")) if general else F.struct(F.array_sort("x").alias("x"), right.alias("y")))
