"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed over the cells of (source, language, topic). Raking multiplies the values of each dimension by
factors until every marginal has its target share, and a document is sampled with its
cell's factor over the largest. Only cells are raked, so the work of a round does not depend on
the number of documents. Cells stay a distributed table that is summed by value with partial aggregation, so that a
value which all cells share is no task of its own; the factors, a row for each value, are written once a round. Up to
``BROADCAST_CELLS`` cells and values are raked within one row instead, by the same steps, as a hundred rounds of small jobs fill the driver.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairograph.llm.common import cut, release

#: Target shares are the observed ones to these powers, where no targets are given.
TEMPER = {"source": 0.8, "lang": 0.9, "topic": 0.95}
#: Raking goes on until no marginal is off by more than ``TOLERANCE`` of its target before it is set, for ``MOST_ROUNDS`` at
#: most, and stops where ``STALL`` rounds have not brought that down; the SQL does ``ROUNDS``.
ROUNDS, MOST_ROUNDS, STALL, TOLERANCE = 15, 100, 10, 1e-11
SEED = "mix-1"
#: Cells are broadcast up to this many rows (four short values each), beyond it joined by shuffle.
BROADCAST_CELLS = 100_000
#: Stands for a null source, language or id.
NONE = "(none)"


def tokens_of(text: Column) -> Column:
    """Runs of anything but ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """A coarse topic by fixed rules: legal notices, texts with figures, and prose by length."""
    return F.when(text.contains("icense"), "legal").when(text.rlike("[0-9]"), "data").when(tokens < 100, "short").when(tokens < 1000, "article").otherwise("long")


def draw(doc_id: Column, seed: str = SEED, text: Column | None = None) -> Column:
    """Uniform number in [0, 1) fixed by seed and id: 52 bits of a digest. Without id the text's digest stands for it."""
    other = F.lit(NONE) if text is None else F.concat(F.lit(NONE), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), other)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, temper: dict[str, float] = TEMPER, rounds: int = MOST_ROUNDS) -> DataFrame:
    """cells: the dimensions of ``temper`` and ``tokens``. Adds ``factor``. targets: for a dimension, rows of
    (its value, share); values without tokens are left out, and shares of the rest scaled to one.
    A value without tokens or target keeps its factor, so its weight is not moved. Targets that contradict each other, or that
    ``rounds`` do not reach, give a warning with what a marginal was off by in the last round."""
    dims = list(temper)
    goals = None
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    for d in dims:
        seen = cells.groupBy(F.col(d).cast("string").alias("value")).agg(F.sum("tokens").alias("_n"))
        if targets and d in targets:
            share = seen.join(targets[d].toDF("value", "_share"), "value", "left").withColumn("_share", F.when((F.col("_n") > 0) & (F.col("_share") > 0), F.col("_share")))
        else:
            share = seen.withColumn("_share", F.when(F.col("_n") > 0, F.pow(F.col("_n").cast("double"), F.lit(temper[d]))))
        total = share.agg(F.sum("_share")).first()[0] or 1.0
        part = share.select(F.lit(d).alias("dim"), "value", (F.col("_share") / F.lit(total) * F.lit(float(whole))).alias("goal"))
        goals = part if goals is None else goals.unionByName(part)
    goals = cut(goals, "goals")

    def weighed(by: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
        """Cells with the factors of some dimensions, and their product."""
        out = cells
        for d, f in by.items():
            out = out.join(f.select(F.col("value").alias(f"_v_{d}"), F.col("factor").alias(f"_f_{d}")), F.col(d).cast("string") == F.col(f"_v_{d}"))
        return out, reduce(lambda a, b: a * b, [F.col(f"_f_{d}") for d in by])

    of = lambda table, d: table.where(F.col("dim") == d).select("value", *[c for c in table.columns if c not in ("dim", "value")])
    few = cells.count() <= BROADCAST_CELLS and goals.count() <= BROADCAST_CELLS
    if few:
        factors, off = _raked_at_once(cells, goals, dims, rounds)
    else:
        factors, off = cut(goals.select("dim", "value", F.lit(1.0).alias("factor")), "factors"), [0.0]
    for done in range(1, 1 if few else rounds + 1):
        now = {d: of(factors, d) for d in dims}
        for d in dims:
            rows, weight = weighed({k: f for k, f in now.items() if k != d})
            sums = rows.groupBy(F.col(d).cast("string").alias("value")).agg(F.sum(F.col("tokens") * weight).alias("sum"))
            now[d] = of(goals, d).join(sums, "value").select("value", F.when((F.col("sum") > 0) & F.col("goal").isNotNull(), F.col("goal") / F.col("sum")).otherwise(F.lit(1.0)).alias("factor"))
        after = cut(reduce(DataFrame.unionByName, [f.select(F.lit(d).alias("dim"), "value", "factor") for d, f in now.items()]), "factors")
        # what a factor changes by is what its marginal was off by
        off.append(after.join(factors.withColumnRenamed("factor", "before"), ["dim", "value"]).agg(F.max(F.abs(F.col("factor") / F.col("before") - 1))).first()[0] or 0.0)
        release(factors)
        factors = after
        if off[-1] <= TOLERANCE or done > 2 * STALL and off[-1] > 0.9 * off[-1 - STALL]:
            break
    if off[-1] > 1e-6:
        warnings.warn(f"marginals are not met after {len(off) - 1} rounds: one was off by {off[-1]:.2g} of its target", stacklevel=2)
    rows, weight = weighed({d: of(factors, d) for d in dims})
    out = cut(rows.select(*dims, "tokens", weight.alias("factor")), "raked")
    release(goals, factors)
    return out


def _raked_at_once(cells: DataFrame, goals: DataFrame, dims: list[str], rounds: int) -> tuple[DataFrame, list[float]]:
    """All rounds of ``rake`` over one row that holds the cells, so that they are one job: dim, value, factor, and by how much the
    marginals were off in each round. Factors are held in arrays, one a dimension, in the order of their values."""
    at = cut(goals.withColumn("k", F.row_number().over(Window.partitionBy("dim").orderBy("value"))), "places")
    named = cells.select(*[F.col(d).cast("string").alias(f"_v{n}") for n, d in enumerate(dims)], F.col("tokens").cast("double").alias("n"))
    for n, d in enumerate(dims):
        named = named.join(at.where(F.col("dim") == d).select(F.col("value").alias(f"_v{n}"), F.col("k").alias(f"k{n}")), f"_v{n}")
    named = cut(named.select("n", *[f"k{n}" for n in range(len(dims))]), "places")
    row = None
    for n, d in enumerate(dims):
        others = [f"k{m}" for m in range(len(dims)) if m != n]
        own = named.groupBy(F.col(f"k{n}").alias("k")).agg(F.array_sort(F.collect_list(F.struct(*others, "n"))).alias("cells"))
        held = at.where(F.col("dim") == d).join(own, "k", "left").select(F.struct("k", "value", "goal", "cells").alias("s"))
        part = held.agg(F.array_sort(F.collect_list("s"), lambda a, b: a["k"] - b["k"]).alias(f"g{n}"))
        row = part if row is None else row.crossJoin(part)

    # One step sets one dimension, and one more a round sees what factors have changed by: ``f`` are factors, ``o`` those of the round before.
    def fitted(s: Column, n: int) -> Column:
        def weight(c: Column) -> Column:
            return reduce(lambda a, b: a * b, [c["n"], *[F.get(s[f"f{m}"], c[f"k{m}"] - 1) for m in range(len(dims)) if m != n]])

        def factor(v: Column) -> Column:
            total = F.aggregate(F.coalesce(v["cells"], F.array().cast(kind_of[n])), F.lit(0.0), lambda acc, c: acc + weight(c))
            return F.aggregate(F.array(total), F.lit(1.0), lambda _, x: F.when((x > 0) & v["goal"].isNotNull(), v["goal"] / x).otherwise(F.lit(1.0)))

        return F.transform(f"g{n}", factor)

    kind_of = [row.schema[f"g{n}"].dataType.elementType["cells"].dataType for n in range(len(dims))]

    def step(s: Column, i: Column) -> Column:
        turn = F.pmod(i, F.lit(len(dims) + 1))
        seen = turn == len(dims)
        change = [F.array_max(F.zip_with(s[f"f{n}"], s[f"o{n}"], lambda f, o: F.abs(f / o - 1))) for n in range(len(dims))]
        worst = F.coalesce(F.array_max(F.array(*change)), F.lit(0.0))
        off = F.when(seen, F.concat(s["off"], F.array(worst))).otherwise(s["off"])
        new = [F.when(turn == n, fitted(s, n)).otherwise(s[f"f{n}"]).alias(f"f{n}") for n in range(len(dims))]
        old = [F.when(seen, s[f"f{n}"]).otherwise(s[f"o{n}"]).alias(f"o{n}") for n in range(len(dims))]
        last, long_ago = F.try_element_at(s["off"], F.lit(-1)), F.try_element_at(s["off"], F.lit(-1 - STALL))
        # ``off`` begins with a zero for the start
        met = (F.size(s["off"]) > 1) & ((last <= TOLERANCE) | (F.size(s["off"]) - 1 > 2 * STALL) & (last > 0.9 * long_ago))
        held = [s[f"{c}{n}"].alias(f"{c}{n}") for c in "fo" for n in range(len(dims))]
        return F.when((turn == 0) & met | s["done"], F.struct(*held, s["off"].alias("off"), F.lit(True).alias("done"))).otherwise(F.struct(*new, *old, off.alias("off"), F.lit(False).alias("done")))

    ones = [F.transform(f"g{n}", lambda _: F.lit(1.0)) for n in range(len(dims))]
    start = F.struct(*[x.alias(f"f{n}") for n, x in enumerate(ones)], *[x.alias(f"o{n}") for n, x in enumerate(ones)], F.array(F.lit(0.0)).alias("off"), F.lit(False).alias("done"))
    end = F.aggregate(F.sequence(F.lit(0), F.lit(rounds * (len(dims) + 1) - 1)), start, step) if rounds else start
    named_factor = lambda d: lambda v, f: F.struct(F.lit(d).alias("dim"), v["value"].alias("value"), f.alias("factor"))
    each = [F.zip_with(f"g{n}", F.col("end")[f"f{n}"], named_factor(d)) for n, d in enumerate(dims)]
    out = cut(row.withColumn("end", end).select(F.concat(*each).alias("each"), "end.off"), "raked")
    factors = cut(out.select(F.explode("each").alias("e")).select("e.*"), "factors")
    off = out.select("off").first()[0]
    release(at, named, out)
    return factors, off


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, temper: dict[str, float] = TEMPER, rounds: int = MOST_ROUNDS, seed: str = SEED, topic: Column | None = None, report: bool = False) -> DataFrame:
    """Sample documents so that expected token shares meet the targets. Columns and rows of ``docs``
    that are drawn; with ``report``, for every row ``doc_id, tokens, topic, probability, kept``.

    Null sources and languages form a value of their own. A document without tokens, null or empty,
    takes its cell's probability, or 1 where no document of the cell has tokens. Rows of one ``doc_id`` in one cell
    are drawn together, and so are rows without ``doc_id`` of one text. Texts of any length count whole. An empty table
    gives an empty result. Extra columns pass through."""
    names = docs.columns
    at = {n: F.col(f"_c{names.index(n)}") for n in ("doc_id", "text", "source", "lang")}
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    n = tokens_of(at["text"])
    plain = plain.withColumn("tokens", n)
    kind = F.coalesce(topic if topic is not None else topic_of(at["text"], F.col("tokens")), F.lit(NONE))
    plain = plain.withColumns({"source": F.coalesce(at["source"].cast("string"), F.lit(NONE)), "lang": F.coalesce(at["lang"].cast("string"), F.lit(NONE)), "topic": kind})
    dims = list(temper)
    cells = cut(plain.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = rake(cells, targets, temper, rounds)
    release(cells)
    most = raked.where("tokens > 0").agg(F.max("factor")).first()[0]
    odds = raked.select(*dims, F.coalesce(F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("factor") / F.lit(most))), F.lit(1.0)).alias("probability"))
    odds = F.broadcast(odds) if raked.count() <= BROADCAST_CELLS else odds
    drawn = plain.join(odds, dims).withColumn("kept", draw(at["doc_id"], seed, at["text"]) < F.col("probability"))
    if report:
        return drawn.select(at["doc_id"].alias("doc_id"), "tokens", "topic", "probability", "kept")
    return drawn.where("kept").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def mixing_sql(rounds: int = ROUNDS, temper: dict[str, float] = TEMPER, seed: str = SEED, source: str = "documents", targets: dict[str, dict[str, float]] | None = None) -> str:
    """The report of ``mix`` over ``source`` as DuckDB SQL: the rounds are unrolled."""
    dims = list(temper)
    steps = [
        f"""counted AS (SELECT doc_id, text, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
            coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS tokens FROM {source})""",
        """d AS (SELECT *, CASE WHEN text LIKE '%icense%' THEN 'legal' WHEN regexp_matches(text, '[0-9]') THEN 'data'
            WHEN tokens < 100 THEN 'short' WHEN tokens < 1000 THEN 'article' ELSE 'long' END AS topic FROM counted)""",
        f"s0 AS (SELECT {', '.join(dims)}, sum(tokens)::DOUBLE AS tokens, 1.0::DOUBLE AS factor FROM d GROUP BY ALL)",
    ]
    for name in dims:
        if targets and name in targets:
            given = ", ".join(f"('{v}', {share!r}::DOUBLE)" for v, share in targets[name].items())
            steps.append(f"m_{name} AS (SELECT {name}, any_value(share) AS share FROM s0 JOIN (VALUES {given}) g(v, share) ON v = {name} GROUP BY 1 HAVING sum(tokens) > 0)")
        else:
            steps.append(f"m_{name} AS (SELECT {name}, pow(sum(tokens), {temper[name]}) AS share FROM s0 GROUP BY 1 HAVING sum(tokens) > 0)")
        steps.append(f"t_{name} AS (SELECT {name}, share / (SELECT sum(share) FROM m_{name}) * (SELECT sum(tokens) FROM s0) AS goal FROM m_{name})")
    k = 0
    for _ in range(rounds):
        for name in dims:
            steps.append(f"n{k + 1} AS MATERIALIZED (SELECT {name}, sum(tokens * factor) AS now FROM s{k} GROUP BY 1)")
            keep = ", ".join(f"s.{x}" for x in dims)
            steps.append(f"s{k + 1} AS MATERIALIZED (SELECT {keep}, s.tokens, CASE WHEN now > 0 AND goal IS NOT NULL THEN factor * (goal / now) ELSE factor END AS factor FROM s{k} s JOIN n{k + 1} USING ({name}) LEFT JOIN t_{name} USING ({name}))")
            k += 1
    steps.append(f"odds AS (SELECT {', '.join(dims)}, CASE WHEN tokens > 0 THEN least(1.0, factor / (SELECT max(factor) FROM s{k} WHERE tokens > 0)) ELSE 1.0 END AS probability FROM s{k})")
    u = f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '{NONE}' || md5(coalesce(text, '')))), 1, 13))::BIGINT / {float(16**13)!r}"
    return f"WITH {', '.join(steps)} SELECT doc_id, d.tokens, d.topic, round(probability, 9) AS probability, {u} < probability AS kept FROM d JOIN odds USING ({', '.join(dims)})"
