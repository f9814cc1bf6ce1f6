"""Line deduplication by distinct-site spread.

Every line (trimmed; empty lines aside) is hashed. A HyperLogLog sketch of the sites of each line hash is
built before the shuffle and merged by aggregation, so a line on any number of pages moves one
sketch per task. Lines whose estimate lies clearly above the threshold are boilerplate, those
near it get exact distinct counts, and the rest stay. A line seen on one site alone needs no sketch, which the least and
the greatest of its sites show.

Only documents that hold such a line go through a shuffle with their text; the others pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.llm.common import cut, release

MIN_SITES = 8
#: Sketches have 2^12 registers: 1.6 % standard error.
REGISTERS = 12
#: Estimates within this share of the threshold are counted exactly: six standard errors.
NEAR = 0.1
#: Ids of touched texts are broadcast up to this many (16 bytes each), beyond it joined by shuffle.
BROADCAST_IDS = 1_000_000
# Fixed value: what is trimmed from the ends of a line.
BLANK = " \t\r\f\v"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _key(line: Column) -> Column:
    return F.xxhash64(_trim(line))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """lines: ``h`` (line hash) and ``site``. Returns ``h`` and ``sites`` of the hashes on ``min_sites``
    sites or more, as a written table. Null sites count as one site."""
    lines = lines.select("h", F.coalesce(F.col("site").cast("string"), F.lit("\0")).alias("site"))
    spread = lines.groupBy("h").agg(F.min("site").alias("_lo"), F.max("site").alias("_hi"))
    several = cut(spread.where("_lo < _hi").select("h"), "several") if min_sites > 1 else spread.select("h")
    held = cut(lines.join(several, "h", "left_semi"), "held")
    sketched = cut(held.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(REGISTERS))).alias("sites")), "sketched")
    sure = sketched.where(F.col("sites") > min_sites * (1 + NEAR))
    near = sketched.where((F.col("sites") <= min_sites * (1 + NEAR)) & (F.col("sites") >= min_sites * (1 - NEAR))).select("h")
    exact = held.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    common = cut(sure.select("h", "sites").unionByName(exact), "common")
    release(*([several] if min_sites > 1 else []), held, sketched)
    return common


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source", length: str | None = "n_chars", report: bool = False, copies_once: bool = False) -> DataFrame:
    """Remove lines found on ``min_sites`` sites or more. Every row and column stays; ``text`` holds
    the lines left, joined as before, and ``length``, if there is such a column, its characters.
    With ``report``, returns ``doc_id, n_lines, n_removed, kept`` (the text left) instead. With ``copies_once`` rows with the
    same whole text count as the first of them alone, so that a document does not lose its lines for having been copied;
    that is for pipelines that remove copies later.

    Null texts stay null and have no lines; empty lines never go. Null sites, and null ids where copies count once, are one
    like any other. A repeated row is treated like its twin. An empty table gives an empty result. Extra columns,
    whatever their names, pass through."""
    names = docs.columns
    at = {n: f"_c{names.index(n)}" for n in {text, site, "doc_id"}}
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    t = F.col(at[text])
    plain = plain.withColumns({"k1": F.xxhash64(t), "k2": F.xxhash64(F.lit("text"), t)})
    rows = plain.where(t.isNotNull()).select(F.col(at["doc_id"]).alias("doc_id"), F.col(at[site]).alias("site"), t.alias("text"), "k1", "k2")
    lines = cut(rows.select("k1", "k2", "doc_id", "site", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _trim(x) != ""), _key))).alias("h")), "lines")
    counted = lines
    if copies_once:
        copies = cut(rows.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "site")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2", "first"), "copies")
        counted = lines.join(copies, ["k1", "k2"], "left").where("first is null or (doc_id <=> first.doc_id and site <=> first.site)")
    common = boilerplate(counted.select("h", "site"), min_sites)
    hits = cut(lines.join(common, "h", "left_semi").groupBy("k1", "k2").agg(F.collect_set("h").alias("_hits")), "hits")
    release(lines, common, *([copies] if copies_once else []))
    ids = hits.select("k1", "k2")
    ids = F.broadcast(ids) if hits.count() <= BROADCAST_IDS else ids
    some = plain.join(ids, ["k1", "k2"], "left_semi").join(hits, ["k1", "k2"]).select(*plain.columns, "_hits")
    rest = plain.join(ids, ["k1", "k2"], "left_anti").select(*plain.columns, F.lit(None).cast("array<long>").alias("_hits"))
    joined = some.unionByName(rest)
    kept = F.when(F.col("_hits").isNull(), t).otherwise(F.array_join(F.filter(_lines(t), lambda x: ~F.array_contains("_hits", _key(x))), "\n"))
    if report:
        n, left = F.size(_lines(t)), F.size(F.filter(_lines(t), lambda x: ~F.array_contains("_hits", _key(x))))
        none = F.when(t.isNull(), F.lit(0))
        return joined.select(F.col(at["doc_id"]).alias("doc_id"), F.coalesce(none, n).cast("long").alias("n_lines"), F.when(F.col("_hits").isNull(), F.lit(0)).otherwise(n - left).cast("long").alias("n_removed"), kept.alias("kept"))
    out = []
    for i, name in enumerate(names):
        c = F.col(f"_c{i}")
        if i == names.index(text):
            c = kept
        elif name == length:
            c = F.when(F.col("_hits").isNull(), c).otherwise(F.char_length(kept)).cast(docs.schema[i].dataType)
        out.append(c.alias(name))
    return joined.select(*out)
