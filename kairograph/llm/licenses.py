"""License scan by canonical digest.

Texts are brought to a canonical form (case, punctuation, copyright lines, equivalent spellings)
and hashed; the digests of whole documents, and of their lines, are hash-joined to those of known
licences and notices. A notice has one form however it grants a licence (licensed, released, SPDX). Known texts of several
lines are also found whole within longer documents, such as a file that begins with its licence. All
of it is built-in functions. Known digests are few, so a document's lines are looked up in its own row, and nothing is shuffled.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import pick
from kairograph.llm.license_texts import WHOLE

#: Known digests are held in expressions and broadcast up to this many (100 bytes each), beyond it joined by shuffle.
BROADCAST_KNOWN = 10_000
#: Known texts of several lines that are looked for within documents.
MOST_BLOCKS = 200

# Spellings that count as the same, after punctuation is gone.
SPELLINGS = (
    ("licence", "license"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("per cent", "percent"),
    ("https", "http"),
)
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright [^a-z\n]|\(c\)|©)[^\n]*"
_PROSE = r"(?!(?i:holders?|owners?|notices?|licen[cs]es?|licensed|laws?|statements?|interests?|and|or|is|in|to|the|on|of|as|for|by|treat(?:y|ies)|protection|permissions?|disclaimers?|infringement|rights?|acts?|status|management|office)\b)"
#: Lines that begin with copyright and a name or a year, in the case they are written in.
COPYRIGHT_NAME = rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?i:copyright)(?:[ \t]*:[ \t]*[\p{{Lu}}\p{{N}}(©<\[{{]|[ \t]+(?:by[ \t]+)?(?:[Tt]he[ \t]+)?{_PROSE}\p{{Lu}}|[ \t]+{_PROSE}[^\n]{{0,80}}?\b(?:19|20)\p{{Nd}}{{2}}\b)[^\n]*"
NOT_WORD = r"[^\p{L}\p{N}\n]+"

_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
    "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Public licence texts and the notices that grant licences by name.
KNOWN = (
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _DISCLAIMER),
    ("ISC", "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_DISCLAIMER),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_DISCLAIMER),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
)

#: What grants a licence by name, in canonical form; the name follows, with or without "license".
GRANT = (
    r"^ *(?:spdx license identifier |license (?!identifier )|(?:(?:this|the)(?: [a-z]+){1,3} (?:is|are) )?(?:dual )?(?:licensed|released|distributed|published|provided|shared|(?:made )?available) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?)"
    r"([^\n]{1,80}?)(?: license)? *$"
)
_GNU = (("GPL", ("gpl", "gnu gpl", "gnu general public license")), ("LGPL", ("lgpl", "gnu lgpl", "gnu lesser general public license")), ("AGPL", ("agpl", "gnu agpl", "gnu affero general public license")))
_VERSIONS = (("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"))
#: Further names of licences in canonical form. "Only" and "or later" name the same licence here.
NAMES = (
    ("MIT", ("mit", "expat", "mit expat")),
    ("ISC", ("isc",)),
    ("0BSD", ("0bsd", "bsd zero clause", "zero clause bsd")),
    ("Apache-2.0", ("apache 2 0", "apache 2", "apache v2", "apache v2 0", "apache license 2 0", "apache license version 2 0", "apache license version 2", "apache license v2", "apache license v2 0", "apache version 2 0")),
    *((f"BSD-{n}-Clause", (f"bsd {n} clause", f"{n} clause bsd", f"{word} clause bsd", f"bsd {word} clause", f"{other} bsd", f"bsd {n} clause {other}")) for n, word, other in ((2, "two", "simplified"), (3, "three", "new"))),
    ("BSD-3-Clause", ("modified bsd", "revised bsd")),
    ("MPL-2.0", ("mpl 2 0", "mpl v2 0", "mpl version 2 0", "mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v2 0", "mozilla public license v 2 0")),
    *((f"CC-BY{k}-4.0", tuple(f"{cc}{n}{v}" for cc, n in (("cc ", f"by{k.replace('-', ' ').lower()}"), ("creative commons ", f"by{k.replace('-', ' ').lower()}"), ("creative commons ", long)) for v in (" 4 0", " v4 0", " 4 0 international", " 4 0 international public", " license 4 0", " version 4 0"))) for k, long in (("", "attribution"), ("-SA", "attribution sharealike"), ("-NC", "attribution noncommercial"), ("-ND", "attribution noderivatives"), ("-NC-SA", "attribution noncommercial sharealike"), ("-NC-ND", "attribution noncommercial noderivatives"))),
    ("CC0-1.0", ("cc0 1 0", "cc0", "cc0 1 0 universal", "creative commons zero 1 0", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal")),
    *((f"{kind}-{v}", tuple(f"{n} {lead}{number}{tail}" for k, names in _GNU if k == kind for n in names for lead in ("", "v", "version ") for number in {v.replace(".", " "), v.removesuffix(".0").replace(".", " ")} for tail in ("", " only", " or later", " or any later version", " or at your option any later version"))) for kind, v in _VERSIONS),
    *((f"{kind}-{v}", (f"{kind.lower()}v{v.replace('.', ' ')}", f"{kind.lower()}v{v.removesuffix('.0').replace('.', ' ')}")) for kind, v in _VERSIONS),
)


def canonical_lines(text: Column) -> Column:
    """Canonical text with its line ends."""
    out = F.regexp_replace(F.lower(F.regexp_replace(text, COPYRIGHT_NAME, "")), COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, NOT_WORD, " ")
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(one), F.lit(other))
    return out


def canonical(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, r"[\n ]+", " "))


def known_licenses(spark: SparkSession) -> DataFrame:
    """The fixed texts as literals, so that no Python worker starts for them."""
    rows = [F.struct(F.lit(name).alias("license_id"), F.lit(text).alias("text")) for name, text in KNOWN]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("k")).select("k.license_id", "k.text")


def notice(line: Column) -> Column:
    """A canonical line or text; a line that grants a licence by name in its one form."""
    return F.regexp_replace(line, GRANT, "licensed under $1")


def further_digests(spark: SparkSession) -> DataFrame:
    """license_id, digest of the whole texts that are held as digests and of the further names."""
    rows = [f"{name} {digest}" for name, digest in WHOLE] + [f"{name} {hashlib.sha256(f'licensed under {n}'.encode()).hexdigest()}" for name, names in NAMES for n in names]
    pair = F.split("pair", " ")
    return spark.range(1).select(F.explode(F.split(F.lit(",".join(rows)), ",")).alias("pair")).select(pair[0].alias("license_id"), pair[1].alias("digest"))


def whole_texts(known: DataFrame) -> DataFrame:
    """license_id and canonical text of the known texts of several lines."""
    return known.where(F.col("text").contains("\n")).select("license_id", canonical(canonical_lines(F.col("text"))).alias("text")).where("text <> ''").distinct()


def digests(known: DataFrame) -> DataFrame:
    """license_id, digest; texts that are equal in canonical form take the least name."""
    return known.select("license_id", F.sha2(notice(canonical(canonical_lines(F.col("text")))), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, license_id, n_notices, notices, blocks`` per row of ``docs``.

    ``license_id``: the licence whose whole text the document is, else null. ``notices``: licences of which
    a line of the document is the whole text, sorted, joined by commas, null without one; ``n_notices``: such
    lines. ``blocks``: licences of several lines whose text stands whole within the document, of those known by their
    text, likewise. Null and empty texts have the digest of the empty string and match nothing. Each row is judged by its own
    text, so repeated rows, null ids and ids with several texts are like any other. Texts are read whole. An empty table gives an
    empty result. Other columns are not looked at."""
    spark = docs.sparkSession
    texts = known if known is not None else known_licenses(spark)
    ids = digests(texts)
    if known is None:
        ids = ids.unionByName(further_digests(spark)).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    ids = ids.where(F.col("digest") != F.sha2(F.lit("").cast("binary"), 256)).withColumnRenamed("digest", "_key")
    few = ids.count() <= BROADCAST_KNOWN
    long_texts = [(r["license_id"], r["text"]) for r in whole_texts(texts).limit(MOST_BLOCKS + 1).collect()] if few else []
    if len(long_texts) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} known texts of several lines")
    rows = pick(docs, "doc_id", "text").select("doc_id", canonical_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    rows = rows.select("doc_id", "lines", canonical(F.col("lines")).alias("text"))
    keys = F.transform(F.filter(F.transform(F.split("lines", "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.sha2(notice(x), 256))
    held = F.concat(F.lit(" "), "text", F.lit(" "))
    blocks = F.array_compact(F.array(*[F.when(held.contains(f" {t} ") & (F.col("text") != t), F.lit(name)) for name, t in long_texts])) if long_texts else F.array().cast("array<string>")
    rows = rows.select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(notice(F.col("text")), 256).alias("_key"), keys.alias("_keys"), F.array_sort(F.array_distinct(blocks)).alias("_blocks"))
    listed = lambda names: F.when(F.size(names) > 0, F.array_join(names, ","))
    if few:
        # Known digests as one map: lines need no shuffle, and no row id.
        ids = F.broadcast(ids)
        table = F.map_from_entries(F.array(*[F.struct(F.lit(r["_key"]), F.lit(r["license_id"])) for r in ids.collect()]))
        rows = rows.withColumn("_hits", F.array_intersect("_keys", F.map_keys(table)))
        rows = rows.withColumn("_names", F.when(F.size("_hits") > 0, F.transform("_hits", lambda k: F.try_element_at(table, k))).otherwise(F.array().cast("array<string>")))
    else:
        rows = rows.withColumn("_row", F.xxhash64(F.array_join("_keys", "")))
        each = rows.select("_row", "_keys").distinct().select("_row", "_keys", F.explode(F.array_distinct("_keys")).alias("_key")).join(ids, "_key")
        found = each.groupBy("_row", "_keys").agg(F.collect_set("_key").alias("_hits"), F.collect_set("license_id").alias("_names"))
        rows = rows.join(found, ["_row", "_keys"], "left")
    n = F.when(F.size("_hits") > 0, F.size(F.filter("_keys", lambda k: F.array_contains("_hits", k)))).otherwise(0)
    out = rows.join(ids, "_key", "left")
    return out.select("doc_id", "digest", "license_id", n.cast("long").alias("n_notices"), listed(F.array_sort(F.array_distinct("_names"))).alias("notices"), listed(F.col("_blocks")).alias("blocks"))


def license_sql(source: str = "documents") -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(i)}, {quote(t)})" for i, t in KNOWN)

    def lines(text: str) -> str:
        out = f"regexp_replace(regexp_replace(lower({text}), {quote(COPYRIGHT_LINE)}, '', 'g'), {quote(NOT_WORD)}, ' ', 'g')"
        for one, other in SPELLINGS:
            out = f"replace({out}, '{one}', '{other}')"
        return out

    form = lambda x: f"trim(regexp_replace({x}, '[\\n ]+', ' ', 'g'))"
    whole = lambda x: f"sha256({form(x)})"
    return f"""
        WITH known(license_id, text) AS (VALUES {known}),
        ids AS (SELECT digest, min(license_id) AS license_id FROM (SELECT license_id, {whole(lines("text"))} AS digest FROM known) GROUP BY digest),
        d AS (SELECT doc_id, {lines("coalesce(text, '')")} AS lines FROM {source}),
        found AS (
            SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
            FROM (SELECT doc_id, sha256(trim(unnest(string_split(lines, chr(10))))) AS digest FROM d) JOIN ids USING (digest) GROUP BY doc_id),
        longer AS (SELECT license_id, {form(lines("text"))} AS text FROM known WHERE contains(text, chr(10))),
        within AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS blocks FROM (SELECT doc_id, {form("lines")} AS own FROM d) JOIN longer ON contains(' ' || own || ' ', ' ' || text || ' ') AND own <> text GROUP BY doc_id)
        SELECT d.doc_id, {whole("lines")} AS digest, license_id, coalesce(n_notices, 0) AS n_notices, notices, blocks
        FROM d LEFT JOIN ids ON ids.digest = {whole("lines")} LEFT JOIN found USING (doc_id) LEFT JOIN within USING (doc_id)"""
