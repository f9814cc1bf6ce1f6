"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

Every derived record refers to the identifier of its response, carries the source's HTTP
headers and payload digest, and has an identifier fixed by the response's, so that a
repeated run gives the same records. Records can be written as WARC files and read back.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm.common import pick

VERSION = "WARC/1.1"
#: Date of responses that have none of their own.
NO_DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"

HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>"
BREAKING = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
#: The same with their common starts once, as Java tries the alternatives one by one at each character.
_HIDDEN_ONCE = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|noscript\b.*?</noscript\s*>|template\b.*?</template\s*>)"
_BREAKING_ONCE = r"(?i)</?(?:a(?:ddress|rticle|side)|b(?:lockquote|ody|r)|d(?:d|iv|l|t)|f(?:ieldset|igure|ooter|orm)|h(?:[1-6r]|ead|eader|tml)|li|main|nav|ol|p|pre|section|t(?:able|d|h|itle|r)|ul)\b[^>]*>"
TAG = r"<[^>]*>"
#: Attributes of a tag before the one sought, and a value with its quotes, if any.
_BEFORE = r"(?=[\s/])(?:[^>=\s/]++|[\s/]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)?+){0,500}?(?<=[\s/\"'])"
_VALUE = r"\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)"
LINK = rf"(?i)<a{_BEFORE}href{_VALUE}"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
LANGUAGE = rf"(?i)<html{_BEFORE}(?:xml:)?lang{_VALUE}"
#: The forms that the SQL reads: double quotes alone.
SQL_LINK, SQL_LANGUAGE = r"(?i)<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\"", r"(?i)<html\b[^>]*?\blang\s*=\s*\"([^\"]*)\""
# Character references that become characters; the ampersand comes last.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&"))
_OTHERS = "&(?!(?:" + "|".join(name[1:-1] for name, _ in REFERENCES) + ");)(?:#[0-9xX]|[A-Za-z][A-Za-z0-9]*;)"
#: The named references of HTML that end with a semicolon, and how numbers below 161 are read.
NAMED = {**{n: c for n, c in html5.items() if n.endswith(";")}, **{name[1:]: c for name, c in REFERENCES if "#" not in name}}
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;)"
_CONTROLS = {str(k): bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160)} | {"160": " "}

RECORD = ("record_id", "refers_to", "warc_type", "target_uri", "warc_date", "content_type", "source_headers", "source_digest", "block_digest", "content_length", "block")


def uuid_of(seed: Column) -> Column:
    d = F.md5(seed)
    part = lambda a, n: F.substring(d, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-"), part(13, 4), F.lit("-"), part(17, 4), F.lit("-"), part(21, 12), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def _table(of: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\1".join(f"{k}\2{v}" for k, v in of.items())), F.lit("\1"), F.lit("\2"))


def _named() -> Column:
    """Name -> characters, by first letter, as a map is searched from its start."""
    first = sorted({n[0] for n in NAMED})
    return F.create_map(*[c for a in first for c in (F.lit(a), _table({n: v for n, v in NAMED.items() if n[0] == a}))])


def character(reference: Column) -> Column:
    """What a reference stands for; unknown names stay as they are."""
    body = F.regexp_replace(reference, "^&#?|;$", "")
    digits = F.regexp_replace(body, "^[xX]?0*", "")
    based = lambda base: F.conv(F.concat(F.lit("0"), digits), base, 10)
    code = F.when(F.length(digits) > 7, F.lit(0x110000)).otherwise(F.when(body.rlike("^[xX]"), based(16)).otherwise(based(10)).cast("int"))
    point = F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(code)
    number = F.coalesce(F.try_element_at(_table(_CONTROLS), point.cast("string")), F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
    name = F.substring(reference, 2, 64)
    return F.when(reference.startswith("&#"), number).otherwise(F.coalesce(F.try_element_at(F.try_element_at(_named(), F.substring(name, 1, 1)), name), reference))


def readable(text: Column) -> Column:
    """References resolved, once each. Texts with the common ones alone need no search, and those without any nothing."""
    plain = text
    for name, c in REFERENCES:
        plain = F.replace(plain, F.lit(name), F.lit(c))
    pieces, found = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    rest = F.zip_with(found, F.slice(pieces, F.lit(2), F.size(found)), lambda r, p: F.concat(character(r), p))
    return F.when(~text.contains("&"), text).when(text.rlike(_OTHERS), F.concat(pieces[0], F.array_join(rest, ""))).otherwise(plain)


def unquoted(value: Column) -> Column:
    return F.when(value.startswith('"') | value.startswith("'"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def visible(html: Column) -> Column:
    """A page without comments, scripts and other hidden parts."""
    return F.regexp_replace(html, _HIDDEN_ONCE, " ")


def untagged(html: Column) -> Column:
    """A page, as ``visible`` leaves it, without tags, one block a line."""
    return F.regexp_replace(F.regexp_replace(html, _BREAKING_ONCE, "\n"), TAG, "")


def plain_text(untagged: Column) -> Column:
    """Text of a page from ``untagged``: references resolved, one block a line."""
    out = F.regexp_replace(readable(untagged), r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r" ?\n[\n ]*", "\n"), r"^[\n ]+|[\n ]+$", "")


#: Characters that may not stand in a field; the last, which only goes with line ends, becomes nothing and the others blanks.
_CONTROL = "".join(map(chr, [*range(1, 13), *range(14, 32), 127, 0x85, 0x2028, 0x2029, 13]))


def one_line(text: Column) -> Column:
    """Without control characters, which would end a field."""
    return F.translate(text, _CONTROL, " " * (len(_CONTROL) - 1))


def responses_of_pages(pages: DataFrame, date: str = NO_DATE) -> DataFrame:
    """Response records (``record_id, target_uri, warc_date, http_headers, payload``) of crawled pages
    (``page_id, url, html``). A null page has an empty payload; a null url stays null."""
    p = pick(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    name = F.concat_ws(" ", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce("url", F.lit("-")))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(CRLF))
    return p.select("page_id", uuid_of(name).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"), F.col("html").alias("payload"))


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response: ``metadata`` (title, language, links) and ``conversion`` (text).

    Links, language and title are those outside comments, scripts and other hidden parts. An empty or null payload gives records with
    no title and an empty text; null headers stay null. Repeated responses give repeated
    records, with one identifier; responses without identifier refer to none, and their records are identified by address and
    payload. No responses give no records. Columns of ``responses`` beyond those named
    in ``responses_of_pages`` stay beside the record's, unless they have one of its names in any case."""
    names = responses.columns
    taken = {"record_id", "target_uri", "warc_date", "http_headers", "payload"}
    extra = [i for i, c in enumerate(names) if c.lower() not in (*RECORD, "http_headers", "payload")]
    kept = [f"_x{i}" for i in extra]
    r = responses.toDF(*[c if c in taken else f"_x{i}" for i, c in enumerate(names)]).select(*kept, *sorted(taken))
    r = r.withColumn("payload", F.coalesce("payload", F.lit("")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    found = lambda value: F.regexp_replace(F.regexp_replace(value, TAG, ""), r"\s+", " ")
    shown = lambda value: F.trim(one_line(readable(value)))
    # Columns of their own, as what an expression holds twice is computed twice.
    r = r.select("*", digest(F.col("payload")).alias("_digest"), visible(F.col("payload")).alias("_visible"))
    r = r.select("*", found(F.regexp_extract("_visible", TITLE, 1)).alias("_title"), found(unquoted(F.regexp_extract("_visible", LANGUAGE, 1))).alias("_language"), F.regexp_extract_all("_visible", F.lit(LINK), F.lit(1)).alias("_links"), untagged(F.col("_visible")).alias("_untagged"))
    links = F.transform("_links", unquoted)
    outlinks = F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), one_line(readable(x)), F.lit(f" L a/@href{CRLF}"))), "")
    fields = F.concat(field("title", shown(F.col("_title"))), field("language", shown(F.col("_language"))), field("source-digest", F.col("_digest")), field("outlinks", F.size("_links").cast("string")), outlinks)
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("_untagged")).alias("block")),
    )
    source = F.coalesce("record_id", F.concat_ws(" ", F.coalesce("target_uri", F.lit("-")), "_digest"))
    d = r.select(*kept, F.col("record_id").alias("refers_to"), source.alias("_source"), "target_uri", "warc_date", F.col("http_headers").alias("source_headers"), F.col("_digest").alias("source_digest"), F.explode(kinds).alias("_kind"))
    d = d.select("*", "_kind.warc_type", "_kind.content_type", "_kind.block")
    d = d.withColumn("record_id", uuid_of(F.concat_ws(" ", "warc_type", "_source"))).withColumn("block_digest", digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))
    return d.select(*[F.col(f"_x{i}").alias(names[i]) for i in extra], *RECORD)


def record_text(df: DataFrame) -> DataFrame:
    """Each record as text of a WARC file, without the blank lines that end it."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{CRLF}{name}: "), one_line(F.col(c).cast("string")))).otherwise("")
    head = F.concat(F.lit(VERSION), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "target_uri"), line("WARC-Date", "warc_date"), line("WARC-Block-Digest", "block_digest"), line("WARC-Source-Payload-Digest", "source_digest"), F.coalesce(F.concat(F.lit(f"{CRLF}WARC-Source-Headers: "), F.replace(F.base64(F.col("source_headers").cast("binary")), F.lit(CRLF), F.lit(""))), F.lit("")), line("Content-Type", "content_type"), line("Content-Length", "content_length"))
    return df.select(F.concat(head, F.lit(CRLF + CRLF), "block").alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """gzip WARC files, one for each partition, each one gzip member."""
    record_text(records).write.option("compression", "gzip").option("lineSep", CRLF * 2).mode("errorifexists").text(path)


def _records(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Of every record of WARC files its head and its block, as text."""
    raw = spark.read.option("lineSep", f"{CRLF}{CRLF}{version}{CRLF}").text(path)
    parts = raw.select(F.regexp_replace("value", f"^{version}{CRLF}", "").alias("t")).withColumn("h", F.substring_index("t", CRLF * 2, 1))
    parts = parts.withColumn("b", F.expr(f"substring(t, length(h) + {len(CRLF * 2) + 1})"))
    return parts.select("h", F.when(F.col("b").endswith(CRLF * 2), F.expr("left(b, length(b) - 4)")).otherwise(F.col("b")).alias("b"))


def _of(name: str) -> Column:
    return F.nullif(F.regexp_extract("h", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that ``write_warc`` wrote, as ``derive`` gives them, and ``complete``: whether
    the block has the length and the digest that its header states."""
    out = _records(spark, path, VERSION).select(_of("WARC-Record-ID").alias("record_id"), _of("WARC-Refers-To").alias("refers_to"), _of("WARC-Type").alias("warc_type"), _of("WARC-Target-URI").alias("target_uri"), _of("WARC-Date").alias("warc_date"), _of("Content-Type").alias("content_type"), F.unbase64(_of("WARC-Source-Headers")).cast("string").alias("source_headers"), _of("WARC-Source-Payload-Digest").alias("source_digest"), _of("WARC-Block-Digest").alias("block_digest"), _of("Content-Length").cast("long").alias("content_length"), F.col("b").alias("block"))
    return out.withColumn("complete", (F.octet_length("block") == F.col("content_length")) & (digest(F.col("block")) == F.col("block_digest")))


def read_responses(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """The response records of a crawl's WARC files (gzip or plain, of one version), for ``derive``. Other records are
    left out. Files are read as UTF-8: bytes that are not become U+FFFD."""
    kept = _records(spark, path, version).where(F.lower(_of("WARC-Type")) == "response")
    head = F.substring_index("b", CRLF * 2, 1)
    return kept.select(_of("WARC-Record-ID").alias("record_id"), _of("WARC-Target-URI").alias("target_uri"), _of("WARC-Date").alias("warc_date"), F.concat(head, F.lit(CRLF)).alias("http_headers"), F.expr(f"substring(b, length(substring_index(b, '\\r\\n\\r\\n', 1)) + {len(CRLF * 2) + 1})").alias("payload"))


def derivative_sql(source: str = "pages") -> str:
    """Digest columns of ``derive`` over pages as DuckDB SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def read(x: str) -> str:
        for name, character in REFERENCES:
            x = f"replace({x}, {quote(name)}, {quote(character)})"
        return x

    sub = lambda x, pattern, to="": f"regexp_replace({x}, {quote(pattern)}, {to if to.startswith('chr') else quote(to)}, 'g')"
    uuid = lambda d: f"'<urn:uuid:' || substr({d}, 1, 8) || '-' || substr({d}, 9, 4) || '-' || substr({d}, 13, 4) || '-' || substr({d}, 17, 4) || '-' || substr({d}, 21, 12) || '>'"
    text = read(sub(sub("seen", BREAKING, "chr(10)"), TAG))
    text = sub(sub(sub(text, r"[ \t\r\f]+", " "), r" ?\n[\n ]*", "chr(10)"), r"^[\n ]+|[\n ]+$")
    found = lambda pattern: f"trim({read(sub(sub(f'regexp_extract(seen, {quote(pattern)}, 1)', TAG), r'[\s]+', ' '))})"
    end = "chr(13) || chr(10)"
    return f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, md5('response ' || coalesce(page_id::VARCHAR, '-') || ' ' || coalesce(url, '-')) AS m FROM {source}),
        q AS (SELECT *, {sub("html", HIDDEN, " ")} AS seen FROM p),
        r AS (SELECT *, {uuid("m")} AS refers_to, 'sha256:' || sha256(html) AS source_digest, regexp_extract_all(seen, {quote(SQL_LINK)}, 1) AS links FROM q),
        k AS (
            SELECT page_id, url, refers_to, source_digest, html, 'metadata' AS warc_type,
                   'title: ' || {found(TITLE)} || {end} || 'language: ' || {found(SQL_LANGUAGE)} || {end} || 'source-digest: ' || source_digest || {end}
                   || 'outlinks: ' || len(links) || {end} || array_to_string(list_transform(links, lambda x: 'outlink: ' || {read("x")} || ' L a/@href' || {end}), '') AS block
            FROM r
            UNION ALL SELECT page_id, url, refers_to, source_digest, html, 'conversion', {text} FROM r),
        i AS (SELECT *, md5(warc_type || ' ' || refers_to) AS m FROM k)
        SELECT page_id, {uuid("m")} AS record_id, refers_to, warc_type, url AS target_uri,
               'sha256:' || sha256('HTTP/1.1 200 OK' || {end} || 'Content-Type: text/html; charset=utf-8' || {end} || 'Content-Length: ' || strlen(html) || {end}) AS source_headers_digest,
               source_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length
        FROM i"""
