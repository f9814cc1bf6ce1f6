"""The registered queries of this subpackage: each applies one operator, with production
parameters, to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kairograph.llm import audio, embedding_dedup, licenses, line_dedup, mixing, ngram_join, packing, substring_dedup, toxicity, warc
from kairograph.llm.common import cut, table


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both records of every page; header and block as digests."""
    out = warc.derive(warc.responses_of_pages(table(spark, sf_dir, "pages")))
    return out.select("page_id", "record_id", "refers_to", "warc_type", "target_uri", warc.digest(F.col("source_headers")).alias("source_headers_digest"), "source_digest", "block_digest", "content_length")


#: Shares that the mix shall have: of languages and topics; sources keep their observed shares, tempered.
MIX = {"lang": {"en": 0.55, "de": 0.2, "fr": 0.15, "es": 0.1}, "topic": {"article": 0.5, "long": 0.25, "data": 0.15, "short": 0.08, "legal": 0.02}}


def op2_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = {name: spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for pair in of.items() for x in pair])).alias("value", "share")) for name, of in MIX.items()}
    out = mixing.mix(table(spark, sf_dir, "documents"), shares, report=True)
    return out.withColumn("probability", F.round("probability", 9))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its lines, how many went, and the digest of what is left."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), report=True)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("kept").alias("kept_md5"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def op8_audio_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, rendered as a recording, fingerprinted and aligned with all others."""
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("rec_id"), "text")
    out = audio.align_recordings(cut(audio.fingerprints(turns, audio.render), "prints"))
    part = lambda name: [F.col(f"{name}_id.{x}").alias(f"{name}_{x}") for x in ("conv_id", "turn")]
    return out.select("rec_id.conv_id", "rec_id.turn", "n_ints", *part("class"), "n_links", *part("component"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": op1_warc_derivatives,
    "op2_mixing_weights": op2_mixing_weights,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_license_scan": op4_license_scan,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_audio_fingerprints": op8_audio_fingerprints,
    "op9_toxicity": op9_toxicity,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

_TRIM = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))"
ORACLE_SQL: dict[str, str] = {
    "op1_warc_derivatives": warc.derivative_sql(),
    "op2_mixing_weights": mixing.mixing_sql(targets=MIX),
    "op4_license_scan": licenses.license_sql(),
    "op5_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS pos
            FROM documents WHERE text IS NOT NULL),
        common AS (
            SELECT {_TRIM} AS line FROM lines WHERE {_TRIM} <> ''
            GROUP BY ALL HAVING count(DISTINCT coalesce(source, chr(0))) >= {line_dedup.MIN_SITES}),
        judged AS (SELECT l.*, c.line IS NULL AS stays FROM lines l LEFT JOIN common c ON {_TRIM.replace("line", "l.line")} = c.line)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
               md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_md5
        FROM judged GROUP BY doc_id
        UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL""",
}
