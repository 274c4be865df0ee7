"""The registered queries: thin wrappers that bind operators to tables and contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table
from .decontaminate import leaks
from .exact_dedup import exact_duplicates
from .langid import identify_languages
from .masked_lm import score_documents, train
from .minmax_dedup import near_duplicates
from .mixing import mix
from .pfp_dedup import remove_repeats
from .quality_cnn import SAMPLE_DOCS as QUALITY_DOCS
from .quality_cnn import Network, quality_of, score_quality
from .toxicity import SAMPLE_DOCS as TOXIC_DOCS
from .toxicity import Model, fit, sampled, score_toxicity
from .warc import archived


def op1_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def quality_network(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Network:
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    return Network().fit(sampled(docs, labels, "quality", "doc_id", "text", QUALITY_DOCS))


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, quality_network(spark, docs, sf_dir))
    return scored.select(F.col("id").alias("doc_id"), held_out("id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_pfp_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0))
    return fit(sampled(docs, labels, "toxic", "doc_id", "text", TOXIC_DOCS))


def op4_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select(F.col("id").alias("doc_id"), held_out("id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")


def quality_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Column:
    """What the quality network says of each text is its weight in a mixture."""
    return quality_of(quality_network(spark, docs, sf_dir), F.col("text"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mix(docs, quality_weight(spark, docs, sf_dir))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op6_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs)).withColumnRenamed("id", "doc_id")


def op7_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gap in what was just written means lost pages, so it ends the query rather than leaving them out."""
    records = archived(table(spark, sf_dir, "pages"))
    lost = F.raise_error(F.concat_ws(" ", F.lit("unreadable archive:"), "file", "offset", "gap_bytes", "reason"))
    kind = F.when(F.col("record_type").isNull(), lost).otherwise(F.col("record_type"))
    return records.select("page_id", "payload_bytes", "payload_digest", kind.alias("record_type"), "refers_to")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = identify_languages(docs, ~held_out("doc_id", 4, 2))
    return predicted.select(F.col("id").alias("doc_id"), held_out("id", 4, 2).alias("held_out"), "lang_pred", "score")


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_windows", "item_windows", "reparameterised")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minmax_near_dedup": op1_minmax_near_dedup,
    "op2_quality_cnn": op2_quality_cnn,
    "op3_pfp_repeats": op3_pfp_repeats,
    "op4_segment_toxicity": op4_segment_toxicity,
    "op5_mixture": op5_mixture,
    "op6_masked_lm": op6_masked_lm,
    "op7_warc_salvage": op7_warc_salvage,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_cross_parsing": op9_cross_parsing,
    "op10_template_leaks": op10_template_leaks,
}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(digest, {5 * g + 1}, 5))::INT >> {shift}) & 31) + 1, 1)" for g in range(8) for shift in (15, 10, 5, 0)
)

ORACLES: dict[str, str] = {
    "op1_minmax_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
            UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        e AS (
            SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (shingle) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) p
            JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
    """,
    "op7_warc_salvage": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest FROM pages),
        g AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
        SELECT page_id, strlen(body) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN g USING (body)
    """,
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
        g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
        SELECT doc_id, keep_id, group_size, row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
        FROM t JOIN g USING (norm)
    """,
}
