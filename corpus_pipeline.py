"""From raw documents to a training mixture in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet in the shared folder and read again as the next one's docs. All but
the last return the columns of documents; the last returns what op5 does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import stored, table
from quillon.llm.decontaminate import drop_leaking
from quillon.llm.exact_dedup import drop_exact_duplicates
from quillon.llm.minmax_dedup import drop_near_duplicates
from quillon.llm.mixing import mix
from quillon.llm.queries import quality_weight, toxicity_model
from quillon.llm.toxicity import drop_toxic
from quillon.shipping import ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the segment model calls toxic.

    The model learns from the labels outside the held-out fold and the texts of
    docs; without labels of both classes no document goes. Null and empty texts
    stay; repeated rows are judged alike; no rows give no rows.
    """
    ship(spark)
    return drop_toxic(docs, toxicity_model(spark, docs, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for runs of whitespace: the smallest id's, one row where it repeats.

    Null counts as empty, so one such row stays; rows with a null id stay only
    where no other row has their text.
    """
    ship(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicate texts: the smallest id's.

    Texts without words and rows with a null id all stay; rows that share an id
    are documents of their own.
    """
    ship(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that leak a benchmark item; null and empty texts leak none, and no items drop no rows."""
    ship(spark)
    return drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mixture takes; weights are the quality network's scores of the texts."""
    ship(spark)
    mixed = mix(docs, quality_weight(spark, docs, sf_dir))
    return mixed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The toxicity stage's model has no SQL form; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
