"""Exact duplicates by progressive refinement, in DataFrame functions only.

Rows are grouped by the length of the normalised text, the survivors by a hash
of its prefix, and only what survives both by the SHA-256 of the whole text.
The first two levels run over a narrow table (length, prefix hash, rows) that
one scan writes; the second scan hashes whole texts of surviving groups.

Defined cases: null counts as the empty text, and empty texts are one group;
of rows that tie on the id exactly one stays; a null id comes after every
other id, and keep_id is null only where all ids of the group are; no rows
give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, is_small, release, stored

PREFIX = 64


def normalised(text: Column) -> Column:
    """Every run of ASCII whitespace becomes one space; null becomes empty."""
    flat = F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_replace(flat, "  +", " ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, digest_all: bool = False, row_col: str | None = None) -> DataFrame:
    """One row a document: id, row, keep_id, group_size, kept, digest (binary SHA-256; of surviving groups, or of all).

    row is the value of row_col; without one it tells this result's rows apart and says nothing about docs.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row.alias("row"), normalised(F.col(text_col).cast("string")).alias("norm"))
    rows = rows.select("id", "row", "norm", F.char_length("norm").alias("n"), F.xxhash64(F.substring("norm", 1, prefix)).alias("p"))

    # counts by (length, prefix) are summed to counts by length, so no length's rows meet in one task
    profile = stored(rows.groupBy("n", "p").count(), "profile")
    lengths = profile.groupBy("n").agg(F.sum("count").alias("rows")).where("rows > 1").select("n")
    prefixes = profile.where("count > 1").join(lengths, "n", "left_semi").select("n", "p", F.lit(True).alias("again"))
    prefixes = stored(prefixes, "prefixes")
    release(profile)

    whole = F.unhex(F.sha2("norm", 256))
    if is_small(prefixes):
        tagged = rows.join(F.broadcast(prefixes), ["n", "p"], "left")
        digest = whole if digest_all else F.when(F.col("again"), whole)
        tagged = tagged.select("id", "row", F.coalesce("again", F.lit(False)).alias("again"), digest.alias("digest"))
    else:  # moving a 32-byte digest costs less than moving the text to where the group is known
        tagged = rows.select("id", "row", "n", "p", whole.alias("digest")).join(prefixes, ["n", "p"], "left")
        tagged = tagged.select("id", "row", F.coalesce("again", F.lit(False)).alias("again"), "digest")
    tagged = stored(tagged, "digests")
    release(prefixes)

    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    groups = tagged.where("again").groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = bounded(groups.select("digest", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"), "groups")

    joined = tagged.where("again").join(groups, "digest", "left")
    alone = F.col("group_size").isNull()
    copies = joined.select(
        "id",
        "row",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "digest",
    )
    single = tagged.where("not again").select("id", "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    return copies.unionByName(single)


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that repeat an earlier one.

    Rows are numbered once, in a stored copy, and dropped from that copy by the
    stored number, so that a scan split another way drops the same rows.
    """
    number = "row"
    while number in map(str.lower, docs.columns):
        number += "_"
    kept = stored(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    gone = bounded(exact_duplicates(kept, row_col=number, **options).where("not kept").select(F.col("row").alias(number)), "gone")
    return kept.join(gone, number, "left_anti").select(*docs.columns)
