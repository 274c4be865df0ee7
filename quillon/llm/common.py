"""Shared helpers: table access, shared scratch tables, checked broadcasts."""

from __future__ import annotations

import operator
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField

#: A side of a join is broadcast only if its measured rows and bytes stay under these.
BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 24 << 20

#: ASCII whitespace, as every contract on words defines it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. One of this machine stands in only where everything runs on it (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(at)
    out = spark.read.schema(schema).parquet(at)
    out.stored_at = at
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        at = getattr(df, "stored_at", None)
        if at:
            context = df.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _width(field: StructField) -> Column:
    """Bytes of a value, about."""
    if isinstance(field.dataType, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(field.name), F.lit(0)) + 16
    if isinstance(field.dataType, ArrayType):
        return 8 * F.coalesce(F.size(field.name), F.lit(0)) + 16
    return F.lit(8)


def is_small(df: DataFrame) -> bool:
    """Whether df's measured rows and bytes allow a broadcast."""
    rows = F.count(F.lit(1))
    size = F.sum(reduce(operator.add, map(_width, df.schema.fields)))
    rows, size = df.agg(rows, size).first()
    return rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES


def if_small(df: DataFrame) -> DataFrame:
    """Mark a stored df for broadcast if it is small; else its joins shuffle."""
    return F.broadcast(df) if is_small(df) else df


def bounded(df: DataFrame, what: str) -> DataFrame:
    """Store df; joins broadcast it if it is small, and shuffle it else."""
    return if_small(stored(df, what))


def numbered(docs: DataFrame, **columns: Column) -> DataFrame:
    """The given columns with `row`, a number of the row, stored once: every later scan reads the same numbers, however it is split."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), *(c.alias(name) for name, c in columns.items())), "numbered")


def id_text(name: str) -> Column:
    """An id as text: pandas would turn a long column with nulls into floats."""
    return F.col(name).cast("long").cast("string").alias("id")


def id_back(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.col("id").cast("long"))


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's text leaves the remainder; ids that are null are never held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A reproducible number in (0, 1) from the columns' values."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
