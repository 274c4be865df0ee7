"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key, -ln(u) / weight, with u from a hash of
its id and text and weight its quality; within a source, documents in key order
are a weighted sample without replacement. A source whose target exceeds its
size first gives complete epochs; the rest of its target is taken from the
front of its key order by prefix sums, and the one document across the target
in part.

The order is never sorted as a whole. Keys fall into bins, as many for a
source as the root of its rows, and bins' sums are prefix-summed; only the rows of the
one bin that a target cuts are put in order, so neither a source that holds a
third of all rows nor any other needs a task of its own size.

Defined cases: null and empty texts have size 0 and are taken 0 times; a null
source is a source of its own, weighed last; repeated rows tie on the key and
are ordered by row; a source without words has target 0; if every source
reaches its cap, targets are the caps; a document without a weight counts as
USUAL, one under FLOOR as FLOOR; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded, stored, unit_hash

WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3.0
FLOOR = 0.05
#: Weight of a document that has none.
USUAL = 0.6


def ranked(totals: DataFrame) -> DataFrame:
    """Stored totals (source, ...) with the place of each source by code point, null last, however many there are.

    Range partitions are in order, so a place is the rows of the partitions before plus the place in the own one.
    """
    last = F.col("source").isNull()
    spread = totals.withColumn("_last", last).repartitionByRange("_last", "source").sortWithinPartitions("_last", "source")
    spread = stored(spread.select("*", F.monotonically_increasing_id().alias("_at")), "sources")
    part = F.shiftright("_at", 33)
    sizes = {r["part"]: r["count"] for r in spread.groupBy(part.alias("part")).count().collect()}  # one row a partition
    before, at = {}, 0
    for k in sorted(sizes):
        before[k], at = at, at + sizes[k]
    offset = F.create_map(*[x for k, n in before.items() for x in (F.lit(k).cast("long"), F.lit(n).cast("long"))]) if before else None
    place = offset[part.cast("long")] + F.col("_at").bitwiseAND((1 << 33) - 1) if before else F.lit(0).cast("long")
    return spread.withColumn("place", place).drop("_at", "_last")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """totals (source, source_size, ...) with the target: all sizes shared by weight, capped at `most` times the size, the excess reshared.

    Every target is min(cap, level * weight) for one level, which rises, from sums over
    all sources, until no more of them reach their caps.
    """
    weight = F.array(*map(F.lit, weights))[F.pmod("place", F.lit(len(weights))).cast("int")]
    known = ranked(totals).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    total = known.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        taken, free = known.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if not free:
            return known.withColumn("target", F.col("cap")).drop("weight", "cap", "place")
        new = (total - taken) / free
        if new <= level:
            break
        level = new
    return known.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("weight", "cap", "place")


def mix(
    docs: DataFrame, quality: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: float = MOST_EPOCHS, seed: int = 5
) -> DataFrame:
    """One row a document: id, source, size, source_size, target, taken. quality: a document's weight, of docs' columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    u = unit_hash(F.col(id_col).cast("string"), text, seed=seed)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        (-F.log(u)).alias("key"),
        (F.lit(USUAL) if quality is None else quality.cast("double")).alias("quality"),
        F.monotonically_increasing_id().alias("row"),
    )
    weight = F.greatest(F.coalesce("quality", F.lit(USUAL)), F.lit(FLOOR))
    rows = stored(rows.withColumn("key", F.col("key") / weight).drop("quality"), "keys")
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"))
    plan = targets(totals, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("bins", F.ceil(F.sqrt("n"))).withColumn("mean", F.greatest(F.col("keys") / F.col("n"), F.lit(1e-12)))
    plan = bounded(plan.select("source", "source_size", "target", "epochs", "rest", "bins", "mean"), "plan")

    mine = plan.withColumnRenamed("source", "s")
    placed = rows.join(mine, rows["source"].eqNullSafe(mine["s"])).drop("s")
    share = 1 - F.exp(-F.col("key") / F.col("mean"))  # the mean's exponential law spreads keys about evenly; any law keeps order
    placed = placed.withColumn("bin", F.least(F.floor(share * F.col("bins")), F.col("bins") - 1).cast("long"))
    sums = stored(placed.groupBy("source", "bin").agg(F.sum("size").alias("words")), "bins")
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    sums = bounded(sums.select(F.col("source").alias("s"), F.col("bin").alias("b"), "words", F.coalesce(before, F.lit(0)).alias("before")), "offsets")

    known = placed.join(sums, placed["source"].eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    cut = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    whole = known.where(~cut).withColumn("extra", F.when(F.col("before") + F.col("words") <= F.col("rest"), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("key", "id", "row")
    inside = known.where(cut).withColumn("ends", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the one document that lies across the target is taken in part
    part = F.least(F.greatest(F.floor(F.col("rest") - (F.col("ends") - F.col("size"))), F.lit(0)), F.col("size")).cast("long")
    inside = inside.withColumn("extra", part).drop("ends")
    both = whole.unionByName(inside)
    return both.select("id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken"))
