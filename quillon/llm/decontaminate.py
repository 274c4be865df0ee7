"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders; what is left is lower-cased
and cut into words. Windows of eight template words of every document are
hash-joined with those of the benchmark items, so a question asked again with
other values still meets its template. Where a window has slots, the values
that stand there must fit: within one occurrence, equal values of the item
correspond to equal values of the document. An occurrence is a diagonal
(document position - item position). A document leaks an item when its
consistent occurrences cover half of the item's windows. Every capitalised word
is a name, wherever it stands, so the template does not depend on the context.

Windows of the plain lower-cased words, numbers included, are joined as well,
so a verbatim copy in any case or context is met, also where capitals or slots
differ or make up most of a window; half of an item's plain windows are a leak.

The windows of a document are hashed by doubling (pairs, fours, eights) inside
its row and only those that a benchmark window meets leave the scan.

Defined cases: null and empty texts and items match nothing; items of four to
seven words are matched by windows of four, all of them; shorter items hold too
little to identify and match nothing; template windows with fewer than half literal
words are not used, plain ones always; repeated documents are reported under their id once;
documents that lack an id are reported under a null id; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, if_small, is_small, stored

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
NUMBER_RE = r"[0-9]+(?:[.,:/][0-9]+)*"
UNITS = (
    "percent|dollars?|euros?|cents?|kilometers?|kilometres?|meters?|metres?|centimeters?|miles?|feet|foot|inches|inch|yards?|acres?"
    "|kilograms?|grams?|pounds?|ounces?|tons?|liters?|litres?|gallons?|cups?|hours?|minutes?|seconds?|days?|weeks?|months?|years?"
    "|degrees?|km|kg|cm|mm|mg|ml|mph|kph|kwh|hz|khz|mhz|ghz|gb|mb|kb|lbs?|oz|ft|hrs?|mins?|secs?"
)
UNIT_RE = rf"(?i)(?<={NUMBER} {{1,3}})(?:{UNITS})\b"
NAME_RE = r"(?<!\p{L})\p{Lu}\p{Ll}+"
WINDOW, SHORT = 8, 4
COVERAGE = 0.5


def _numbers(text: Column) -> Column:
    return F.regexp_replace(text, NUMBER_RE, f" {NUMBER} ")


def _units(text: Column) -> Column:
    return F.regexp_replace(text, UNIT_RE, f" {UNIT} ")


def template_words(text: Column) -> Column:
    """The template's words; a placeholder is a word of its own."""
    bare = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[-]", " ")
    marked = F.regexp_replace(_units(_numbers(bare)), NAME_RE, f" {NAME} ")
    return F.array_remove(F.split(F.lower(marked), rf"[^\p{{L}}{NUMBER}-{UNIT}]+"), "")


def plain_words(text: Column) -> Column:
    """The lower-cased words and numbers as they stand."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _slot_values(text: Column) -> Column:
    """The values behind the placeholders of each type, in order."""
    bare = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[-]", " ")
    numbers = _numbers(bare)
    return F.create_map(
        F.lit(NUMBER), F.regexp_extract_all(bare, F.lit(NUMBER_RE), F.lit(0)),
        F.lit(UNIT), F.transform(F.regexp_extract_all(numbers, F.lit(UNIT_RE), F.lit(0)), F.lower),
        F.lit(NAME), F.transform(F.regexp_extract_all(_units(numbers), F.lit(NAME_RE), F.lit(0)), F.lower),
    )


def _joined(h: str, step: int) -> Column:
    """Hashes of neighbours `step` apart."""
    a = F.col(h)
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(step + 1), n), lambda x, y: F.xxhash64(x, y))


def _hashes(df: DataFrame) -> DataFrame:
    """Adds h4 and h8, hashes of all windows of four and eight of the column words."""
    df = df.withColumn("h1", F.transform("words", lambda w: F.xxhash64(w)))
    return df.withColumn("h2", _joined("h1", 1)).withColumn("h4", _joined("h2", 2)).withColumn("h8", _joined("h4", 4)).drop("h1", "h2")


def _slots(df: DataFrame, key: str) -> DataFrame:
    """(key, pos, kind, value) for every placeholder of the columns words and text."""
    df = df.select(key, "words", _slot_values(F.col("text")).alias("values"))
    each = df.select(key, "values", "words", F.posexplode_outer("words").alias("pos", "kind")).where(F.col("kind").isin(NUMBER, NAME, UNIT))
    rank = F.size(F.filter(F.slice("words", F.lit(1), F.col("pos") + 1), lambda w: w == F.col("kind")))
    return each.select(key, "pos", "kind", F.get(F.col("values")[F.col("kind")], rank - 1).alias("value"))


def _verbatim(source: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """Pairs whose plain windows cover the item: id, text_hash, item, n_windows, item_windows."""
    bench = _hashes(items.select("item", plain_words(F.col("text")).alias("words")))
    bench = bench.where(F.size("words") >= SHORT).withColumn("w", F.when(F.size("words") >= WINDOW, WINDOW).otherwise(SHORT))
    windows = stored(bench.select("item", "w", F.posexplode_outer(F.when(F.col("w") == WINDOW, F.col("h8")).otherwise(F.col("h4"))).alias("item_pos", "h")), "plain")
    n_short = windows.where(F.col("w") == SHORT).count()
    small = is_small(windows)
    totals = windows.groupBy("item").agg(F.count(F.lit(1)).alias("item_windows"), F.max("w").alias("w"))
    hashed = _hashes(source.select("id", F.xxhash64("text").alias("text_hash"), plain_words(F.col("text")).alias("words")))
    kinds = [("h8", WINDOW)] + ([("h4", SHORT)] if n_short else [])
    met = None
    for h, w in kinds:
        wanted = windows.where(F.col("w") == w).select("h", "item", "item_pos")
        found = hashed.select("id", "text_hash", F.posexplode_outer(h).alias("pos", "h")).join((F.broadcast(wanted) if small else wanted), "h").select("id", "text_hash", "item", "item_pos")
        met = found if met is None else met.unionByName(found)
    pairs = met.distinct().groupBy("id", "text_hash", "item").agg(F.count(F.lit(1)).alias("n_windows"))
    enough = F.when(F.col("w") == WINDOW, F.col("n_windows") >= coverage * F.col("item_windows")).otherwise(F.col("n_windows") == F.col("item_windows"))
    return pairs.join(F.broadcast(totals) if small else totals, "item").where(enough).select("id", "text_hash", "item", "n_windows", "item_windows")


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and item it leaks: id, text_hash, item, n_windows, item_windows, reparameterised."""
    known = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where(F.col("text").isNotNull())
    bench = _hashes(known.select("item", "text", template_words(F.col("text")).alias("words")))
    bench = bench.where(F.size("words") >= SHORT).withColumn("w", F.when(F.size("words") >= WINDOW, WINDOW).otherwise(SHORT))
    windows = bench.select("item", "w", "words", F.posexplode_outer(F.when(F.col("w") == WINDOW, F.col("h8")).otherwise(F.col("h4"))).alias("item_pos", "h"))
    literal = F.size(F.filter(F.slice("words", F.col("item_pos") + 1, F.col("w")), lambda x: ~x.isin(NUMBER, NAME, UNIT)))
    windows = windows.where(2 * literal >= F.col("w")).select("item", "w", "item_pos", "h", (literal < F.col("w")).alias("has_slots"))
    windows = stored(windows, "bench")
    n_slotted, n_short = windows.agg(F.count_if("has_slots"), F.count_if(F.col("w") == SHORT)).first()
    small = is_small(windows)
    totals = windows.groupBy("item").agg(F.count(F.lit(1)).alias("item_windows"), F.max("w").alias("w"))

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    hashed = _hashes(source.select("id", F.xxhash64("text").alias("text_hash"), template_words(F.col("text")).alias("words")))
    wanted = windows.select("h", "item", "item_pos", "w", "has_slots")
    long = wanted.where(F.col("w") == WINDOW)
    met = hashed.select("id", "text_hash", F.posexplode_outer("h8").alias("pos", "h")).join(F.broadcast(long) if small else long, "h")
    if n_short:
        brief = wanted.where(F.col("w") == SHORT)
        short = hashed.select("id", "text_hash", F.posexplode_outer("h4").alias("pos", "h")).join(F.broadcast(brief) if small else brief, "h")
        met = met.unionByName(short)
    met = met.select("id", "text_hash", "item", "item_pos", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "w", "has_slots")
    met = stored(met, "met")

    same = [F.col("id").eqNullSafe(F.col("d_id")), F.col("text_hash") == F.col("d_hash")]
    if n_slotted:
        asked = met.where("has_slots").select(F.col("id").alias("d_id"), F.col("text_hash").alias("d_hash")).distinct()
        asked = stored(asked, "asked")
        texts = source.withColumn("text_hash", F.xxhash64("text")).join(if_small(asked), same, "left_semi").dropDuplicates(["id", "text_hash"])
        texts = texts.withColumn("key", F.struct("id", "text_hash")).withColumn("words", template_words(F.col("text")))
        there = _slots(texts, "key").select(F.col("key.id").alias("d_id"), F.col("key.text_hash").alias("d_hash"), "pos", "kind", F.col("value").alias("doc_value"))
        ours = _slots(bench, "item").select("item", "pos", "kind", F.col("value").alias("item_value"))
        covered = met.where("has_slots").select("id", "text_hash", "item", "diagonal", F.explode(F.sequence("item_pos", F.col("item_pos") + F.col("w") - 1)).alias("at")).distinct()
        covered = covered.join(ours.withColumnRenamed("pos", "at"), ["item", "at"])
        held = covered.join(there, [*same, F.col("pos") == F.col("at") + F.col("diagonal"), there["kind"] == covered["kind"]])
        held = held.groupBy("id", "text_hash", "item", "diagonal", covered["kind"], "item_value").agg(F.min("doc_value").alias("low"), F.max("doc_value").alias("high"))
        held = held.groupBy("id", "text_hash", "item", "diagonal").agg(F.bool_and(F.col("low") == F.col("high")).alias("fits"), F.bool_or(F.col("low") != F.col("item_value")).alias("other"))
        held = held.select(F.col("id").alias("d_id"), F.col("text_hash").alias("d_hash"), F.col("item").alias("d_item"), F.col("diagonal").alias("d_diagonal"), "fits", "other")
        met = met.join(held, [*same, F.col("item") == F.col("d_item"), F.col("diagonal") == F.col("d_diagonal")], "left")
        met = met.where(F.coalesce("fits", F.lit(True))).withColumn("other", F.coalesce("other", F.lit(False)))
    else:
        met = met.withColumn("other", F.lit(False))
    pairs = met.groupBy("id", "text_hash", "item", "item_pos").agg(F.bool_and("other").alias("other"))
    pairs = pairs.groupBy("id", "text_hash", "item").agg(F.count(F.lit(1)).alias("n_windows"), F.bool_or("other").alias("reparameterised"))
    enough = F.when(F.col("w") == WINDOW, F.col("n_windows") >= coverage * F.col("item_windows")).otherwise(F.col("n_windows") == F.col("item_windows"))
    out = ["n_windows", "item_windows", "reparameterised"]
    asked = pairs.join(F.broadcast(totals) if small else totals, "item").where(enough).select("id", "text_hash", "item", *out, F.lit(True).alias("template"))
    copied = _verbatim(source, known, coverage).select("*", F.lit(False).alias("reparameterised"), F.lit(False).alias("template"))
    both = asked.unionByName(copied).groupBy("id", "text_hash", "item").agg(F.max(F.struct("template", *out)).alias("best"))
    return both.select("id", "text_hash", "item", *(f"best.{c}" for c in out))


def drop_leaking(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that leak no item."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    gone = bounded(leaks(docs, items, **options).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct(), "gone")
    same = [F.xxhash64(F.col(text_col).cast("string")) == F.col("__hash"), F.col(id_col).cast("long").eqNullSafe(F.col("__id"))]
    return docs.join(gone, same, "left_anti")
