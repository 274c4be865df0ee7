"""Composite rules, pattern groups, look-aheads, transforms, base64 rescans, rotation, continuation lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import Rule
from .scan import matches, scan_raw


def composite(lines: DataFrame, pattern: str, require: list[str], proximity: int) -> DataFrame:
    """First match of each line that has, for every required pattern, a line within `proximity` lines that holds it."""
    near = Window.partitionBy("path").orderBy("line").rangeBetween(-proximity, proximity)
    out = lines
    for k, p in enumerate(require):
        out = out.withColumn(f"_near{k}", F.max(F.col("text").rlike(p)).over(near))
    ok = F.lit(True)
    for k in range(len(require)):
        ok = ok & F.col(f"_near{k}")
    first = F.get(matches(F.lit(pattern), F.col("text")), F.lit(0))
    out = out.where(F.col("text").rlike(pattern) & ok).withColumn("m", first)
    return out.select("path", "line", (F.col("m.start") + 1).alias("column"), F.col("m.text").alias("matched"))


def any_pattern(lines: DataFrame, patterns: list[str]) -> DataFrame:
    """All matches of all patterns, by start; equal starts in pattern order."""
    def numbered(k: int, p: str) -> Column:
        return F.transform(matches(F.lit(p), F.col("text")), lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("pattern"), m["text"].alias("matched")))

    each = F.flatten(F.array(*(numbered(k, p) for k, p in enumerate(patterns))))
    found = lines.select("path", "line", F.explode(F.array_sort(each)).alias("m"))
    return found.select("path", "line", "m.start", "m.pattern", "m.matched")


def without_following(lines: DataFrame, pattern: str, lookaheads: list[str]) -> DataFrame:
    """Matches after which, anywhere in the line, no look-ahead pattern follows."""
    found = lines.select("path", "line", "text", F.explode(matches(F.lit(pattern), F.col("text"))).alias("m"))
    after = F.substring(F.col("text").cast("binary"), F.col("m.start") + F.octet_length("m.text") + 1, F.octet_length("text")).cast("string")
    for p in lookaheads:
        found = found.where(~after.rlike(p))
    return found.select("path", "line", F.col("m.start").alias("start"), F.col("m.text").alias("matched"))


def transform(value: Column, kind: str, argument: str = "", strict_compat: bool = False) -> Column:
    """none, base64_decode, url_decode, trim, strip_prefix, strip_suffix, upper, lower."""
    if kind == "base64_decode":
        return value if strict_compat else F.coalesce(F.try_to_binary(value, F.lit("base64")).cast("string"), value)
    if kind == "url_decode":
        for code, c in (("%20", " "), ("%2F", "/"), ("%3A", ":"), ("%3D", "="), ("%26", "&"), ("%40", "@")):
            value = F.replace(value, F.lit(code), F.lit(c))
        return value
    if kind == "strip_prefix":
        return F.when(value.startswith(argument), F.substring(value, F.lit(len(argument) + 1), F.char_length(value))).otherwise(value)
    if kind == "strip_suffix":
        return F.when(value.endswith(argument), F.substring(value, F.lit(1), F.char_length(value) - len(argument))).otherwise(value)
    return {"none": lambda: value, "trim": lambda: F.trim(value), "upper": lambda: F.upper(value), "lower": lambda: F.lower(value)}[kind]()


def captured(line: Column, pattern: str, group: int, kind: str = "none", argument: str = "") -> Column:
    """A capture of the first match, transformed; null without a match."""
    return F.when(line.rlike(pattern), transform(F.regexp_extract(line, pattern, group), kind, argument))


def rule_tests(cases: DataFrame, rules: list[Rule]) -> DataFrame:
    """cases (rule_id, input, should_match) with `passed`."""
    out = F
    for r in rules:
        out = out.when(F.col("rule_id") == r.rule_id, F.col("input").rlike(r.pattern))
    found = F.coalesce(out.otherwise(F.lit(False)), F.lit(False))
    return cases.withColumn("passed", found == F.col("should_match"))


_BASE64 = r"[A-Za-z0-9+/]{6,}={0,2}"


def base64_candidates(lines: DataFrame) -> DataFrame:
    """Decoded base64 runs of each line that look like text: (path, line, context, text)."""
    runs = lines.select("path", "line", F.col("text").alias("context"), F.explode(F.regexp_extract_all("text", F.lit(_BASE64), F.lit(0))).alias("run"))
    mixed = F.col("run").rlike("[+/=]") | (F.col("run").rlike("[A-Z]") & F.col("run").rlike("[a-z]") & F.col("run").rlike("[0-9]"))
    runs = runs.where((F.char_length("run") >= 8) & (F.char_length("run") % 4 == 0) & mixed)
    plain = F.try_validate_utf8(F.try_to_binary("run", F.lit("base64")).cast("string"))
    return runs.withColumn("text", plain).where(F.col("text").isNotNull() & (F.char_length("text") >= 8) & F.col("text").rlike(r"\A[\x20-\x7e\t\r\n]*\z")).drop("run")


def scan_base64(lines: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Raw findings inside base64 text; a second level is read where the first finds nothing."""
    first = base64_candidates(lines)
    once = scan_raw(first.select("path", "line", "text"), rules)
    quiet = first.join(once.select("path", "line").distinct(), ["path", "line"], "left_anti")
    second = base64_candidates(quiet.select("path", "line", "text"))
    twice = scan_raw(second.select("path", "line", "text"), rules)
    return once.withColumn("context", F.concat(F.lit("[base64] "), "context")).unionByName(twice.withColumn("context", F.concat(F.lit("[base64x2] "), "context")))


def rotated(findings: DataFrame, within: int = 3) -> DataFrame:
    """Findings whose rule has another value one to `within` lines further down, in any file: likely old values.

    A line's values are known by their least and greatest: another value follows
    if either differs. Both are summed up by (rule, line) over all files first,
    so a line number that every file has is one row, and the join is an equi-join.
    """
    values = findings.groupBy("rule_id", "line").agg(F.min("matched").alias("_low"), F.max("matched").alias("_high"))
    above = F.sequence(F.col("line") - within, F.col("line") - 1)
    ahead = values.select("rule_id", F.explode(above).alias("line"), "_low", "_high").groupBy("rule_id", "line").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    other = (F.col("_low") != F.col("matched")) | (F.col("_high") != F.col("matched"))
    return findings.join(ahead, ["rule_id", "line"]).where(other).select(*findings.columns)


def continued(lines: DataFrame, least: int = 20) -> DataFrame:
    """Lines joined over trailing backslashes: (path, first, last, text) of over `least` bytes."""
    order = Window.partitionBy("path").orderBy("line")
    goes_on = F.col("text").endswith("\\")
    marked = lines.withColumn("_on", goes_on).withColumn("_start", (~F.coalesce(F.lag("_on").over(order), F.lit(False))).cast("int"))
    marked = marked.withColumn("_island", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.struct("line", F.regexp_replace("text", r"\\+$", "").alias("text"))
    last = F.max("line").over(Window.partitionBy("path"))
    marked = marked.withColumn("_last", last)
    grouped = marked.groupBy("path", "_island").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count(F.lit(1)).alias("n"), F.max("_last").alias("_last"), F.sort_array(F.collect_list(part)).alias("parts"), F.max_by("_on", "line").alias("open"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    return grouped.where("n > 1").select("path", "first", "last", joined.alias("text")).where(F.octet_length("text") > least)
