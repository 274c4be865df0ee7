"""What all registered queries share: the registry, lines built from `orders`, and their findings in SQL.

The given tables hold few secrets, so lines are built from `orders` by rules
that Spark and DuckDB share (md5, modulo).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from ..rules import ENTROPY_RULE, Rule, builtin

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CHOSEN = ("aws-access-key-id", "github-pat", ENTROPY_RULE)


def rules() -> list[Rule]:
    return [r for r in builtin() if r.rule_id in CHOSEN]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, line, text), a line an order."""
    k = F.col("o_orderkey")
    digest = F.md5(k.cast("string").cast("binary"))
    folder = F.element_at(F.array(*map(F.lit, ("tests", "docs", "vendor", "src", "src", "src", "src"))), (k % 7 + 1).cast("int"))
    ext = F.element_at(F.array(*map(F.lit, ("py", "js", "env", "md", "yaml"))), (k % 5 + 1).cast("int"))
    body = (
        F.when(k % 4 == 0, F.concat(F.lit('aws_key = "AKIA'), F.upper(F.substring(digest, 1, 16)), F.lit('"')))
        .when(k % 4 == 1, F.concat(F.lit("token = ghp_"), digest, F.substring(digest, 1, 4)))
        .when(k % 4 == 2, F.concat(F.lit("# password: "), digest))
        .otherwise(F.concat(F.lit("plain text line "), k.cast("string")))
    )
    path = F.concat(folder, F.lit("/f"), (k % 50).cast("string"), F.lit("."), ext)
    return table(spark, sf_dir, "orders").select(path.alias("path"), k.cast("int").alias("line"), body.alias("text"))


LINES_SQL = """
lines AS (SELECT (['tests','docs','vendor','src','src','src','src'])[o_orderkey % 7 + 1] || '/f' || (o_orderkey % 50) || '.' || (['py','js','env','md','yaml'])[o_orderkey % 5 + 1] AS path,
  o_orderkey::INT AS line,
  CASE o_orderkey % 4 WHEN 0 THEN 'aws_key = "AKIA' || upper(substr(md5(o_orderkey::VARCHAR), 1, 16)) || '"'
    WHEN 1 THEN 'token = ghp_' || md5(o_orderkey::VARCHAR) || substr(md5(o_orderkey::VARCHAR), 1, 4)
    WHEN 2 THEN '# password: ' || md5(o_orderkey::VARCHAR) ELSE 'plain text line ' || o_orderkey END AS text FROM orders)"""

BITS = "list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -((length({v}) - length(replace({v}, c, '')))::DOUBLE / strlen({v})) * log2((length({v}) - length(replace({v}, c, '')))::DOUBLE / strlen({v}))))"

FOUND_SQL = (
    LINES_SQL
    + r""",
hits AS (
  SELECT 'aws-access-key-id' AS rule_id, 'critical' AS severity, 4 AS severity_rank, path, line, text, regexp_extract(text, '\b(AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA|ASCA)[0-9A-Z]{16}\b') AS matched FROM lines
  UNION ALL SELECT 'github-pat', 'critical', 4, path, line, text, regexp_extract(text, '\bgh[pousr]_[A-Za-z0-9]{36,255}\b') FROM lines
  UNION ALL SELECT 'generic-high-entropy', 'medium', 2, path, line, text, v FROM (SELECT *, regexp_extract(text, '(?i)(key|token|secret|passwd|password|api[_-]?key)\s*[:=]\s*[''"]?([A-Za-z0-9+/_\-\.=]{16,})[''"]?', 2) AS v FROM lines)
    WHERE strlen(v) >= 20 AND """
    + BITS.format(v="v")
    + r""" >= 3.5),
found AS (SELECT rule_id, severity, severity_rank, path, line, strpos(text, matched)::INT AS "column", matched, text AS context,
    (CASE WHEN path LIKE '%.py' OR path LIKE '%.env' OR path LIKE '%.yaml' THEN strpos(text, '#') > 0 AND strpos(text, matched) >= strpos(text, '#')
          WHEN path LIKE '%.js' THEN strpos(text, '//') > 0 AND strpos(text, matched) >= strpos(text, '//') ELSE false END) OR path LIKE 'tests/%' AS likely_false_positive
  FROM hits WHERE matched <> '')"""
)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan_gated(lines(spark, sf_dir), rules())


def found_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for queries that read the findings more than once: scanned once, kept by the executors, scanned again only where one is lost."""
    return found(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK)


def register(name: str, sql: str | None = None, cte: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = f"WITH {cte}\n{sql}" if cte else sql
        return query

    return add
