"""Schemas and the severity scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("low", "medium", "high", "critical")

FINDING = (
    "rule_id string, description string, severity string, severity_rank int, path string, line int, column int, matched string, "
    "context string, commit string, likely_false_positive boolean, verification string, verification_error string"
)
FINDING_COLUMNS = [c.split()[0] for c in FINDING.split(", ")]
LINES = "path string, line int, text string"
RULES = (
    "rule_id string, description string, severity string, severity_rank int, pattern string, prefilter array<string>, entropy double, "
    "secret_group int, path_filter string, allow_regexes array<string>, allow_paths array<string>, allow_stopwords array<string>, ordinal int"
)
BASELINE = "rule_id string, path string, matched string"
SUPPRESSION = "fingerprint string, reason string, suppressed_by string, created_at bigint, expires_at bigint"
VERIFY_CACHE = "rule_id string, secret_hash string, status string, timestamp bigint"


def rank(severity: str) -> int:
    return SEVERITIES.index(severity.lower()) + 1


def severity_rank(severity: Column) -> Column:
    """1 (low) to 4 (critical); null for anything else."""
    return F.when(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(severity)) > 0, F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(severity))).cast("int")


def fingerprint(*, sarif: bool = False) -> Column:
    """rule:path:line:matched, or for SARIF rule:path:line:commit with '-' for none."""
    last = F.coalesce("commit", F.lit("-")) if sarif else F.col("matched")
    return F.concat_ws(":", "rule_id", "path", F.col("line").cast("string"), last)
