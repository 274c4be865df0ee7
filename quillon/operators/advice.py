"""Texts about findings: summaries, guidance, rule documentation, audit rows. Deterministic projections only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import Rule
from .relational import compliance, risk_score, severity_counts

# What kind of credential a rule id names, by its first matching word, and what to do about it.
KINDS = (
    ("private-key", "cryptographic key", "Generate a new key pair, replace the public key everywhere and destroy the old one"),
    ("password", "password", "Change the password and end the sessions that used it"),
    ("webhook", "webhook address", "Delete the webhook and create a new one"),
    ("jwt", "session token", "Revoke the token and rotate the signing key"),
    ("token", "access token", "Revoke the token at its provider and issue a new one"),
    ("key", "API key", "Rotate the key at its provider and update what uses it"),
    ("secret", "client secret", "Rotate the secret and restart what uses it"),
)


def _by_kind(at: int, other: str) -> Column:
    out = F
    for word, *texts in KINDS:
        out = out.when(F.col("rule_id").contains(word), texts[at])
    return out.otherwise(F.lit(other))


def classified(findings: DataFrame) -> DataFrame:
    """With kind, risk (0 to 100) and guidance."""
    return findings.withColumn("kind", _by_kind(0, "credential")).withColumn("risk", risk_score(F.col("severity"))).withColumn("guidance", _by_kind(1, "Revoke the credential and replace it"))


def impact(findings: DataFrame) -> DataFrame:
    """One row a kind: findings, files, worst risk."""
    return classified(findings).groupBy("kind").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("files"), F.max("risk").alias("risk"))


def summary(findings: DataFrame, most: int = 10) -> str:
    """A few sentences with the counts and the first rules by id."""
    c = severity_counts(findings).first()
    if not c["total"]:
        return "No findings."
    rules = [r["rule_id"] for r in findings.select("rule_id").distinct().orderBy("rule_id").limit(most).collect()]
    return f"{c['total']} findings: {c['critical']} critical, {c['high']} high, {c['medium']} medium, {c['low']} low. Rules: {', '.join(rules)}."


def compliance_text(findings: DataFrame, framework: str = "SOC2") -> str:
    r = compliance(findings, framework).first()
    lines = [f"{framework}: {r['status']}", *(f"{k}: {r[k]}" for k in ("total", "critical", "high", "medium", "low", "active", "inactive", "unverified"))]
    return "\n".join([*lines, *(f"- {x}" for x in r["recommendations"])])


def rule_documentation(rules: list[Rule]) -> str:
    """Markdown, a section a rule."""
    return "\n".join(f"## {r.rule_id}\n\n{r.description}\n\n- severity: {r.severity}\n- pattern: `{r.pattern}`\n- gate: {', '.join(r.prefilter) or 'none'}\n" for r in rules)


def audit_rows(findings: DataFrame, user: str, action: str, at: int) -> DataFrame:
    """JSON lines that say who did what to how many findings of each rule."""
    counts = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))
    return counts.select(F.to_json(F.struct(F.lit(at).alias("timestamp"), F.lit(user).alias("user"), F.lit(action).alias("action"), "rule_id", "findings")).alias("value"))


def applies(path: Column, size: Column, extensions: tuple[str, ...] = (), contains: tuple[str, ...] = (), env: dict[str, bool] | None = None, least: int = 0, most: int = 0) -> Column:
    """A rule's conditions: extension, path substring, environment variables set, size bounds (0: off)."""
    from ..functions.text import extension

    out = F.lit(all((env or {}).values()))
    if extensions:
        out = out & extension(path).isin(*(e.lower().lstrip(".") for e in extensions))
    if contains:
        some = F.lit(False)
        for part in contains:
            some = some | path.contains(part)
        out = out & some
    out = out & (size >= least) if least else out
    return out & (size <= most) if most else out
