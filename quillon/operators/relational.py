"""What happens to findings after the scan: joins, aggregates, lifecycle, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import secret_hash
from ..schema import fingerprint

KEY = ["rule_id", "path", "matched"]


def baseline_of(findings: DataFrame) -> DataFrame:
    return findings.select(*KEY).distinct()


def apply_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings the baseline does not hold, wherever their lines have moved to."""
    return findings.join(baseline.select(*KEY), KEY, "left_anti")


def suppressed_by(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    return findings.join(baseline.select(*KEY), KEY, "left_semi").agg(F.count(F.lit(1)).alias("suppressed"))


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Findings with status new, unchanged (from current) or resolved (from previous); duplicates stay."""
    old, new = (df.withColumn("fingerprint", fingerprint()) for df in (previous, current))
    seen = old.select("fingerprint").distinct().withColumn("_seen", F.lit(True))
    now = new.join(seen, "fingerprint", "left").withColumn("status", F.when(F.col("_seen"), "unchanged").otherwise("new")).drop("_seen")
    gone = old.join(new.select("fingerprint").distinct(), "fingerprint", "left_anti").withColumn("status", F.lit("resolved"))
    return now.unionByName(gone)


def diff_summary(changes: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return changes.agg(count("new").alias("new"), count("unchanged").alias("unchanged"), count("resolved").alias("resolved"), F.count(F.lit(1)).alias("total"))


def apply_suppressions(findings: DataFrame, suppressions: DataFrame, now: int) -> DataFrame:
    """Without findings under a suppression that has no expiry or one after `now` (epoch seconds)."""
    live = suppressions.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select("fingerprint")
    return findings.withColumn("fingerprint", fingerprint()).join(live, "fingerprint", "left_anti").drop("fingerprint")


def apply_project_baseline(findings: DataFrame, baselines: DataFrame) -> DataFrame:
    """findings (project, …) without those that baselines (project, fingerprint) hold."""
    return findings.withColumn("fingerprint", fingerprint()).join(baselines.select("project", "fingerprint"), ["project", "fingerprint"], "left_anti").drop("fingerprint")


def fill_verification(findings: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached status where a finding has none; the newest entry of a secret counts."""
    newest = cache.groupBy("rule_id", "secret_hash").agg(F.max_by("status", "timestamp").alias("_status"))
    keyed = findings.withColumn("secret_hash", secret_hash("matched"))
    return keyed.join(newest, ["rule_id", "secret_hash"], "left").withColumn("verification", F.coalesce("verification", "_status")).drop("secret_hash", "_status")


def to_verify(findings: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Distinct (rule_id, matched) to send to verifiers; exclusion wins."""
    rule = F.col("rule_id")
    wanted = rule.isin(include) if include else F.lit(True)
    return findings.where(wanted & ~(rule.isin(exclude) if exclude else F.lit(False))).select("rule_id", "matched").distinct()


# Offline verifiers by the bytes a value must have at least, and by the starts one of which it must have.
LEAST_BYTES: dict[int, tuple[str, ...]] = {
    10: ("backblaze-b2-key-id", "wasabi-api-key", "harbor-token", "nexus-token"),
    16: ("linkedin-client-secret",),
    20: (
        "azure-ad-client-secret", "azure-client-secret", "bitbucket-app-password", "bitbucket-client-secret", "tencent-secret-id", "tiktok-access-token", "paypal-client-secret", "paddle-token", "wepay-token",
        "maven-central-token", "semgrep-api-token", "codeium-api-key", "tabnine-api-key", "weaviate-api-key", "qdrant-api-key", "comet-ml-api-key", "modal-api-key", "runwayml-api-key", "portkey-api-key",
        "braintrust-api-key", "cal-com-api-key", "metabase-session-token", "drone-ci-token", "woodpecker-ci-token",
    ),
}
STARTS: dict[str, tuple[str, ...]] = {
    "alibaba-access-key-id": ("LTAI", "AK"), "flutterwave-secret-key": ("FLWSECK",), "razorpay-key": ("rzp_",), "razorpay-key-v2": ("rzp_",), "nuget-api-key": ("oy2",), "fly-io-token": ("FlyV1_",),
    "deno-deploy-token": ("ddp_",), "greptile-api-key": ("grpt_",), "langsmith-api-key": ("lsk_",), "langfuse-secret-key": ("sk-lf-",), "helicone-api-key": ("sk-helicone-",),
}
ANY_VALUE = ("gcp-oauth-client-id", "zoom-api-secret")
AWS_SECRETS = ("aws-secret-access-key", "aws-access-key-id")
DATABASES = ("postgres://", "postgresql://", "mysql://", "mongodb://", "mongodb+srv://", "redis://", "rediss://")


def _some(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def verify_formats(findings: DataFrame) -> DataFrame:
    """Offline verification: unknown where the value has its provider's shape, inactive where not; untouched for rules that need the network.

    A whole PEM block whose body is base64 is active. A service account is JSON with its type, key and address.
    """
    rule, value = F.col("rule_id"), F.col("matched")
    size = F.octet_length(value)
    shaped = F
    for least, rules in LEAST_BYTES.items():
        shaped = shaped.when(rule.isin(*rules), size >= least)
    for name, starts in STARTS.items():
        shaped = shaped.when(rule == name, _some([value.startswith(x) for x in starts]))
    shaped = shaped.when(rule.isin(*ANY_VALUE), F.lit(True)).when(rule.isin(*AWS_SECRETS), value.rlike(r"^[A-Za-z0-9+/=]{40}\z"))
    shaped = shaped.when(rule.isin("plaid-token", "plaid-key"), value.startswith("access-") | (size >= 20))
    has = lambda path: F.get_json_object(value, path).isNotNull()
    shaped = shaped.when(rule == "gcp-service-account-key", F.coalesce((F.get_json_object(value, "$.type") == "service_account") & has("$.private_key") & has("$.client_email"), F.lit(False)))
    address = _some([value.startswith(x) for x in DATABASES])
    pairs = (value.contains("password=") | value.contains("pwd=")) & (value.contains("host=") | value.contains("server="))
    shaped = shaped.when(rule == "database-connection-string", F.when(address, value.contains("@") & value.contains(":")).otherwise(pairs))
    shaped = shaped.when(rule == "private-key-pem", value.contains("-----BEGIN ") & value.contains("-----END ") & value.contains("PRIVATE KEY-----")).otherwise(F.lit(None))
    body = F.regexp_extract(value, r"(?s)-----BEGIN.*?-----\n(.*?)-----END", 1)
    whole = (rule == "private-key-pem") & value.rlike(r"(?s)-----BEGIN.*?-----\n.*?-----END") & F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")).rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    status = F.when(whole & shaped, "active").when(shaped, "unknown").when(~shaped, "inactive")
    return findings.withColumn("verification", F.coalesce("verification", status))


def override_severity(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides: (rule_id, severity)."""
    from ..schema import severity_rank

    out = findings.join(overrides.select("rule_id", F.col("severity").alias("_severity")), "rule_id", "left")
    out = out.withColumn("severity", F.coalesce("_severity", "severity")).drop("_severity")
    return out.withColumn("severity_rank", severity_rank(F.col("severity")))


def _of(severity: str) -> Column:
    return F.count_if(F.col("severity") == severity)


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.agg(_of("critical").alias("critical"), _of("high").alias("high"), _of("medium").alias("medium"), _of("low").alias("low"), F.count(F.lit(1)).alias("total"))


def rule_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy("rule_id")


def rules_seen(findings: DataFrame) -> DataFrame:
    """Distinct rules with a description, by id."""
    return findings.groupBy("rule_id").agg(F.min("description").alias("description")).orderBy("rule_id")


def hidden_count(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if("likely_false_positive").alias("hidden"))


def exit_code(findings: DataFrame, severity: str = "low", code: int = 1, ignore: bool = False) -> int:
    from ..schema import rank

    if ignore:
        return 0
    return code if not findings.where(F.col("severity_rank") >= rank(severity)).isEmpty() else 0


# The sentences of a compliance report; frameworks with theirs, and whether those need a serious finding.
ROTATE = "Immediately rotate %d critical-severity secrets detected in the codebase."
REMEDIATE = "Prioritize remediation of %d high-severity findings within 24 hours."
ACTIVE = "%d secrets were verified as ACTIVE — rotate them immediately."
UNVERIFIED = "More than 50% of findings are unverified. Run with --verify to check active status."
NOTHING = "No critical findings detected. Continue regular scanning."
FRAMEWORKS: dict[str, list[tuple[str, bool]]] = {
    "SOC2": [("SOC 2 CC6.1: Security controls must prevent unauthorized access to sensitive data.", False)],
    "PCI-DSS": [
        ("PCI-DSS Requirement 6.5.6: All security vulnerabilities must be remediated.", True),
        ("PCI-DSS Requirement 3.2: Strong cryptography must be used for stored cardholder data.", False),
    ],
    "HIPAA": [("HIPAA 164.312(a)(2)(iv): Encryption and decryption of electronic protected health information.", False)],
    "GDPR": [("GDPR Article 32: Security of processing — implement appropriate technical measures.", False)],
    "ISO27001": [("ISO 27001 A.8.3: Information access restriction and cryptography controls.", False)],
    "NIST": [("NIST CSF PR.DS-1: Data-at-rest is protected. Rotate exposed secrets.", False)],
}


def compliance(findings: DataFrame, framework: str = "SOC2") -> DataFrame:
    """One row: counts, status, findings by rule and recommendations.

    Critical or high findings are non_compliant, medium ones compliant_with_warnings; unverified
    are those without any status; half of the findings is rounded down.
    """
    status = lambda s: F.count_if(F.col("verification") == s)
    counts = {"total": F.count(F.lit(1)), **{s: _of(s) for s in ("critical", "high", "medium", "low")}, "active": status("active"), "inactive": status("inactive"), "unverified": F.count_if(F.col("verification").isNull())}
    by_rule = findings.groupBy("rule_id").agg(*(c.alias(n) for n, c in counts.items()))
    rules = F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule_id", "total"))))
    one = by_rule.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts), rules.alias("findings_by_rule"))
    serious = (F.col("critical") > 0) | (F.col("high") > 0)
    state = F.when(serious, "non_compliant").when(F.col("medium") > 0, "compliant_with_warnings").otherwise("compliant")
    advice = F.array_compact(
        F.array(
            F.when(F.col("critical") > 0, F.format_string(ROTATE, "critical")),
            F.when(F.col("high") > 0, F.format_string(REMEDIATE, "high")),
            F.when(F.col("active") > 0, F.format_string(ACTIVE, "active")),
            F.when(F.col("unverified") > F.floor(F.col("total") / 2), F.lit(UNVERIFIED)),
        )
    )
    advice = F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(NOTHING)))
    own = F.array_compact(F.array(*(F.when(serious, F.lit(text)) if needed else F.lit(text) for text, needed in FRAMEWORKS[framework])))
    return one.withColumn("framework", F.lit(framework)).withColumn("status", state).withColumn("recommendations", F.concat(advice, own))


BASE_RISK = {"critical": 90, "high": 70, "medium": 50, "low": 25}


def risk_score(severity: Column) -> Column:
    out = F
    for s, n in BASE_RISK.items():
        out = out.when(severity == s, n)
    return out.otherwise(F.lit(25))


#: Places in the original order that still lower a priority.
PLACES = 20


def prioritise(findings: DataFrame, order: list[str]) -> DataFrame:
    """Active first, then by severity; priority is the base less the place in the original order (20 at most, 10 for low).

    Only the first PLACES places differ, so only those rows are numbered; all others have place PLACES.
    """
    keyed = findings.withColumn("_key", F.struct(*order, F.xxhash64(*findings.columns).alias("_tie")))
    last = keyed.select("_key").orderBy("_key").limit(PLACES).agg(F.max("_key")).first()[0]
    fields = keyed.schema["_key"].dataType.fields
    limit = F.struct(*(F.lit(None if last is None else last[f.name]).cast(f.dataType).alias(f.name) for f in fields))
    place = F.least(F.row_number().over(Window.orderBy("_key")) - 1, F.lit(PLACES))
    head = keyed.where(F.col("_key") <= limit).withColumn("place", place)
    rest = keyed.where(F.col("_key") > limit).withColumn("place", F.lit(PLACES))
    most = F.when(F.col("severity") == "low", 10).otherwise(20)
    ranked = head.unionByName(rest).withColumn("priority", risk_score(F.col("severity")) - F.least(F.col("place"), most))
    ranked = ranked.orderBy(F.desc(F.coalesce(F.col("verification") == "active", F.lit(False))), F.desc("severity_rank"), "place", "_key")
    return ranked.drop("_key")


def project_counts(findings: DataFrame) -> DataFrame:
    """Findings of each project."""
    return findings.groupBy("project").agg(F.count(F.lit(1)).alias("findings"), _of("critical").alias("critical"))


def baseline_total(baselines: DataFrame) -> DataFrame:
    """Fingerprints over the baselines of all projects (project, fingerprint): one row."""
    return baselines.agg(F.count("fingerprint").alias("total"))


def category_of(findings: DataFrame, categories: DataFrame) -> DataFrame:
    """Each finding with its first category by name; categories: (name, rule_ids array)."""
    flat = categories.select("name", F.explode("rule_ids").alias("rule_id")).groupBy("rule_id").agg(F.min("name").alias("category"))
    return findings.join(flat, "rule_id", "left")


def permitted(tokens: DataFrame, roles: DataFrame, permission: str) -> DataFrame:
    """tokens (token, role) whose role (role, permissions array) holds the permission."""
    return tokens.join(roles, "role").where(F.array_contains("permissions", permission)).select("token", "role")


def ingest(tracked: DataFrame, findings: DataFrame, now: int, by: str = "scanner") -> DataFrame:
    """Tracked findings with first-seen ones added in state open; what is tracked stays as it is."""
    fresh = findings.withColumn("fingerprint", fingerprint()).dropDuplicates(["fingerprint"])
    fresh = fresh.join(tracked.select("fingerprint"), "fingerprint", "left_anti")
    fresh = fresh.select("fingerprint", "rule_id", "path", "line", "matched", F.lit("open").alias("state"), F.lit(now).cast("long").alias("detected_at"), F.lit(now).cast("long").alias("updated_at"), F.lit(by).alias("updated_by"), F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("assigned_to"))
    return tracked.select(*fresh.columns).unionByName(fresh)


def set_state(tracked: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """changes: (fingerprint, state, by)."""
    new = changes.select("fingerprint", F.col("state").alias("_state"), F.col("by").alias("_by"))
    out = tracked.join(new, "fingerprint", "left")
    return out.withColumn("updated_at", F.when(F.col("_state").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("updated_at"))).withColumn("state", F.coalesce("_state", "state")).withColumn("updated_by", F.coalesce("_by", "updated_by")).drop("_state", "_by")


def by_state(tracked: DataFrame) -> DataFrame:
    return tracked.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def with_tag(tracked: DataFrame, tag: str) -> DataFrame:
    return tracked.where(F.array_contains("tags", tag))


def assigned_to(tracked: DataFrame, who: str) -> DataFrame:
    return tracked.where(F.col("assigned_to") == who)


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """rows replace what has their key."""
    return table.join(rows.select(*key).distinct(), key, "left_anti").unionByName(rows)


def webhook_batch(findings: DataFrame, severity: str = "high", only_active: bool = False) -> DataFrame:
    from ..schema import rank

    out = findings.where(F.col("severity_rank") >= rank(severity))
    return out.where(F.col("verification") == "active") if only_active else out


def cap_per_source(lines: DataFrame, source: str, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of each source in order (0: all)."""
    if not most:
        return lines
    n = F.row_number().over(Window.partitionBy(source).orderBy(*order))
    return lines.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def custom_severities(table: DataFrame) -> DataFrame:
    """Custom levels with the built-in ones, heaviest first; table: (name, weight)."""
    own = table.sparkSession.createDataFrame([("critical", 400), ("high", 300), ("medium", 200), ("low", 100)], "name string, weight int")
    return table.select("name", F.col("weight").cast("int").alias("weight")).unionByName(own).orderBy(F.desc("weight"), "name")
