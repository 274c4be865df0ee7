"""Registered queries on findings: scans, reports, joins, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode, filters, text
from ..operators import expressions, iac, matching, relational, scan
from ..rules import ENTROPY_RULE, Allowlist, builtin
from ..schema import fingerprint
from ..sinks import formats
from ..streaming import tracker
from .base import BITS, FOUND_SQL, LINES_SQL, ORACLES, QUERIES, found, found_once, lines, register, rules, table


@register("scan_gated", 'SELECT rule_id, severity, path, line, "column", matched, context, likely_false_positive FROM found', FOUND_SQL)
def scan_gated(spark, sf_dir):
    return found(spark, sf_dir).select("rule_id", "severity", "path", "line", "column", "matched", "context", "likely_false_positive")


@register(
    "entropy_documents",
    r"""SELECT doc_id, v AS value, round("""
    + BITS.format(v="v")
    + r""", 6) AS bits FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(key|token|secret|passwd|password|api[_-]?key)[ \t]*[:=][ \t]*[''"]?([A-Za-z0-9+/_\-\.=]{16,})[''"]?', 2)) AS v FROM documents)
    WHERE strlen(v) >= 20 AND """
    + BITS.format(v="v")
    + " >= 3.5",
)
def entropy_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    hits = scan.scan_gated(scan.lines_of(docs), [r for r in builtin() if r.rule_id == ENTROPY_RULE], flag=False)
    return hits.select(F.col("path").cast("long").alias("doc_id"), F.col("matched").alias("value"), F.round(text.shannon("matched"), 6).alias("bits"))


@register(
    "document_lines",
    r"""SELECT doc_id, generate_subscripts(parts, 1)::INT AS line, unnest(parts) AS text
    FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS parts FROM documents WHERE text <> '')""",
)
def document_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    return scan.lines_of(docs).withColumnRenamed("path", "doc_id")


@register("raw_scan", 'SELECT rule_id, path, line, "column", matched FROM found', FOUND_SQL)
def raw_scan(spark, sf_dir):
    return scan.scan_raw(lines(spark, sf_dir), rules()).select("rule_id", "path", "line", "column", "matched")


@register("allow_comment", "SELECT rule_id, path, line FROM found WHERE line % 3 <> 0", FOUND_SQL)
def allow_comment(spark, sf_dir):
    marked = lines(spark, sf_dir).withColumn("text", F.when(F.col("line") % 3 == 0, F.concat("text", F.lit(" # Quillon:ALLOW"))).otherwise(F.col("text")))
    return scan.scan_gated(marked, rules()).select("rule_id", "path", "line")


@register("rule_subset", "SELECT rule_id, path, line FROM found WHERE rule_id = 'github-pat'", FOUND_SQL)
def rule_subset(spark, sf_dir):
    return scan.scan_gated(lines(spark, sf_dir), rules(), enable=["github-pat"]).select("rule_id", "path", "line")


@register("allowlist", "SELECT rule_id, path, line FROM found WHERE NOT regexp_matches(matched, '^AKIA0') AND NOT path LIKE 'vendor/%' AND NOT contains(matched, 'abc')", FOUND_SQL)
def allowlist(spark, sf_dir):
    return scan.scan_gated(lines(spark, sf_dir), rules(), allow=Allowlist(("^AKIA0",), ("^vendor/",), ("abc",))).select("rule_id", "path", "line")


@register("ignore_paths", "SELECT path, line FROM lines WHERE NOT (path LIKE '%.md' OR contains(path, 'vendor/'))", LINES_SQL)
def ignore_paths(spark, sf_dir):
    return lines(spark, sf_dir).where(~scan.ignored(F.col("path"), ["*.md", "vendor/"])).select("path", "line")


@register("severity_counts", "SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM found", FOUND_SQL)
def severity_counts(spark, sf_dir):
    return relational.severity_counts(found(spark, sf_dir))


@register("rule_counts", "SELECT rule_id, count(*) AS n FROM found GROUP BY rule_id", FOUND_SQL)
def rule_counts(spark, sf_dir):
    return relational.rule_counts(found(spark, sf_dir))


@register("hidden_count", "SELECT count(*) FILTER (likely_false_positive) AS hidden FROM found", FOUND_SQL)
def hidden_count(spark, sf_dir):
    return relational.hidden_count(found(spark, sf_dir))


@register("report", "SELECT rule_id, severity, path, line, CASE WHEN length(matched) <= 6 THEN repeat('*', length(matched)) ELSE substr(matched, 1, least(4, length(matched) - 2)::INT) || repeat('*', length(matched) - least(4, length(matched) - 2)) END AS matched FROM found WHERE severity_rank >= 3 AND NOT likely_false_positive", FOUND_SQL)
def report(spark, sf_dir):
    return scan.report(found(spark, sf_dir), min_severity="high").select("rule_id", "severity", "path", "line", "matched")


@register("redact_context", "SELECT path, line, replace(context, matched, substr(matched, 1, 4) || repeat('*', length(matched) - 4)) AS context FROM found", FOUND_SQL)
def redact_context(spark, sf_dir):
    return found(spark, sf_dir).select("path", "line", text.redact_within("context", "matched").alias("context"))


@register("expression_filter", "SELECT rule_id, path, line FROM found WHERE (severity = 'critical' AND NOT contains(path, 'vendor')) OR (regexp_matches(matched, '^[0-9a-f]+$') AND line <> 2)", FOUND_SQL)
def expression_filter(spark, sf_dir):
    where = expressions.compile_filter('severity == "critical" && !(path contains "vendor") || matched matches "^[0-9a-f]+$" && line != 2')
    return found(spark, sf_dir).where(where).select("rule_id", "path", "line")


@register("expression_verifier", "SELECT matched, strlen(matched) >= 32 AS ok FROM found", FOUND_SQL)
def expression_verifier(spark, sf_dir):
    return found(spark, sf_dir).select("matched", expressions.compile_verifier("length >= 32").alias("ok"))


@register("baseline_anti", "SELECT rule_id, path, line FROM found WHERE line % 10 <> 0", FOUND_SQL)
def baseline_anti(spark, sf_dir):
    hits = found_once(spark, sf_dir)
    return relational.apply_baseline(hits, relational.baseline_of(hits.where(F.col("line") % 10 == 0))).select("rule_id", "path", "line")


@register("baseline_suppressed", "SELECT count(*) AS suppressed FROM found WHERE line % 10 = 0", FOUND_SQL)
def baseline_suppressed(spark, sf_dir):
    hits = found_once(spark, sf_dir)
    return relational.suppressed_by(hits, relational.baseline_of(hits.where(F.col("line") % 10 == 0)))


def _changes(spark, sf_dir):
    hits = found_once(spark, sf_dir)
    return relational.diff(hits.where(F.col("line") % 3 != 0), hits.where(F.col("line") % 5 != 0))


CHANGES_SQL = FOUND_SQL + ", changes AS (SELECT rule_id, path, line, CASE WHEN line % 3 <> 0 AND line % 5 <> 0 THEN 'unchanged' WHEN line % 5 <> 0 THEN 'new' ELSE 'resolved' END AS status FROM found WHERE line % 3 <> 0 OR line % 5 <> 0)"


@register("diff_status", "SELECT rule_id, path, line, status FROM changes", CHANGES_SQL)
def diff_status(spark, sf_dir):
    return _changes(spark, sf_dir).select("rule_id", "path", "line", "status")


@register("diff_summary", "SELECT count(*) FILTER (status = 'new') AS \"new\", count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'resolved') AS resolved, count(*) AS total FROM changes", CHANGES_SQL)
def diff_summary(spark, sf_dir):
    return relational.diff_summary(_changes(spark, sf_dir))


@register("suppressions", "SELECT rule_id, path, line FROM found WHERE NOT (line % 4 = 0 AND (line % 8 <> 0 OR line % 3 = 0))", FOUND_SQL)
def suppressions(spark, sf_dir):
    hits = found_once(spark, sf_dir)
    expiry = F.when(F.col("line") % 8 != 0, F.lit(None)).when(F.col("line") % 3 == 0, 2_000).otherwise(500).cast("long")
    table = hits.where(F.col("line") % 4 == 0).select(fingerprint().alias("fingerprint"), F.lit("known").alias("reason"), F.lit("me").alias("suppressed_by"), F.lit(1).cast("long").alias("created_at"), expiry.alias("expires_at"))
    return relational.apply_suppressions(hits, table, now=1_000).select("rule_id", "path", "line")


@register("override_severity", "SELECT rule_id, path, line, CASE rule_id WHEN 'github-pat' THEN 'low' ELSE severity END AS severity, CASE rule_id WHEN 'github-pat' THEN 1 ELSE severity_rank END AS severity_rank FROM found", FOUND_SQL)
def override_severity(spark, sf_dir):
    table = spark.createDataFrame([("github-pat", "low")], "rule_id string, severity string")
    return relational.override_severity(found(spark, sf_dir), table).select("rule_id", "path", "line", "severity", "severity_rank")


@register("verify_cache", "SELECT rule_id, path, line, CASE WHEN line % 2 = 0 THEN 'active' END AS verification FROM found", FOUND_SQL)
def verify_cache(spark, sf_dir):
    hits = found_once(spark, sf_dir)
    cache = hits.where(F.col("line") % 2 == 0).select("rule_id", text.secret_hash("matched").alias("secret_hash"), F.lit("active").alias("status"), F.lit(1).cast("long").alias("timestamp"))
    return relational.fill_verification(hits, cache).select("rule_id", "path", "line", "verification")


@register("verify_formats", "SELECT rule_id, line, CASE WHEN rule_id = 'aws-access-key-id' THEN 'inactive' END AS verification FROM found", FOUND_SQL)
def verify_formats(spark, sf_dir):
    return relational.verify_formats(found(spark, sf_dir)).select("rule_id", "line", "verification")


@register(
    "compliance",
    """SELECT *, CASE WHEN critical > 0 OR high > 0 THEN 'non_compliant' WHEN medium > 0 THEN 'compliant_with_warnings' ELSE 'compliant' END AS status,
        list_concat(CASE WHEN len(said) > 0 THEN said ELSE ['No critical findings detected. Continue regular scanning.'] END, ['SOC 2 CC6.1: Security controls must prevent unauthorized access to sensitive data.']) AS recommendations, 'SOC2' AS framework
    FROM (SELECT *, list_filter([CASE WHEN critical > 0 THEN 'Immediately rotate ' || critical || ' critical-severity secrets detected in the codebase.' END,
            CASE WHEN high > 0 THEN 'Prioritize remediation of ' || high || ' high-severity findings within 24 hours.' END, CASE WHEN active > 0 THEN active || ' secrets were verified as ACTIVE — rotate them immediately.' END,
            CASE WHEN unverified > total // 2 THEN 'More than 50% of findings are unverified. Run with --verify to check active status.' END], lambda x: x IS NOT NULL) AS said
        FROM (SELECT count(*) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low,
            count(*) FILTER (line % 3 = 0) AS active, count(*) FILTER (line % 3 = 1) AS inactive, count(*) FILTER (line % 9 = 2) AS unverified FROM found))""".replace("SELECT *, CASE WHEN critical > 0 OR", "SELECT * EXCLUDE (said), CASE WHEN critical > 0 OR"),
    FOUND_SQL,
)
def compliance(spark, sf_dir):
    k = F.col("line")
    known = found(spark, sf_dir).withColumn("verification", F.when(k % 3 == 0, "active").when(k % 3 == 1, "inactive").when(k % 9 == 2, None).otherwise("unknown"))
    return relational.compliance(known).drop("findings_by_rule")


@register(
    "compliance_by_rule",
    "SELECT unnest(['SOC2', 'PCI-DSS', 'HIPAA', 'GDPR', 'ISO27001', 'NIST']) AS framework, rule_id, n FROM (SELECT rule_id, count(*) AS n FROM found WHERE severity = 'medium' GROUP BY rule_id)",
    FOUND_SQL,
)
def compliance_by_rule(spark, sf_dir):
    """Reports of all frameworks over the medium findings."""
    hits = found_once(spark, sf_dir).where("severity = 'medium'")
    out = None
    for name in relational.FRAMEWORKS:
        one = relational.compliance(hits, name).where("status = 'compliant_with_warnings'").select("framework", F.explode("findings_by_rule").alias("rule_id", "n"))
        out = one if out is None else out.unionByName(one)
    return out


@register("prioritise", "SELECT rule_id, line, CASE severity WHEN 'critical' THEN 90 WHEN 'high' THEN 70 WHEN 'medium' THEN 50 ELSE 25 END - least(row_number() OVER (ORDER BY path, line, rule_id) - 1, 20) AS priority FROM found", FOUND_SQL)
def prioritise(spark, sf_dir):
    return relational.prioritise(found_once(spark, sf_dir), ["path", "line", "rule_id"]).select("rule_id", "line", "priority")


@register("category_lookup", "SELECT rule_id, line, CASE WHEN rule_id LIKE 'aws%' THEN 'cloud' WHEN rule_id = 'github-pat' THEN 'code' END AS category FROM found", FOUND_SQL)
def category_lookup(spark, sf_dir):
    table = spark.createDataFrame([("cloud", ["aws-access-key-id"]), ("code", ["github-pat"]), ("platform", ["github-pat"])], "name string, rule_ids array<string>")
    return relational.category_of(found(spark, sf_dir), table).select("rule_id", "line", "category")


@register("project_counts", "SELECT split_part(path, '/', 1) AS project, count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical FROM found GROUP BY 1", FOUND_SQL)
def project_counts(spark, sf_dir):
    return relational.project_counts(found(spark, sf_dir).withColumn("project", F.split_part("path", F.lit("/"), F.lit(1))))


@register("tracker_ingest", "SELECT state, count(*) AS n FROM (SELECT CASE WHEN line % 6 = 0 THEN 'closed' ELSE 'open' END AS state FROM found) GROUP BY state", FOUND_SQL)
def tracker_ingest(spark, sf_dir):
    hits = found_once(spark, sf_dir)
    empty = relational.ingest(hits.where("false").select(F.lit("").alias("fingerprint"), "rule_id", "path", "line", "matched", *[F.lit(None).cast(t).alias(c) for c, t in (("state", "string"), ("detected_at", "long"), ("updated_at", "long"), ("updated_by", "string"), ("tags", "array<string>"), ("assigned_to", "string"))]), hits.where(F.col("line") % 6 == 0), now=1)
    closed = relational.set_state(empty, empty.select("fingerprint", F.lit("closed").alias("state"), F.lit("me").alias("by")), now=2)
    return relational.by_state(relational.ingest(closed, hits, now=3))


@register("rotation", "SELECT rule_id, path, line FROM found f WHERE EXISTS (SELECT 1 FROM found o WHERE o.rule_id = f.rule_id AND o.line - f.line BETWEEN 1 AND 3 AND o.matched <> f.matched)", FOUND_SQL)
def rotation(spark, sf_dir):
    return matching.rotated(found_once(spark, sf_dir)).select("rule_id", "path", "line")


@register("composite", r"SELECT path, line, strpos(text, 'AKIA')::INT AS \"column\", regexp_extract(text, 'AKIA[0-9A-Z]+') AS matched FROM lines l WHERE contains(text, 'AKIA') AND EXISTS (SELECT 1 FROM lines o WHERE o.path = l.path AND o.line BETWEEN l.line - 100 AND l.line + 100 AND contains(o.text, 'password'))".replace('\\"', '"'), LINES_SQL)
def composite(spark, sf_dir):
    return matching.composite(lines(spark, sf_dir), "AKIA[0-9A-Z]+", ["password"], 100)


@register("max_per_source", "SELECT path, line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM lines) WHERE n <= 3", LINES_SQL)
def max_per_source(spark, sf_dir):
    return relational.cap_per_source(lines(spark, sf_dir), "path", ["line"], 3).select("path", "line")


@register("path_predicates", "SELECT DISTINCT path, path LIKE 'docs%' OR path LIKE '%.md' AS documentation, path LIKE 'vendor/%' AS vendored, path LIKE 'tests/%' AS fixture, CASE WHEN path LIKE '%.yaml' THEN 3.0 WHEN path LIKE '%.env' THEN 2.5 WHEN path LIKE '%.md' THEN 3.0 ELSE 3.5 END AS threshold FROM lines", LINES_SQL)
def path_predicates(spark, sf_dir):
    p = "path"
    return lines(spark, sf_dir).select(p, filters.is_documentation(p).alias("documentation"), filters.is_vendored(p).alias("vendored"), filters.is_fixture(p).alias("fixture"), filters.entropy_threshold(p).cast("double").alias("threshold")).distinct()


@register("value_predicates", "SELECT matched, regexp_matches(matched, '^([0-9A-Fa-f]{40}|[0-9A-Fa-f]{64,})$') AS hex_blob, contains(matched, 'test') OR contains(matched, 'TEST') OR contains(matched, 'FAKE') AS example FROM found", FOUND_SQL)
def value_predicates(spark, sf_dir):
    return found(spark, sf_dir).select("matched", filters.is_hex_blob("matched").alias("hex_blob"), filters.is_example("matched").alias("example"))


@register("entropies", "SELECT v AS value, round(" + BITS.format(v="v") + ", 6) AS shannon, round(-log2(list_max(list_transform(list_distinct(string_split(v, '')), lambda c: (length(v) - length(replace(v, c, '')))::DOUBLE / length(v)))), 6) AS least FROM (SELECT md5(c_name) AS v FROM customer)")
def entropies(spark, sf_dir):
    values = table(spark, sf_dir, "customer").select(F.md5(F.col("c_name").cast("binary")).alias("value"))
    return values.select("value", F.round(text.shannon("value"), 6).alias("shannon"), F.round(text.min_entropy("value"), 6).alias("least"))


@register("secret_hashes", "SELECT DISTINCT rule_id, sha256(matched) AS hash, substr(sha256('n' || matched), 1, 8) AS prefix FROM found", FOUND_SQL)
def secret_hashes(spark, sf_dir):
    return found(spark, sf_dir).select("rule_id", text.secret_hash("matched").alias("hash"), text.zero_knowledge("matched", F.lit("n"))["prefix"].alias("prefix")).distinct()


@register("html_text", r"SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<[^>]*>', '', 'g')) AS n FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.char_length(decode.strip_tags("html")).cast("long").alias("n"))


@register("json_strings", """SELECT event_id, regexp_extract_all(props, '"((?:[^"\\\\]|\\\\.)*)"', 1) AS strings FROM events""".replace("\\\\\\\\", "\\\\"))
def json_strings(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", decode.json_strings("props").alias("strings"))


@register("env_pairs", "SELECT path, line, trim(split_part(text, '=', 1)) AS key, trim(trim(substr(text, strpos(text, '=') + 1)), '\"''') AS value FROM lines WHERE contains(text, '=')", LINES_SQL)
def env_pairs(spark, sf_dir):
    return decode.env_pairs(lines(spark, sf_dir))


@register("yaml_pairs", "SELECT path, line, trim(split_part(text, ':', 1)) AS key, trim(substr(text, strpos(text, ':') + 1)) AS value FROM (SELECT path, line, replace(text, '# ', '') AS text FROM lines) WHERE contains(text, ':')", LINES_SQL)
def yaml_pairs(spark, sf_dir):
    return decode.yaml_pairs(lines(spark, sf_dir).withColumn("text", F.replace("text", F.lit("# "))))


@register("csv_rows", "SELECT rule_id || ',' || severity || ',' || path || ',' || line AS value FROM found", FOUND_SQL)
def csv_rows(spark, sf_dir):
    rows = formats.csv_value(found(spark, sf_dir).withColumn("description", F.lit("d")).withColumn("matched", F.lit("m")))
    part = lambda k: F.split_part("value", F.lit(","), F.lit(k))
    return rows.select(F.concat_ws(",", part(1), part(3), part(4), part(5)).alias("value"))


@register("github_annotations", """SELECT '::' || CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END || ' file=' || path || ',line=' || line || ',col=' || "column" || '::' || rule_id AS value FROM found""", FOUND_SQL)
def github_annotations(spark, sf_dir):
    return formats.github_value(found(spark, sf_dir)).select(F.regexp_replace("value", "(::.*::[^:]*): .*", "$1").alias("value"))


@register("prometheus", """SELECT 'quillon_findings_total{severity="' || severity || '"} ' || count(*) AS value FROM found GROUP BY severity UNION ALL SELECT 'quillon_findings_by_rule{rule="' || rule_id || '"} ' || count(*) FROM found GROUP BY rule_id""", FOUND_SQL)
def prometheus(spark, sf_dir):
    return formats.prometheus_lines(found_once(spark, sf_dir))


@register("sarif_rules", "SELECT rule_id FROM found GROUP BY rule_id", FOUND_SQL)
def sarif_rules(spark, sf_dir):
    return relational.rules_seen(found(spark, sf_dir)).select("rule_id")


@register("events_by_hour", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_hour(spark, sf_dir):
    return tracker.counts_by_window(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")


@register("key_pairs", "SELECT path, max(line) FILTER (k % 2 = 0) AS line FROM (SELECT path, line, line // 4 AS k FROM lines WHERE contains(text, 'AKIA')) GROUP BY path HAVING count(*) FILTER (k % 2 = 0) > 0 AND count(*) FILTER (k % 2 = 1) > 0", LINES_SQL)
def key_pairs(spark, sf_dir):
    own = lines(spark, sf_dir).where(F.col("text").contains("AKIA"))
    even = F.floor(F.col("line") / 4) % 2 == 0
    own = own.withColumn("text", F.when(even, F.replace("text", F.lit("aws_key"), F.lit("aws_access_key_id"))).otherwise(F.concat(F.lit("aws_secret_access_key = "), F.md5("text"))))
    return iac.key_pairs(own).select("path", "line")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule and severity of the built lines and the documents together."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("corpus/"), F.col("doc_id").cast("string"), F.lit(".log")).alias("path"), "text")
    both = lines(spark, sf_dir).unionByName(scan.lines_of(docs))
    hits = scan.scan_gated(both)
    return hits.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("findings"), F.count_if("likely_false_positive").alias("hidden"), F.countDistinct("path").alias("files"))


from . import contents, reports, services  # noqa: E402, F401  they register themselves
