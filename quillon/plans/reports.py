"""Registered queries on what reports are made of: rows of every format, summaries, lifecycle tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import sealing, text
from ..operators import advice, plugins, relational, scan
from ..schema import fingerprint
from ..sinks import formats
from .base import FOUND_SQL, LINES_SQL, found, found_once, lines, register, table

ABOUT_SQL = (
    FOUND_SQL
    + """,
told AS (SELECT *, CASE rule_id WHEN 'aws-access-key-id' THEN 'AWS Access Key ID' WHEN 'github-pat' THEN 'GitHub Personal Access Token' ELSE 'High-entropy string assigned to a key/secret/token-like identifier' END AS description,
    CASE line % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'error' END AS verification, CASE WHEN line % 3 = 1 THEN 'boom' END AS verification_error, CASE WHEN line % 2 = 0 THEN 'c' || line END AS commit,
    replace(context, '"', chr(92) || '"') AS escaped, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level FROM found)"""
)


def told(spark, sf_dir):
    """The findings, some verified, some from commits."""
    k = F.col("line")
    out = found(spark, sf_dir).withColumn("verification", F.when(k % 3 == 0, "active").when(k % 3 == 1, "error"))
    return out.withColumn("verification_error", F.when(k % 3 == 1, "boom")).withColumn("commit", F.when(k % 2 == 0, F.concat(F.lit("c"), k.cast("string"))))


def _rows(name: str, value: str, make) -> None:
    register(name, f"SELECT {value} AS value FROM told", ABOUT_SQL)(lambda spark, sf_dir: make(told(spark, sf_dir)))


_rows("table_rows", "rpad(upper(severity), 10, ' ') || ' ' || rpad(rule_id, 32, ' ') || ' ' || path || ':' || line", formats.table_rows)
_JSON = """'{"rule_id":"' || rule_id || '","description":"' || description || '","severity":"' || {severity} || '","path":"' || path || '","line":' || line || ',"column":' || "column" || ',"matched":"' || matched || '"'"""
_COMMIT = """ || CASE WHEN commit IS NOT NULL THEN ',"commit":"' || commit || '"' ELSE '' END || ',"likely_false_positive":' || likely_false_positive"""
_rows(
    "json_rows",
    _JSON.replace("{severity}", "upper(substr(severity, 1, 1)) || substr(severity, 2)") + """ || ',"context":"' || escaped || '"'""" + _COMMIT
    + """ || CASE verification WHEN 'active' THEN ',"verification":"active"' WHEN 'error' THEN ',"verification":"{' || chr(92) || '"error' || chr(92) || '":' || chr(92) || '"boom' || chr(92) || '"}"' ELSE '' END || '}'""",
    formats.json_value,
)
_rows("jsonl_rows", _JSON.replace("{severity}", "severity") + _COMMIT + """ || CASE verification WHEN 'active' THEN ',"verification":"Active"' WHEN 'error' THEN ',"verification":"Error(' || chr(92) || '"boom' || chr(92) || '")"' ELSE '' END || '}'""", formats.jsonl_value)
_rows("csv_cells", "rule_id || ',' || description || ',' || severity || ',' || path || ',' || line || ',' || \"column\" || ',' || matched || ',' || coalesce(commit, '') || ',' || CASE verification WHEN 'error' THEN 'error: boom' WHEN 'active' THEN 'active' ELSE '' END", formats.csv_value)
_rows("annotations", "'::' || CASE level WHEN 'error' THEN 'error' ELSE 'warning' END || ' file=' || path || ',line=' || line || ',col=' || \"column\" || '::' || rule_id || ': ' || description", formats.github_value)
_rows("template_rows", "rule_id || '|' || description || '|' || severity || '|' || path || '|' || line || '|' || \"column\" || '|' || matched || '|' || context || '|' || coalesce(commit, '') || '|{{.Nope}}'", lambda df: formats.template_value(df, "|".join(f"{{{{.{x}}}}}" for x in "RuleID Description Severity Path Line Column Match Context Commit Nope".split())))
_rows("xml_rows", "'<finding><rule_id>' || rule_id || '</rule_id><description>' || description || '</description><severity>' || severity || '</severity><path>' || path || '</path><line>' || line || '</line><column>' || \"column\" || '</column><matched>' || matched || '</matched><commit>' || coalesce(commit, '') || '</commit></finding>'", formats.xml_value)
_rows("junit_rows", """'<testcase classname="' || rule_id || '" name="' || path || ':' || line || '"><failure type="' || severity || '" message="' || description || '"/></testcase>'""", formats.junit_value)
_rows("html_rows", "'<tr><td>' || severity || '</td><td>' || rule_id || '</td><td>' || path || ':' || line || '</td><td>' || description || '</td></tr>'", formats.html_value)
_rows("markdown_rows", "'| ' || severity || ' | ' || rule_id || ' | ' || path || ':' || line || ' | ' || description || ' |'", formats.markdown_value)
_PRINT = "rule_id || ':' || path || ':' || line || ':' || matched"
_rows("spdx_rows", f"""'{{"SPDXID":"SPDXRef-' || substr(sha256({_PRINT}), 1, 16) || '","name":"' || rule_id || '","fileName":"' || path || '","comment":"' || severity || '"}}'""", formats.spdx_value)
_rows("cyclonedx_rows", f"""'{{"bom-ref":"' || substr(sha256({_PRINT}), 1, 16) || '","id":"' || rule_id || '","ratings":[{{"severity":"' || severity || '"}}],"description":"' || description || '"}}'""", formats.cyclonedx_value)
for _kind, _value in {
    "slack": """'{"text":"[' || upper(severity) || '] ' || rule_id || ' at ' || path || ':' || line || '"}'""",
    "teams": """'{"@type":"MessageCard","text":"[' || upper(severity) || '] ' || rule_id || ' at ' || path || ':' || line || '"}'""",
    "discord": """'{"content":"[' || upper(severity) || '] ' || rule_id || ' at ' || path || ':' || line || '"}'""",
    "generic": """'{"rule_id":"' || rule_id || '","severity":"' || severity || '","path":"' || path || '","line":' || line || ',"description":"' || description || '"}'""",
}.items():
    _rows(f"webhook_{_kind}", _value, functools.partial(formats.webhook, kind=_kind))


@register(
    "sarif_results",
    f"""SELECT rule_id AS "ruleId", level, description AS message, path AS uri, greatest(line, 1) AS line, "column", sha256(rule_id || ':' || path || ':' || line || ':' || coalesce(commit, '-')) AS print FROM told""",
    ABOUT_SQL,
)
def sarif_results(spark, sf_dir):
    rows = formats.sarif_results(told(spark, sf_dir))
    got = lambda path: F.get_json_object("value", f"$.{path}")
    place = "locations[0].physicalLocation"
    prints = F.regexp_extract("value", '([0-9a-f]{64})', 1)
    return rows.select(
        got("ruleId").alias("ruleId"), got("level").alias("level"), got("message.text").alias("message"), got(f"{place}.artifactLocation.uri").alias("uri"),
        got(f"{place}.region.startLine").cast("int").alias("line"), got(f"{place}.region.startColumn").cast("int").alias("column"), prints.alias("print"),
    )


@register("sarif_rule_objects", """SELECT DISTINCT '{"id":"' || rule_id || '","shortDescription":{"text":"' || description || '"}}' AS value FROM told""", ABOUT_SQL)
def sarif_rule_objects(spark, sf_dir):
    return formats.sarif_rule_values(told(spark, sf_dir))


@register("pr_comment", "SELECT '## ' || count(*) || ' findings' AS head FROM found", FOUND_SQL)
def pr_comment(spark, sf_dir):
    body = formats.comment_body(found_once(spark, sf_dir))
    return spark.createDataFrame([(body.split("\n")[0],)], "head string")


@register("reported", "SELECT rule_id, path, line, matched FROM told WHERE verification = 'active' AND severity_rank >= 4 AND line > 0", ABOUT_SQL)
def reported(spark, sf_dir):
    """The reporting chain with every switch: severity, hidden ones too, verified only, a condition, unredacted."""
    return scan.report(told(spark, sf_dir), min_severity="critical", show_all=True, only_verified=True, where=F.col("line") > 0, redact=False).select("rule_id", "path", "line", "matched")


@register("report_places", "SELECT rule_id, line, row_number() OVER (ORDER BY severity_rank DESC, path, line, \"column\", rule_id, matched)::INT AS place FROM found", FOUND_SQL)
def report_places(spark, sf_dir):
    """The order of a report: most severe first, then by path, with ties settled."""
    rows = scan.sort_report(found(spark, sf_dir)).select("rule_id", "line")
    numbered = rows.withColumn("_at", F.monotonically_increasing_id()).persist()
    sizes = sorted((r["part"], r["count"]) for r in numbered.groupBy(F.shiftright("_at", 33).alias("part")).count().collect())
    before, at = {}, 0
    for part, n in sizes:
        before[part], at = at, at + n
    offset = F.create_map(*[x for p, n in before.items() for x in (F.lit(p).cast("long"), F.lit(n))])
    return numbered.select("rule_id", "line", (offset[F.shiftright("_at", 33)] + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("int").alias("place"))


@register("to_verify", "SELECT DISTINCT rule_id, matched FROM found WHERE rule_id = 'github-pat'", FOUND_SQL)
def to_verify(spark, sf_dir):
    return relational.to_verify(found(spark, sf_dir), include=["github-pat", "aws-access-key-id"], exclude=["aws-access-key-id"])


@register("webhook_batch", "SELECT rule_id, line FROM told WHERE severity_rank >= 3 AND verification = 'active'", ABOUT_SQL)
def webhook_batch(spark, sf_dir):
    return relational.webhook_batch(told(spark, sf_dir), only_active=True).select("rule_id", "line")


@register("exit_codes", "SELECT CASE WHEN count(*) FILTER (severity_rank >= 4) > 0 THEN 7 ELSE 0 END AS critical, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS low, 0 AS ignored FROM found", FOUND_SQL)
def exit_codes(spark, sf_dir):
    hits = found_once(spark, sf_dir)
    return spark.createDataFrame([(relational.exit_code(hits, "critical", 7), relational.exit_code(hits), relational.exit_code(hits, ignore=True))], "critical int, low int, ignored int")


@register("risks", "SELECT rule_id, line, CASE severity WHEN 'critical' THEN 90 WHEN 'high' THEN 70 WHEN 'medium' THEN 50 ELSE 25 END AS risk, CASE WHEN rule_id = 'aws-access-key-id' THEN 'API key' WHEN rule_id = 'github-pat' THEN 'credential' ELSE 'credential' END AS kind FROM found", FOUND_SQL)
def risks(spark, sf_dir):
    return advice.classified(found(spark, sf_dir)).select("rule_id", "line", "risk", "kind")


@register("impact", "SELECT CASE WHEN rule_id = 'aws-access-key-id' THEN 'API key' ELSE 'credential' END AS kind, count(*) AS findings, count(DISTINCT path) AS files, max(CASE severity WHEN 'critical' THEN 90 ELSE 50 END) AS risk FROM found GROUP BY 1", FOUND_SQL)
def impact(spark, sf_dir):
    return advice.impact(found(spark, sf_dir))


@register("custom_severities", "SELECT * FROM (VALUES ('blocker', 500), ('critical', 400), ('high', 300), ('notice', 250), ('medium', 200), ('low', 100)) AS t(name, weight)")
def custom_severities(spark, sf_dir):
    return relational.custom_severities(spark.createDataFrame([("notice", 250), ("blocker", 500)], "name string, weight int"))


@register("audit_rows", """SELECT '{"timestamp":5,"user":"me","action":"scan","rule_id":"' || rule_id || '","findings":' || count(*) || '}' AS value FROM found GROUP BY rule_id""", FOUND_SQL)
def audit_rows(spark, sf_dir):
    return advice.audit_rows(found(spark, sf_dir), "me", "scan", 5)


@register("scan_summary", "SELECT count(*) || ' findings: ' || count(*) FILTER (severity = 'critical') || ' critical, ' || count(*) FILTER (severity = 'high') || ' high, ' || count(*) FILTER (severity = 'medium') || ' medium, ' || count(*) FILTER (severity = 'low') || ' low. Rules: ' || string_agg(DISTINCT rule_id, ', ' ORDER BY rule_id) || '.' AS value FROM found", FOUND_SQL)
def scan_summary(spark, sf_dir):
    return spark.createDataFrame([(advice.summary(found_once(spark, sf_dir)),)], "value string")


@register("compliance_lines", "SELECT unnest(['SOC2: non_compliant', 'total: ' || count(*), 'critical: ' || count(*) FILTER (severity = 'critical')]) AS value FROM found", FOUND_SQL)
def compliance_lines(spark, sf_dir):
    said = advice.compliance_text(found_once(spark, sf_dir)).split("\n")[:3]
    return spark.createDataFrame([(x,) for x in said], "value string")


@register("baseline_total", "SELECT count(*) AS total FROM found WHERE line % 10 = 0", FOUND_SQL)
def baseline_total(spark, sf_dir):
    kept = found(spark, sf_dir).where("line % 10 = 0").select(F.split_part("path", F.lit("/"), F.lit(1)).alias("project"), fingerprint().alias("fingerprint"))
    return relational.baseline_total(kept)


@register("project_baseline", "SELECT rule_id, path, line FROM found WHERE NOT (line % 10 = 0 AND path LIKE 'src/%')", FOUND_SQL)
def project_baseline(spark, sf_dir):
    hits = found_once(spark, sf_dir).withColumn("project", F.split_part("path", F.lit("/"), F.lit(1)))
    kept = hits.where("line % 10 = 0 and project = 'src'").select("project", fingerprint().alias("fingerprint"))
    return relational.apply_project_baseline(hits, kept).select("rule_id", "path", "line")


@register("permitted_tokens", "SELECT c_custkey::VARCHAR AS token, CASE WHEN c_custkey % 3 = 0 THEN 'admin' ELSE 'viewer' END AS role FROM customer WHERE c_custkey % 3 < 2")
def permitted_tokens(spark, sf_dir):
    k = F.col("c_custkey")
    role = F.when(k % 3 == 0, "admin").when(k % 3 == 1, "viewer").otherwise("nobody")
    tokens = table(spark, sf_dir, "customer").select(k.cast("string").alias("token"), role.alias("role"))
    roles = spark.createDataFrame([("admin", ["read", "write"]), ("viewer", ["read"]), ("nobody", [])], "role string, permissions array<string>")
    return relational.permitted(tokens, roles, "read")


@register("tracked", "SELECT path, line, CASE WHEN line % 6 = 0 THEN 'closed' ELSE 'open' END AS state, CASE WHEN line % 6 = 0 THEN 2 ELSE 1 END AS updated_at FROM found WHERE rule_id = 'github-pat'", FOUND_SQL)
def tracked(spark, sf_dir):
    hits = found_once(spark, sf_dir).where("rule_id = 'github-pat'")
    none = hits.where("false").select(F.lit("").alias("fingerprint"), "rule_id", "path", "line", "matched", *[F.lit(None).cast(t).alias(c) for c, t in (("state", "string"), ("detected_at", "long"), ("updated_at", "long"), ("updated_by", "string"), ("tags", "array<string>"), ("assigned_to", "string"))])
    first = relational.ingest(none, hits, now=1)
    closed = relational.set_state(first, first.where("line % 6 = 0").select("fingerprint", F.lit("closed").alias("state"), F.lit("me").alias("by")), now=2)
    return closed.select("path", "line", "state", F.col("updated_at").cast("int").alias("updated_at"))


@register("tagged", "SELECT path, line FROM found WHERE rule_id = 'github-pat' AND line % 5 = 0 AND line % 3 = 0", FOUND_SQL)
def tagged(spark, sf_dir):
    hits = found(spark, sf_dir).where("rule_id = 'github-pat'")
    rows = hits.withColumn("tags", F.when(F.col("line") % 5 == 0, F.array(F.lit("prod"))).otherwise(F.array().cast("array<string>"))).withColumn("assigned_to", F.when(F.col("line") % 3 == 0, "me"))
    return relational.assigned_to(relational.with_tag(rows, "prod"), "me").select("path", "line")


@register("upserted", "SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS v FROM customer")
def upserted(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    return relational.upsert(base, base.where("k % 4 = 0").withColumn("v", F.lit("new")), ["k"])


@register("sealed", "SELECT c_custkey AS k, c_name AS opened, NULL::VARCHAR AS wrong FROM customer")
def sealed(spark, sf_dir):
    """Reports sealed and opened again, and not opened with another key."""
    key, other = F.lit("0123456789abcdef"), F.lit("fedcba9876543210")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), sealing.seal("c_name", key).alias("s"))
    return rows.select("k", sealing.unseal("s", key).alias("opened"), sealing.unseal("s", other).alias("wrong"))


@register("cron", "SELECT unnest([0, 1, 2]) AS k, unnest([true, false, true]) AS ok")
def cron(spark, sf_dir):
    return spark.createDataFrame([(0, " 0 1 * * *"), (1, "0 1 * *"), (2, "*/5 * * * 1-5")], "k int, v string").select("k", text.is_cron("v").alias("ok"))


@register("conditions", "SELECT path, line FROM lines WHERE (path LIKE '%.py' OR path LIKE '%.env') AND contains(path, 'src') AND length(text) BETWEEN 20 AND 60", LINES_SQL)
def conditions(spark, sf_dir):
    return lines(spark, sf_dir).where(advice.applies(F.col("path"), F.octet_length("text"), (".py", "env"), ("src",), {"CI": True}, 20, 60)).select("path", "line")


@register("plugin_findings", "SELECT path, line, strpos(text, 'ghp_')::INT AS \"column\", substr(text, strpos(text, 'ghp_'), 8) AS matched FROM lines WHERE contains(text, 'ghp_')", LINES_SQL)
def plugin_findings(spark, sf_dir):
    """A detector given as a function."""
    own = plugins.Registry()
    own.register("own", "starts of tokens", "low", lambda line: [(at, at + 8, line[at : at + 8]) for at in [line.find("ghp_")] if at >= 0], ["GHP_"])
    return own.scan(lines(spark, sf_dir)).select("path", "line", "column", "matched")
