"""Report formats. A finding's row is a column, so reports are written in parallel.

Formats that are one document (SARIF, XML, HTML, ...) have a head and a foot around
their rows: `write_report` writes the three as files whose names sort in that order,
and `document` puts a report that is known to be small into one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_csv, escape_html, escape_markdown, escape_xml
from ..operators.relational import rule_counts, rules_seen, severity_counts
from ..schema import fingerprint

LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note"}
CSV_HEADER = "rule_id,description,severity,path,line,column,matched,commit,verification"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def level(severity: Column) -> Column:
    out = F
    for s, name in LEVELS.items():
        out = out.when(severity == s, name)
    return out.otherwise(F.lit("note"))


def verification_text() -> Column:
    return F.when(F.col("verification") == "error", F.concat(F.lit("error: "), F.coalesce("verification_error", F.lit("")))).otherwise(_text("verification"))


def table_rows(findings: DataFrame) -> DataFrame:
    return findings.select(F.format_string("%-10s %-32s %s:%d", F.upper("severity"), "rule_id", "path", "line").alias("value"))


def json_value(findings: DataFrame) -> DataFrame:
    """One object a finding, severity capitalised; a null verification is left out."""
    status = F.when(F.col("verification") == "error", F.to_json(F.struct(F.col("verification_error").alias("error")))).otherwise(F.col("verification"))
    return findings.select(F.to_json(F.struct("rule_id", "description", F.initcap("severity").alias("severity"), "path", "line", "column", "matched", "context", "commit", "likely_false_positive", status.alias("verification"))).alias("value"))


def jsonl_value(findings: DataFrame) -> DataFrame:
    status = F.when(F.col("verification") == "error", F.format_string('Error("%s")', F.coalesce("verification_error", F.lit("")))).otherwise(F.initcap("verification"))
    return findings.select(F.to_json(F.struct("rule_id", "description", "severity", "path", "line", "column", "matched", "commit", "likely_false_positive", status.alias("verification"))).alias("value"))


def csv_value(findings: DataFrame) -> DataFrame:
    cells = [*(escape_csv(_text(c)) for c in ("rule_id", "description", "severity", "path", "line", "column", "matched", "commit")), escape_csv(verification_text())]
    return findings.select(F.concat_ws(",", *cells).alias("value"))


def github_value(findings: DataFrame) -> DataFrame:
    kind = F.when(F.col("severity").isin("critical", "high"), "error").otherwise("warning")
    return findings.select(F.format_string("::%s file=%s,line=%d,col=%d::%s: %s", kind, "path", "line", "column", "rule_id", "description").alias("value"))


def template_value(findings: DataFrame, template: str) -> DataFrame:
    """{{.Field}} for nine fields."""
    fields = {"RuleID": "rule_id", "Description": "description", "Severity": "severity", "Path": "path", "Line": "line", "Column": "column", "Match": "matched", "Context": "context", "Commit": "commit"}
    out = F.lit(template)
    for name, c in fields.items():
        out = F.replace(out, F.lit(f"{{{{.{name}}}}}"), _text(c))
    return findings.select(out.alias("value"))


def xml_value(findings: DataFrame) -> DataFrame:
    parts = [F.concat(F.lit(f"<{c}>"), escape_xml(_text(c)), F.lit(f"</{c}>")) for c in ("rule_id", "description", "severity", "path", "line", "column", "matched", "commit")]
    return findings.select(F.concat(F.lit("<finding>"), *parts, F.lit("</finding>")).alias("value"))


def junit_value(findings: DataFrame) -> DataFrame:
    case = F.format_string('<testcase classname="%s" name="%s:%d"><failure type="%s" message="%s"/></testcase>', escape_xml(_text("rule_id")), escape_xml(_text("path")), "line", "severity", escape_xml(_text("description")))
    return findings.select(case.alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result object a finding."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.greatest("line", F.lit(1)).alias("startLine"), F.greatest("column", F.lit(1)).alias("startColumn")).alias("region")).alias("physicalLocation"))
    return findings.select(
        F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.sha2(fingerprint(sarif=True), 256).alias("primary")).alias("partialFingerprints"))).alias("value")
    )


def html_value(findings: DataFrame) -> DataFrame:
    return findings.select(F.format_string("<tr><td>%s</td><td>%s</td><td>%s:%d</td><td>%s</td></tr>", "severity", escape_html(_text("rule_id")), escape_html(_text("path")), "line", escape_html(_text("description"))).alias("value"))


def markdown_value(findings: DataFrame) -> DataFrame:
    return findings.select(F.format_string("| %s | %s | %s:%d | %s |", "severity", escape_markdown(_text("rule_id")), escape_markdown(_text("path")), "line", escape_markdown(_text("description"))).alias("value"))


def spdx_value(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(F.concat(F.lit("SPDXRef-"), F.substring(F.sha2(fingerprint(), 256), 1, 16)).alias("SPDXID"), F.col("rule_id").alias("name"), F.col("path").alias("fileName"), F.col("severity").alias("comment"))).alias("value"))


def cyclonedx_value(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(F.substring(F.sha2(fingerprint(), 256), 1, 16).alias("bom-ref"), F.col("rule_id").alias("id"), F.array(F.struct(F.col("severity").alias("severity"))).alias("ratings"), F.col("description").alias("description"))).alias("value"))


def sarif_rule_values(findings: DataFrame) -> DataFrame:
    """The rules object of each rule seen, by id: a row a rule."""
    return rules_seen(findings).select(F.to_json(F.struct(F.col("rule_id").alias("id"), F.struct(F.col("description").alias("text")).alias("shortDescription"))).alias("value"))


def _sarif_head(findings: DataFrame) -> str:
    rules = ",".join(r["value"] for r in sarif_rule_values(findings).collect())  # a row a rule of the catalog
    return f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"quillon","rules":[{rules}]}}}},"results":['


def _junit_head(findings: DataFrame) -> str:
    n = findings.count()
    return f'<?xml version="1.0" encoding="UTF-8"?><testsuites><testsuite name="quillon" tests="{n}" failures="{n}">'


def _markdown_head(findings: DataFrame) -> str:
    c = severity_counts(findings).first()
    return f"# Findings\n\n{c['total']} in all: {c['critical']} critical, {c['high']} high, {c['medium']} medium, {c['low']} low\n\n| severity | rule | place | what |\n| --- | --- | --- | --- |"


def _html_head(findings: DataFrame) -> str:
    return f"<!DOCTYPE html><html><body><h1>{findings.count()} findings</h1><table>"


def _just(text: str) -> Callable[[DataFrame], str]:
    return lambda findings: text


#: Rows, what stands between them, head and foot of each format; a format without a head is its rows.
REPORTS: dict[str, tuple[Callable[[DataFrame], DataFrame], str, Callable[[DataFrame], str] | None, str]] = {
    "table": (table_rows, "", None, ""),
    "jsonl": (jsonl_value, "", None, ""),
    "github": (github_value, "", None, ""),
    "json": (json_value, ",", _just("["), "]"),
    "sarif": (sarif_results, ",", _sarif_head, "]}]}"),
    "csv": (csv_value, "", _just(CSV_HEADER), ""),
    "xml": (xml_value, "", _just('<?xml version="1.0" encoding="UTF-8"?><findings>'), "</findings>"),
    "junit": (junit_value, "", _junit_head, "</testsuite></testsuites>"),
    "markdown": (markdown_value, "", _markdown_head, ""),
    "html": (html_value, "", _html_head, "</table></body></html>"),
    "spdx": (spdx_value, ",", _just('{"spdxVersion":"SPDX-2.3","name":"quillon","files":['), "]}"),
    "cyclonedx": (cyclonedx_value, ",", _just('{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"vulnerabilities":['), "]}"),
}


def write_report(findings: DataFrame, kind: str, path: str) -> str:
    """Write a report as text files below path, rows in parallel; all files in the order of their names are the report.

    Where rows are separated, each is written with the separator before it, but
    the first of the first file, which the rows' stored numbers tell.
    """
    rows, separator, head, foot = REPORTS[kind]
    spark = findings.sparkSession
    one = lambda text, at: spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/{at}")
    if head:
        one(head(findings), "0-head")
    values = rows(findings)
    if separator:
        values.select("value", F.monotonically_increasing_id().alias("at")).write.parquet(f"{path}/_rows")
        stored = spark.read.parquet(f"{path}/_rows")
        first = stored.agg(F.min("at")).first()[0]
        values = stored.select(F.concat(F.when(F.col("at") == (-1 if first is None else first), "").otherwise(separator), "value").alias("value"), "at").sort("at").select("value")
    values.write.text(f"{path}/1-rows")
    if foot:
        one(foot, "2-foot")
    return path


def document(findings: DataFrame, kind: str) -> str:
    """The whole report as one text, for few findings: it comes to the driver."""
    rows, separator, head, foot = REPORTS[kind]
    body = (f"{separator}\n").join(r["value"] for r in rows(findings).toLocalIterator())
    return "\n".join(x for x in (head(findings) if head else "", body, foot) if x) + "\n"


def sarif(findings: DataFrame) -> str:
    return document(findings, "sarif")


def xml(findings: DataFrame) -> str:
    return document(findings, "xml")


def junit(findings: DataFrame) -> str:
    return document(findings, "junit")


def csv(findings: DataFrame) -> str:
    return document(findings, "csv")


def json_array(findings: DataFrame) -> str:
    return document(findings, "json")


def markdown(findings: DataFrame) -> str:
    return document(findings, "markdown")


def html(findings: DataFrame) -> str:
    return document(findings, "html")


def spdx(findings: DataFrame) -> str:
    return document(findings, "spdx")


def cyclonedx(findings: DataFrame) -> str:
    return document(findings, "cyclonedx")


def prometheus_lines(findings: DataFrame) -> DataFrame:
    """Gauge lines by severity and by rule."""
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    one = counts.select(F.format_string('quillon_findings_total{severity="%s"} %d', "severity", "n").alias("value"))
    return one.unionByName(rule_counts(findings).select(F.format_string('quillon_findings_by_rule{rule="%s"} %d', "rule_id", "n").alias("value")))


def comment_body(findings: DataFrame, most: int = 20) -> str:
    """A review comment with the first findings; the number shown is the format's."""
    total = findings.count()
    rows = findings.limit(most).select(F.format_string("- **%s** `%s` at `%s:%d`", "severity", "rule_id", "path", "line").alias("value"))
    return f"## {total} findings\n\n" + "\n".join(r["value"] for r in rows.collect())


def webhook(findings: DataFrame, kind: str = "generic") -> DataFrame:
    """A JSON payload a finding for slack, teams, discord or a plain hook."""
    text = F.format_string("[%s] %s at %s:%d", F.upper("severity"), "rule_id", "path", "line")
    fields = {"slack": F.struct(text.alias("text")), "teams": F.struct(F.lit("MessageCard").alias("@type"), text.alias("text")), "discord": F.struct(text.alias("content"))}
    return findings.select(F.to_json(fields.get(kind, F.struct("rule_id", "severity", "path", "line", "description"))).alias("value"))
