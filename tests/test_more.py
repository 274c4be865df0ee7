"""Plugins, advice, sealing."""

import re

from pyspark.sql import functions as F

from quillon import rules as catalog
from quillon.functions import sealing
from quillon.operators import advice, plugins, scan
from quillon.schema import FINDING_COLUMNS


def test_plugins(spark):
    registry = plugins.Registry()
    lines = scan.lines_of(spark.createDataFrame([("a", "é ID-12 ID-3\nid none\nID-9")], "path string, text string"))
    assert registry.scan(lines).count() == 0
    registry.register("ids", "d", "high", lambda line: [(m.start(), m.end(), m.group()) for m in re.finditer(r"ID-\d+", line)], prefilter=["id-"])
    got = registry.scan(lines)
    assert got.columns == FINDING_COLUMNS
    assert sorted((r.line, r.column, r.matched) for r in got.collect()) == [(1, 4, "ID-12"), (1, 10, "ID-3"), (3, 1, "ID-9")]


def test_advice(spark):
    lines = scan.lines_of(spark.createDataFrame([("src/a", "t ghp_" + "a" * 36), ("src/b", "-----BEGIN PRIVATE KEY-----")], "path string, text string"))
    found = scan.scan_gated(lines)
    kinds = {r.rule_id: (r.kind, r.risk) for r in advice.classified(found).collect()}
    assert kinds["private-key-pem"] == ("cryptographic key", 90) and kinds["github-pat"][0] == "credential"
    assert advice.summary(found).startswith("2 findings: 2 critical") and advice.summary(found.limit(0)) == "No findings."
    assert "SOC2: non_compliant" in advice.compliance_text(found) and advice.impact(found).count() == 2
    assert advice.rule_documentation(catalog.builtin()).count("## ") == len(catalog.builtin())
    assert advice.audit_rows(found, "me", "scan", 5).count() == 2
    sized = spark.createDataFrame([("a.py", 10), ("b.PY", 99), ("lib/c.js", 10)], "path string, n long")
    ok = advice.applies(F.col("path"), F.col("n"), (".py",), most=50)
    assert [r.path for r in sized.where(ok).collect()] == ["a.py"]
    assert sized.where(advice.applies(F.col("path"), F.col("n"), contains=("lib/",), env={"X": False})).count() == 0


def test_sealing(spark):
    df = spark.createDataFrame([("text é", "k" * 16, "x" * 16)], "t string, k string, o string").withColumn("s", sealing.seal("t", "k"))
    row = df.select("s", sealing.unseal("s", "k").alias("back"), sealing.unseal("s", "o").alias("wrong")).first()
    assert row.back == "text é" and row.wrong is None and "text" not in row.s
    assert sealing.read_xor("AAMC", "abc") == "aaa"
    rules = {r.rule_id: r for r in catalog.builtin()}
    assert all(re.search(rules[k].pattern, sealing.replacement(k)) for k in sealing.SHAPES)
