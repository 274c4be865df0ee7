"""The driver's entry points, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    names = __spark_entry__.queries()
    assert {"scan_gated", "rule_counts"} <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_entry_without_the_training_operators(tmp_path):
    for p in ROOT.rglob("*.py"):
        below = p.relative_to(ROOT)
        if "llm" not in below.parts and below.name != "corpus_pipeline.py":
            (tmp_path / below).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / below).write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'scan_gated' in q and not [n for n in q if n.startswith('op') or n == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
