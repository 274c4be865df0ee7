"""Detectors written in Python, run Arrow-batched beside the built-in rules.

A plugin is a function from a line to (start, end, text) triples, in characters,
with the metadata of a rule. Its gate words are tested in the JVM, so only lines
that hold one reach Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FINDING, FINDING_COLUMNS, rank
from .scan import fold

Detect = Callable[[str], Iterable[tuple[int, int, str]]]


@dataclass(frozen=True)
class Plugin:
    """One registered detector."""

    rule_id: str
    description: str
    severity: str
    detect: Detect
    prefilter: tuple[str, ...] = ()


class Registry:
    """Plugins by id; a later one replaces an earlier one of the same id."""

    def __init__(self) -> None:
        self.plugins: dict[str, Plugin] = {}

    def register(self, rule_id: str, description: str, severity: str, detect: Detect, prefilter: Iterable[str] = ()) -> None:
        rank(severity)
        self.plugins[rule_id] = Plugin(rule_id, description, severity, detect, tuple(prefilter))

    def scan(self, lines: DataFrame) -> DataFrame:
        """Findings of all plugins over (path, line, text)."""
        out = None
        for plugin in self.plugins.values():
            found = _run(plugin, lines)
            out = found if out is None else out.unionByName(found)
        return lines.sparkSession.createDataFrame([], FINDING) if out is None else out


def _run(plugin: Plugin, lines: DataFrame) -> DataFrame:
    wanted = lines
    if plugin.prefilter:
        hit = F.lit(False)
        for word in plugin.prefilter:
            hit = hit | fold(F.col("text")).contains(word.lower())
        wanted = lines.where(hit)
    detect = plugin.detect

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, n, len(t[:a].encode()) + 1, m, t) for p, n, t in zip(pdf["path"], pdf["line"], pdf["text"], strict=True) for a, _, m in detect(t or "")]
            yield pd.DataFrame(rows, columns=["path", "line", "column", "matched", "context"]).astype({"line": "int32", "column": "int32"})

    found = wanted.select("path", "line", "text").mapInPandas(run, "path string, line int, column int, matched string, context string")
    fixed = {"rule_id": F.lit(plugin.rule_id), "description": F.lit(plugin.description), "severity": F.lit(plugin.severity), "severity_rank": F.lit(rank(plugin.severity)), "likely_false_positive": F.lit(False)}
    nulls = {c: F.lit(None).cast("string") for c in ("commit", "verification", "verification_error")}
    return found.withColumns(fixed | nulls).select(*FINDING_COLUMNS)
