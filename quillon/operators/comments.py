"""Comment spans of whole files, string-aware, and the findings that lie in them.

One scanner serves all languages: a regex of string, comment (and for
JavaScript regex-literal) forms is matched from left to right, so a comment
marker inside a string opens no comment and the other way round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import is_fixture
from ..functions.text import extension

_DQ, _SQ, _BACK = r'"(?:[^"\\\n]|\\.)*"?', r"'(?:[^'\\\n]|\\.)*'?", r"`(?:[^`\\]|\\.)*`?"
_LINE, _BLOCK = r"(?P<c1>//[^\n]*)", r"(?P<c2>/\*.*?(?:\*/|\Z))"
_JS_REGEX = r"(?<=[=(,:;!&|?{}\[+\-*%~^<>\n])[ \t]*/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_FORMS = {
    "py": rf"(?P<c1>\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z))|{_DQ}|{_SQ}|(?P<c2>\#[^\n]*)",
    "rb": r"(?P<c1>^=begin\b.*?(?:^=end[^\n]*|\Z))|(?P<c2>^[ \t]*\#[^\n]*)",
    "js": rf"{_DQ}|{_SQ}|{_BACK}|{_LINE}|{_BLOCK}|{_JS_REGEX}",
    "go": rf"{_DQ}|{_SQ}|`[^`]*`?|{_LINE}|{_BLOCK}",
    "c": rf"{_DQ}|{_SQ}|{_LINE}|{_BLOCK}",
    "cs": rf'@"(?:[^"]|"")*"?|{_DQ}|{_SQ}|{_LINE}|{_BLOCK}',
    "php": rf"{_DQ}|{_SQ}|{_LINE}|{_BLOCK}|(?P<c3>\#(?!\[)[^\n]*)",
}
_LANGUAGE = {
    **dict.fromkeys("py pyi".split(), "py"), "rb": "rb", **dict.fromkeys("js jsx ts tsx mjs cjs".split(), "js"), "go": "go",
    **dict.fromkeys("java kt kts scala c h cpp hpp cc cxx".split(), "c"), "cs": "cs", "php": "php",
}
_SCANNERS = {k: re.compile(v, re.S | re.M) for k, v in _FORMS.items()}


def comment_spans(text: str, ext: str) -> list[tuple[int, int]] | None:
    """Byte spans [start, end) of comments; None for a language that is not known."""
    language = _LANGUAGE.get(ext.lower())
    if language is None:
        return None
    spans = [m.span() for m in _SCANNERS[language].finditer(text) if any(v is not None for v in m.groupdict().values())]
    if text.isascii():
        return spans
    size = lambda a, b: len(text[a:b].encode("utf-8", "surrogatepass"))
    out, at, byte = [], 0, 0
    for a, b in spans:
        start = byte + size(at, a)
        at, byte = b, start + size(a, b)
        out.append((start, byte))
    return out


def annotate_files(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """Replace the comment part of likely_false_positive by the spans of documents (path, text), where their language is known."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, ext, text in zip(pdf["path"], pdf["ext"], pdf["text"], strict=True):
                spans = comment_spans(text or "", ext)
                if spans is None:
                    continue
                ends, at = [], 0
                for line in (text or "").split("\n"):
                    ends.append(at)
                    at += len(line.encode("utf-8", "surrogatepass")) + 1
                rows.append((path, [a for a, _ in spans], [b for _, b in spans], ends))
            yield pd.DataFrame(rows, columns=["path", "_from", "_to", "_lines"])

    wanted = documents.join(findings.select("path").distinct(), "path", "left_semi")
    spans = wanted.select("path", extension("path").alias("ext"), "text").mapInPandas(run, "path string, _from array<long>, _to array<long>, _lines array<long>")
    offset = F.get("_lines", F.col("line") - 1) + F.col("column") - 1
    inside = F.exists(F.arrays_zip(F.col("_from").alias("a"), F.col("_to").alias("b")), lambda s: (offset >= s["a"]) & (offset < s["b"]))
    joined = findings.join(spans, "path", "left")
    flag = F.when(F.col("_from").isNull(), F.col("likely_false_positive")).otherwise(F.coalesce(inside, F.lit(False)) | is_fixture("path"))
    return joined.withColumn("likely_false_positive", flag).drop("_from", "_to", "_lines")
