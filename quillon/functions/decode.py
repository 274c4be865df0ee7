"""Content decoders: line formats as DataFrame operations, markup and binary formats as Arrow functions."""

from __future__ import annotations

import csv
import io
import json
import re
import unicodedata
import zipfile
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import ColumnLike, _c, basename

# Content type by extension.
TYPES = {
    "html": "html htm", "xml": "xml", "json": "json", "yaml": "yaml yml", "csv": "csv tsv", "ini": "ini cfg conf properties", "env": "env",
    "dockerfile": "dockerfile", "hcl": "hcl tf", "markdown": "md markdown", "jupyter": "ipynb", "pdf": "pdf", "docx": "docx", "xlsx": "xlsx", "pptx": "pptx",
}


def content_type(path: ColumnLike) -> Column:
    """By extension as written, then by file name; else text."""
    name = basename(path)
    ext = F.regexp_extract(name, r"^.+\.([^.]*)$", 1)
    out = F
    for kind, names in TYPES.items():
        out = out.when(ext.isin(*names.split()), kind)
    return out.when(F.lower(name) == "dockerfile", "dockerfile").when(name.startswith(".") & name.contains("env"), "env").otherwise("text")


# --- line formats, native -------------------------------------------------------------------


def _split_at(text: Column, sep: str) -> tuple[Column, Column, Column]:
    """Position of the first separator, trimmed key, trimmed rest."""
    at = F.instr(text, sep)
    return at, F.trim(F.substring(text, F.lit(1), at - 1)), F.trim(F.substring(text, at + 1, F.char_length(text)))


def yaml_pairs(lines: DataFrame) -> DataFrame:
    """(path, line, key, value) at each line's first colon; blank, comment and empty-valued lines give none."""
    at, key, value = _split_at(F.trim("text"), ":")
    out = lines.where(~F.trim("text").startswith("#") & (at > 0))
    return out.select("path", "line", key.alias("key"), value.alias("value")).where("value <> ''")


def yaml_documents(lines: DataFrame) -> DataFrame:
    """lines with `document`, counted up at `---` and `...`, which are dropped."""
    order = Window.partitionBy("path").orderBy("line")
    stop = F.trim("text").isin("---", "...")
    return lines.withColumn("document", F.sum(stop.cast("int")).over(order)).where(~stop)


def ini_pairs(lines: DataFrame) -> DataFrame:
    """(path, line, key, value); a key carries its section in front."""
    bare = F.trim("text")
    own = lines.where((bare != "") & ~bare.startswith("#") & ~bare.startswith(";"))
    is_section = bare.startswith("[") & bare.endswith("]")
    own = own.withColumn("_section", F.last(F.when(is_section, F.substring(bare, F.lit(2), F.char_length(bare) - 2)), ignorenulls=True).over(Window.partitionBy("path").orderBy("line")))
    at, key, value = _split_at(bare, "=")
    full = F.when(F.coalesce("_section", F.lit("")) == "", key).otherwise(F.concat_ws(".", "_section", key))
    return own.where(~is_section & (at > 0)).select("path", "line", full.alias("key"), value.alias("value"))


def env_pairs(lines: DataFrame) -> DataFrame:
    """(path, line, key, value) of KEY=VALUE, with `export` and quotes taken off."""
    bare = F.regexp_replace(F.trim("text"), "^export ", "")
    at, key, value = _split_at(bare, "=")
    out = lines.where(~F.trim("text").startswith("#") & (at > 1))
    return out.select("path", "line", key.alias("key"), F.btrim(value, F.lit("\"'")).alias("value")).where("key <> ''")


def dockerfile_pairs(lines: DataFrame) -> DataFrame:
    """(path, line, key, value) of ENV, ARG and LABEL."""
    bare = F.trim("text")
    word = F.regexp_extract(bare, "^(ENV|ARG|LABEL) ", 1)
    rest = F.regexp_replace(bare, "^(ENV|ARG|LABEL) ", "")
    at, key, value = _split_at(rest, "=")
    gap_key, gap_value = F.regexp_extract(rest, r"^(\S+)\s+(.*)$", 1), F.regexp_extract(rest, r"^(\S+)\s+(.*)$", 2)
    out = lines.where((word != "") & ((at > 0) | (word == "ARG") | ((word == "ENV") & rest.rlike(r"\s"))))
    return out.select(
        "path", "line",
        F.when(at > 0, key).when(word == "ENV", gap_key).otherwise(F.trim(rest)).alias("key"),
        F.when((at > 0) & (word == "LABEL"), F.btrim(value, F.lit('"'))).when(at > 0, value).when(word == "ENV", F.trim(gap_value)).otherwise("").alias("value"),
    )


def fenced_lines(lines: DataFrame) -> DataFrame:
    """(path, line, language, text) of lines inside closed ``` fences."""
    order = Window.partitionBy("path").orderBy("line")
    fence = F.trim("text").startswith("```")
    marked = lines.withColumn("_fence", fence).withColumn("_n", F.sum(fence.cast("int")).over(order)).withColumn("_all", F.sum(fence.cast("int")).over(Window.partitionBy("path")))
    opener = F.when(F.col("_fence") & (F.col("_n") % 2 == 1), F.trim(F.substring(F.trim("text"), 4, 1000)))
    marked = marked.withColumn("language", F.last(opener, ignorenulls=True).over(order))
    inside = (F.col("_n") % 2 == 1) & ~F.col("_fence") & (F.col("_n") < F.col("_all"))
    return marked.where(inside).select("path", "line", "language", "text")


def strip_tags(html: ColumnLike) -> Column:
    """Text between tags, without script and style bodies."""
    bare = F.regexp_replace(_c(html), r"(?is)<(script|style)\b.*?</\1\s*>", "")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", "")


def printable_runs(content: ColumnLike, least: int = 4) -> Column:
    """Runs of printable ASCII in binary content, trimmed."""
    runs = F.regexp_extract_all(F.decode(_c(content), "ISO-8859-1"), F.lit(rf"[\x20-\x7e]{{{least},}}"), F.lit(0))
    return F.transform(runs, lambda r: F.trim(r))


def json_strings(text: ColumnLike) -> Column:
    """All string literals of a JSON text, keys included, still escaped."""
    return F.regexp_extract_all(_c(text), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))


# --- formats that need a parser, as plain functions ------------------------------------------


def html_entities(text: str) -> str:
    """Entities that end with a semicolon; anything else stays as it is."""
    return re.sub(r"&(?:#\d{1,8}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});", lambda m: unescape(m[0]), text)


def url_decode(text: str) -> str:
    """%XX to the Latin-1 character, + to space; malformed escapes stay."""
    return re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text.replace("+", " "))


def nfc(text: str) -> str:
    return unicodedata.normalize("NFC", text)


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def json_unescape(text: str) -> str:
    """JSON escapes, each \\u on its own."""
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 and not 0xD800 <= int(m[1][1:], 16) < 0xE000 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def xml_values(text: str) -> list[str]:
    """Attribute values and text nodes in order."""
    out = []
    for tag, body in re.findall(r"(<[^>]*>)|([^<]+)", text):
        if tag:
            out += [html_entities(a or b) for a, b in re.findall(r"""=\s*(?:"([^"]*)"|'([^']*)')""", tag)]
        elif body.strip():
            out.append(html_entities(body.strip()))
    return [v for v in out if v]


def csv_cells(text: str) -> list[list[str]]:
    """Rows of cells; a quoted cell ends with its line."""
    return [next(csv.reader(io.StringIO(line)), []) for line in text.splitlines() if line]


def hcl_pairs(text: str) -> list[tuple[str, str]]:
    """(block.name.key, value) inside top-level blocks."""
    out: list[tuple[str, str]] = []
    depth, head = 0, ""
    for line in (raw.strip() for raw in text.splitlines()):
        if not line or line.startswith(("#", "//")):
            continue
        if depth <= 0:
            before, brace, _ = line.partition("{")
            if brace:
                words = before.split(None, 1)
                head = ".".join([words[0] if words else "", *([words[1].strip().strip('"')] if len(words) > 1 else [])])
                depth = 1
            continue
        depth += line.count("{") - line.count("}")
        key, equals, value = (x.strip() for x in line.partition("="))
        if depth > 0 and key and equals and value:
            out.append((f"{head}.{key}", value.strip('"')))
    return out


def notebook_cells(text: str) -> list[tuple[str, str]]:
    """(kind, text) of a notebook's cells and outputs."""
    try:
        cells = json.loads(text).get("cells", [])
    except (ValueError, AttributeError):
        return []
    joined = lambda s: "".join(x for x in s if isinstance(x, str)) if isinstance(s, list) else s if isinstance(s, str) else ""
    out = []
    for cell in (c for c in cells if isinstance(c, dict)):
        out.append((cell.get("cell_type", ""), joined(cell.get("source"))))
        for o in cell.get("outputs") or []:
            out.append(("output", joined(o.get("text")) or joined((o.get("data") or {}).get("text/plain"))))
    return [(k, t) for k, t in out if t]


def pdf_text(content: bytes) -> str:
    """Strings in parentheses between BT and ET."""
    text = content.decode("utf-8", "replace")
    out = []
    for block in re.findall(r"BT(.*?)(?:ET|\Z)", text, flags=re.S):
        out += [re.sub(r"\\(.)", r"\1", s, flags=re.S) for s in re.findall(r"\(((?:[^)\\]|\\.)*)\)?", block, flags=re.S)]
    return "".join(s + " " for s in out if s)


def _office(content: bytes, member: str, tag: str, joiner: str) -> list[str]:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = sorted(n for n in z.namelist() if re.fullmatch(member, n))
            return [joiner.join(html_entities(t) for t in re.findall(rf"<{tag}(?:\s[^>]*)?>([^<]*)</{tag}>", z.read(n).decode("utf-8", "replace"))) for n in names]
    except (zipfile.BadZipFile, KeyError, OSError):
        return []


def docx_text(content: bytes) -> str:
    return "\n".join(_office(content, r"word/document\.xml", "w:t", " "))


def xlsx_cells(content: bytes) -> list[str]:
    return [c for part in _office(content, r"xl/(?:sharedStrings|worksheets/[^/]+)\.xml", "(?:t|v)", "\n") for c in part.split("\n") if c]


def pptx_text(content: bytes) -> str:
    return "\n".join(_office(content, r"ppt/slides/slide\d+\.xml", "a:t", " "))


def _pairs(text: str, kind: str) -> list[str]:
    out, section = [], ""
    for line in (x.strip() for x in text.splitlines()):
        if not line or line.startswith("#") or (kind == "ini" and line.startswith(";")):
            continue
        if kind == "ini" and line.startswith("[") and line.endswith("]"):
            section = line[1:-1]
            continue
        if kind == "dockerfile":
            m = re.match(r"(?:ENV|LABEL|ARG) +([^=\s]+)(?:\s*=\s*|\s+)?(.*)$", line)
            out += [f"{m[1]}={m[2].strip(chr(34))}"] if m else []
            continue
        sep = ":" if kind == "yaml" else "="
        key, found, value = (x.strip() for x in line.removeprefix("export " if kind == "env" else "").partition(sep))
        if found and (value or kind != "yaml"):
            key = f"{section}.{key}" if section else key
            out.append(f"{key}: {value}" if kind == "yaml" else f"{key}={value.strip(chr(34) + chr(39)) if kind == 'env' else value}")
    return out


#: Rows and characters that a task holds before it hands them on as one frame: one frame a file costs more than most files.
FRAME_ROWS, FRAME_SIZE = 5_000, 4 << 20


def frames(rows: Iterable[tuple], columns: list[str], size: Callable[[tuple], int]) -> Iterator[pd.DataFrame]:
    """Rows in frames of bounded rows and sizes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if len(held) >= FRAME_ROWS or total >= FRAME_SIZE:
            yield pd.DataFrame(held, columns=columns)
            held, total = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def decode_content(content: bytes, kind: str) -> list[str]:
    """The lines that a file of this kind holds for a scanner."""
    text = content.decode("utf-8", "replace") if kind not in ("pdf", "docx", "xlsx", "pptx", "binary") else ""
    if kind == "html":
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", text)
        return html_entities(re.sub(r"(?s)<[^>]*>", "", bare)).splitlines()
    if kind == "markdown":
        return [x for body in re.findall(r"(?ms)^[ \t]*```[^\n]*\n(.*?)^[ \t]*```", text) for x in body.splitlines()]
    plain: dict[str, Callable[[], list[str]]] = {
        "xml": lambda: xml_values(text),
        "json": lambda: [json_unescape(s) for s in re.findall(r'"((?:[^"\\]|\\.)*)"', text)],
        "csv": lambda: [c for row in csv_cells(text) for c in row],
        "hcl": lambda: [f"{k}={v}" for k, v in hcl_pairs(text)],
        "jupyter": lambda: [x for _, t in notebook_cells(text) for x in t.splitlines()],
        "pdf": lambda: pdf_text(content).splitlines(),
        "docx": lambda: docx_text(content).splitlines(),
        "xlsx": lambda: xlsx_cells(content),
        "pptx": lambda: pptx_text(content).splitlines(),
        "binary": lambda: [r.decode().strip() for r in re.findall(rb"[\x20-\x7e]{4,}", content)],
    }
    if kind in plain:
        return plain[kind]()
    return _pairs(text, kind) if kind in ("yaml", "ini", "env", "dockerfile") else text.splitlines()


def decoded_lines(files: DataFrame) -> DataFrame:
    """(path, line, text) from files (path, content binary), each decoded by its type."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            of_files = ((path, n, text) for path, content, kind in zip(pdf["path"], pdf["content"], pdf["kind"], strict=True) for n, text in enumerate(decode_content(bytes(content or b""), kind), 1))
            yield from frames(of_files, ["path", "line", "text"], lambda r: len(r[2]))

    return files.select("path", "content", content_type("path").alias("kind")).mapInPandas(run, "path string, line int, text string")


def text_function(fn: Callable[[str], str]) -> Callable[[ColumnLike], Column]:
    """A string function as an Arrow-batched column function that keeps nulls."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore")

    return lambda column: run(_c(column))
