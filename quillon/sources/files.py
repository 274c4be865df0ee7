"""Files, archives, charts and state files as DataFrames of (path, content) or (path, line, text)."""

from __future__ import annotations

import base64
import io
import json
import re
import subprocess
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.decode import frames
from ..functions.text import basename, glob_regex
from ..operators.scan import MAX_FILE_BYTES, ignored, lines_of


def gitignore_regexes(text: str) -> list[tuple[bool, str]]:
    """(negated, regex on the path below the root) of a .gitignore's lines, in order."""
    out = []
    for raw in text.splitlines():
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.removeprefix("!")
        folder, anchored = line.endswith("/"), "/" in line.rstrip("/")
        parts = re.split(r"(\*\*/|\*\*|\*|\?)", line.strip("/"))
        body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)
        out.append((negated, f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if folder else '(?:/.*)?'}$"))
    return out


def _kept_by_git(path: Column, rules: list[tuple[bool, str]]) -> Column:
    keep = F.lit(True)
    for negated, regex in rules:
        keep = F.when(path.rlike(regex), F.lit(negated)).otherwise(keep)
    return keep


def read_files(spark: SparkSession, root: str, ignore: list[str] | None = None, max_bytes: int = MAX_FILE_BYTES, gitignore: str = "") -> DataFrame:
    """(path, length, modificationTime, content) below root; length, ignore and gitignore tests come before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where(F.col("length") <= max_bytes)
    if ignore:
        files = files.where(~ignored(F.col("path"), ignore))
    if gitignore:
        below = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(root.removeprefix("file:").strip("/")) + "/?", "")
        files = files.where(_kept_by_git(below, gitignore_regexes(gitignore)))
    return files


def as_documents(files: DataFrame) -> DataFrame:
    """(path, text), bytes that are not UTF-8 replaced."""
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def from_text(spark: SparkSession, text: str, path: str = "<stdin>") -> DataFrame:
    return spark.createDataFrame([(path, text)], "path string, text string")


def git_changed(root: str) -> list[str]:
    """Changed and untracked files, sorted, each once."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout.splitlines()
    return sorted({*run("diff", "--name-only", "HEAD"), *run("ls-files", "--others", "--exclude-standard")})


def only_paths(files: DataFrame, root: str, paths: list[str]) -> DataFrame:
    """Files whose path below root is listed."""
    wanted = files.sparkSession.createDataFrame([(p,) for p in paths], "below string")
    below = F.regexp_replace("path", "^(?:file:)?/*" + re.escape(root.strip("/")) + "/", "")
    return files.join(wanted, below == F.col("below"), "left_semi")


def archive_entries(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """(name/entry, bytes) of a zip or tar (compressed or not); unreadable archives have none."""
    try:
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for info in z.infolist():
                    if not info.is_dir():
                        yield f"{name}/{info.filename}", z.read(info)
        else:
            # a plain header needs no trial of every compression
            plain = content[257:262] == b"ustar" and not content.startswith((b"\x1f\x8b", b"BZh", b"\xfd7zXZ"))
            with tarfile.open(fileobj=io.BytesIO(content), mode="r:" if plain else "r:*") as t:
                for m in t:
                    if m.isfile() and (f := t.extractfile(m)):
                        yield f"{name}/{m.name}", f.read()
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, RuntimeError):
        return


def image_entries(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """Files of a saved image's layers: those its manifest names, else every inner tar; binaries over 1 KiB are left out."""
    outer = dict(archive_entries(name, content))
    layers = [p for p in outer if p.endswith(".tar")]
    manifest = outer.get(f"{name}/manifest.json")
    if manifest:
        try:
            layers = [f"{name}/{layer}" for image in json.loads(manifest) for layer in image.get("Layers", [])]
        except (ValueError, AttributeError):
            pass
    for layer in layers:
        for path, data in archive_entries(layer, outer.get(layer, b"")):
            if not (len(data) > 1024 and b"\0" in data[:1024]):
                yield path, data


def is_archive(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(zip|tar|gz|tgz)$")


def unpack(files: DataFrame, images: bool = False) -> DataFrame:
    """(path, text) of every entry of archive files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            entries = ((entry, data.decode("utf-8", "replace")) for path, content in zip(pdf["path"], pdf["content"], strict=True) for entry, data in (image_entries if images else archive_entries)(path, bytes(content)))
            yield from frames(entries, ["path", "text"], lambda r: len(r[1]))

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def chart_files(files: DataFrame) -> DataFrame:
    """A chart's values, templates and Chart.yaml."""
    return files.where(F.col("path").rlike(r"(^|/)(values\.ya?ml|values-[^/]*\.ya?ml|Chart\.yaml|templates/.*\.(yaml|yml|tpl|txt))$"))


def json_leaves(text: str, least: int = 10) -> list[tuple[str, str]]:
    """(dotted path, value) of every string over `least` bytes in a JSON text."""
    try:
        stack = [("", json.loads(text))]
    except ValueError:
        return []
    out = []
    while stack:
        at, node = stack.pop()
        if isinstance(node, dict):
            stack += [(f"{at}.{k}" if at else k, v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            stack += [(f"{at}[{k}]", v) for k, v in reversed(list(enumerate(node)))]
        elif isinstance(node, str) and len(node.encode()) > least:
            out.append((at, node))
    return out


def state_lines(documents: DataFrame) -> DataFrame:
    """A state file's lines, and its JSON strings again as line 0 with their path in front."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, 0, f"{at}: {value}") for p, t in zip(pdf["path"], pdf["text"], strict=True) for at, value in json_leaves(t or "")]
            yield pd.DataFrame(rows, columns=["path", "line", "text"]).astype({"line": "int32"})

    leaves = documents.select("path", "text").mapInPandas(run, "path string, line int, text string")
    return lines_of(documents).unionByName(leaves)


def secret_manifest_lines(documents: DataFrame) -> DataFrame:
    """A manifest's lines, its decoded `data`, its `stringData`, and lines' own base64 values decoded."""
    schema = "struct<data:map<string,string>,stringData:map<string,string>>"
    parsed = documents.select("path", F.from_json("text", F.lit(schema)).alias("m"))
    data = parsed.select("path", F.explode("m.data").alias("key", "raw")).select("path", F.try_to_binary("raw", F.lit("base64")).cast("string").alias("text"))
    plain = parsed.select("path", F.explode("m.stringData").alias("key", "text")).select("path", "text")
    lines = lines_of(documents)
    value = F.regexp_extract("text", r"^\s*[^:]+:\s*\"?([A-Za-z0-9+/]{11,}={0,2})\"?\s*,?\s*$", 1)
    decoded = F.try_validate_utf8(F.try_to_binary(value, F.lit("base64")).cast("string"))
    inline = lines.withColumn("text", F.when(value != "", decoded)).where(F.char_length("text") > 5)
    extra = data.unionByName(plain).where(F.col("text").isNotNull()).withColumn("line", F.lit(0))
    return lines.unionByName(extra.select("path", "line", "text")).unionByName(inline)


def decode_base64(value: str) -> str | None:
    try:
        return base64.b64decode(value, validate=True).decode()
    except ValueError:
        return None


def matches_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern)) | basename(path).rlike(glob_regex(pattern))
