"""Patch history as added lines.

The patch stream is spooled to a file and read in parallel, a row a commit,
which becomes numbered lines. Commit, file and hunk are
carried down by window functions over one commit's lines, so commits are
independent and spread over the cluster.
"""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """What of the history to read; without anything, all refs."""

    commit_range: str | None = None
    since_commit: str | None = None
    since_date: str | None = None
    branch: str | None = None

    def arguments(self) -> list[str]:
        out = [f"--since={self.since_date}"] if self.since_date else []
        if self.commit_range:
            return [*out, self.commit_range]
        if self.since_commit:
            return [*out, f"{self.since_commit}..HEAD"]
        return [*out, self.branch or "--all"]


def spool_patches(root: str, folder: str, scope: Scope | None = None) -> str:
    """Write the patch stream of a repository to a file in folder, as it comes; folder must be one that executors see."""
    path = Path(folder) / "history.patch"
    command = ["git", "-C", root, "log", "-p", "--unified=0", "--no-color", *(scope or Scope()).arguments()]
    with path.open("wb") as out:
        subprocess.run(command, stdout=out, check=True)
    return str(path)


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """(commit, path, line, text) of every added line of patch files, split at commits so that a file is read in parallel.

    Only a commit's first line starts with the word: messages are indented, and lines of a patch carry a sign.
    """
    chunks = spark.read.option("lineSep", "\ncommit ").text(path).select(F.monotonically_increasing_id().alias("chunk"), "value")
    whole = F.when(F.col("value").startswith("commit "), F.col("value")).otherwise(F.concat(F.lit("commit "), "value"))
    return parse_patches(chunks.select("chunk", whole.alias("patch")))


def added_lines(spark: SparkSession, patch: str) -> DataFrame:
    """The same of a patch stream that is at hand as one text."""
    chunks = re.split(r"\n(?=commit )", patch)
    return parse_patches(spark.createDataFrame(list(enumerate(chunks)), "chunk long, patch string"))


def parse_patches(chunks: DataFrame) -> DataFrame:
    """The same from rows (chunk, patch), a commit each."""
    rows = chunks.select("chunk", F.posexplode(F.split("patch", r"\r?\n")).alias("seq", "raw"))
    order = Window.partitionBy("chunk").orderBy("seq")
    raw = F.col("raw")
    sha = F.when(raw.rlike("^commit [0-9a-f]+"), F.regexp_extract(raw, "^commit ([0-9a-f]+)", 1))
    # deleted files and new commits reset the path, marked by an empty string
    path = F.when(raw.rlike("^commit "), "").when(raw.startswith("+++ /dev/null"), "").when(raw.rlike(r"^\+\+\+ b/"), F.regexp_extract(raw, r"^\+\+\+ b/(.*)$", 1))
    hunk = F.when(raw.rlike(r"^@@ "), F.regexp_extract(raw, r"^@@ -\S+ \+(\d+)", 1).cast("int"))
    marked = rows.select("chunk", "seq", "raw", sha.alias("_sha"), path.alias("_path"), hunk.alias("_hunk"))
    marked = marked.withColumn("commit", F.last("_sha", ignorenulls=True).over(order)).withColumn("path", F.last("_path", ignorenulls=True).over(order))
    marked = marked.withColumn("_start", F.last("_hunk", ignorenulls=True).over(order)).withColumn("_group", F.count("_hunk").over(order))
    added = marked.where(raw.startswith("+") & ~raw.startswith("+++ b/") & ~raw.startswith("+++ /dev/null") & (F.col("path") != "") & F.col("_start").isNotNull())
    place = F.row_number().over(Window.partitionBy("chunk", "_group").orderBy("seq")) - 1
    return added.select("commit", "path", (F.col("_start") + place).cast("int").alias("line"), F.substring("raw", 2, 1 << 30).alias("text"))


def scan_history(lines: DataFrame, scan) -> DataFrame:
    """Apply a raw scan to added lines and put the commit back on its findings."""
    keyed = lines.withColumn("path", F.concat_ws("\x01", "commit", "path"))
    found = scan(keyed.select("path", "line", "text"))
    return found.withColumn("commit", F.substring_index("path", "\x01", 1)).withColumn("path", F.substring_index("path", "\x01", -1))
