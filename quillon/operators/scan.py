"""Lines, the keyword gate, and the two scan modes.

Gated: a trie regex of all gate words runs over each line, its hits name rules,
and only those (line, rule) pairs see their rule's regex. Raw: every rule's
regex sees every line. Both are one pass in the JVM without a join or a
shuffle. Patterns are literals of the plan, a branch for each rule, so a task
compiles each once; a pattern that came from a column would be compiled anew
whenever the rule changes from row to row.

With compat_gate the gate keeps the earliest rule of each gate word only, as an
automaton that maps a word to one rule does; by default every rule of a word is
reached.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters, text
from ..rules import ENTROPY_BYTES, ENTROPY_RULE, Allowlist, Rule, builtin
from ..schema import FINDING, FINDING_COLUMNS, rank

ALLOW_MARKER = "quillon:allow"
MAX_FILE_BYTES = 5 * 1024 * 1024
#: Rules whose patterns are compiled into one method.
FEW_RULES = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(documents: DataFrame, path: str = "path", content: str = "text") -> DataFrame:
    """(path, line, text): lines end at \\n or \\r\\n, and a final line break starts no line."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"\r?\n\z", ""), r"\r?\n")
    whole = documents.where(F.coalesce(F.col(content), F.lit("")) != "")
    return whole.select(F.col(path).alias("path"), F.posexplode(parts).alias("line", "text")).withColumn("line", F.col("line") + 1)


def _trie(words: list[str]) -> str:
    """One regex for all words that prefers the longest at each place."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def either(chars: list[str], node: dict) -> str:
        """Branches by their first character; many are told apart by classes of six first, as branches are tried in turn."""
        if len(chars) > 6:
            parts = [chars[k : k + 6] for k in range(0, len(chars), 6)]
            return "(?:" + "|".join(f"(?=[{''.join(map(re.escape, part))}]){either(part, node)}" for part in parts) + ")"
        branches = [re.escape(c) + build(node[c]) for c in chars]
        return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"

    def build(node: dict) -> str:
        chars = sorted(c for c in node if c)
        if not chars:
            return ""
        inner = either(chars, node)
        return f"(?:{inner})?" if "" in node else inner

    return build(root)


def gate_words(rules: list[Rule], compat_gate: bool = False) -> list[tuple[str, int]]:
    """(word, ordinal of a rule it triggers); rules without words are not listed."""
    out: dict[str, list[int]] = {}
    for k, r in enumerate(rules):
        for word in r.prefilter:
            own = out.setdefault(word.translate(str.maketrans(_UPPER, _LOWER)), [])
            if k not in own and not (compat_gate and own):
                own.append(k)
    return [(w, k) for w, ks in out.items() for k in ks]


def fold(line: Column) -> Column:
    """ASCII lower case: never changes a text's length."""
    return F.translate(line, _UPPER, _LOWER)


def gate(lines: DataFrame, rules: list[Rule], compat_gate: bool = False) -> DataFrame:
    """lines with the ordinal of every rule whose gate word they hold, or that has none.

    A row's words are mapped to rules inside the row, so the gate is one scan
    without a join or a shuffle, and a rule with two words in a line comes once.
    """
    words = gate_words(rules, compat_gate)
    free = [k for k, r in enumerate(rules) if not r.prefilter]
    always = F.array(*map(F.lit, free)).cast("array<int>")
    if not words:
        return lines.withColumn("ordinal", F.explode(always))
    of_word: dict[str, list[int]] = {}
    for word, k in words:
        of_word.setdefault(word, []).append(k)
    keys, ordinals = ", ".join(map(_quoted, of_word)), ", ".join(f"array({', '.join(map(str, own))})" for own in of_word.values())
    table = F.expr(f"map_from_arrays(array({keys}), array({ordinals}))")
    found = lines.withColumn("_words", F.regexp_extract_all(fold(F.col("text")), F.lit(_trie(sorted(of_word))), F.lit(0)))
    # lines without words explode to nothing, so no filter runs the pattern a second time
    ordinals = F.concat(always, F.flatten(F.transform(F.array_distinct("_words"), lambda w: F.element_at(table, w))))
    return found.withColumn("ordinal", F.explode(F.array_distinct(ordinals))).drop("_words")


def matches(pattern: Column, line: Column, group: int = 0) -> Column:
    """array<struct<start, text>> of all non-overlapping matches; start is a 0-based byte offset of the match."""
    whole = F.concat(F.lit(r"\G(?s:(.*?))("), pattern, F.lit(")"))
    gaps = F.regexp_extract_all(line, whole, F.lit(1))
    found = F.regexp_extract_all(line, whole, F.lit(2))
    wanted = found if group == 0 else F.regexp_extract_all(line, whole, F.lit(group + 2))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), wanted.alias("want"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.octet_length(m["gap"])
        one = F.struct(start.cast("int").alias("start"), m["want"].alias("text"))
        return F.struct((start + F.octet_length(m["hit"])).cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(zipped, zero, step, lambda acc: acc["out"])


def _quoted(value: str) -> str:
    """A text as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_rule(rules: list[Rule], one: Callable[[Rule], str]) -> Column:
    """one(rule) of the row's rule, in SQL: a leaf for each, so that patterns are literals and compiled once a task.

    A few leaves are branches of compiled code. A catalog makes hundreds, which are found by halves of the
    ordinals; inside a function on arrays they are interpreted, as compiled they make a method too large
    for the JVM; and as one text they are parsed at once.
    """
    if len(rules) <= FEW_RULES:
        return F.expr("CASE " + " ".join(f"WHEN ordinal = {k} THEN {one(r)}" for k, r in enumerate(rules)) + " END")

    def half(low: int, high: int) -> str:
        if high - low == 1:
            return one(rules[low])
        middle = (low + high) // 2
        return f"IF(ordinal < {middle}, {half(low, middle)}, {half(middle, high)})"

    return F.expr(f"get(transform(array(0), x -> {half(0, len(rules))}), 0)")


def _extracted(pattern: str, group: int) -> str:
    return f"regexp_extract_all(text, {_quoted(pattern)}, {group})"


def with_matches(pairs: DataFrame, rules: list[Rule]) -> DataFrame:
    """pairs (text, ordinal, ...) with m, struct<start, text>, for each match of the row's rule, or of its group; start is a 0-based byte offset.

    The texts of the matches come first and alone, so a line without any costs one pass of its pattern.
    """
    found = pairs.withColumn("_hit", _by_rule(rules, lambda r: _extracted(r.pattern, 0)))
    some = F.size("_hit") > 0
    found = found.withColumn("_gap", F.when(some, _by_rule(rules, lambda r: _extracted(rf"\G(?s:(.*?))({r.pattern})", 1))))
    grouped = any(r.secret_group is not None for r in rules)
    columns = [F.col("_gap").alias("gap"), F.col("_hit").alias("hit")]
    if grouped:
        found = found.withColumn("_want", F.when(some, _by_rule(rules, lambda r: "NULL" if r.secret_group is None else _extracted(r.pattern, r.secret_group))))
        columns.append(F.coalesce("_want", "_hit").alias("want"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start, want = acc["at"] + F.octet_length(m["gap"]), m["want"] if grouped else m["hit"]
        lead = F.octet_length(F.substring(m["hit"], F.lit(1), F.position(want, m["hit"]) - 1)) if grouped else F.lit(0)
        one = F.struct((start + lead).cast("int").alias("start"), want.alias("text"))
        return F.struct((start + F.octet_length(m["hit"])).cast("int").alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    placed = F.aggregate(F.arrays_zip(*columns), zero, step, lambda acc: acc["out"])
    return found.withColumn("m", F.explode(placed)).drop("_hit", "_gap", "_want")


def spread(lines: DataFrame) -> DataFrame:
    """lines over all cores where they come in fewer partitions, as from one small file; large inputs stay as they are split."""
    cores = lines.sparkSession.sparkContext.defaultParallelism
    if lines.isStreaming or lines._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return lines
    return lines.repartition(cores)


def _allowed(allow: Allowlist, matched: Column, path: Column) -> Column:
    out = F.lit(False)
    for r in allow.regexes:
        out = out | matched.rlike(r)
    for p in allow.paths:
        out = out | path.rlike(p)
    for w in allow.stopwords:
        out = out | matched.contains(w)
    return out


def detect(pairs: DataFrame, rules: list[Rule], allow: Allowlist | None = None, honour_lists: bool = True) -> DataFrame:
    """Findings of (path, line, text, ordinal) pairs: regex, then group, entropy and allowlists."""
    if not rules:
        return pairs.sparkSession.createDataFrame([], FINDING)
    found = with_matches(pairs, rules).withColumn("matched", F.col("m.text"))
    grouped = [k for k, r in enumerate(rules) if r.secret_group is not None]
    if grouped:
        found = found.where((F.col("matched") != "") | ~F.col("ordinal").isin(grouped))
    of_entropy = [(k, r) for k, r in enumerate(rules) if r.entropy is not None]
    if of_entropy:
        least = F
        for k, r in of_entropy:
            least = least.when(F.col("ordinal") == k, r.entropy)
        sizes = [k for k, r in of_entropy if r.rule_id == ENTROPY_RULE]
        found = found.where(~F.col("ordinal").isin(sizes) | (F.octet_length("matched") >= ENTROPY_BYTES)) if sizes else found
        found = found.where(~F.col("ordinal").isin([k for k, _ in of_entropy]) | (text.shannon("matched") >= least.otherwise(F.lit(0.0))))
    if honour_lists:
        for k, r in enumerate(rules):
            if r.allow != Allowlist():
                found = found.where((F.col("ordinal") != k) | ~_allowed(r.allow, F.col("matched"), F.col("path")))
        if allow is not None:
            found = found.where(~_allowed(allow, F.col("matched"), F.col("path")))
    about = {"rule_id": [r.rule_id for r in rules], "description": [r.description for r in rules], "severity": [r.severity for r in rules]}
    names = {c: F.expr(f"get(array({', '.join(map(_quoted, values))}), ordinal)") for c, values in about.items()}
    names["severity_rank"] = F.expr(f"get(array({', '.join(str(rank(r.severity)) for r in rules)}), ordinal)")
    return found.select(
        *(value.alias(c) for c, value in names.items()), "path", "line", (F.col("m.start") + 1).alias("column"), "matched", F.col("text").alias("context"),
        F.lit(None).cast("string").alias("commit"), F.lit(False).alias("likely_false_positive"), F.lit(None).cast("string").alias("verification"), F.lit(None).cast("string").alias("verification_error"),
    )


def scan_gated(
    lines: DataFrame, rules: list[Rule] | None = None, enable: list[str] | None = None, allow: Allowlist | None = None, allow_marker: str = ALLOW_MARKER, compat_gate: bool = False, flag: bool = True
) -> DataFrame:
    """The working-tree mode: gate, path filters, allowlists, allow comment, then annotation."""
    rules = builtin() if rules is None else rules
    rules = [r for r in rules if enable is None or r.rule_id in enable]
    kept = spread(lines).where(~F.lower("text").contains(allow_marker.lower()))
    pairs = gate(kept, rules, compat_gate)
    for k, r in enumerate(rules):
        if r.path_filter:
            pairs = pairs.where((F.col("ordinal") != k) | F.col("path").rlike(r.path_filter))
        for p in r.allow.paths:
            pairs = pairs.where((F.col("ordinal") != k) | ~F.col("path").rlike(p))
    found = detect(pairs, rules, allow)
    return filters.annotate(found) if flag else found


def scan_raw(lines: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Every rule on every line, without gate, path filters, lists or allow comment."""
    rules = builtin() if rules is None else rules
    if not rules:
        return lines.sparkSession.createDataFrame([], FINDING)
    every = F.expr("array(" + ", ".join(f"CASE WHEN text RLIKE {_quoted(r.pattern)} THEN {k} END" for k, r in enumerate(rules)) + ")")
    # inside a function on arrays the tests are interpreted: compiled, hundreds of them make a method too large for the JVM
    pairs = spread(lines).withColumn("ordinal", F.explode(F.filter(every, lambda k: k.isNotNull())))
    return detect(pairs, rules, honour_lists=False)


def ignored(path: Column, patterns: list[str]) -> Column:
    """A pattern matches the whole path or its last part as a glob, or the path as a substring."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(text.glob_regex(p)) | text.basename(path).rlike(text.glob_regex(p)) | path.contains(p)
    return out


def changed_only(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (path, length, modificationTime, content_hash) that differ from the cache: size, or time and hash."""
    old = cache.select("path", F.col("length").alias("_length"), F.col("modificationTime").alias("_time"), F.col("content_hash").alias("_hash"))
    same = (F.col("length") == F.col("_length")) & ((F.col("modificationTime") == F.col("_time")) | (F.col("content_hash") == F.col("_hash")))
    return files.join(old, "path", "left").where(~F.coalesce(same, F.lit(False))).drop("_length", "_time", "_hash")


def sort_report(findings: DataFrame) -> DataFrame:
    """Most severe first, then by path, with ties settled."""
    return findings.orderBy(F.desc("severity_rank"), "path", "line", "column", "rule_id", "matched")


def report(findings: DataFrame, min_severity: str | None = None, show_all: bool = False, only_verified: bool = False, where: Column | None = None, redact: bool = True) -> DataFrame:
    """The reporting chain: severity, false positives, verification, expression, redaction, order."""
    if min_severity:
        findings = findings.where(F.col("severity_rank") >= rank(min_severity))
    if not show_all:
        findings = findings.where(~F.col("likely_false_positive"))
    if only_verified:
        findings = findings.where(F.col("verification") == "active")
    if where is not None:
        findings = findings.where(where)
    if redact:
        findings = findings.withColumn("context", text.redact_within("context", "matched")).withColumn("matched", text.redact("matched"))
    return sort_report(findings.select(*FINDING_COLUMNS))
