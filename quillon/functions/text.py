"""Scalar functions on text, all as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def characters(text: ColumnLike) -> Column:
    """Array of the characters of a text."""
    return F.split(_c(text), "")


def _share_sum(text: Column, size: Column, term) -> Column:
    """Sum of term(p) over distinct characters, p being occurrences / size."""
    one_of_each = F.array_distinct(characters(text))
    count = lambda c: F.char_length(text) - F.char_length(F.replace(text, c))
    return F.aggregate(F.filter(one_of_each, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc + term(count(c) / size))


def shannon(text: ColumnLike, by_bytes: bool = True) -> Column:
    """Bits a character. With by_bytes, shares are over the UTF-8 length, as the detectors compute them."""
    t = _c(text)
    size = F.octet_length(t) if by_bytes else F.char_length(t)
    return F.when(F.char_length(t) == 0, 0.0).otherwise(_share_sum(t, size, lambda p: -p * F.log2(p)))


def renyi(text: ColumnLike, alpha: float = 2.0) -> Column:
    """Renyi entropy; alpha 1 is its limit, Shannon's."""
    if alpha == 1:
        return shannon(text, by_bytes=False)
    t = _c(text)
    return F.when(F.char_length(t) == 0, 0.0).otherwise(F.log2(_share_sum(t, F.char_length(t), lambda p: F.pow(p, F.lit(alpha)))) / (1 - alpha))


def min_entropy(text: ColumnLike) -> Column:
    t = _c(text)
    most = F.array_max(F.transform(F.array_distinct(characters(t)), lambda c: F.char_length(t) - F.char_length(F.replace(t, c))))
    return F.when(F.char_length(t) == 0, 0.0).otherwise(-F.log2(most / F.char_length(t)))


def entropy(text: ColumnLike, kind: str = "shannon", alpha: float = 2.0) -> Column:
    """By name; an unknown name is Shannon."""
    return {"renyi": lambda: renyi(text, alpha), "min": lambda: min_entropy(text)}.get(kind, lambda: shannon(text, by_bytes=False))()


def redact(secret: ColumnLike) -> Column:
    """Up to six characters are hidden; longer values show at most four, and never the last two."""
    s = _c(secret)
    n = F.char_length(s)
    shown = F.least(F.lit(4), n - 2)
    return F.when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(s, F.lit(1), shown), F.repeat(F.lit("*"), n - shown)))


def redact_within(context: ColumnLike, secret: ColumnLike) -> Column:
    c, s = _c(context), _c(secret)
    return F.when(F.char_length(s) == 0, c).otherwise(F.replace(c, s, redact(s)))


def redact_all(text: ColumnLike, secrets: ColumnLike) -> Column:
    """Replace every secret of an array, one after the other."""
    return F.aggregate(_c(secrets), _c(text), lambda acc, s: F.when(F.char_length(s) == 0, acc).otherwise(F.replace(acc, s, redact(s))))


def sanitize_log(line: ColumnLike) -> Column:
    """Hide values of secret-like keys, bearer tokens and two well-known token shapes."""
    out = F.regexp_replace(_c(line), r"(?i)(password|secret|token|api[_-]?key)\s*[:=]\s*\S+", "$1=[REDACTED]")
    out = F.regexp_replace(out, r"(?i)bearer\s+[A-Za-z0-9._\-]+", "Bearer [REDACTED]")
    out = F.regexp_replace(out, r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED]")
    return F.regexp_replace(out, r"\bgh[pousr]_[A-Za-z0-9]{36,}\b", "[REDACTED]")


def secret_hash(secret: ColumnLike) -> Column:
    return F.sha2(_c(secret).cast("binary"), 256)


def zero_knowledge(secret: ColumnLike, nonce: ColumnLike) -> Column:
    """(proof, prefix): a salted hash and its first eight digits."""
    proof = F.sha2(F.concat(_c(nonce), _c(secret)).cast("binary"), 256)
    return F.struct(proof.alias("proof"), F.substring(proof, 1, 8).alias("prefix"))


def version_at_least(version: ColumnLike, least: str) -> Column:
    """Dotted numbers compared part by part; missing and unreadable parts are 0."""
    want = [int(p) if p.isdigit() else 0 for p in least.split(".")]
    parts = F.split(_c(version), r"\.")
    number = lambda k: F.coalesce(F.get(parts, F.lit(k)).try_cast("int"), F.lit(0))
    out = F.lit(True)
    for k in reversed(range(max(3, len(want)))):
        w = want[k] if k < len(want) else 0
        out = F.when(number(k) > w, True).when(number(k) < w, False).otherwise(out)
    return out


def is_cron(expression: ColumnLike) -> Column:
    """Five fields."""
    return F.size(F.split(F.trim(_c(expression)), r"\s+")) == 5


def _chain(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_csv(text: ColumnLike) -> Column:
    t = _c(text)
    return F.when(t.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def escape_xml(text: ColumnLike) -> Column:
    return _chain(_c(text), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")])


def escape_html(text: ColumnLike) -> Column:
    return _chain(_c(text), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")])


def escape_markdown(text: ColumnLike) -> Column:
    return _chain(_c(text), [("|", "\\|"), ("\n", " ")])


def escape_json(text: ColumnLike) -> Column:
    return _chain(_c(text), [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")])


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored regex; `**` crosses folders, `*` does too, as full paths are matched."""
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern.replace("**", "*"))
    return f"(?s)^{out}$"


def extension(path: ColumnLike) -> Column:
    """Lower-case extension of the last component, empty for none; a leading dot starts no extension."""
    return F.lower(F.regexp_extract(basename(path), r"^.+\.([^.]*)$", 1))


def basename(path: ColumnLike) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def strip_utf8(text: ColumnLike) -> Column:
    """Bytes decoded as UTF-8 with replacement characters."""
    return F.decode(_c(text), "UTF-8")
