"""Repeated substrings by prefix-free parsing.

A rolling hash over TRIGGER bytes places triggers: the trigger of a window of
`span` bytes is the smallest hash in its first half, leftmost on ties, so it
depends on the window's bytes alone. Starts that share a trigger form a phrase,
and a phrase reaches at most `reach` bytes.

A suffix of the corpus is a suffix of a phrase followed by the parse after it.
As only suffixes that agree on `span` bytes matter, corpus order is needed to
that depth only: the dictionary holds each distinct phrase extended by `span`
bytes of parse, once, with its count, and suffixes are named by 128-bit
fingerprints of phrase suffix plus parse. Equal names are the neighbours that
the dictionary's and the parse's suffix arrays would place side by side with an
LCP of `span`; no sort or rank of the whole corpus is made. All starts of an
extended phrase that occurs twice repeat. What occurs once is compared with the
other dictionary entries of its trigger: first blocks of STEP suffixes, by the
bytes that all of them have in common (none repeats if those don't) and by the
bytes of all together (all repeat if those do), then single suffixes.

Rows are spread by fingerprints and pre-aggregated, so a passage in any share
of the documents is one row a task. A fixed-size bitmap of repeated trigger
contexts keeps most of the text's parse out of the second scan's output; where
it fills up, more rows go on, and none is lost.

Rows are numbered once, in a stored copy of the texts that all scans read, so
that a name stands for the same row however a scan is split or repeated.

Defined cases: null counts as empty; texts under `span` bytes lose nothing;
matches never cross documents; equal and repeated rows each lose what they
share; ids may be null or repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_text, numbered, release, stored
from .minmax_dedup import _steps, encode
from .shingles import mix64

TRIGGER = 16
STEP = 16
#: Starts of a text that one vectorised step takes.
PIECE = 1 << 17
#: Bits of the bitmap of repeated contexts.
BITMAP = 1 << 26
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept between batches."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            step = np.full(max(n, 3 * PIECE), b, dtype=np.uint64)
            step[0] = 1
            out.append(np.cumprod(step))
        _POWERS[base] = out[0], out[1]
    return _POWERS[base]


class Prints:
    """Fingerprints of byte ranges of a buffer, by either of two bases."""

    def __init__(self, buf: np.ndarray):
        self.plain = buf.astype(np.uint64) + np.uint64(1)
        self.totals: dict[int, np.ndarray] = {}

    def table(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = _powers(_BASES[which], len(self.plain) + 1)
        if which not in self.totals:
            total = np.zeros(len(self.plain) + 1, dtype=np.uint64)
            np.cumsum(self.plain * power[: len(self.plain)], out=total[1:])
            self.totals[which] = total
        return self.totals[which], inverse

    def of(self, start: np.ndarray, end: np.ndarray, which: int = 0, salt: np.ndarray | int = 0) -> np.ndarray:
        total, inverse = self.table(which)
        raw = (total[end] - total[start]) * inverse[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.asarray(salt, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def place(uid: np.ndarray, at: np.ndarray | int = 0) -> np.ndarray:
    """A hash of a position in a document, or of the document."""
    return mix64(uid.astype(np.uint64) * np.uint64(_BASES[1]) + np.asarray(at).astype(np.uint64))


def parse(texts: list[bytes], span: int) -> tuple[Prints, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of a batch: fingerprints, offsets of texts, and for each phrase its text, first start, last start and trigger."""
    lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.cumsum(lengths) - lengths
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, dtype=np.int64)
    wide = span // 2 - TRIGGER + 1
    prints = Prints(buf)
    if not (lengths >= span).any():
        return prints, offsets, none, none, none, none
    total, inverse = prints.table(0)
    grams = len(buf) - TRIGGER + 1
    gram = mix64((total[TRIGGER:] - total[:-TRIGGER]) * inverse[:grams])
    key = (gram & ~np.uint64((1 << 31) - 1)) | np.arange(grams, dtype=np.uint64)
    low, have = key, 1
    while have * 2 <= wide:
        low, have = np.minimum(low[: len(low) - have], low[have:]), have * 2
    if have < wide:
        low = np.minimum(low[: len(low) - (wide - have)], low[wide - have :])
    trigger = (low & np.uint64((1 << 31) - 1)).astype(np.int64)
    starts = np.zeros(len(buf) + 1, dtype=np.int8)
    long = np.flatnonzero(lengths >= span)
    np.add.at(starts, offsets[long], 1)
    np.add.at(starts, offsets[long] + lengths[long] - span + 1, -1)
    valid = np.flatnonzero(np.cumsum(starts)[:-1] > 0)
    owner = np.searchsorted(offsets, valid, side="right") - 1
    t = trigger[valid]
    new = np.ones(len(valid), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    return prints, offsets, owner[first], valid[first], valid[last], t[first]


def _pieces(texts: list[bytes], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Batches of pieces, whose starts together are the texts' starts: text of each piece, its offset, its bytes."""
    cut = [(k, at, t[at : at + PIECE + span - 1]) for k, t in enumerate(texts) for at in range(0, max(1, len(t) - span + 1), PIECE) if len(t) >= span]
    for a, b in _steps([x[2] for x in cut], 2 * PIECE):
        yield np.array([x[0] for x in cut[a:b]], dtype=np.int64), np.array([x[1] for x in cut[a:b]], dtype=np.int64), [x[2] for x in cut[a:b]]


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether both bits of each hash are set in a bitmap."""
    out = np.ones(len(h), dtype=bool)
    for bit in (h % np.uint64(BITMAP), (h >> np.uint64(32)) % np.uint64(BITMAP)):
        out &= (bits[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32) & 1).astype(bool)
    return out


def _parsed(pdf: pd.DataFrame, span: int, wanted: np.ndarray | None = None) -> Iterator[tuple[Prints, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Phrases of a batch's (wanted) documents: fingerprints, uid, where its text starts in the buffer, a, b, t."""
    uids, texts = pdf["uid"].to_numpy(), encode(pdf["text"])
    if wanted is not None:
        texts = [t if k else b"" for t, k in zip(texts, _has(wanted, place(uids)), strict=True)]
    for whose, base, pieces in _pieces(texts, span):
        prints, offsets, owner, a, b, t = parse(pieces, span)
        if len(t):
            yield prints, uids[whose[owner]], offsets[owner] - base[owner], a, b, t


def _blocks(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phrases cut into blocks by distance from the trigger: phrase, block number, first and last start."""
    near, far = (t - b) // STEP, (t - a) // STEP
    n = far - near + 1
    k = np.repeat(np.arange(len(t)), n)
    j = near[k] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return k, j, np.maximum(a[k], t[k] - j * STEP - STEP + 1), np.minimum(b[k], t[k] - j * STEP)


def contexts(docs: DataFrame, span: int) -> DataFrame:
    """Fingerprint of what follows each trigger, as far as every window of it reaches."""
    ahead = span - (span // 2 - TRIGGER)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for prints, _, _, _, _, t in _parsed(pdf, span):
                yield pd.DataFrame({"h": prints.of(t, t + ahead).view(np.int64)})

    return docs.mapInPandas(run, "h long")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Two bits a hash, in a map of fixed size that reaches the driver as pages of 32,768 bits."""
    bits = hashes.select(F.explode(F.array(F.pmod("h", F.lit(BITMAP)), F.pmod(F.shiftrightunsigned("h", 32), F.lit(BITMAP)))).alias("bit"))
    placed = bits.select(F.bitmap_bucket_number(F.col("bit") + 1).alias("page"), F.bitmap_bit_position(F.col("bit") + 1).alias("at"))
    pages = placed.repartition("page").groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(BITMAP // 32, dtype="<u4")
    for row in pages.toLocalIterator():
        out[(row["page"] - 1) * 1024 : row["page"] * 1024] = np.frombuffer(bytes(row["bits"]), dtype="<u4")
    return out


def phrases(docs: DataFrame, span: int, known: np.ndarray) -> DataFrame:
    """Extended phrases whose trigger's context may repeat: uid, a, b (starts), h, x, y (name), d, e (places)."""
    ahead = span - (span // 2 - TRIGGER)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for prints, uid, at, a, b, t in _parsed(pdf, span):
                h = prints.of(t, t + ahead)
                ok = _has(shared.value, h)
                uid, at, a, b, t, h = (v[ok] for v in (uid, at, a, b, t, h))
                salt = (t - a) * 1024 + (t - b)
                x, y = (prints.of(a, b + span, k, salt).view(np.int64) for k in (0, 1))
                yield pd.DataFrame({"uid": uid, "a": a - at, "b": b - at, "h": h.view(np.int64), "x": x, "y": y})

    return docs.mapInPandas(run, "uid long, a int, b int, h long, x long, y long")


def places(rows: DataFrame, at: str) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the documents and of the positions (uid, at) that rows name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            uid = pdf["uid"].to_numpy()
            yield pd.DataFrame({"d": place(uid).view(np.int64), "h": place(uid, pdf[at].to_numpy()).view(np.int64)})

    hashed = stored(rows.select("uid", at).mapInPandas(run, "d long, h long"), "places")
    return bitmap(hashed.select(F.col("d").alias("h")).distinct()), bitmap(hashed.select("h"))


def blocks(docs: DataFrame, entries: DataFrame, span: int) -> DataFrame:
    """Blocks of up to STEP suffixes of dictionary entries (uid, a, single): common bytes' name (j, c), all bytes' name (u, v).

    The documents are scanned again with a bitmap of the entries; a join on
    (uid, a) then leaves exactly theirs, so no text is shuffled.
    """
    context = docs.sparkSession.sparkContext
    wanted, phrase = map(context.broadcast, places(entries, "a"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for prints, uid, at, a, b, t in _parsed(pdf, span, wanted.value):
                ok = _has(phrase.value, place(uid, a - at))
                uid, at, a, b, t = (v[ok] for v in (uid, at, a, b, t))
                k, j, first, last = _blocks(a, b, t)
                common = t[k] - j * STEP
                c = prints.of(common, common - STEP + 1 + span, 0, j).view(np.int64)
                salt = (t[k] - first) * 1024 + (t[k] - last)
                u, v = (prints.of(first, last + span, w, salt).view(np.int64) for w in (0, 1))
                yield pd.DataFrame({"uid": uid[k], "a": (a - at)[k], "first": first - at[k], "last": last - at[k], "j": j, "c": c, "u": u, "v": v})

    found = docs.mapInPandas(run, "uid long, a int, first int, last int, j int, c long, u long, v long")
    return found.join(entries.select("uid", "a", "single"), ["uid", "a"]).drop("a")


def suffixes(docs: DataFrame, parts: DataFrame, span: int) -> DataFrame:
    """Every suffix of the given blocks (uid, first, wanted): uid, start, name (u, v)."""
    context = docs.sparkSession.sparkContext
    wanted, block = map(context.broadcast, places(parts, "first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for prints, uid, at, a, b, t in _parsed(pdf, span, wanted.value):
                k, _, first, last = _blocks(a, b, t)
                ok = _has(block.value, place(uid[k], first - at[k]))
                k, first, last = k[ok], first[ok], last[ok]
                n = last - first + 1
                m = np.repeat(np.arange(len(n)), n)
                start = first[m] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                u, v = (prints.of(start, start + span, w).view(np.int64) for w in (0, 1))
                shift = at[k][m]
                yield pd.DataFrame({"uid": uid[k][m], "first": first[m] - shift, "start": start - shift, "u": u, "v": v})

    found = docs.mapInPandas(run, "uid long, first int, start int, u long, v long")
    return found.join(parts.select("uid", "first", "wanted"), ["uid", "first"]).drop("first")


def repeated_starts(docs: DataFrame, span: int) -> DataFrame:
    """Runs of starts (uid, first, last) whose span of bytes also starts elsewhere; docs (uid, text) must say the same uids in every scan."""
    again = stored(contexts(docs, span).groupBy("h").count().where("count > 1").select("h"), "contexts")
    found = stored(phrases(docs, span, bitmap(again)), "phrases")
    entry = F.min(F.struct("uid", "a", "h"))
    names = stored(found.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), entry.alias("e")).select("x", "y", "n", "e.*"), "dictionary")
    twice = stored(names.where("n > 1").select("x", "y"), "twice")
    whole = stored(found.join(twice, ["x", "y"], "left_semi").select("uid", F.col("a").alias("first"), F.col("b").alias("last")), "whole")
    release(again, found, twice)

    contested = stored(names.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1").select("h"), "contested")
    entries = names.join(contested, "h", "left_semi").select("uid", "a", (F.col("n") == 1).alias("single"))
    entries = stored(entries, "entries")
    release(names, contested)
    parts = stored(blocks(docs, entries, span), "blocks")
    same_all = stored(parts.groupBy("u", "v").count().where("count > 1").select("u", "v", F.lit(True).alias("all")), "same")
    state = stored(parts.join(same_all, ["u", "v"], "left").withColumn("all", F.coalesce("all", F.lit(False))), "state")
    release(entries, parts, same_all)
    # blocks that are in question, with every other block that has the same bytes in common, one of each name
    keys = state.groupBy("j", "c").agg(F.count(F.lit(1)).alias("k"), F.bool_or(F.col("single") & ~F.col("all")).alias("open")).where("k > 1 and open").select("j", "c")
    open_ = state.join(stored(keys, "open"), ["j", "c"], "left_semi")
    asked = F.bool_or(F.col("single") & ~F.col("all")).alias("wanted")
    open_ = open_.groupBy("u", "v").agg(F.min(F.struct("uid", "first")).alias("e"), asked).select("e.*", "wanted")
    single = stored(suffixes(docs, stored(open_, "open"), span), "suffixes")
    twins = stored(single.groupBy("u", "v").count().where("count > 1").select("u", "v"), "twins")
    alone = single.where("wanted").join(twins, ["u", "v"], "left_semi").select("uid", F.col("start").alias("first"), F.col("start").alias("last"))
    block = state.where("single and `all`").select("uid", "first", "last")
    runs = stored(whole.unionByName(block).unionByName(alone), "runs")
    release(whole, state, single, twins)
    return runs


def marked(rows: DataFrame, some: DataFrame) -> DataFrame:
    """rows with hit: true for every uid that some has, and for few others.

    A bitmap of hashed uids in pages of 32,768 bits, of which BITMAP bits make 8 MB at most, goes to every task.
    """
    bit = F.pmod(F.xxhash64("uid"), F.lit(BITMAP))
    page, at = F.shiftright(bit, 15), F.col("_bit").bitwiseAND(32_767)
    pages = some.select(page.alias("_page"), bit.alias("_bit")).groupBy("_page").agg(F.bitmap_construct_agg(at).alias("_bits"))
    known = rows.withColumn("_page", page).withColumn("_bit", bit).join(F.broadcast(stored(pages, "pages")), "_page", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at.bitwiseAND(7).cast("int"))) != 0
    return known.withColumn("hit", F.coalesce(hit, F.lit(False))).drop("_page", "_bit", "_bits")


def _cut(text: bytes, first: np.ndarray, last: np.ndarray, span: int) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs, and the rest."""
    mark = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(mark, first, 1)
    np.add.at(mark, last + span, -1)
    gone = np.cumsum(mark)[:-1] > 0
    edges = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    return int(gone.sum()), int((edges == 1).sum()), np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 400) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    source = numbered(docs, id=id_text(id_col), text=F.col(text_col).cast("string")).withColumnRenamed("row", "uid")
    runs = repeated_starts(source.select("uid", "text"), span)
    lists = stored(runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("rows")), "lists")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = encode(pdf["text"])
            for p, q in _steps(texts, 4 << 20):
                out = []
                for text, firsts, lasts in zip(texts[p:q], pdf["firsts"].iloc[p:q], pdf["lasts"].iloc[p:q], strict=True):  # the bitmap lets a few by that lose nothing
                    out.append((0, 0, text) if firsts is None else _cut(text, np.asarray(firsts, dtype=np.int64), np.asarray(lasts, dtype=np.int64), span))
                yield pd.DataFrame(
                    {"id": pdf["id"].iloc[p:q].array, "n_bytes": [len(t) for t in texts[p:q]], "n_removed": [o[0] for o in out], "n_spans": [o[1] for o in out], "kept": [o[2] for o in out]}
                )

    # only texts that lose something move to their runs
    source = marked(source, lists)
    some = source.where("hit").join(lists, "uid", "left").select("id", "text", F.col("rows.first").alias("firsts"), F.col("rows.last").alias("lasts"))
    cut = some.mapInPandas(run, "id string, n_bytes long, n_removed long, n_spans long, kept binary")
    whole = F.coalesce("text", F.lit("")).cast("binary")
    none = F.lit(0).cast("long")
    rest = source.where("not hit").select("id", F.octet_length(whole).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), whole.alias("kept"))
    return id_back(cut.unionByName(rest))
