"""Near-duplicate detection by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its
smallest and its largest image, so a signature of 288 values costs 144 hash
evaluations a shingle. Six values make a band, 48 bands a signature: a pair
with similarity 0.75 shares no band with probability (1 - 0.75^6)^48 < 1e-4,
and pairs under 0.3 almost never meet.

Texts with the same set collapse to one class first, which a number of its own
names, not an id: ids may repeat over different texts. In a bucket (classes
with one band in common) every class is compared with the bucket's leader, its
smallest class, only, which is linear in the bucket, and verified links merge
classes into components. Buckets that still hold several components are
compared in full. Small ones are cut into blocks of bounded size, and each
pair of blocks weighs its members' one-byte sketches of the signature; pairs of
different components whose estimate reaches 0.1 (four standard errors) under
the threshold are weighed again by the LEAST smallest shingles of both, which
are the whole sets of most texts and give the others' similarity with an error
of 0.02; what may link goes on. In the others, where pairs of blocks would grow with the
square of the bucket, classes meet over the rarest shingles of their sets: a
pair that links must share one of the first |set| - ceil(0.75 |set|) + 1 of
either in any common order, so a join on those loses nothing; a shingle that
many classes have among their rarest is again a bucket with a leader, and only
what its leader leaves apart is paired. Every link is confirmed on the full
shingle sets.

Defined cases: null, empty and blank texts have no shingles and link with
nothing; fewer words than a shingle make the whole sequence one shingle;
repeated rows share their set and so a component; rows that share an id are
documents of their own, and a component is named by the smallest id among its
rows; rows whose id is null get a null component and are kept; no rows give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, id_text, numbered, release, stored
from .shingles import mix64, shingle_sets

BANDS, ROWS = 48, 6
#: Members of a block; two blocks meet in one group of at most twice as many rows.
BLOCK = 256
#: Members up to which a split bucket is compared by blocks; a larger one is joined on rare shingles.
BY_BLOCKS = 2_048
#: How far under the threshold a sketch's estimate may fall, in parts of the whole.
SLACK = 0.1
#: Smallest shingles of a set that a block holds, and how far under the threshold they may say of larger sets.
LEAST, LEAST_SLACK = 512, 0.08
#: Bytes of text that one vectorised step takes.
STEP_BYTES = 1 << 20


def _steps(texts: Sequence[bytes] | Sequence[int], most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts (or sizes) of at most `most` bytes, or of one text."""
    at = size = 0
    for k, t in enumerate(texts):
        n = t if isinstance(t, int) else len(t)
        if k > at and size + n > most:
            yield at, k
            at, size = k, 0
        size += n
    if len(texts):
        yield at, len(texts)


def encode(series: pd.Series) -> list[bytes]:
    return [t.encode() if isinstance(t, str) else b"" for t in series.tolist()]


def signatures(hashes: np.ndarray, counts: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and one byte of every signature value, one row for each text that has shingles."""
    starts = (np.cumsum(counts) - counts)[counts > 0]
    values = bands * rows
    rng = np.random.default_rng(20_240_607)
    multipliers = rng.integers(1, 1 << 63, size=(values + 1) // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    keys = np.zeros((len(starts), bands), dtype=np.uint64)
    sketch = np.zeros((len(starts), values), dtype=np.uint8)
    image = np.empty(len(hashes), dtype=np.uint64)
    spare = np.empty(len(hashes), dtype=np.uint64)
    for p, m in enumerate(multipliers):
        np.multiply(hashes, m, out=image)
        np.right_shift(image, np.uint64(29), out=spare)
        np.bitwise_xor(image, spare, out=image)
        np.multiply(image, np.uint64(0x9FB21C651E98DF25), out=image)
        for k, extreme in ((2 * p, np.minimum), (2 * p + 1, np.maximum)):
            if k < values:
                band = k // rows
                value = mix64(extreme.reduceat(image, starts))
                sketch[:, k] = value & np.uint64(255)
                keys[:, band] = mix64(keys[:, band] + value + np.uint64(band + 1))
    return keys, sketch


def profile(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """One row a text of docs (row, id, text): row, id, n_shingles, a 128-bit fingerprint of the set, the band keys and the sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = encode(pdf["text"])
            for a, b in _steps(texts):
                hashes, counts = shingle_sets(texts[a:b], shingle)
                full = counts > 0
                starts = (np.cumsum(counts) - counts)[full]
                lo = np.zeros(b - a, dtype=np.uint64)
                hi = np.zeros(b - a, dtype=np.uint64)
                out, sketches = [None] * (b - a), [None] * (b - a)
                if len(starts):
                    lo[full] = np.add.reduceat(mix64(hashes), starts)
                    hi[full] = np.add.reduceat(mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    keys, sketch = signatures(hashes, counts, bands, rows)
                    for k, row, own in zip(np.flatnonzero(full), keys.view(np.int64), sketch, strict=True):
                        out[k], sketches[k] = row, own.tobytes()
                own = {c: pdf[c].iloc[a:b].array for c in ("row", "id")}
                yield pd.DataFrame({**own, "n_shingles": counts, "lo": lo.view(np.int64), "hi": hi.view(np.int64), "bands": out, "sketch": sketches})

    found = docs.select("row", "id", "text").mapInPandas(run, "row long, id string, n_shingles long, lo long, hi long, bands array<long>, sketch binary")
    return found.withColumn("id", F.col("id").cast("long"))


def linked(pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b, a_text, b_text) whose full sets reach the similarity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            left, right = encode(pdf["a_text"]), encode(pdf["b_text"])
            keep = np.zeros(len(pdf), dtype=bool)
            both = [x for pair in zip(left, right, strict=True) for x in pair]
            for a, b in _steps([len(x) + len(y) for x, y in zip(left, right, strict=True)]):
                hashes, counts = shingle_sets(both[2 * a : 2 * b], shingle)
                ends = np.cumsum(counts)
                for k in range(b - a):
                    x = hashes[ends[2 * k] - counts[2 * k] : ends[2 * k]]
                    y = hashes[ends[2 * k + 1] - counts[2 * k + 1] : ends[2 * k + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[a + k] = common > 0 and 100 * common >= percent * (len(x) + len(y) - common)
            yield pdf.loc[keep, ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Attach both texts to the candidate pairs and keep those that link."""
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    return linked(pairs.join(b, "b").join(a, "a"), shingle, percent)


def smallest(texts: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, least): the LEAST smallest shingles of the given texts (id, text), their upper halves in order, four bytes each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = encode(pdf["text"])
            for a, b in _steps(raw):
                hashes, counts = shingle_sets(raw[a:b], shingle)
                ends = np.cumsum(counts)
                own = [(hashes[e - n : e - n + min(n, LEAST)] >> np.uint64(32)).astype("<u4").tobytes() for e, n in zip(ends, counts, strict=True)]
                yield pd.DataFrame({"id": pdf["id"].iloc[a:b].to_numpy(), "least": own})

    return texts.join(ids, "id", "left_semi").select("id", "text").mapInPandas(run, "id long, least binary")


def may_link(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets may reach the similarity, by their smallest shingles; one shingle's room for equal halves."""
    both = np.intersect1d(x, y)
    if len(x) < LEAST and len(y) < LEAST:
        return 100 * (len(both) + 1) >= percent * (len(x) + len(y) - len(both) - 1)
    every = np.union1d(x, y)[:LEAST]
    return np.searchsorted(both, every[-1], side="right") >= (percent / 100 - LEAST_SLACK) * len(every)


def likely(state: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that may link.

    state: bucket, band, n (members), id, component, bands, sketch, least. A bucket's
    members are dealt over blocks of about BLOCK, and each pair of blocks is one
    group, so no group grows with its bucket. Texts that share several bands
    are paired in the first one only.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    placed = state.withColumn("blocks", blocks).withColumn("own", own)
    met = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "band", "id", "component", "bands", "sketch", "least")
    least = percent / 100 - SLACK

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["own"] == i], pdf[pdf["own"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        x = np.frombuffer(b"".join(left["sketch"]), dtype=np.uint8).reshape(len(left), -1)
        y = np.frombuffer(b"".join(right["sketch"]), dtype=np.uint8).reshape(len(right), -1)
        ids, comps = right["id"].to_numpy(), right["component"].to_numpy()
        few, others = ([np.frombuffer(v, dtype="<u4") for v in side["least"]] for side in (left, right))
        band, mine, theirs = pdf["band"].iloc[0], np.stack(left["bands"].tolist()), np.stack(right["bands"].tolist())
        found = []
        for row, keys, one, comp, own in zip(x, mine, left["id"], left["component"], few, strict=True):
            same = (y == row).mean(axis=1)
            good = ((same - 1 / 256) / (1 - 1 / 256) >= least) & (comps != comp)
            if i == j:
                good &= ids > one
            k = np.flatnonzero(good)
            k = k[(theirs[k, :band] != keys[:band]).all(axis=1)]
            found += [(min(one, ids[o]), max(one, ids[o])) for o in k if may_link(own, others[o], percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return met.groupBy("bucket", "i", "j").applyInPandas(run, "a long, b long").distinct()


def rare_lists(state: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(h, id): the classes of state (id) that have each shingle among their rarest, where several do; texts: (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = encode(pdf["text"])
            for a, b in _steps(raw):
                hashes, counts = shingle_sets(raw[a:b], shingle)
                yield pd.DataFrame({"id": np.repeat(pdf["id"].iloc[a:b].to_numpy(), counts), "size": np.repeat(counts, counts), "h": hashes.view(np.int64)})

    sets = stored(texts.join(state.select("id").distinct(), "id").select("id", "text").mapInPandas(run, "id long, size long, h long"), "shingles")
    # a shingle of one class only pairs nothing, but has its place in the order
    often = sets.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = sets.join(often, "h", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    order = F.row_number().over(Window.partitionBy("id").orderBy("n", "h"))
    first = ranked.withColumn("place", order).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1).where("n > 1")
    lists = stored(first.select("h", "id"), "lists")
    release(sets)
    return lists


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (id, ...) with the component of each id."""
    return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def split_lists(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Stored (h, id, component, leader) of the lists that still hold several components."""
    known = stored(labelled(lists, labels), "known")
    both = known.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("leader")).where("low <> high").select("h", "leader")
    return stored(known.join(both, "h"), "split")


def close(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches agree enough."""
    least = percent / 100 - SLACK

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = (np.frombuffer(b"".join(pdf[c]), dtype=np.uint8).reshape(len(pdf), -1) for c in ("x", "y"))
            same = (x == y).mean(axis=1) if len(pdf) else np.zeros(0)
            yield pdf.loc[(same - 1 / 256) / (1 - 1 / 256) >= least, ["a", "b"]]

    x, y = (reps.select(F.col("id").alias(i), F.col("sketch").alias(c)) for i, c in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").mapInPandas(run, "a long, b long")


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, component) for every id that is not its component's smallest; edges are (a, b).

    Rounds of hooking (every id to its smallest neighbour), pointer jumping
    and contraction, each a join or a partial aggregate, so a component of any
    size stays spread out. known: labels of edges handled before.
    """

    def mapped(pairs: DataFrame, to: DataFrame) -> DataFrame:
        for side in ("u", "v"):
            pairs = pairs.join(to.select(F.col("id").alias(side), "component"), side, "left").withColumn(side, F.coalesce("component", side)).drop("component")
        return pairs

    left = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    left = mapped(left, known) if known is not None else left
    labels = known
    while True:
        left = stored(left.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        if left.isEmpty():
            return labels if labels is not None else left.select(F.col("u").alias("id"), F.col("v").alias("component"))
        parent = bounded(left.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id"), "parents")
        while True:
            above = parent.select(F.col("id").alias("component"), F.col("component").alias("top"))
            parent = bounded(parent.join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component"), F.col("top").isNotNull().alias("moved")), "parents")
            moved = not parent.where("moved").isEmpty()
            parent = parent.select("id", "component")
            if not moved:
                break
        if labels is not None:
            above = parent.select(F.col("id").alias("component"), F.col("component").alias("top"))
            older = labels.join(above, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
            labels = bounded(older.unionByName(parent), "labels")
        else:
            labels = parent
        left = mapped(left, parent)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS, row_col: str | None = None
) -> DataFrame:
    """One row a document: id, n_shingles, component (smallest id reachable over links), kept; row and key say which row and class it is."""
    key = ["n_shingles", "lo", "hi"]
    columns = {"id": id_text(id_col), "text": F.col(text_col).cast("string")}
    source = docs.select(F.col(row_col).alias("row"), *(c.alias(name) for name, c in columns.items())) if row_col else numbered(docs, **columns)
    sets = stored(profile(source, shingle, bands, rows), "sets")
    full = sets.where("n_shingles > 0 and id is not null")
    classes = full.groupBy(*key).agg(F.min(F.struct("id", "row")).alias("first"))
    classes = bounded(classes.select(*key, F.monotonically_increasing_id().alias("class"), F.col("first.id").alias("rep"), F.col("first.row").alias("row")), "classes")
    own = classes.select("row", F.col("class").alias("id"))
    reps = stored(full.join(own.withColumnRenamed("id", "class"), "row").select(F.col("class").alias("id"), "bands", "sketch"), "reps")
    banded = reps.select("id", F.posexplode("bands").alias("band", "hash")).select("id", "band", F.xxhash64("band", "hash").alias("bucket"))
    shared = stored(banded.groupBy("bucket").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    members = stored(banded.join(shared, "bucket"), "members")
    release(shared)
    inside = bounded(members.select("id").distinct().join(own, "id"), "inside")
    texts = stored(source.select("row", "text").join(inside, "row").select("id", "text"), "texts")
    release(source)  # a caller's table, where it gave rows, stays

    pairs = members.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(verify(pairs, texts, shingle, percent), "links")
    labels = components(links)
    state = members.join(labels, "id", "left").select("bucket", "band", "n", "id", F.coalesce("component", "id").alias("component"))
    state = stored(state, "state")
    split = bounded(state.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket"), "split")
    state = state.join(split, "bucket", "left_semi")
    few = state.where(F.col("n") <= BY_BLOCKS)
    least = stored(smallest(texts, few.select("id").distinct(), shingle), "least")
    more = stored(likely(few.join(reps, "id").join(least, "id"), percent), "likely")
    labels = components(stored(verify(more, texts, shingle, percent), "links"), labels)
    large = state.where(F.col("n") > BY_BLOCKS)
    if not large.isEmpty():
        lists = rare_lists(large, texts, shingle, percent)
        apart = split_lists(lists, labels)
        led = apart.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
        labels = components(stored(verify(close(led, reps, percent), texts, shingle, percent), "links"), labels)
        apart = split_lists(lists, labels)
        across = (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
        rest = apart.alias("x").join(apart.alias("y"), across).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
        labels = components(stored(verify(stored(close(rest, reps, percent), "likely"), texts, shingle, percent), "links"), labels)
    release(members, texts, reps, least)

    known = labelled(classes.withColumnRenamed("class", "id"), labels)
    named = known.groupBy("component").agg(F.min("rep").alias("name"))
    of_class = bounded(known.join(named, "component").select(*key, F.col("component").alias("class"), F.col("name").alias("component")), "of_class")
    found = sets.where("n_shingles > 0").join(of_class, key, "left").select("row", "id", "n_shingles", "class", "component")
    empty = sets.where("n_shingles = 0").select("row", "id", "n_shingles", F.lit(None).cast("long").alias("class"), F.col("id").alias("component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    result = found.unionByName(empty).select("row", "id", "n_shingles", F.when(F.col("id").isNotNull(), F.col("class")).alias("class"), component.alias("component"))
    return result.withColumn("kept", F.coalesce(F.col("component") == F.col("id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those that a group's first one, by id and then by row, stands for.

    Rows without shingles or id all stay. Rows are numbered once, in a stored
    copy, and dropped from that copy by the stored number.
    """
    number = "row"
    while number in map(str.lower, docs.columns):
        number += "_"
    kept = stored(docs.withColumn(number, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(kept, id_col, row_col=number, **options).where("class is not null").select("row", "id", "class")
    found = stored(found, "found")
    first = found.groupBy("class").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = bounded(first.select("class", F.col("first.row").alias("keep")), "firsts")
    gone = bounded(found.join(first, "class").where("row <> keep").select(F.col("row").alias(number)), "gone")
    return kept.join(gone, number, "left_anti").select(*docs.columns)
