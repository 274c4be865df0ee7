"""Toxicity by maximum-scoring segments.

Token log-odds come from labelled counts under Dirichlet priors that back off:
the prior of a word is the posterior of its six-byte prefix, that prefix's is
its five-byte one's, and so on down to even odds, so a new word of
a known toxic family scores as the family does. A linear scan (Ruzzo and
Tompa) over the scores, less a constant drift, finds every maximal segment.
Under the clean text's score distribution the best segment follows an extreme
value law with lambda from the moment equation and K from the observed maxima;
a segment is significant when its expected number of chance hits is under
EXPECTED. The sum of the significant segments' nats over chance goes through a
logistic curve fitted on the training documents.

Learning reads a bounded sample of labelled documents, SAMPLE_DOCS at most by a
hash of the text, whole; equal texts count once. Scoring reads every whole text.

Defined cases: null, empty and tokenless texts have no segment and get the
curve's value at nothing found; a training set without either class scores
every text with the base rate (0 without labels); repeated rows are scored
alike; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, id_back, id_text

SAMPLE_DOCS = 6_000
STRENGTH = 4.0
DRIFT = 1.0
EXPECTED = 0.05
#: Features nearer to zero only add to the drift.
LEAST_ODDS = 0.5
#: Toxic documents (or distinct words, for a family) that make evidence.
LEAST_COUNT = 2
#: K is under 1 for independent words; clean texts that repeat themselves have higher maxima, which the fit must follow.
MOST_K = 1e6

_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def chain(word: bytes) -> list[bytes]:
    """The features of a word, general to special."""
    return [b"^" + word[:n] for n in (4, 5, 6) if len(word) > n] + [word]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in linear time."""
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    before = np.concatenate([[0.0], np.cumsum(scores)])
    # each entry: start, end, cumulative score before it, cumulative score after it
    found: list[tuple[int, int, float, float]] = []
    for k in hits.tolist():
        start, low, high = k, float(before[k]), float(before[k + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j -= 1
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
        found.append((start, k + 1, low, high))
    return [(a, b, high - low) for a, b, low, high in found]


class Scores(dict):
    """Word to score, filled as words come and emptied when it grows too large."""

    def __init__(self, odds: dict[bytes, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: bytes) -> float:
        value = 0.0
        for feature in reversed(chain(word)):
            if feature in self.odds:
                value = self.odds[feature]
                break
        if len(self) > 100_000:
            self.clear()
        self[word] = value - DRIFT
        return value - DRIFT


class Model:
    """Fitted log-odds, extreme-value parameters and calibration."""

    def __init__(self, odds: dict[bytes, float], lam: float, k: float, slope: float, base: float):
        self.odds, self.lam, self.k, self.slope, self.base = odds, lam, k, slope, base
        self.scores: Scores | None = None

    def __getstate__(self):
        return self.__dict__ | {"scores": None}

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant segments (first token, end, nats over chance)."""
        if self.scores is None:
            self.scores = Scores(self.odds)
        words = tokens(text)
        if not words or not self.odds:
            return []
        scores = np.fromiter(map(self.scores.__getitem__, words), dtype=np.float64, count=len(words))
        chance = math.log(max(self.k * len(words), 1e-9))
        over = [(a, b, self.lam * s - chance) for a, b, s in segments(scores)]
        return [x for x in over if x[2] >= -math.log(EXPECTED)]

    def score(self, text: str | None) -> tuple[float, int]:
        found = self.passages(text)
        x = self.base + self.slope * math.log1p(sum(n for _, _, n in found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x)))), len(found)


def log_odds(docs: list[tuple[list[bytes], int]]) -> dict[bytes, float]:
    """Posterior log-odds of words and prefix families; what is not listed has none."""
    toxic, clean = Counter(), Counter()
    for words, y in docs:  # a document counts a word once, however often it says it
        (toxic if y else clean).update(set(words))
    # a prefix counts the distinct words of its family, a word its documents, so no evidence enters twice;
    # a feature that no toxic document has can say nothing toxic, so only theirs are counted
    a: Counter = Counter()
    for word, c in toxic.items():
        *families, own = chain(word)
        a.update(families)
        a[own] += c
    b: Counter = Counter()
    for word, c in clean.items():
        for feature in chain(word):
            if feature in a:
                b[feature] += 1 if feature[:1] == b"^" else c
    scale = (sum(toxic.values()) + 1) / (sum(clean.values()) + 1)  # both classes as if they had as many tokens
    types = (len(toxic) + 1) / (len(clean) + 1)

    def follow(word: bytes, own: float) -> Iterator[tuple[bytes, float]]:
        theta = 0.5
        for feature in chain(word):
            whole = feature[:1] != b"^"
            yt, yc = a[feature], (own if whole else b[feature]) * (scale if whole else types)
            if yt >= LEAST_COUNT or yc:
                theta = (yt + STRENGTH * theta) / (yt + yc + STRENGTH)
            yield feature, math.log(theta / (1 - theta))

    odds: dict[bytes, float] = {}
    for word in toxic:
        odds.update(follow(word, clean[word]))
    strong = {f: v for f, v in odds.items() if v >= LEAST_ODDS}
    # a word's own low odds must hide its family's high ones
    for words in (toxic, clean):
        for word in words:
            if word not in strong and any(f in strong for f in chain(word)[:-1]):
                *_, (_, value) = follow(word, clean[word])
                strong[word] = value if value >= LEAST_ODDS else 0.0
    return strong


def fit(rows: list[tuple[str, int]]) -> Model:
    """Odds from all rows; chance law and calibration from rows whose half the odds have not seen."""
    same: dict[bytes, bytes] = {}
    docs = [([same.setdefault(w, w) for w in tokens(t)], y) for t, y in rows]
    n = sum(y for _, y in docs)
    prior = (n + 0.5) / (len(docs) + 1) if docs else 0.0
    if not n or n == len(docs):
        return Model({}, 1.0, 1.0, 0.0, math.log(prior / (1 - prior)) if 0 < prior < 1 else -30.0)
    seen = [0, 0]
    half = np.zeros(len(docs), dtype=int)  # every other document of each class
    for k, (_, y) in enumerate(docs):
        half[k] = seen[y] % 2
        seen[y] += 1
    halves = [Scores(log_odds([d for d, own in zip(docs, half, strict=True) if own != k])) for k in (0, 1)]
    values, best = Counter(), []
    for k, (words, y) in enumerate(docs):
        if not y and words:
            s = np.fromiter(map(halves[half[k]].__getitem__, words), dtype=np.float64, count=len(words))
            values.update(np.round(s, 2).tolist())
            best.append((len(words), max((x[2] for x in segments(s)), default=0.0)))
    x = np.array(list(values), dtype=float)
    p = np.array(list(values.values()), dtype=float) / max(1, sum(values.values()))
    lam = 1.0
    if len(x) and x.max() > 0 and (p * x).sum() < 0:
        low, high = 1e-3, 20.0
        for _ in range(60):
            lam = (low + high) / 2
            low, high = (lam, high) if (p * np.exp(np.minimum(lam * x, 500))).sum() < 1 else (low, lam)
    mean = [lam * s - math.log(m) for m, s in best]
    k = float(np.clip(math.exp(np.mean(mean) - 0.5772) if mean else 1.0, 1e-4, MOST_K))
    found = np.zeros(len(rows))
    models = [Model(h.odds, lam, k, 0.0, 0.0) for h in halves]
    for at, (text, _) in enumerate(rows):
        found[at] = math.log1p(sum(s for _, _, s in models[half[at]].passages(text)))
    labels = np.array([y for _, y in rows], dtype=float)
    w = np.zeros(2)
    design = np.stack([np.ones(len(found)), found], axis=1)
    for _ in range(50):  # Newton steps of a lightly ridged logistic curve
        q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (q - labels) + 0.01 * w
        w -= np.linalg.solve((design * (q * (1 - q))[:, None]).T @ design + 0.01 * np.eye(2), grad)
    return Model(log_odds(docs), lam, k, float(max(w[1], 0.0)), float(w[0]))


def sampled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most: int) -> list[tuple[str, int]]:
    """At most `most` labelled whole texts, equal ones once, by a hash of the text."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    share = min(1.0, 1.1 * most / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= F.lit(int(share * (1 << 20))))
    drawn = bounded(drawn, "drawn")
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    rows = source.join(drawn, "id").select(F.xxhash64("text").alias("h"), "text", "y")
    rows = rows.groupBy("h").agg(F.first("text").alias("text"), F.max("y").alias("y")).orderBy("h").limit(most)  # the same rows in every run
    return [(r["text"], r["y"]) for r in rows.toLocalIterator()]


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, score, n_passages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [model.score(t if isinstance(t, str) else None) for t in pdf["text"].tolist()]
            yield pd.DataFrame({"id": pdf["id"].array, "score": [s for s, _ in out], "n_passages": [n for _, n in out]})

    return id_back(docs.select(id_text(id_col), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "id string, score double, n_passages long"))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score under the threshold, every column as it was."""

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t if isinstance(t, str) else None)[0] < threshold for t in texts.tolist()], dtype=bool)

    return docs.where(clean(F.col(text_col).cast("string")))
