"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are cut into chunks that overlap by a filter's width
and cover it whole. Learned filters slide over each chunk's byte embeddings;
every filter's largest response is the chunk's feature. The chunks' features
are pooled over the document, by mean and by maximum, and one hidden layer
combines them into one probability. Chunks are pooled as they come, so memory
does not grow with a document.

Learning reads a bounded sample of labelled documents, SAMPLE_DOCS at most by a
hash of the text, and every byte of those; scoring reads every byte of all.

Defined cases: null and empty texts are one chunk of padding and get the
network's value for it; without both classes among the labels every text gets
the smoothed share of label 1; repeated rows are scored alike; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_text

SAMPLE_DOCS = 4_000
CHUNK, WIDTH, STRIDE = 512, 8, 2
EMBED, FILTERS, HIDDEN = 6, 24, 16
EPOCHS, BATCH, RATE = 8, 64, 0.01
PAD = 256
#: Chunks that one vectorised step takes.
STEP = 512


def chunks_of(text: str | None) -> np.ndarray:
    """(chunks, CHUNK + WIDTH) byte codes; chunk k starts at k * CHUNK and overlaps the next one by WIDTH."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8) if text else np.zeros(0, np.uint8)
    n = max(1, -(-len(raw) // CHUNK))
    flat = np.full(n * CHUNK + WIDTH, PAD, dtype=np.int16)
    flat[: len(raw)] = raw
    return np.lib.stride_tricks.as_strided(flat, (n, CHUNK + WIDTH), (CHUNK * 2, 2))


class Network:
    """The network's parameters, its passes and its training."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "embed": (rng.standard_normal((PAD + 1, EMBED)) * 0.5).astype(np.float32),
            "filters": draw(WIDTH * EMBED, FILTERS),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": draw(2 * FILTERS, HIDDEN),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN, 1),
            "out_bias": np.zeros(1, np.float32),
        }
        self.share: float | None = None

    def convolve(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each filter's largest response in each chunk, where it was, and the windows."""
        e = self.p["embed"][chunks]
        n, positions = len(chunks), CHUNK // STRIDE
        s = e.strides
        windows = np.lib.stride_tricks.as_strided(e, (n, positions, WIDTH * EMBED), (s[0], s[1] * STRIDE, s[2]))
        z = windows.reshape(n * positions, -1) @ self.p["filters"]
        z = z.reshape(n, positions, FILTERS)
        return np.maximum(z.max(axis=1) + self.p["bias"], 0), z, windows

    def combine(self, mean: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.concatenate([mean, most], axis=1)
        h = np.tanh(x @ self.p["hidden"] + self.p["hidden_bias"])
        return x, h, (h @ self.p["out"] + self.p["out_bias"])[:, 0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 for each whole text."""
        if self.share is not None:
            return np.full(len(texts), self.share)
        total = np.zeros((len(texts), FILTERS), np.float64)
        most = np.zeros((len(texts), FILTERS), np.float32)
        count = np.zeros(len(texts), np.int64)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            if not held:
                return
            owner = np.repeat([k for k, _ in held], [len(c) for _, c in held])
            feats, _, _ = self.convolve(np.concatenate([c for _, c in held]))
            np.add.at(total, owner, feats)
            np.maximum.at(most, owner, feats)
            np.add.at(count, owner, 1)
            held.clear()

        for k, text in enumerate(texts):
            chunks = chunks_of(text)
            for at in range(0, len(chunks), STEP):
                part = chunks[at : at + STEP]
                if size + len(part) > STEP:
                    flush()
                    size = 0
                held.append((k, part))
                size += len(part)
        flush()
        if not len(texts):
            return np.zeros(0)
        _, _, logit = self.combine((total / count[:, None]).astype(np.float32), most)
        return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30)))

    def gradients(self, chunks: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Mean cross-entropy gradients of a batch; owner is the document of each chunk, ascending.

        Only each filter's best place in each chunk has a gradient, so the chunks' responses
        are made STEP chunks at a time and a long document costs no more memory than its bytes.
        """
        parts = [(f, z.argmax(axis=1)) for f, z, _ in (self.convolve(chunks[a : a + STEP]) for a in range(0, len(chunks), STEP))]
        feats, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts = np.searchsorted(owner, np.arange(len(y)))
        counts = np.diff(np.append(starts, len(owner)))
        mean = np.add.reduceat(feats, starts) / counts[:, None]
        most = np.maximum.reduceat(feats, starts)
        x, h, logit = self.combine(mean, most)
        g: dict[str, np.ndarray] = {}
        d = ((1 / (1 + np.exp(-logit)) - y) / len(y)).astype(np.float32)[:, None]
        g["out"], g["out_bias"] = h.T @ d, d.sum(0)
        dh = (d @ self.p["out"].T) * (1 - h * h)
        g["hidden"], g["hidden_bias"] = x.T @ dh, dh.sum(0)
        dx = dh @ self.p["hidden"].T
        top = (feats == most[owner]) & (feats > 0)
        df = (dx[:, :FILTERS] / counts[:, None])[owner] + dx[:, FILTERS:][owner] * top
        df = (df * (feats > 0)).astype(np.float32)
        g["bias"] = df.sum(0)
        g["filters"], g["embed"] = np.zeros_like(self.p["filters"]), np.zeros(self.p["embed"].shape)
        for a in range(0, len(chunks), STEP):
            own, n = df[a : a + STEP], np.arange(min(STEP, len(chunks) - a))[:, None, None]
            codes = chunks[a : a + STEP][n, at[a : a + STEP, :, None] * STRIDE + np.arange(WIDTH)]  # (chunks, filters, width)
            won = self.p["embed"][codes].reshape(len(own), FILTERS, WIDTH * EMBED)
            g["filters"] += np.einsum("cf,cfw->wf", own, won)
            back = (own[:, :, None] * self.p["filters"].T[None]).reshape(len(own), FILTERS, WIDTH, EMBED)
            g["embed"] += np.stack([np.bincount(codes.ravel(), weights=back[..., k].ravel(), minlength=PAD + 1) for k in range(EMBED)], axis=1)
        return g

    def fit(self, rows: list[tuple[str, int]], seed: int = 7) -> Network:
        y = np.array([v for _, v in rows], dtype=np.float32)
        if not len(y) or y.min() == y.max():
            self.share = float((y.sum() + 0.5) / (len(y) + 1)) if len(y) else 0.5
            return self
        docs = [chunks_of(text) for text, _ in rows]
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v, dtype=np.float64) for k, v in self.p.items()}
        second = {k: np.zeros_like(v, dtype=np.float64) for k, v in self.p.items()}
        epochs = max(EPOCHS, int(np.ceil(300 * BATCH / len(docs))))
        total, step = epochs * -(-len(docs) // BATCH), 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                chunks = np.concatenate([docs[k] for k in pick])
                owner = np.repeat(np.arange(len(pick)), [len(docs[k]) for k in pick])
                step += 1
                rate = RATE * (1 - step / (total + 1))
                for k, g in self.gradients(chunks, owner, y[pick]).items():
                    g = g + 1e-4 * self.p[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    self.p[k] = (self.p[k] - rate * move).astype(np.float32)
        return self


def quality_of(network: Network, text: Column) -> Column:
    """The network's score of a text, in Arrow batches."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(network.scores([t if isinstance(t, str) else None for t in texts.tolist()]), dtype=float)

    return run(text.cast("string"))


def score_quality(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"].array, "score": network.scores([t if isinstance(t, str) else None for t in pdf["text"].tolist()])})

    return id_back(docs.select(id_text(id_col), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "id string, score double"))
