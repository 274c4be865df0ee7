"""Byte-pair merges over a given merge list, and what they say about a string's randomness."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import ColumnLike, _c


def _bits(counts: Counter) -> float:
    n = sum(counts.values())
    return -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0


class Tokenizer:
    """Merges apply in the order of the list, each to every place it fits; unknown tokens have id 0."""

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int] | None = None):
        self.merges = list(merges)
        self.vocabulary = vocabulary if vocabulary is not None else {a + b: k + 1 for k, (a, b) in enumerate(merges)}

    def tokenize(self, text: str) -> list[str]:
        tokens = list(text)
        for a, b in self.merges:
            if a not in tokens:
                continue
            out, k = [], 0
            while k < len(tokens):
                if tokens[k] == a and tokens[k + 1 : k + 2] == [b]:
                    out.append(a + b)
                    k += 2
                else:
                    out.append(tokens[k])
                    k += 1
            tokens = out
        return tokens

    def encode(self, text: str) -> list[int]:
        return [self.vocabulary.get(t, 0) for t in self.tokenize(text)]

    def token_entropy(self, text: str) -> float:
        return _bits(Counter(self.tokenize(text)))

    def uniqueness(self, text: str) -> float:
        tokens = self.tokenize(text)
        return len(set(tokens)) / len(tokens) if tokens else 0.0

    def secret_score(self, text: str) -> float:
        """0.3 of token entropy, 0.3 of uniqueness, 0.4 of character entropy, each in 0..1; 0 under eight bytes."""
        if len(text.encode()) < 8:
            return 0.0
        return 0.3 * min(self.token_entropy(text) / 4, 1) + 0.3 * self.uniqueness(text) + 0.4 * min(_bits(Counter(text)) / 4, 1)

    def score_column(self, text: ColumnLike) -> Column:
        @F.pandas_udf("double")
        def run(values: pd.Series) -> pd.Series:
            return values.map(self.secret_score, na_action="ignore")

        return run(_c(text))
