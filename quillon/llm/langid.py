"""Language identification by cross-parsing entropy.

For each language a suffix automaton over its labelled text accepts exactly the
substrings of that text. A document is parsed greedily into longest matches,
and the language that needs the fewest phrases wins. As a longer reference
gives longer matches by itself (about as the logarithm of its length), phrases
are counted times that logarithm, so a language with little labelled text
neither loses by it nor shortens the others' references.

Texts are lower-cased; letters of any script are spelled in their UTF-8 bytes,
and every run of anything else is one space, so the alphabet has at most 256
symbols and no script runs out of them. The automata are dense tables stacked
in one, so all texts of a batch step through all languages together, one
vectorised step a byte. A text longer than LANE bytes is parsed in lanes that
start WARM bytes early: a greedy parse forgets where it began within a few
phrases, so the phrases that end inside each lane are those of one parse of the
whole text.

Learning reads whole texts of a bounded sample: distinct texts of a language in
the order of a hash, as many as stay within TRAIN_CHARS characters together (a
longer text is passed over), or the shortest one if none does. At most DRAWN
texts a language reach the driver.

Defined cases: null texts and texts without a letter are `und` with score 0;
an empty training set makes every text `und`; ties go to the language that
sorts first; rows with a null lang never train, nor do texts without a letter;
repeated rows are scored alike; other columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_text

#: Characters of training text of a language, and the distinct texts drawn to find them.
TRAIN_CHARS = 65_536
DRAWN = 200
#: Bytes of a text that are parsed in one go, and how much earlier each further lane starts.
LANE, WARM = 8_192, 256
FLAG = np.int32(1 << 30)
#: Bytes that one step of the parser holds, lanes of one language.
STEP_BYTES = 1 << 21
SPACE = 32

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point of Unicode is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(k).isalpha() for k in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _LETTERS[0]


def spelled(text: str) -> np.ndarray:
    """The text's lower-cased letters as UTF-8 bytes, every run of anything else after a letter as one space; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    own = letters()[points]
    if not own.any():
        return np.zeros(0, dtype=np.uint8)
    keep = own.copy()
    keep[1:] |= own[:-1]  # the first of a run that is no letter
    points = np.where(own, points, SPACE)[keep]
    return np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)


def automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of every state of the suffix automaton of codes; state 0 is the root."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        new = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = new
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return goto


class Parser:
    """The languages' automata in one dense table.

    A row is a state, a column a symbol; the entry is the next state, with FLAG
    where the match ends before the symbol and a phrase starts with it.
    """

    def __init__(self, samples: dict[str, np.ndarray]):
        self.langs = sorted(samples)
        seen = np.unique(np.concatenate([samples[k] for k in self.langs])) if samples else np.zeros(0, np.uint8)
        self.symbols = np.zeros(256, dtype=np.int32)  # 0: a byte that no language has
        self.symbols[seen] = np.arange(1, len(seen) + 1)
        self.width = len(seen) + 2  # the last one is padding: no step
        parts, self.roots, at = [], [], 0
        for lang in self.langs:
            goto = automaton(self.symbols[samples[lang]])
            dense = np.full((len(goto), self.width), -1, dtype=np.int32)
            places = np.repeat(np.arange(len(goto)), [len(x) for x in goto])
            dense[places, [c for x in goto for c in x]] = [to for x in goto for to in x.values()]
            root = np.maximum(dense[0], 0)
            dense = np.where(dense < 0, (root + at)[None, :] | FLAG, dense + at)
            dense[:, self.width - 1] = np.arange(len(goto)) + at
            parts.append(dense)
            self.roots.append(at)
            at += len(goto)
        self.table = np.concatenate(parts).reshape(-1) if parts else np.zeros(0, np.int32)
        # expected phrases fall with the logarithm of the reference's length
        self.weight = np.log2(np.array([len(samples[k]) + 2 for k in self.langs], dtype=float)) if samples else np.zeros(0)

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """(languages, texts): number of phrases of each spelled text."""
        out = np.zeros((len(self.langs), len(texts)), dtype=np.int64)
        lanes = [(k, a, max(0, a - WARM), min(len(t), a + LANE)) for k, t in enumerate(texts) for a in range(0, max(1, len(t)), LANE)]
        lanes.sort(key=lambda x: x[2] - x[3])  # the longest first, so that those still running are in front
        at = 0
        while at < len(lanes):
            size = lanes[at][3] - lanes[at][2]
            part = lanes[at : at + max(1, STEP_BYTES // max(1, size))]
            at += len(part)
            self._run(texts, part, out)
        return out + np.array([len(t) > 0 for t in texts])

    def _run(self, texts: list[np.ndarray], lanes: list[tuple[int, int, int, int]], out: np.ndarray) -> None:
        sizes = np.array([end - start for _, _, start, end in lanes])
        longest = int(sizes[0])
        grid = np.full((len(lanes), longest), self.width - 1, dtype=np.int32)
        for row, (k, _, start, end) in zip(grid, lanes, strict=True):
            row[: end - start] = self.symbols[texts[k][start:end]]
        columns = np.ascontiguousarray(grid.T)
        del grid
        warm = np.array([a - start for _, a, start, _ in lanes])
        state = np.repeat(np.array(self.roots, dtype=np.int32)[:, None], len(lanes), axis=1)
        count = np.zeros(state.shape, dtype=np.int32)
        running = np.searchsorted(-sizes, -np.arange(longest), side="left")  # lanes longer than each step
        for k in range(longest):
            n = running[k]
            to = self.table[state[:, :n] * self.width + columns[k, :n]]
            ends = to >= FLAG
            if k < WARM:
                ends &= k >= warm[:n]
            count[:, :n] += ends
            state[:, :n] = to & (FLAG - 1)
        owner = np.array([k for k, *_ in lanes])
        for lang, own in enumerate(count):
            out[lang] += np.bincount(owner, weights=own, minlength=out.shape[1]).astype(np.int64)


_BUILT: dict[tuple, Parser] = {}


def built(samples: dict[str, str]) -> Parser:
    key = tuple(sorted(samples.items()))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Parser({lang: spelled(text) for lang, text in samples.items()})
    return _BUILT[key]


def identify(texts: list[str | None], samples: dict[str, str]) -> tuple[list[str], list[float]]:
    """The winning language of each text, and the runner-up's cost / (winner's + runner-up's)."""
    parser = built(samples)
    pred, score = ["und"] * len(texts), [0.0] * len(texts)
    if not parser.langs:
        return pred, score
    spelt = [(k, spelled(t)) for k, t in enumerate(texts) if t]
    spelt = [(k, t) for k, t in spelt if len(t)]
    if not spelt:
        return pred, score
    cost = parser.phrases([t for _, t in spelt]) * parser.weight[:, None]
    best = cost.argmin(axis=0)
    ranked = np.sort(cost, axis=0)
    for j, (k, _) in enumerate(spelt):
        pred[k] = parser.langs[best[j]]
        score[k] = float(ranked[1, j] / (ranked[0, j] + ranked[1, j])) if len(parser.langs) > 1 else 1.0
    return pred, score


def samples_of(rows: DataFrame) -> dict[str, str]:
    """Training text of each language from rows (lang, text): whole texts, joined by line breaks."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64("text").alias("h"), "text", F.char_length("text").alias("n"))
    # the distinct texts of the smallest hashes, and the shortest one, found on (hash, length) without the texts
    known = rows.groupBy("lang", "h").agg(F.min("n").alias("n"))
    fits = known.where(F.col("n") <= TRAIN_CHARS)
    share = F.pmod(F.shiftrightunsigned("h", 20), F.lit(1 << 20))
    counts = {r["lang"]: r["k"] for r in fits.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).toLocalIterator()}
    shortest = {r["lang"]: r["first"]["h"] for r in known.groupBy("lang").agg(F.min(F.struct("n", "h")).alias("first")).toLocalIterator()}
    if not shortest:
        return {}
    rate = F.create_map(*[x for lang, k in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, DRAWN / k) * (1 << 20))))]) if counts else F.create_map().cast("map<string,int>")
    least = F.create_map(*[x for lang, h in shortest.items() for x in (F.lit(lang), F.lit(h))])
    drawn = rows.where(((F.col("n") <= TRAIN_CHARS) & (share <= rate[F.col("lang")])) | (F.col("h") == least[F.col("lang")]))
    texts: dict[str, dict[int, str]] = {}
    for r in drawn.select("lang", "h", "text").dropDuplicates(["lang", "h"]).toLocalIterator():
        texts.setdefault(r["lang"], {})[r["h"]] = r["text"]
    out = {}
    for lang, own in texts.items():
        taken, size = [], 0
        for h in sorted(own, key=lambda h: (h >> 20 & (1 << 20) - 1, h)):
            if size + len(own[h]) <= TRAIN_CHARS:
                taken.append(own[h])
                size += len(own[h])
        out[lang] = "\n".join(taken or [own[shortest[lang]]])
    return out


def identify_languages(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row a document: id, lang_pred, score. `train` says which rows may be learned from."""
    samples = samples_of(docs.where(train).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pred, score = identify([t if isinstance(t, str) else None for t in pdf["text"].tolist()], samples)
            yield pd.DataFrame({"id": pdf["id"].array, "lang_pred": pred, "score": score})

    return id_back(docs.select(id_text(id_col), F.col(text_col).cast("string").alias("text")).mapInPandas(run, "id string, lang_pred string, score double"))
