"""Language-model scoring by masked pseudo-likelihood.

Every word of a document is masked in turn and predicted from the RADIUS words
on each side. A window network in numpy mixes the neighbours' embeddings, each
weighed by its place, into a hidden vector, and a hierarchical softmax over a
Huffman tree of the vocabulary turns that into p(word | both sides): the
product, along the word's path, of the probability of each turn, which sums to
one over all words. A document's score is the sum of the logarithms over its
words.

Gathered from all documents are the counts of words, by 64-bit hashes in a
table in the shared folder that grows with the corpus. The most frequent words
(HEAD at most) have leaves and embeddings of their own; all others are one leaf
and one embedding, and such a word's part of the leaf is its exact count, which
scoring joins from the table.

The network starts as the words' frequencies (the tree's biases) and learns from
the window of every word of every document:
in each of ROUNDS passes the tasks train on
their own documents from the same parameters, and each row of the parameters
moves by the mean of what the tasks that met it would move it, weighed by how
often they did. A task hands back a row for each parameter row it met, summed
by shuffle, so neither task nor driver holds more than one copy of the network.

Defined cases: null, empty and blank texts have no words and log_prob 0, mean
null; beyond a text's ends a padding word stands; a word no corpus row holds
has the smoothed count; an empty corpus yields no rows; repeated rows are
scored alike; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_text, stored
from .minmax_dedup import _steps, encode
from .shingles import word_hashes

#: Words with a leaf of their own; the counts of all others are joined.
HEAD = 1 << 15
#: Distinct words that a task of the count holds before it passes them on.
HELD = 1 << 20
RADIUS = 2
EMBED = 20
#: Passes, and every how many words of a text one is predicted in training: 1 is all of them.
ROUNDS, EVERY = 1, 1
BATCH, RATE = 512, 0.15
#: Heaviest nodes of the tree, which most paths end in: their turns are made for whole batches at once.
TOP = 64
SMOOTH = 0.5
#: First bits of a name by which it is looked up in the head.
LOOKUP = 18
#: Batches that are laid out together, and values of a row that are added one by one in a batch.
TOGETHER, OFTEN = 8, 8
#: Words that one vectorised step of scoring takes.
STEP = 1_024


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit names of all words in order, and the number of words of each text."""
    hashes, counts = word_hashes(texts)
    return hashes.view(np.int64), counts


def lookup(head: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For the sorted head: its names with an end, where names that begin with each LOOKUP bits start, and how many of those there are at most."""
    edges = np.arange(-(1 << LOOKUP - 1), 1 << LOOKUP - 1, dtype=np.int64) << 64 - LOOKUP
    start = np.searchsorted(head, edges)
    return np.append(head, np.iinfo(np.int64).max), start.astype(np.int32), int(np.diff(np.append(start, len(head))).max())


def leaves(words: np.ndarray, head: np.ndarray, table: tuple[np.ndarray, np.ndarray, int] | None = None) -> np.ndarray:
    """Place of each word in the sorted head; len(head) for all others."""
    names, start, most = table or lookup(head)
    at = start.take((words >> 64 - LOOKUP) + (1 << LOOKUP - 1))
    for _ in range(most):
        at += names.take(at) < words
    return np.where(names.take(at) == words, at, len(head)).astype(np.int32)


def _summed(h: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate(h), return_inverse=True)
    return words, np.bincount(at, weights=np.concatenate(n), minlength=len(words)).astype(np.int64)


def word_counts(texts: DataFrame) -> DataFrame:
    """Stored (h, n): occurrences of every word over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, times, size = [], [], 0
        for pdf in batches:
            raw = encode(pdf["text"])
            for a, b in _steps(raw):
                h, n = np.unique(buckets(raw[a:b])[0], return_counts=True)
                words.append(h)
                times.append(n)
                size += len(h)
                if size > 2 * HELD:
                    h, n = _summed(words, times)
                    words, times, size = [h], [n], len(h)
                    if size > HELD:
                        yield pd.DataFrame({"h": h, "n": n})
                        words, times, size = [], [], 0
        if size:
            h, n = _summed(words, times)
            yield pd.DataFrame({"h": h, "n": n})

    return stored(texts.mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "words")


def head_of(words: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The most frequent words by name with their counts, HEAD at most (words of equal counts are in it or not together), and the rest's occurrences and number."""
    sizes = words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).toArrow()
    n, many = (np.asarray(sizes[c].to_numpy(), dtype=np.int64) for c in ("n", "words"))
    order = np.argsort(-n)
    n, many = n[order], many[order]
    inside = np.cumsum(many) <= HEAD
    rest = int((n * many)[~inside].sum()), int(many[~inside].sum())
    if not inside.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), *rest
    found = words.where(F.col("n") >= int(n[inside].min())).select("h", "n").toArrow()
    h, counts = (np.asarray(found[c].to_numpy(), dtype=np.int64) for c in ("h", "n"))
    order = np.argsort(h)
    return h[order], counts[order], *rest


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths of the leaves in the tree of least mean depth: where each leaf's path starts, its inner nodes, its turns (1 or -1); and the log-odds of turning 1 at each node."""
    n = len(counts)
    heap = [(float(c), k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, turn, odds = np.zeros(2 * n - 1, dtype=np.int64), np.zeros(2 * n - 1, dtype=np.float32), np.zeros(max(0, n - 1), dtype=np.float32)
    for node in range(n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = n + node
        turn[i], turn[j] = 1, -1
        odds[node] = np.log(a / b)
        heapq.heappush(heap, (a + b, n + node))
    starts, nodes, turns = [0], [], []
    for leaf in range(n):
        at = leaf
        while at != 2 * n - 2:
            nodes.append(parent[at] - n)
            turns.append(turn[at])
            at = parent[at]
        starts.append(len(nodes))
    return np.array(starts, dtype=np.int64), np.array(nodes, dtype=np.int32), np.array(turns, dtype=np.float32), odds


def windows(ids: np.ndarray, counts: np.ndarray, padding: int) -> np.ndarray:
    """(words, 2 * RADIUS): the neighbours of each word, within its own text."""
    padded = np.full(len(ids) + (len(counts) + 1) * RADIUS, padding, dtype=np.int32)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(ids)) + (owner + 1) * RADIUS
    padded[at] = ids
    return np.stack([padded[at + k] for k in range(-RADIUS, RADIUS + 1) if k], axis=1)


def _narrow(values: np.ndarray, most: int) -> np.ndarray:
    """The values, all under most, in the type that sorts fastest: numpy sorts 16 bits by radix."""
    return values.astype(np.uint16) if most <= 1 << 16 else values


def _runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of such lengths, one after the other: run and place in it of each element."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _side_by_side(lengths: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of such lengths, in each group the longest first, as run and place ordered by group, place and run, and how many each (group, place) has."""
    run, at = _runs(lengths)
    depth = int(lengths.max(initial=0))
    cell = group[run] * depth + at
    order = np.argsort(_narrow(cell, groups * depth), kind="stable")
    return run[order], at[order], np.bincount(cell, minlength=groups * depth).reshape(groups, depth)


class Sums:
    """How the values of a batch add up to its distinct rows: first, one of each; then the second, third and so on of all rows that have one; those beyond OFTEN by a product."""

    def __init__(self, rows: np.ndarray, n: np.ndarray, first: np.ndarray, places: np.ndarray, many: list[int], owner: np.ndarray, beyond: np.ndarray):
        self.rows, self.n, self.first, self.places, self.many, self.owner, self.beyond = rows, n, first, places, many, owner, beyond

    def of(self, values: np.ndarray) -> np.ndarray:
        out, laid, at = values.take(self.first, axis=0), values.take(self.places, axis=0), 0
        for m in self.many:
            out[:m] += laid[at : at + m]
            at += m
        if len(self.owner):
            whose = np.zeros((self.owner[-1] + 1, len(self.owner)), np.float32)
            whose[self.owner, np.arange(len(self.owner))] = 1
            out[: len(whose)] += whose @ values.take(self.beyond, axis=0)
        return out


def sums_of(rows: np.ndarray, sizes: np.ndarray, most: int) -> list[Sums]:
    """Sums of batches with so many values each, for rows under most."""
    groups, ends = len(sizes), np.cumsum(sizes)
    starts = ends - sizes
    narrow = _narrow(rows, most)
    order = np.concatenate([np.argsort(narrow[a:b], kind="stable") + a for a, b in zip(starts, ends, strict=True)])
    own = narrow.take(order)
    new = np.ones(len(own), dtype=bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    new[starts] = True
    first = np.flatnonzero(new)
    group = np.searchsorted(ends, first, side="right")
    n = np.diff(np.append(first, len(own)))
    by = np.argsort(_narrow((group + 1) * (OFTEN + 2) - 1 - np.minimum(n, OFTEN + 1), groups * (OFTEN + 2)), kind="stable")
    first, n = first[by], n[by]
    distinct, counts = own[first].astype(np.int64), n.astype(np.float32)
    run, at, many = _side_by_side(np.minimum(n, OFTEN) - 1, group, groups)
    places = order.take(first.take(run) + 1 + at)
    owner, at = _runs(np.maximum(n - OFTEN, 0))
    beyond, first = order[first[owner] + OFTEN + at], order[first]
    r, q = (np.searchsorted(g, np.arange(groups + 1)) for g in (group, group[owner]))
    p = np.r_[0, np.cumsum(many.sum(axis=1))]
    return [
        Sums(distinct[a:b], counts[a:b], first[a:b] - start, places[c:d] - start, own_many.tolist(), owner[e:g] - a, beyond[e:g] - start)
        for start, own_many, a, b, c, d, e, g in zip(starts, many, r[:-1], r[1:], p[:-1], p[1:], q[:-1], q[1:], strict=True)
    ]


def slopes(s: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Derivative of -log p of each turn by its sum s, which is overwritten."""
    s *= turns
    np.exp(np.minimum(s, 60, out=s), out=s)
    s += 1
    return np.divide(turns, np.negative(s, out=s), out=s)


_KINDS = ("in", "out", "mix")


class WindowNetwork:
    """p(word | words on both sides): embeddings weighed by place, one hidden layer, hierarchical softmax.

    p["in"]: embeddings of all leaves and the padding; p["out"]: inner nodes, the last column is the bias;
    p["mix"]: weights of the places, the last row is the bias. All have EMBED + 1 columns and are parts of
    one array, rows, so that a batch moves all it met at once; its end, the top's nodes and the mix, moves whole.
    """

    def __init__(self, counts: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.starts, self.nodes, self.turns, odds = huffman(counts)
        leaves = len(counts)
        self.padding = leaves
        # a path's nodes grow heavier towards the root, so those of the top are its end
        self.first = max(0, len(odds) - TOP)
        self.length = np.diff(self.starts)
        self.deep = self.length - np.bincount(np.repeat(np.arange(leaves), self.length)[self.nodes >= self.first], minlength=leaves)
        self.rows = np.zeros((leaves + 1 + len(odds) + 2 * RADIUS + 1, EMBED + 1), np.float32)
        self.growths = np.full(len(self.rows), 1e-3, np.float32)
        self.name_parts()
        self.p["in"][:, :EMBED] = rng.standard_normal((leaves + 1, EMBED)) * 0.5
        self.p["out"][:, EMBED] = odds
        self.p["mix"][: 2 * RADIUS, :EMBED] = 1 / np.sqrt(2 * RADIUS) + 0.1 * rng.standard_normal((2 * RADIUS, EMBED))

    def name_parts(self) -> None:
        """p and grown: what belongs to the embeddings, the nodes and the mix."""
        cut = self.padding + 1, len(self.rows) - 2 * RADIUS - 1
        self.wholes = self.rows.view(np.dtype((np.void, self.rows.strides[0]))).ravel()
        self.p, self.grown = (dict(zip(_KINDS, np.split(v, cut), strict=True)) for v in (self.rows, self.growths))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("p", "grown", "wholes")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.name_parts()

    def copied(self) -> WindowNetwork:
        out = WindowNetwork.__new__(WindowNetwork)
        out.__setstate__(self.__getstate__() | {"rows": self.rows.copy(), "growths": self.growths.copy()})
        return out

    def hidden(self, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of the sides, and the hidden layer, whose last column is 1 for the bias."""
        x = self.p["in"].take(sides, axis=0)
        mix = self.p["mix"]
        h = np.einsum("bkd,kd->bd", x, mix[:-1])
        h += mix[-1]
        np.tanh(h, out=h)
        h[:, EMBED] = 1
        return x, h

    def log_p(self, sides: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log p of each word given its sides."""
        out = np.zeros(len(words))
        if not len(self.nodes):
            return out
        out_of, top = self.p["out"], self.p["out"][self.first :]
        for a in range(0, len(words), STEP):
            own = words[a : a + STEP]
            _, h = self.hidden(sides[a : a + STEP])
            run, at = _runs(self.length.take(own))
            start = np.flatnonzero(at == 0)
            at += self.starts.take(own).take(run)
            node = self.nodes.take(at)
            under, over = np.flatnonzero(node < self.first), np.flatnonzero(node >= self.first)
            s = np.empty(len(run), np.float32)
            s[over] = (h @ top.T).ravel().take(run.take(over) * len(top) + node.take(over) - self.first)
            s[under] = (out_of.take(node.take(under), axis=0) * h.take(run.take(under), axis=0)) @ np.ones(EMBED + 1, np.float32)
            s *= self.turns.take(at)
            np.exp(-np.clip(s, -60, 60, out=s), out=s)
            s += 1
            out[a : a + STEP] = -np.add.reduceat(np.log(s, out=s), start, dtype=np.float64)
        return out

    def batches(self, sides: np.ndarray, words: np.ndarray) -> Iterator[tuple]:
        """Batches of BATCH words with all that does not depend on the parameters, which is made for many batches at once.

        In each the words with the longest paths below the top come first, so that the k-th steps of all that have one are side by side.
        """
        groups, tops = -(-len(words) // BATCH), len(self.p["out"]) - self.first
        group = np.arange(len(words)) // BATCH
        deep = self.deep.take(words)
        depth = int(deep.max(initial=0)) + 1
        by = np.argsort(_narrow((group + 1) * depth - 1 - deep, groups * depth), kind="stable")
        sides, words = sides.take(by, axis=0), words.take(by)
        run, at, many = _side_by_side(deep.take(by), group, groups)
        at += self.starts.take(words).take(run)
        node, turn = self.nodes.take(at) + (self.padding + 1), self.turns.take(at)
        run -= group.take(run) * BATCH
        # steps through the top, as places in a table of a batch's words by the top's nodes
        deep, length = deep.take(by), self.length.take(words)
        high = np.repeat(np.arange(len(words)), length - deep)
        at = np.arange(len(high)) + np.repeat(self.starts.take(words) + length - np.cumsum(length - deep), length - deep)
        cell = high * tops + self.nodes.take(at) - self.first
        turned, whose = self.turns.take(at), group.take(high)
        met = np.bincount(cell % tops + whose * tops, minlength=groups * tops).reshape(groups, tops)
        p, q = (np.r_[0, np.cumsum(n)] for n in (many.sum(axis=1), np.bincount(whose, minlength=groups)))
        own = [slice(k * BATCH, (k + 1) * BATCH) for k in range(groups)]
        rows = np.concatenate([v for k in range(groups) for v in (node[p[k] : p[k + 1]], sides[own[k]].ravel())])
        sums = sums_of(rows, np.diff(p) + 2 * RADIUS * np.bincount(group), self.padding + 1 + self.first)
        for k in range(groups):
            a, b, c, d = *p[k : k + 2], *q[k : k + 2]
            yield sides[own[k]], many[k].tolist(), run[a:b], node[a:b], cell[c:d] - k * BATCH * tops, np.concatenate([turn[a:b], turned[c:d]]), met[k], sums[k]

    def slope(self, sides: np.ndarray, many: list[int], run: np.ndarray, node: np.ndarray, cell: np.ndarray, turn: np.ndarray, met: np.ndarray, sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradient of the cross-entropy summed over one of the batches: that of the rows of sums, that of the end, and how often each row of the end was met."""
        x, h = self.hidden(sides)
        top, mix = self.p["out"][self.first :], self.p["mix"]
        own, hr = self.rows.take(node, axis=0), h.take(run, axis=0)
        s = np.empty(len(turn), np.float32)
        values = np.empty((len(node) + sides.size, EMBED + 1), np.float32)
        np.multiply(own, hr, out=values[: len(node)])
        np.matmul(values[: len(node)], np.ones(EMBED + 1, np.float32), out=s[: len(node)])  # faster than einsum for short rows
        s[len(node) :] = (h @ top.T).ravel().take(cell)
        slopes(s, turn)
        g = np.zeros((len(sides), len(top)), np.float32)
        g.ravel()[cell] = s[len(node) :]
        dh = g @ top
        end = np.empty((len(top) + len(mix), EMBED + 1), np.float32)
        np.matmul(g.T, h, out=end[: len(top)])
        g = s[: len(node), None]
        own *= g
        np.multiply(hr, g, out=values[: len(node)])
        a = 0
        for m in many:
            dh[:m] += own[a : a + m]
            a += m
        dh *= 1 - h * h  # 0 in the bias's column
        np.einsum("bkd,bd->kd", x, dh, out=end[len(top) : -1])
        np.matmul(np.ones(len(dh), np.float32), dh, out=end[-1])
        np.einsum("bd,kd->bkd", dh, mix[:-1], out=values[len(node) :].reshape(x.shape))
        return sums.of(values), end, np.append(met, np.full(len(mix), len(sides))).astype(np.float32)

    def gradients(self, sides: np.ndarray, words: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, gradient sums and touches of each parameter for the cross-entropy summed over one batch."""
        batch = next(self.batches(sides, words))
        g, end, met = self.slope(*batch)
        rows = np.concatenate([batch[-1].rows, np.arange(len(self.rows) - len(end), len(self.rows))])
        g, n = np.concatenate([g, end]), np.concatenate([batch[-1].n, met])
        firsts = np.cumsum([0, *(len(v) for v in self.p.values())])
        own = {k: (rows >= a) & (rows < b) for k, a, b in zip(self.p, firsts[:-1], firsts[1:], strict=True)}
        return {k: (rows[v] - a, g[v], n[v]) for (k, v), a in zip(own.items(), firsts, strict=False)}

    def learn(self, sides: np.ndarray, words: np.ndarray) -> None:
        """One step a batch, scaled by what each row has moved before."""
        for a in range(0, len(words) if len(self.nodes) else 0, TOGETHER * BATCH):
            for batch in self.batches(sides[a : a + TOGETHER * BATCH], words[a : a + TOGETHER * BATCH]):
                g, end, met = self.slope(*batch)
                rows, tail = batch[-1].rows, slice(len(self.rows) - len(end), None)
                g *= self.rate(self.growths.take(rows), rows, g, batch[-1].n)
                np.subtract(self.rows.take(rows, axis=0), g, out=g)
                self.wholes[rows] = g.view(self.wholes.dtype).ravel()
                # a node of the top that no word met has no gradient
                self.rows[tail] -= end * self.rate(self.growths[tail], tail, end, np.maximum(met, 1))

    def rate(self, grown: np.ndarray, rows: np.ndarray | slice, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What a step takes of each row's gradient: a row met often in a batch has many steps' worth, which the root of n makes up for."""
        grown = grown + np.square(g) @ np.full(EMBED + 1, 1 / (EMBED + 1), np.float32) / n
        self.growths[rows] = grown
        return (RATE / np.sqrt(grown * n))[:, None]

    def met(self, words: np.ndarray, sides: np.ndarray) -> dict[str, np.ndarray]:
        """How often training met each row, of how often it met each leaf as the word and on the sides."""
        nodes = np.bincount(self.nodes, weights=np.repeat(words, self.length), minlength=len(self.p["out"]))
        return {"in": sides, "out": nodes, "mix": np.full(len(self.p["mix"]), words.sum())}


class Model:
    """What scoring needs: the head's words, the network, and the table of all words with the mass of those past the head."""

    def __init__(self, head: np.ndarray, network: WindowNetwork, words: DataFrame, mass: float):
        self.head, self.network, self.words, self.mass = head, network, words, mass


def one_pass(texts: DataFrame, head: np.ndarray, network: WindowNetwork) -> None:
    """Train on the windows of all texts (one in EVERY), each task from the same parameters, and move those by the weighed means."""
    shared = texts.sparkSession.sparkContext.broadcast((head, network))
    columns = [f"d{k}" for k in range(EMBED + 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, start = shared.value
        own, table = start.copied(), lookup(head)
        met, beside = np.zeros(own.padding), np.zeros(own.padding + 1)
        for pdf in batches:
            raw = encode(pdf["text"])
            for a, b in _steps(raw):
                words, counts = buckets(raw[a:b])
                ids = leaves(words, head, table)
                order = np.random.default_rng(len(ids)).permutation(len(ids))[::EVERY]
                sides, ids = windows(ids, counts, own.padding)[order], ids[order]
                own.learn(sides, ids)
                met += np.bincount(ids, minlength=len(met))
                beside += np.bincount(sides.ravel(), minlength=len(beside))
        touched = own.met(met, beside)
        for kind, k in enumerate(_KINDS):
            rows = np.flatnonzero(touched[k])
            moved = (own.p[k][rows] - start.p[k][rows]) * touched[k][rows, None]
            frame = pd.DataFrame(moved.astype(np.float32), columns=columns)
            frame.insert(0, "kind", np.full(len(rows), kind, np.int32))
            frame.insert(1, "place", rows.astype(np.int32))
            frame.insert(2, "n", touched[k][rows])
            frame.insert(3, "grown", (own.grown[k][rows] - start.grown[k][rows]).astype(np.float64))
            yield frame

    schema = ", ".join(["kind int, place int, n double, grown double", *(f"{c} float" for c in columns)])
    sums = texts.mapInPandas(run, schema).groupBy("kind", "place").agg(F.sum("n").alias("n"), F.sum("grown").alias("grown"), *(F.sum(c).alias(c) for c in columns)).toArrow()
    kinds, places, n, grown = (sums[c].to_numpy() for c in ("kind", "place", "n", "grown"))
    moved = np.stack([sums[c].to_numpy() for c in columns], axis=1) if len(kinds) else np.zeros((0, EMBED + 1))
    for kind, k in enumerate(_KINDS):
        own = kinds == kind
        network.p[k][places[own]] += (moved[own] / n[own, None]).astype(np.float32)
        network.grown[k][places[own]] += grown[own].astype(np.float32)
    shared.destroy()


def train(docs: DataFrame, text_col: str = "text") -> Model:
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    words = word_counts(texts)
    head, counts, rest, n_rest = head_of(words)
    mass = rest + SMOOTH * (n_rest + 1)  # one more stands for the words that no row holds
    network = WindowNetwork(np.append(counts, mass))
    for _ in range(ROUNDS if len(head) else 0):
        one_pass(texts, head, network)
    return Model(head, network, words, mass)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_tokens, log_prob, mean_log_prob."""
    shared = docs.sparkSession.sparkContext.broadcast((model.head, model.network))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, network = shared.value
        table = lookup(head)
        for pdf in batches:
            raw = encode(pdf["text"])
            for a, b in _steps(raw):
                words, n = buckets(raw[a:b])
                ids = leaves(words, head, table)
                logp = network.log_p(windows(ids, n, network.padding), ids)
                past = ids == len(head)
                sums, others = np.concatenate([[0.0], np.cumsum(logp)]), np.concatenate([[0], np.cumsum(past)])
                ends = np.cumsum(n)
                rare = np.split(words[past], others[ends][:-1])
                yield pd.DataFrame({"id": pdf["id"].iloc[a:b].array, "n_tokens": n, "seen": sums[ends] - sums[ends - n], "rare": rare})

    rows = docs.select(id_text(id_col), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInPandas(run, "id string, n_tokens long, seen double, rare array<long>")
    rows = stored(rows.select(F.monotonically_increasing_id().alias("uid"), "*"), "scored")
    # the words past the head meet their counts in the table
    rare = rows.where(F.size("rare") > 0).select("uid", F.explode("rare").alias("h"))
    logp = F.log((F.coalesce("n", F.lit(0)) + F.lit(SMOOTH)) / F.lit(float(model.mass)))
    rare = rare.join(model.words, "h", "left").groupBy("uid").agg(F.sum(logp).alias("rest"))
    out = rows.drop("rare").join(rare, "uid", "left").withColumn("log_prob", F.col("seen") + F.coalesce("rest", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return id_back(out.select("id", "n_tokens", "log_prob", mean.alias("mean_log_prob")))
