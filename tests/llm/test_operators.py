"""Operators against brute force on small fixtures, with every odd input the contracts name."""

import gzip
import hashlib
import itertools
import pickle
import random
import re
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quillon.llm import decontaminate, exact_dedup, langid, masked_lm, minmax_dedup, mixing, pfp_dedup, quality_cnn, shingles, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, uid string, rows string"


def documents(spark, rows, source="s"):
    """Documents with extra columns whose names clash with what operators use inside."""
    return spark.createDataFrame([(i, t, "en", source, len(t or ""), "x", "y", "z") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows(rng):
    base = words(rng, 120)
    parts = base.split()
    near = " ".join(parts[:40] + ["changed"] + parts[41:])
    return [
        (1, base), (2, base), (2, base), (3, near), (4, base.upper()), (5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "One  TWO"), (10, words(rng, 6_000)),
        (11, words(rng, 90)), (None, base), (12, words(rng, 30) + " " + base), (2**60 + 1, words(rng, 50)), (13, "é" * 500), (14, "é" * 500 + " a"),
    ]


def set_of(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return set(zip(*(found[k:] for k in range(5)))) if len(found) >= 5 else {tuple(found)} if found else set()


def brute_components(rows):
    rows = [(i, set_of(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in rows}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((top(i), top(j)))
            label[y] = x
    return {i: top(i) for i, _ in rows}


def test_shingles_are_sets_of_five_words():
    texts = ["a b c d e f", "A B C D E", "a b", " \t", "", "a b c d e a b c d e a b c d e"]
    hashes, counts = shingles.shingle_sets([t.encode() for t in texts])
    assert counts.tolist() == [len(set_of(t)) for t in texts]
    ends = np.cumsum(counts)
    sets = [set(hashes[e - c : e].tolist()) for c, e in zip(counts, ends)]
    assert sets[1] <= sets[0] and not sets[2] & sets[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = odd_rows(rng)
    for k in range(30):  # a family of edits of growing distance
        parts = rows[0][1].split()
        for at in rng.sample(range(len(parts)), k // 5):
            parts[at] = f"e{k}"
        rows.append((100 + k, " ".join(parts)))
    got = minmax_dedup.near_duplicates(documents(spark, rows)).collect()
    want = brute_components(rows)
    assert sorted((r.id is None, r.id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    for r in got:
        assert r.n_shingles == len(set_of(dict(rows)[r.id]))
        assert r.component == want.get(r.id)
        assert r.kept == (r.id is None or r.id == r.component)
    kept = minmax_dedup.drop_near_duplicates(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {r.id for r in got if r.kept}


def test_near_duplicates_compare_split_buckets_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(minmax_dedup, "BLOCK", 3)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        parts = list(base)
        for at in rng.sample(range(60), 1 + k % 3):
            parts[at] = f"x{k}"
        rows.append((k, " ".join(parts)))
    got = {r.id: r.component for r in minmax_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("by_blocks", [2, 1_000])
def test_near_duplicates_in_large_split_buckets(spark, monkeypatch, by_blocks):
    """Families around one template, linked inside and apart from each other, in buckets that either way compares."""
    monkeypatch.setattr(minmax_dedup, "BY_BLOCKS", by_blocks)
    monkeypatch.setattr(minmax_dedup, "BLOCK", 3)
    rng = random.Random(15)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for family in range(8):
        parts = list(base)
        for at in range(0, 100, 14):
            parts[at] = f"f{family}at{at}"
        for k in range(6):
            own = list(parts)
            own[rng.randrange(100)] = f"x{family}y{k}"
            rows.append((10 * family + k, " ".join(own)))
    rng.shuffle(rows)
    want = brute_components(rows)
    assert len(set(want.values())) > 3
    assert {r.id: r.component for r in minmax_dedup.near_duplicates(documents(spark, rows)).collect()} == want


def test_smallest_shingles_tell_what_may_link():
    rng = np.random.default_rng(3)
    for size in (40, 400, 4_000):
        every = np.unique(rng.integers(0, 1 << 32, size, dtype=np.uint32))
        for share, may in ((0.9, True), (0.76, True), (0.6, False), (0.0, False)):
            cut = int(len(every) * (1 - share) / (1 + share))  # each lacks as many of the other's
            shuffled = rng.permutation(every)
            x, y = np.sort(shuffled[cut:]), np.sort(np.r_[shuffled[2 * cut :], shuffled[:cut]] if cut else shuffled)
            exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            got = minmax_dedup.may_link(x[: minmax_dedup.LEAST], y[: minmax_dedup.LEAST], 75)
            assert got or exact < 0.75
            assert not got or exact > 0.62


def test_near_duplicates_of_one_id_on_two_texts(spark):
    rng = random.Random(14)
    a, b = words(rng, 100), words(rng, 100)
    near = lambda t: t.replace(" ", " edited ", 1)
    rows = [(5, a), (5, b), (9, near(a)), (8, near(b))]
    got = sorted((r.id, r.component, r.kept) for r in minmax_dedup.near_duplicates(documents(spark, rows)).collect())
    assert got == [(5, 5, True), (5, 5, True), (8, 5, False), (9, 5, False)]
    left = minmax_dedup.drop_near_duplicates(documents(spark, [*rows, (3, near(a) + " end")]))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(3, near(a) + " end"), (5, b)])


def test_near_duplicate_links_found(spark):
    """Recall of links at and just over the threshold, against brute force."""
    rng = random.Random(16)
    rows = []
    for k in range(60):
        parts = [f"v{rng.randrange(5_000)}" for _ in range(60)]
        own = list(parts)
        own[30 - 1] = "changed"  # 51 of 61 shingles in common
        rows += [(2 * k, " ".join(parts)), (2 * k + 1, " ".join(own))]
    want, got = brute_components(rows), {r.id: r.component for r in minmax_dedup.near_duplicates(documents(spark, rows)).collect()}
    linked = [i for i, c in want.items() if c != i]
    assert len(linked) == 60 and np.mean([got[i] == want[i] for i in linked]) >= 0.98


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in minmax_dedup.components(edges).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {101: 100}


def test_exact_duplicates(spark):
    rows = odd_rows(random.Random(3)) + [(20, "a  b"), (19, "a\tb"), (21, "a b ")]
    got = exact_dedup.exact_duplicates(documents(spark, rows), digest_all=True).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    digest = {hashlib.sha256(n.encode()).hexdigest(): ids for n, ids in groups.items()}
    assert len(got) == len(rows)
    for ids in digest.values():
        own = [r for r in got if digest[bytes(r.digest).hex()] is ids]
        least = min((i for i in ids if i is not None), default=None)
        assert [r.keep_id for r in own] == [least] * len(ids) and {r.group_size for r in own} == {len(ids)}
        assert [r.id for r in own if r.kept] == [least]
    left = exact_dedup.drop_exact_duplicates(documents(spark, rows))
    assert left.count() == len(groups) and left.columns == documents(spark, rows).columns


def brute_repeats(rows, span):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for k, t in enumerate(texts):
        for a in range(len(t) - span + 1):
            seen.setdefault(t[a : a + span], []).append((k, a))
    gone = [np.zeros(len(t), dtype=bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, a in places:
                gone[k][a : a + span] = True
    out = []
    for (i, _), t, g in zip(rows, texts, gone):
        edges = np.diff(np.concatenate([[0], g.astype(int), [0]]))
        out.append((i, len(t), int(g.sum()), int((edges == 1).sum()), bytes(np.frombuffer(t, dtype=np.uint8)[~g])))
    return out


@pytest.mark.parametrize("span", [60, 400])
def test_repeats_match_brute_force(spark, span):
    rng = random.Random(span)
    passage = words(rng, 200)
    rows = odd_rows(rng)[:9] + [(30 + k, words(rng, 60) + passage[k * 7 : 900 + k] + words(rng, 60)) for k in range(6)]
    rows += [(50, "a" * 1000), (51, "ab" * 700), (52, "b" * 399), (53, passage[:450]), (54, passage[100:560] + "é"), (None, words(rng, 80) + passage[300:1000]), (55, "xyz" * 41 + passage[:120])]
    got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in pfp_dedup.remove_repeats(documents(spark, rows), span=span).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(brute_repeats(rows, span), key=key)


def test_results_do_not_depend_on_how_scans_are_split(spark, tmp_path, monkeypatch):
    """Row numbers are made once: scans that split the input another way each time give the same rows."""
    rng = random.Random(21)
    passage = words(rng, 120)
    rows = [(k, words(rng, 40) + passage * (k % 3 == 0) + words(rng, 30)) for k in range(60)] + [(k, "same") for k in range(100, 130)]
    documents(spark, rows).repartition(16).write.parquet(f"file://{tmp_path}/documents")
    from quillon.llm import common

    real, turns = common.stored, itertools.cycle(["1k", "128m", "3k", "9k"])

    def stored(df, what):
        spark.conf.set("spark.sql.files.maxPartitionBytes", next(turns))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return real(df, what)

    for module in (common, pfp_dedup, exact_dedup, minmax_dedup):
        monkeypatch.setattr(module, "stored", stored)
    try:
        docs = spark.read.parquet(f"file://{tmp_path}/documents")
        got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in pfp_dedup.remove_repeats(docs).collect()]
        assert sorted(got) == sorted(brute_repeats(rows, 400))
        assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(docs).collect()) == [*range(60), 100]
        assert sorted(r.doc_id for r in minmax_dedup.drop_near_duplicates(docs.where("doc_id >= 100")).collect()) == [100]
    finally:
        for key in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{key}")


def test_repeats_in_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(pfp_dedup, "PIECE", 700)
    rng = random.Random(8)
    shared = words(rng, 300)
    rows = [(1, words(rng, 400) + shared + words(rng, 100)), (2, shared[33:]), (3, words(rng, 500))]
    got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in pfp_dedup.remove_repeats(documents(spark, rows)).collect()]
    assert sorted(got) == sorted(brute_repeats(rows, 400))


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "A train travels from Boston to Chicago at 60 miles per hour for 3 hours before it stops, how far is 60 miles"), (2, "the quick brown fox jumps over it"), (3, "two words"), (4, None)], "item_id long, text string")
    again = "So: a train travels from Dallas to Denver at 75 miles per hour for 8 hours before it stops, how far is 75 miles"
    wrong = "So: a train travels from Dallas to Denver at 75 miles per hour for 8 hours before it stops, how far is 90 miles"
    rows = [(1, "x " + again), (2, again), (3, wrong), (4, "he said the quick brown fox jumps over it today"), (5, "two words"), (6, None), (7, ""), (8, "clean text about nothing in particular at all " * 30), (None, again), (2, again)]
    got = {(r.id, r.item, r.reparameterised) for r in decontaminate.leaks(documents(spark, rows), items).collect()}
    assert got == {(1, 1, True), (2, 1, True), (4, 2, False), (None, 1, True)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaking(documents(spark, rows), items).collect()) == [3, 5, 6, 7, 8]


def test_leaks_in_any_case_and_context(spark):
    items = spark.createDataFrame([(1, "Maria has 5 apples and 3 pears. Maria gives 2 apples to Peter."), (2, "What is the capital city of France called?"), (3, "Name the largest planet.")], "item_id long, text string")
    again = "John has 7 apples and 4 pears. John gives 3 apples to Paul."
    rows = [(1, again), (2, "he asked, What is the capital city of France called? and left"), (3, "so WHAT IS THE CAPITAL CITY OF FRANCE CALLED then"), (4, "maria has 5 apples and 3 pears. maria gives 2 apples to peter."), (5, "please, Name the largest planet. now"), (6, again.replace("John gives", "Mark gives"))]
    got = {(r.id, r.item, r.reparameterised) for r in decontaminate.leaks(documents(spark, rows), items).collect()}
    assert got == {(1, 1, True), (2, 2, False), (3, 2, False), (4, 1, False), (5, 3, False)}


N, M, U = decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT


def brute_template(text):
    """Template words and the value behind each placeholder, by plain substitution from left to right."""
    out, out_end = [], 0
    bare = text.replace("-", " ")
    for m in regex.finditer(rf"(?P<n>{decontaminate.NUMBER_RE})|(?P<w>\p{{L}}+)", bare):
        word = m[0]
        if m["n"]:
            out.append((N, word))
        elif out and out[-1][0] == N and bare[out_end : m.start()].strip(" ") == "" and regex.fullmatch(rf"(?i)(?:{decontaminate.UNITS})", word):
            out.append((U, word.lower()))
        elif regex.fullmatch(r"\p{Lu}\p{Ll}+", word):
            out.append((M, word.lower()))
        else:
            out.append((word.lower(), None))
        out_end = m.end()
    return out


def brute_windows(words, w):
    return {k: tuple(words[k : k + w]) for k in range(len(words) - w + 1)}


def brute_leaks(rows, items):
    found = set()
    for i, text in rows:
        for item, question in items:
            if not text or not question:
                continue
            pair = None
            ours, theirs = brute_template(question), brute_template(text)
            w = 8 if len(ours) >= 8 else 4
            slots = {N, M, U}
            wanted = {k: v for k, v in brute_windows([x for x, _ in ours], w).items() if 2 * sum(x not in slots for x in v) >= w} if len(ours) >= 4 else {}
            there = brute_windows([x for x, _ in theirs], w)
            met = {}
            for k, v in wanted.items():
                for at, u in there.items():
                    if u == v:
                        met.setdefault(at - k, set()).add(k)
            good, other = {}, {}
            for diagonal, places in met.items():
                groups = {}
                for k in places:
                    for at in range(k, k + w):
                        if ours[at][0] in slots:
                            groups.setdefault(ours[at], set()).add(theirs[at + diagonal][1])
                if all(len(v) == 1 for v in groups.values()):
                    changed = any(min(v) != value for (_, value), v in groups.items())
                    for k in places:
                        good[k] = True
                        other.setdefault(k, []).append(changed)
            if wanted and (len(good) >= 0.5 * len(wanted) if w == 8 else len(good) == len(wanted)):
                pair = (i, item, any(all(v) for v in other.values()))
            split = lambda t: regex.findall(r"[\p{L}\p{N}]+", t.lower())
            plain, words_ = split(question), split(text)
            w = 8 if len(plain) >= 8 else 4
            ask = brute_windows(plain, w) if len(plain) >= 4 else {}
            have = set(brute_windows(words_, w).values())
            n = sum(v in have for v in ask.values())
            if pair is None and ask and (n >= 0.5 * len(ask) if w == 8 else n == len(ask)):
                pair = (i, item, False)
            if pair:
                found.add(pair)
    return found


def test_leaks_match_brute_force(spark):
    rng = random.Random(23)
    names, units = ["Maria", "Peter", "Boston", "Anna"], ["miles", "hours", "apples", "kg"]

    def question(n):
        return " ".join(rng.choice([f"q{rng.randrange(30)}x".translate({c: 97 + c - 48 for c in range(48, 58)}), rng.choice(names), f"{rng.randrange(1, 90)} {rng.choice(units)}", "the"]) for _ in range(n))

    items = [(k, question(rng.choice([3, 5, 9, 14, 20]))) for k in range(25)]
    again = lambda t: regex.sub(r"[0-9]+", lambda m: str(int(m[0]) + 7), t)
    renamed = lambda t: t.replace("Maria", "Julia").replace("Boston", "Denver")
    broken = lambda t: regex.sub(r"[0-9]+", lambda m: str(rng.randrange(100)), t)
    rows = []
    for k, (_, t) in enumerate(items):
        for j, change in enumerate((str, again, renamed, broken, str.upper, lambda t: t[: len(t) // 2], lambda t: t[len(t) // 3 :])):
            rows.append((10 * k + j, f"some words before it, {change(t)} and after it"))
    got = decontaminate.leaks(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.id, r.item, r.reparameterised) for r in got.collect()} == brute_leaks(rows, items)


def brute_segments(scores):
    """All maximal scoring segments by their definition: the best one, then both sides."""
    n = len(scores)
    best = max(((sum(scores[a:b]), -(b - a), -a, a, b) for a in range(n) for b in range(a + 1, n + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, _, a, b = best
    return [*brute_segments(scores[:a]), (a, b), *((x + b, y + b) for x, y in brute_segments(scores[b:]))]


def test_segments_are_all_maximal_ones():
    rng = random.Random(4)
    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, -1, 1, 2, 4]) + rng.random() / 100 for _ in range(rng.randrange(14))]
        assert [(a, b) for a, b, _ in toxicity.segments(np.array(scores))] == brute_segments(scores)


def toxic_rows(rng, n):
    out = []
    for k in range(n):
        body = words(rng, 60).split()
        if k % 4 == 0:
            body[20:22] = ["vile" + rng.choice(["ness", "st", "ly", "r", "man", "ton", "wit", "face", "brain", "head", "mouth", "heart"]), "scumbag"]
        out.append((" ".join(body), int(k % 4 == 0)))
    return out


def test_toxicity(spark):
    rng = random.Random(6)
    model = toxicity.fit(toxic_rows(rng, 400))
    held = toxic_rows(rng, 80)
    assert np.mean([(model.score(t)[0] >= 0.5) == y for t, y in held]) > 0.95
    assert [(a, b) for a, b, _ in model.passages(held[0][0])] == [(20, 22)]
    assert toxicity.Scores(model.odds)[b"vilehood"] > 0 > toxicity.Scores(model.odds)[b"wild"]  # a new word of a known family
    rows = [(1, None), (2, ""), (3, held[0][0]), (3, held[0][0]), (None, held[1][0]), (2**60 + 1, "plain")]
    got = {r.id: r.score for r in toxicity.score_toxicity(documents(spark, rows), model).collect()}
    assert set(got) == {i for i, _ in rows} and got[1] == got[2] < 0.5 < got[3]
    assert sorted((r.doc_id or 0) for r in toxicity.drop_toxic(documents(spark, rows), model).collect()) == [0, 1, 2, 2**60 + 1]
    assert toxicity.fit([]).score("x")[0] < 0.01 and toxicity.fit([("a", 1)]).score("x")[0] > 0.5


def test_toxicity_query_matches_brute_force(spark, tmp_path):
    """The whole query: fold, fit, and every document's score by its definition."""
    from quillon.llm import queries

    rng = random.Random(26)
    rows = [(k, t, y) for k, (t, y) in enumerate(toxic_rows(rng, 300))] + [(900, None, None), (901, "", None), (902, "vileness scumbag " * 3, None)]
    spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, y) for k, _, y in rows if y is not None], "doc_id long, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op4_segment_toxicity(spark, f"file://{tmp_path}").collect()}
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    learned = toxicity.sampled(spark.read.parquet(f"file://{tmp_path}/documents.parquet"), spark.createDataFrame([(k, y) for k, _, y in rows if y is not None and not held(k)], "doc_id long, toxic int"), "toxic", "doc_id", "text", 10_000)
    assert sorted(learned) == sorted((t, y) for k, t, y in rows if y is not None and not held(k))
    model = toxicity.fit(learned)
    for k, text, _ in rows:
        scores = [next((model.odds[f] for f in reversed(toxicity.chain(w)) if f in model.odds), 0.0) - toxicity.DRIFT for w in toxicity.tokens(text)]
        over = [model.lam * sum(scores[a:b]) - np.log(max(model.k * len(scores), 1e-9)) for a, b in brute_segments(scores)]
        kept = [x for x in over if x >= -np.log(toxicity.EXPECTED)]
        x = model.base + model.slope * np.log1p(sum(kept))
        assert got[k].score == pytest.approx(1 / (1 + np.exp(-x)), abs=1e-9) and got[k].held_out == held(k) and got[k].n_passages == len(kept)
        assert got[k].predicted == int(got[k].score >= 0.5)


def test_toxic_passages_that_repeat_earlier_words():
    rng = random.Random(6)
    model = toxicity.fit(toxic_rows(rng, 400))
    clean = lambda n: words(rng, n).split()
    passage = ["vileness", "scumbag", "vilewit"]
    twice = [*clean(60), *passage, *clean(60), *passage, *clean(60)]
    assert [(a, b) for a, b, _ in model.passages(" ".join(twice))] == [(60, 63), (123, 126)]
    scattered = [w for insult in passage for w in (*clean(80), insult)]
    dense = [*scattered, *clean(80), *passage, *clean(20)]
    assert (len(scattered) + 80, len(scattered) + 83) in [(a, b) for a, b, _ in model.passages(" ".join(dense))]


def test_quality_network(spark):
    rng = random.Random(7)
    row = lambda k: (" ".join(w + ("###" if k % 3 == 0 and rng.random() < 0.5 else "") for w in words(rng, 80).split()), int(k % 3 != 0))
    network = quality_cnn.Network().fit([row(k) for k in range(150)])
    held = [row(k) for k in range(60)]
    assert np.mean((network.scores([t for t, _ in held]) >= 0.5) == [y for _, y in held]) > 0.9
    long = held[1][0] * 300 + held[0][0] * 300  # the second half must count
    assert network.scores([long])[0] < network.scores([held[1][0] * 300])[0]
    rows = [(1, None), (2, ""), (2, ""), (None, "a"), (2**60 + 1, "b")]
    got = quality_cnn.score_quality(documents(spark, rows), network).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and 2**60 + 1 in {r.id for r in got}
    assert quality_cnn.Network().fit([("a", 1)]).scores(["x", None]).tolist() == [0.75, 0.75]


def brute_quality(text, p):
    """The network's score by plain loops over every chunk, place and filter."""
    q = quality_cnn
    raw = [*(text or "").encode()]
    chunks = [raw[a : a + q.CHUNK + q.WIDTH] for a in range(0, max(1, len(raw)), q.CHUNK)]
    feats = []
    for chunk in chunks:
        chunk = chunk + [q.PAD] * (q.CHUNK + q.WIDTH - len(chunk))
        windows = [np.concatenate([p["embed"][c] for c in chunk[a : a + q.WIDTH]]) for a in range(0, q.CHUNK, q.STRIDE)]
        feats.append([max(0.0, max(float(w @ p["filters"][:, f]) for w in windows) + p["bias"][f]) for f in range(q.FILTERS)])
    x = np.concatenate([np.mean(feats, axis=0), np.max(feats, axis=0)])
    h = np.tanh(x @ p["hidden"] + p["hidden_bias"])
    return 1 / (1 + np.exp(-(h @ p["out"] + p["out_bias"])[0]))


def test_quality_scores_match_brute_force(spark):
    rng = random.Random(17)
    network = quality_cnn.Network().fit([(words(rng, 80) + "#" * (k % 2 * 30), 1 - k % 2) for k in range(60)])
    rows = [(1, None), (2, ""), (3, "é" * 300), (4, words(rng, 700)), (5, words(rng, 3) + "###")]
    got = {r.id: r.score for r in quality_cnn.score_quality(documents(spark, rows), network).collect()}
    assert all(got[i] == pytest.approx(brute_quality(t, network.p), abs=1e-4) for i, t in rows)


def test_quality_learns_from_the_end_of_long_texts():
    rng = random.Random(18)
    rows = [(words(rng, 900) + ("###" * 300 if k % 2 else " plain"), 1 - k % 2) for k in range(60)]
    network = quality_cnn.Network().fit(rows[:40])
    assert np.mean((network.scores([t for t, _ in rows[40:]]) >= 0.5) == [y for _, y in rows[40:]]) > 0.9


def test_quality_gradients_agree_with_differences():
    network = quality_cnn.Network(3)
    chunks = np.concatenate([quality_cnn.chunks_of("some text with ### marks"), quality_cnn.chunks_of("other é text")])
    owner, y = np.array([0, 1]), np.array([1.0, 0.0], dtype=np.float32)

    def loss():
        f, _, _ = network.convolve(chunks)
        logit = network.combine(f, f)[2].astype(np.float64)
        return np.mean(np.log1p(np.exp(logit)) - y * logit)

    grads = network.gradients(chunks, owner, y)
    for name in ("filters", "hidden", "bias", "out"):
        flat = network.p[name].reshape(-1)
        at = int(np.abs(grads[name]).argmax())
        old = flat[at]
        flat[at] = old + 1e-2
        up = loss()
        flat[at] = old - 1e-2
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-2 - grads[name].reshape(-1)[at]) < 0.02 * max(1e-2, abs((up - down) / 2e-2))


def test_suffix_automaton_accepts_exactly_the_substrings():
    codes = np.array([2, 3, 2, 2, 3, 4, 2], dtype=np.uint8)
    goto = langid.automaton(codes)
    inside = {tuple(codes[a:b].tolist()) for a in range(7) for b in range(a + 1, 8)}
    for n in (1, 2, 3, 4):
        for word in itertools.product((2, 3, 4), repeat=n):
            state = 0
            for c in word:
                state = None if state is None else goto[state].get(c)
            assert (state is not None) == (word in inside)


def brute_phrases(codes, train):
    """Phrases of one greedy parse of the whole text into the longest pieces that train holds."""
    count, word = 1 if codes else 0, b""
    for c in codes:
        c = bytes([c])
        if word + c in train:
            word += c
        else:
            count += 1
            word = c if c in train else b""
    return count


@pytest.mark.parametrize("lane", [8_192, 300])
def test_phrases_match_brute_force(monkeypatch, lane):
    monkeypatch.setattr(langid, "LANE", lane)
    rng = random.Random(9)
    samples = {"x": bytes(rng.choices(b"abc ", k=300)), "y": bytes(rng.choices(b"abd", k=90)), "z": b"a"}
    texts = [bytes(rng.choices(b"abcde ", weights=[9, 9, 9, 3, 1, 2], k=n)) for n in (1, 5, 40, 256, 300, 301, 2_000)] + [b""]
    parser = langid.Parser({k: np.frombuffer(v, dtype=np.uint8) for k, v in samples.items()})
    got = parser.phrases([np.frombuffer(t, dtype=np.uint8) for t in texts])
    assert got.tolist() == [[brute_phrases(t, samples[lang]) for t in texts] for lang in parser.langs]


def test_texts_are_spelled_in_letters():
    said = lambda t: langid.spelled(t).tobytes().decode()
    assert said("  Ab--C, d1") == "ab c d " and said("É$$ñ") == "é ñ" and said("123 $") == "" and said("") == ""
    assert said("\U00010330\U00010331!") == "\U00010330\U00010331 "


def test_languages(spark):
    rng = random.Random(10)
    make = lambda syllables, n: " ".join("".join(rng.choices(syllables, k=3)) for _ in range(n))
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["str", "eng", "auf"], "cc": ["ção", "nha", "lhe"]}
    rows = [(k, make(kinds[lang], 60), lang) for k, lang in enumerate(list(kinds) * 20)] + [(100, None, "aa"), (101, "", "bb"), (102, "12 34 !", "cc"), (103, make(kinds["bb"], 40), None), (103, make(kinds["bb"], 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify_languages(docs, F.col("doc_id") % 2 == 0).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.id: r.lang_pred for r in got}
    assert all(by_id[i] == lang for i, _, lang in rows[:60]) and [by_id[i] for i in (100, 101, 102, 103)] == ["und", "und", "und", "bb"]
    assert {r.lang_pred for r in langid.identify_languages(docs, F.lit(False)).collect()} == {"und"}


def brute_language(text, samples):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    spelt = re.sub(" +", " ", letters).lstrip().encode()
    cost = {lang: brute_phrases(spelt, own) * np.log2(len(own) + 2) for lang, own in samples.items()}
    return min(sorted(cost), key=cost.get) if letters.strip() else "und"


def test_languages_match_brute_force(spark):
    """The whole query: samples, spelling, parse and choice, with scripts past any small alphabet and a language of one short text."""
    rng = random.Random(12)
    block = lambda start, n: [chr(start + k) for k in range(n)]
    kinds = {"cjk": block(0x4E00, 900), "got": block(0x10330, 20), "hang": block(0xAC00, 600), "lat": list("abcdefgh")}
    make = lambda lang, n: " ".join("".join(rng.choices(kinds[lang], k=4)) for _ in range(n))
    rows = [(k, make(lang, 25), lang) for k, lang in enumerate(["cjk", "hang", "lat"] * 12)] + [(50, make("got", 3), "got"), (51, make("got", 30), None), (52, "7 $", "lat"), (53, None, "lat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = (F.col("doc_id") % 3 != 1) | (F.col("doc_id") >= 50)
    texts = langid.samples_of(docs.where(train).select("lang", "text"))
    learned = {lang: {t for i, t, own in rows if own == lang and t and (i % 3 != 1 or i >= 50)} for lang in texts}
    assert all(set(texts[lang].split("\n")) == {t for t in learned[lang] if any(c.isalpha() for c in t)} for lang in texts)
    samples = {lang: langid.spelled(t).tobytes() for lang, t in texts.items()}
    got = {r.id: r.lang_pred for r in langid.identify_languages(docs, train).collect()}
    assert got == {i: "und" if not t else brute_language(t, samples) for i, t, _ in rows}
    assert got[51] == got[50] == "got" and got[52] == got[53] == "und"


def test_training_texts_are_whole(spark, monkeypatch):
    monkeypatch.setattr(langid, "TRAIN_CHARS", 100)
    rows = [("a", "x" * 90), ("a", "y" * 300), ("b", "z" * 500), ("b", "w" * 400), ("c", "12"), (None, "v")]
    got = langid.samples_of(spark.createDataFrame(rows, "lang string, text string"))
    assert got == {"a": "x" * 90, "b": "w" * 400}


def brute_log_prob(text, model, counts):
    """Sum over the words of the log of the product of turns, by plain loops over both sides."""
    net, found = model.network, text.lower().split()
    ids = [int(masked_lm.leaves(masked_lm.buckets([w.encode()])[0], model.head)[0]) for w in found]
    total = 0.0
    for k, leaf in enumerate(ids):
        z = net.p["mix"][-1, : masked_lm.EMBED].astype(float)
        sides = [k + d for d in range(-masked_lm.RADIUS, masked_lm.RADIUS + 1) if d]
        for place, at in enumerate(sides):
            side = ids[at] if 0 <= at < len(ids) else net.padding
            z = z + net.p["mix"][place, : masked_lm.EMBED] * net.p["in"][side, : masked_lm.EMBED]
        h = np.tanh(z)
        for step in range(net.starts[leaf], net.starts[leaf + 1]):
            own = net.p["out"][net.nodes[step]]
            total -= np.log1p(np.exp(-net.turns[step] * (own[: masked_lm.EMBED] @ h + own[masked_lm.EMBED])))
        if leaf == len(model.head):
            total += np.log((counts.get(found[k], 0) + masked_lm.SMOOTH) / model.mass)
    return total


def test_masked_lm(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "BATCH", 8)
    rng = random.Random(11)
    order = [f"w{k}" for k in range(12)]
    fluent = [" ".join(order[(k + j) % 12] for j in range(200)) for k in range(30)]
    shuffled = " ".join(rng.sample(fluent[0].split(), 200))
    rows = [*enumerate(fluent), (50, None), (51, ""), (52, "w1"), (52, "w1"), (None, "zzz unseen"), (2**60 + 1, shuffled)]
    docs = documents(spark, rows)
    model = masked_lm.train(documents(spark, rows[:-1]))
    got = {r.id: r for r in masked_lm.score_documents(docs, model).collect()}
    assert len(got) == len({i for i, _ in rows})
    assert got[50].n_tokens == 0 and got[50].log_prob == 0 and got[50].mean_log_prob is None
    assert got[0].mean_log_prob > got[2**60 + 1].mean_log_prob + 0.5
    for i, text in rows:
        if text:
            assert got[i].log_prob == pytest.approx(brute_log_prob(text, model, {}), abs=1e-2)


def test_lm_words_are_told_apart_beyond_any_table():
    n = 400_000
    names, counts = masked_lm.buckets([" ".join(f"w{k}" for k in range(n)).encode()])
    assert counts.tolist() == [n] and len(np.unique(names)) == n


def test_lm_counts_of_words_past_the_head_are_exact(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "HEAD", 3)
    texts = ["a a a a b b b c c d", "a b c d e E", "f " * 2 + "a", "", None]
    model = masked_lm.train(documents(spark, [*enumerate(texts)]))
    rows = [*enumerate(texts[:3]), (9, "a unseen f")]
    got = {r.id: r.log_prob for r in masked_lm.score_documents(documents(spark, rows), model).collect()}
    count = {"a": 6, "b": 4, "c": 3, "d": 2, "e": 2, "f": 2}
    assert set(model.head.tolist()) == set(masked_lm.buckets([b"a b c"])[0].tolist())
    assert model.mass == sum(count[w] + masked_lm.SMOOTH for w in "def") + masked_lm.SMOOTH
    for i, text in rows:
        assert got[i] == pytest.approx(brute_log_prob(text, model, count), abs=1e-4)


def test_lm_probabilities_sum_to_one_and_start_as_frequencies():
    counts = np.array([50.0, 3, 20, 1, 7, 7, 12])
    net = masked_lm.WindowNetwork(counts)
    sides = np.array([[0, 1, 2, 3], [7, 7, 6, 5]])
    every = lambda: np.stack([net.log_p(np.repeat(s[None], 7, axis=0), np.arange(7)) for s in sides])
    assert np.allclose(np.exp(every()), counts / counts.sum(), atol=1e-6)
    net.learn(np.repeat(sides, 50, axis=0), np.repeat([3, 0], 50))
    assert np.allclose(np.exp(every()).sum(axis=1), 1, atol=1e-5) and every()[0, 3] > np.log(1 / 100)


@pytest.mark.parametrize("top", [2, 64])
def test_lm_gradients_agree_with_differences(monkeypatch, top):
    monkeypatch.setattr(masked_lm, "TOP", top)
    rng = np.random.default_rng(2)
    net = masked_lm.WindowNetwork(np.arange(1.0, 9.0))
    net.p["out"][:, : masked_lm.EMBED] = rng.standard_normal((7, masked_lm.EMBED)) / 3
    sides, words = rng.integers(0, 9, (20, 4)), rng.integers(0, 8, 20)
    for name, (rows, g, _) in net.gradients(sides, words).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        place = (rows[at[0]], at[1])
        loss = []
        for move in (1e-2, -2e-2):
            net.p[name][place] += move
            loss.append(-net.log_p(sides, words).sum())
        net.p[name][place] += 1e-2
        assert (loss[0] - loss[1]) / 2e-2 == pytest.approx(g[at], rel=0.02)


@pytest.mark.parametrize("top", [3, 64])
def test_lm_pass_reaches_every_word_and_equals_one_task(spark, monkeypatch, top):
    """A pass with one task is plain training; with several, every word's path still moves."""
    monkeypatch.setattr(masked_lm, "EVERY", 1)
    monkeypatch.setattr(masked_lm, "TOP", top)
    rows = [(k, words(random.Random(k), 30 + k)) for k in range(40)]
    texts = documents(spark, rows).select("text")
    head, counts, rest, n_rest = masked_lm.head_of(masked_lm.word_counts(texts))
    fresh = lambda: masked_lm.WindowNetwork(np.append(counts, rest + 1.0))
    alone, several, plain = fresh(), fresh(), fresh()
    start = plain.p["out"].copy()
    masked_lm.one_pass(texts.coalesce(1), head, alone)
    masked_lm.one_pass(texts.repartition(4), head, several)
    found, n = masked_lm.buckets([t.encode() for _, t in rows])
    ids = masked_lm.leaves(found, head)
    order = np.random.default_rng(len(ids)).permutation(len(ids))
    plain.learn(masked_lm.windows(ids, n, plain.padding)[order], ids[order])
    assert all(np.allclose(alone.p[k], plain.p[k], atol=1e-4) for k in plain.p)
    assert (several.p["out"] != start).any(axis=1).all()


def test_lm_learns_from_every_window(spark):
    """As it is set, a pass of one task is training on the windows of all words."""
    rows = [(k, words(random.Random(k), 30 + k)) for k in range(10)]
    texts = documents(spark, rows).select("text")
    head, counts, rest, n_rest = masked_lm.head_of(masked_lm.word_counts(texts))
    trained, plain = (masked_lm.WindowNetwork(np.append(counts, rest + 1.0)) for _ in range(2))
    masked_lm.one_pass(texts.coalesce(1), head, trained)
    found, n = masked_lm.buckets([t.encode() for _, t in rows])
    ids = masked_lm.leaves(found, head)
    order = np.random.default_rng(len(ids)).permutation(len(ids))
    plain.learn(masked_lm.windows(ids, n, plain.padding)[order], ids[order])
    assert all(np.allclose(trained.p[k], plain.p[k], atol=1e-4) for k in plain.p)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_lm_words_are_looked_up_by_their_first_bits(n):
    """Names at both ends, and many that begin alike."""
    rng = np.random.default_rng(6)
    ends = np.array([-(2**63), -1, 0, 2**63 - 1])
    head = np.unique(np.concatenate([ends, rng.integers(-(2**63), 2**63 - 1, 5000), np.arange(40)]))[:n]
    found = np.concatenate([ends, head, head + 1, rng.integers(-(2**63), 2**63 - 1, 1000), np.arange(50)])
    place = {int(w): k for k, w in enumerate(head)}
    want = [place.get(int(w), len(head)) for w in found]
    assert masked_lm.leaves(found, head).tolist() == masked_lm.leaves(found, head, masked_lm.lookup(head)).tolist() == want


@pytest.mark.parametrize("most", [40, 1 << 17])
def test_lm_sums_of_many_batches_match_plain_addition(most):
    rng = np.random.default_rng(4)
    sizes = np.array([60, 1, 45])
    rows = np.minimum(rng.zipf(1.3, sizes.sum()), 40) - 1
    values = rng.standard_normal((len(rows), 3)).astype(np.float32)
    for own, a, n in zip(masked_lm.sums_of(rows, sizes, most), np.cumsum(sizes) - sizes, sizes, strict=True):
        plain, times = np.zeros((40, 3)), np.zeros(40)
        np.add.at(plain, rows[a : a + n], values[a : a + n])
        np.add.at(times, rows[a : a + n], 1)
        assert sorted(own.rows) == np.flatnonzero(times).tolist() and (own.n == times[own.rows]).all()
        assert np.allclose(own.of(values[a : a + n]), plain[own.rows], atol=1e-5)


@pytest.mark.parametrize("top", [2, 64])
def test_lm_learning_in_laid_out_batches_matches_a_plain_loop(monkeypatch, top):
    """Batches laid out together, of which the last is short, move every row as a loop over words and turns does."""
    for name, value in (("TOP", top), ("BATCH", 16), ("TOGETHER", 3), ("OFTEN", 2)):
        monkeypatch.setattr(masked_lm, name, value)
    rng = np.random.default_rng(5)
    net = pickle.loads(pickle.dumps(masked_lm.WindowNetwork(np.arange(1.0, 13.0) ** 2)))
    net.p["out"][:, : masked_lm.EMBED] = rng.standard_normal((11, masked_lm.EMBED)) / 3
    plain, grown = ({k: v.astype(float) for k, v in own.items()} for own in (net.p, net.grown))
    sides, found = rng.integers(0, 13, (120, 4)), rng.integers(0, 12, 120)
    for a in range(0, 120, 16):
        g, n = {k: np.zeros_like(v) for k, v in plain.items()}, {k: np.zeros(len(v)) for k, v in plain.items()}
        for side, word in zip(sides[a : a + 16], found[a : a + 16], strict=True):
            h = np.tanh((plain["in"][side] * plain["mix"][:4]).sum(axis=0) + plain["mix"][4])
            h[-1] = 1
            dh = np.zeros_like(h)
            for step in range(net.starts[word], net.starts[word + 1]):
                node, turn = net.nodes[step], net.turns[step]
                d = -turn / (1 + np.exp(turn * (plain["out"][node] @ h)))
                dh += d * plain["out"][node]
                g["out"][node] += d * h
                n["out"][node] += 1
            dz = dh * (1 - h * h)
            for place, row in enumerate(side):
                g["in"][row] += dz * plain["mix"][place]
                n["in"][row] += 1
                g["mix"][place] += dz * plain["in"][row]
            g["mix"][4] += dz
            n["mix"] += 1
        for k in plain:
            met = n[k] > 0
            step = g[k][met] / np.sqrt(n[k][met])[:, None]
            grown[k][met] += (step * step).mean(axis=1)
            plain[k][met] -= masked_lm.RATE / np.sqrt(grown[k][met])[:, None] * step
    net.learn(sides, found)
    assert all(np.allclose(net.p[k], plain[k], atol=1e-3) and np.allclose(net.grown[k], grown[k], rtol=1e-3) for k in plain)


def test_lm_words_past_the_head_are_not_shuffled_to_be_counted(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "HEAD", 1)
    docs = documents(spark, [(1, "a a a b b c"), (2, "c c d")])
    scored = masked_lm.score_documents(docs, masked_lm.train(docs))
    assert "hashpartitioning(uid#" in (plan := scored._jdf.queryExecution().executedPlan().toString()) and not re.search(r"hashpartitioning\(uid#\d+L, h#", plan)


def test_lm_windows_stay_within_their_text():
    sides = masked_lm.windows(np.array([1, 2, 3], dtype=np.int32), np.array([2, 0, 1]), 9)
    assert sides.tolist() == [[9, 9, 2, 9], [9, 1, 9, 9], [9, 9, 9, 9]]


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    """Water-filling in a plain loop: share by weight, cap, share the excess again."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight, left, free, target = {s: weights[k % 3] for k, s in enumerate(order)}, float(sum(sizes.values())), list(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        free = [s for s in free if s not in over]
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 100}, {"a": 5}, {}, {"a": 0, "b": 0}, {f"s{k:02}": k * k for k in range(40)}, {"é": 7, "z": 3, "A": 900, "a": 1}])
def test_targets_match_water_filling(spark, sizes):
    totals = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(totals).collect()}
    want = brute_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def brute_mix(rows, keys):
    """Complete epochs, then whole documents in key order up to the target, the one across it in part."""
    sizes, own = {}, {}
    for k, (_, text, source, *_) in enumerate(rows):
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
        own.setdefault(source, []).append(k)
    taken = {}
    for source, target in brute_targets(sizes).items():
        epochs = int(target // sizes[source]) if sizes[source] else 0
        rest = target - epochs * sizes[source]
        for k in sorted(own[source], key=lambda k: keys[k]):
            n = len((rows[k][1] or "").split())
            part = min(n, max(0, int(rest)))
            rest -= n
            taken[k] = epochs * n + part
    return taken


def test_mixture(spark):
    rng = random.Random(12)
    rows = [(k, words(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "c", None]), 1.0 if k % 2 else 0.1) for k in range(600)] + [(700, None, "a", None), (701, None, "a", 0.5), (None, "x y", "b", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, w double").withColumn("size", F.lit("clash")).withColumn("quality", F.lit("clash"))
    got = mixing.mix(docs, F.col("w")).collect()
    assert sorted(got, key=repr) == sorted(mixing.mix(docs, F.col("w")).collect(), key=repr) and len(got) == len(rows)
    # the reference selection by plain loops, from the same uniform numbers
    from quillon.llm.common import unit_hash

    u = {r.doc_id: r.u for r in docs.select("doc_id", unit_hash(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")), seed=5).alias("u")).collect()}
    weight = lambda w: max(mixing.USUAL if w is None else w, mixing.FLOOR)
    taken = brute_mix(rows, [-np.log(u[i]) / weight(w) for i, _, _, w in rows])
    assert {r.id: r.taken for r in got} == {rows[k][0]: n for k, n in taken.items()}
    size = {}
    for _, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    target = brute_targets(size)
    for s in size:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {size[s]} and abs(own[0].target - target[s]) < 1e-6
        assert abs(sum(r.taken for r in own) - target[s]) < 1
        assert all(r.taken <= 3 * r.size for r in own)
    picked = lambda odd: np.mean([r.taken % max(r.size, 1) == 0 and r.taken > 0 for r in got if r.source == "c" and r.id is not None and r.size and r.id % 2 == odd])
    assert picked(1) > picked(0)
    again = mixing.mix(spark.createDataFrame([(5, "a b c", "s"), (5, "a b c", "s"), (6, "", "t")], "doc_id long, text string, source string")).collect()
    assert sorted((r.id, r.taken) for r in again) == [(5, 3), (5, 3), (6, 0)]
    assert mixing.mix(docs.limit(0)).collect() == []


def test_warc_round_trip(spark, tmp_path):
    rows = [(3, "http://a/\n", "<p>é same</p>"), (1, None, "<p>é same</p>"), (2, "u", None), (5, "u", ""), (4, "u", "WARC/1.1\r\nnot a record\r\n\r\n"), (None, "n", "<p>é same</p>"), (2**60 + 1, "u", "x" * 200_000), (4, "u", "WARC/1.1\r\nnot a record\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = warc.write_archives(pages, f"file://{tmp_path}/archive")
    got = warc.read_archives(spark, path).collect()
    assert not [r for r in got if r.reason] and len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for r in got:
        bodies = {h or "" for i, _, h in rows if i == r.page_id}
        body = bodies.pop()
        assert r.payload_bytes == len(body.encode()) and r.payload_digest == warc.base32_sha1(body.encode())
        if r.page_id is not None:
            assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == first[body] else ("revisit", first[body]))
    for file in (tmp_path / "archive").glob("part-*"):
        gzip.decompress(file.read_bytes())  # a valid concatenation of members


@pytest.mark.parametrize("small", [True, False])
def test_archives_are_cut_by_bytes(spark, tmp_path, monkeypatch, small):
    monkeypatch.setattr(warc, "FILE_BYTES", 4_000)
    monkeypatch.setattr(warc, "is_small", lambda df: small)
    rng = random.Random(19)
    rows = [(k, "u", "same" if k % 3 == 0 else words(rng, 900 if k > 40 else 3)) for k in range(60)]
    path = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), f"file://{tmp_path}/archive")
    sizes = [f.stat().st_size for f in (tmp_path / "archive").glob("part-*")]
    assert len(sizes) > 5 and max(sizes) < 4_000 + 2_000
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(spark, path).collect()}
    assert got == {i: ("revisit", 0) if t == "same" and i else ("response", None) for i, _, t in rows}


def test_a_lost_page_ends_the_query(spark, tmp_path, monkeypatch):
    from quillon.llm import queries

    rows = [(k, "u", f"page {k}") for k in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    assert queries.op7_warc_salvage(spark, f"file://{tmp_path}").count() == 6
    real = warc.member
    monkeypatch.setattr(queries, "archived", lambda pages: warc.read_archives(spark, damaged(warc.write_archives(pages, f"file://{tmp_path}/damaged"))))

    def damaged(path):
        for f in (tmp_path / "damaged").glob("part-*"):
            data = bytearray(f.read_bytes())
            data[len(data) // 2] ^= 0xFF
            f.write_bytes(bytes(data))
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
        return path

    with pytest.raises(Exception, match="unreadable archive"):
        queries.op7_warc_salvage(spark, f"file://{tmp_path}").collect()
    assert real is warc.member


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_what_damage_leaves(packed):
    parts = [warc.record(str(k), "u", f"body {k} ".encode() * 50, None) for k in range(6)]
    parts = [warc.member(p) for p in parts] if packed else parts
    whole = warc.salvage(b"".join(parts))
    assert [r.headers["warc-record-id"] for r in whole.records] == [f"<urn:page:{k}>" for k in range(6)] and not whole.gaps
    offsets = np.cumsum([0] + [len(p) for p in parts])
    damaged = bytearray(b"".join(parts))
    damaged[offsets[2] + len(parts[2]) // 2] ^= 0xFF  # a bit of record 2's body
    del damaged[offsets[4] + 5 : offsets[4] + 25]  # a cut in record 4
    found = warc.salvage(bytes(damaged))
    assert [r.headers["warc-record-id"] for r in found.records] == [f"<urn:page:{k}>" for k in (0, 1, 3, 5)]
    assert [(a, n) for a, n, _ in found.gaps] == [(offsets[2], len(parts[2])), (offsets[4], len(parts[4]) - 20)]
    assert [r.offset for r in found.records] == [0, offsets[1], offsets[3], offsets[5] - 20]
    junk = warc.salvage(b"garbage" + parts[0] + b"\x1f\x8b\x08tail")
    assert len(junk.records) == 1 and [g[:2] for g in junk.gaps] == [(0, 7), (7 + len(parts[0]), 7)]
    assert warc.salvage(b"") == warc.Salvage()


def test_empty_tables(spark):
    none = documents(spark, []).limit(0)
    assert minmax_dedup.near_duplicates(none).count() == 0
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert pfp_dedup.remove_repeats(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(documents(spark, [(1, "some text here")]), items).count() == 0
    assert masked_lm.score_documents(none, masked_lm.train(none)).count() == 0
    assert langid.identify_languages(none, F.lit(True)).count() == 0
    assert toxicity.score_toxicity(none, toxicity.fit([])).count() == 0
    assert quality_cnn.score_quality(none, quality_cnn.Network().fit([])).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(pages).count() == 0
