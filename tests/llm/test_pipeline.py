"""The pipeline against what its planted documents ask for, stage by stage."""

import random
import re

import pytest

import corpus_pipeline
from quillon.llm import mixing
from quillon.llm.common import table
from quillon.llm.queries import ORACLES, QUERIES, toxicity_model


def words(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def plant(spark, at):
    rng = random.Random(1)
    clean = {k: words(rng, 80) for k in range(60)}
    item = " ".join(f"q{k}" for k in range(20))
    rows = dict(clean)
    rows |= {100 + k: clean[k].replace(" ", "  ") for k in range(5)}  # equal after normalising
    near = clean[7].split()
    near[40] = "edited"
    rows |= {200: " ".join(near), 300: words(rng, 30) + " " + item + " " + words(rng, 30), 400: None, 401: ""}
    toxic = {500 + k: words(rng, 30) + " scumbag vileness " + words(rng, 30) for k in range(40)}
    rows |= toxic
    source = lambda i: f"s{i % 3}"
    docs = spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in [*clean, *toxic]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return rows, clean, source


def test_stages_and_run(spark, tmp_path):
    rows, clean, source = plant(spark, str(tmp_path))
    docs = table(spark, str(tmp_path), "documents")
    kept = [set(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = out
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
    model = toxicity_model(spark, table(spark, str(tmp_path), "documents"), str(tmp_path))
    assert kept[1] == {i for i, t in rows.items() if model.score(t)[0] < 0.5} == set(rows) - set(range(500, 540))
    first = {}
    for i in sorted(kept[1]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    assert kept[2] == set(first.values())
    assert kept[3] == kept[2] - {200} and kept[4] == kept[3] - {300}
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == kept[4] == set(clean) | {400}
    size = {}
    for i in kept[4]:
        size[source(i)] = size.get(source(i), 0) + len((rows[i] or "").split())
    totals = spark.createDataFrame([(s, n) for s, n in size.items()], "source string, source_size long")
    for r in mixing.targets(totals).collect():
        assert abs(sum(x.taken for x in final if x.source == r.source) - r.target) < 1


def odd(spark, rows):
    """Documents with further columns whose names operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, class string, n int"
    return spark.createDataFrame([(i, t, None, None, None, 7, "x", "y", 1) for i, t in rows], schema)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_nulls_and_clashing_columns(spark, tmp_path, name):
    plant(spark, str(tmp_path))
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, odd(spark, []), str(tmp_path)).count() == 0
    rng = random.Random(4)
    own = words(rng, 70)
    rows = [(None, None), (None, own), (1, None), (2, ""), (2, ""), (3, own), (3, own), (4, own + " end"), (5, words(rng, 20_000)), (6, " \t\n"), (None, words(rng, 50))]
    docs = odd(spark, rows)
    out = stage(spark, docs, str(tmp_path))
    left = sorted(((r.doc_id, getattr(r, "text", None)) for r in out.collect()), key=repr)
    if name == "mixing":
        assert [i for i, _ in left] == sorted((i for i, _ in rows), key=repr)
        return
    assert out.columns == docs.columns
    gone = {"exact_dedup": [(1, None), (2, ""), (None, None), (3, own), (None, own)], "near_dedup": [(3, own), (4, own + " end")]}.get(name, [])
    if name == "exact_dedup":  # null, empty: one row stays, of the smallest id
        gone = [(None, None), (2, ""), (2, ""), (3, own), (None, own)]
    assert left == sorted([r for r in rows if r not in gone] + [r for r in set(gone) if gone.count(r) < rows.count(r)], key=repr)


def test_toxicity_without_labels_drops_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.toxicity(spark, odd(spark, [(1, "a"), (2, None)]), str(tmp_path)).count() == 2


def test_registry():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11)) and set(ORACLES) <= set(QUERIES)
