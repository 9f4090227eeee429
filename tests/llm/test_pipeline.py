"""The pipeline's stages against plain Python."""

import importlib.util
from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(corpus_pipeline is None or not __import__("os").path.isdir(SF), reason="no pipeline or tables")


def test_stages(spark):
    from test_operators import normal, shingles

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bases = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.quality_stage(spark, docs, SF).cache()
    kept = {r.doc_id for r in good.collect()}
    assert good.columns == columns
    clean = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in clean) / len(clean) > 0.9

    exact = corpus_pipeline.exact_stage(spark, good, SF).cache()
    groups = defaultdict(list)
    for d in kept:
        groups[normal(bases[d])].append((-len(bases[d]), d))
    assert {r.doc_id for r in exact.collect()} == {min(g)[1] for g in groups.values()}

    near = corpus_pipeline.near_stage(spark, exact, SF).cache()
    sets = {min(g)[1]: shingles(bases[min(g)[1]], 5) for g in groups.values()}
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert sorted(r.doc_id for r in near.collect()) == sorted({find(d) for d in sets})

    mixed = corpus_pipeline.mixing_stage(spark, near, SF).cache()
    words = sum(len(bases[find(d)].encode().split()) for d in {find(d) for d in sets})
    taken = sum(len(r.text.encode().split()) for r in mixed.collect())
    assert mixed.columns == columns and abs(taken - words) < 0.2 * words

    packed = corpus_pipeline.packing_stage(spark, mixed, SF)
    ends = packed.where("start + length = doc_tokens").count()
    assert ends == mixed.count()


def test_near_stage_keeps_one_row_of_a_group(spark):
    def text(stem, last):
        return " ".join([f"{stem}{i}" for i in range(60)] + [last])

    rows = [(1, text("a", "x")), (1, text("a", "y")), (2, text("a", "z")), (2, text("b", "x")), (None, text("c", "x"))]
    rows += [(None, text("c", "y")), (None, text("b", "y")), (None, text("d", "x")), (3, ""), (3, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_stage(spark, docs, SF).collect()
    stems = sorted((str(r.doc_id), (r.text or "")[:2]) for r in got)
    assert stems == sorted([("1", "a0"), ("2", "b0"), ("None", "c0"), ("None", "d0"), ("3", ""), ("3", ""), ("None", "")])


def odd_documents(spark):
    from pyspark.sql import functions as F

    plain = "The old house stood near the river and people came there every day"
    rows = [(i, f"{plain} {i} {'and so on ' * (i % 7)}", "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(5, rows[5][1], "en", "s2", 1), (5, rows[5][1], "en", "s2", 1), (None, plain, None, None, None), (None, plain, None, None, None)]
    rows += [(90, None, "en", "s0", 0), (91, "", None, "s1", 0), (92, "word " * 30_000, "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashes = ("quality_score", "row", "rid", "copies", "of_doc", "of_text", "points", "keys_0", "component", "ids", "first", "part", "start")
    return docs.withColumns({c: F.lit(f"keep {c}") for c in clashes})


def test_stages_take_odd_rows_and_clashing_names(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert rows and all(r.quality_score == "keep quality_score" and r.copies == "keep copies" and r.row == "keep row" for r in rows), name
    pieces = corpus_pipeline.packing_stage(spark, docs, SF).collect()
    assert sum(1 for r in pieces if r.start + r.length == r.doc_tokens) == docs.count()
    exact = corpus_pipeline.exact_stage(spark, docs, SF)
    assert exact.count() == 40 + 3  # null and empty texts are equal, repeated rows stay once


def test_stages_of_an_empty_table(spark):
    docs = odd_documents(spark).where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
