"""Graphs, changes, streams and texts on hand-written frames: what must be refused, repeated or left alone."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import changes as C
from lorekeep.operators import design as B
from lorekeep.operators import excerpts as X
from lorekeep.operators import folders as D
from lorekeep.operators import graphs as G
from lorekeep.operators import influence as I
from lorekeep.operators import search as S
from lorekeep.operators import transfers as R
from lorekeep.operators import vectors as N


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


def test_cycles_of_a_complete_graph_and_of_large_components(spark):
    whole = spark.range(40).alias("a").join(spark.range(40).alias("b"), F.col("a.id") != F.col("b.id")).select(F.col("a.id").alias("child"), F.col("b.id").alias("parent"))
    found = G.hierarchy_cycles(whole)
    assert found.count() == 40 * 39 // 2 and found.where("length != 2 or size != 40 or component != 0").isEmpty()
    ring = spark.range(30).select(F.col("id").alias("child"), ((F.col("id") + 1) % 30).alias("parent"))
    large = G.hierarchy_cycles(ring.unionByName(spark.createDataFrame([(50, 50), (60, 61)], "child long, parent long")), most=10)
    assert rows(large, "component", "size", "cycle") == [(0, 30, None), (50, 1, [50])]
    assert G.hierarchy_cycles(ring.limit(0)).collect() == []


def test_a_name_in_texts_without_copies_of_them(spark):
    parts = spark.createDataFrame([(1, "ab"), (2, "b"), (3, "abc"), (4, "zzz"), (5, "")], "part_id long, part string")
    wholes = spark.createDataFrame([(1, "xabcx"), (2, "b"), (3, ""), (4, "ab" * 5000)], "whole_id long, whole string")
    assert rows(S.contained(parts, wholes), "part_id", "whole_id") == [(1, 1), (1, 4), (2, 1), (2, 2), (2, 4), (3, 1)]
    assert S.contained(parts.limit(0), wholes).collect() == []


def test_receipts_with_a_payload_of_any_name(spark):
    receipts = [('{"nodes": []}', "ok"), ('{"by_document": 0}', "ok"), ('{"data": [1]}', "ok_brief"), ('{"candidates": 1}', "ok_brief"), ("{}", "silent")]
    frame = spark.createDataFrame(receipts, "receipt string, want string").withColumn("shape", S.result_shape(F.col("receipt"), F.lit(True)))
    assert frame.where("shape != want").isEmpty()


def test_services_against_dependencies(spark):
    services = spark.createDataFrame([("s1", ["need"], ["e1"]), ("s2", [], ["e1", "e2"])], "service string, derived_from array<string>, entities array<string>")
    own = spark.createDataFrame(
        [("s1", "客户.证件号码（主）", "自维护"), ("s2", "`证件号码`", "自维护"), ("s2", "bmm:Thing.Name", "自维护"), ("s1", "x", "sometimes"), ("s1", "y", "只读缓存")],
        "service string, attribute string, way string",
    )
    ends = spark.createDataFrame([("f1", "determinant", "证件号码"), ("f1", "dependent", "name"), ("f2", "determinant", "nobody")], "title string, role string, attribute string")
    keys = spark.createDataFrame([("s1", "证件号码 + z"), ("s2", "q")], "service string, keys string")
    found = rows(B.dependency_check(services, own, keys, ends), "check", "severity", "subject", "detail")
    assert found == sorted([
        ("F1", "critical", "证件号码", "s1,s2"), ("F1", "low", "s1", "x:sometimes"), ("F2", "medium", "f2", "nobody"), ("F4", "high", "s2", "q"), ("F5", "high", "s2", ""), ("F6", "medium", "s2", "e1,e2"),
    ], key=repr)  # s2 owns the determinant too, so it may own the dependent
    assert not any(r.check == "F4" for r in B.dependency_check(services, own, keys, ends.limit(0)).collect())


def test_excerpts_are_words_of_the_section_or_refused(spark):
    text = "# 背景\n\n" + "背景内容。" * 30 + "\n\n## 业务目标\n\n" + "提高评审效率。" * 30 + "\n\n### inner\nmore\n## 范围\n\n不应被取到。\n## empty\n## later\n（无原文片段）"
    lines = spark.createDataFrame([(1, n, line) for n, line in enumerate(text.split("\n"))], "doc long, place int, line string")
    asked = spark.createDataFrame([(1, s) for s in ("业务 目标", "目标", "none", "empty", "later", "", None)], "doc long, section string")
    got = {r.section: r for r in X.excerpts(lines, asked).collect()}
    assert (got["业务 目标"].matched_by, got["业务 目标"].chars, got["业务 目标"].truncated) == ("section_exact", 150, True)
    assert got["业务 目标"].text == ("提高评审效率。" * 30)[:150]
    assert got["目标"].matched_by == "section_contains" and got["none"].code == "section_not_found" and "业务目标|inner" in got["none"].available
    assert (got["empty"].code, got["later"].code) == ("source_empty", "source_placeholder")
    assert got[""].matched_by == "first_paragraph" and got[""].text.startswith("背景内容") and len(got) == 6


def test_values_keep_their_commas_and_headings(spark):
    told = [
        "## 属性（数据属性）", "### 名称（bmm:name，xsd:string）", "line one", "## not a section", "- bmm:size of it = 3, 4", "dropped", "### empty", "## 用途", "### bmm:late", "x",
        "## 关系限定（边属性）", "- 有（`o:has`）→ [[p/1|P]]：crudKind=C,U，o:key=a,b；note=x", "- broken", "## 本体关系", "- 有（`o:has`）→ [P](wiki:p/1)", "- 有（`o:by`）→ [[s/1|S 1]]", "- plain", "## end", "- 有（`o:has`）→ [Q](wiki:q)",
    ]
    lines = spark.createDataFrame([(1, n, line) for n, line in enumerate(told)], "doc long, place int, line string")
    assert rows(X.attributes(lines), "name", "value") == [("name", "line one\n## not a section"), ("size", "3, 4")]
    assert rows(X.relation_qualifiers(lines), "slug", "name", "value") == [("p/1", "crudKind", "C,U"), ("p/1", "note", "x"), ("p/1", "o:key", "a,b")]
    assert rows(X.relation_lines(lines), "rel", "slug", "target") == [("o:by", "s/1", "S 1"), ("o:has", "p/1", "P")]


def test_off_chain_rules_are_never_returned(spark):
    pair = lambda data, names: spark.createDataFrame(data, names)
    out = I.influencer_chain(
        pair([(1, "risk"), (2, "nothing")], "ask_id long, q string"), pair([("i1", "Big risk"), ("i2", "other")], "slug string, name string"),
        pair([("i1", "p1"), ("i1", "m1"), ("i2", "p9")], "influencer string, means string"), pair([("p1",), ("p2",), ("p9",)], "slug string"),
        pair([("p2", "p1"), ("p1", "p2")], "child string, parent string"), pair([("p2", "r1"), ("p9", "r9"), ("m1", "r8")], "policy string, rule string"),
    )
    assert rows(out, "ask_id", "means", "policy", "rule") == [(1, "m1", None, None), (1, "p1", "p1", None), (1, "p1", "p2", "r1")]


def test_metadata_is_walked_to_any_depth(spark):
    frame = spark.createDataFrame([("a", '{"x": [{"y": ["k", 1, null]}, "k"], "z": "k", "n": {"m": {"o": "k"}}}'), ("b", "{broken"), ("c", None), ("d", '"k"')], "page string, json string")
    assert rows(C.json_leaves(frame, "json"), "page", "path") == [("a", "$.n.m.o"), ("a", "$.x[0].y[0]"), ("a", "$.x[1]"), ("a", "$.z"), ("d", "$")]


def base(spark):
    pages = spark.createDataFrame([("index", False, False, False), ("a", False, False, True), ("b", False, True, True), ("c", True, False, True), ("d", False, False, True)], "slug string, deleted boolean, imported boolean, entity boolean")
    index = spark.createDataFrame([("d", "live"), ("d", "missing")], "slug string, status string")
    revisions = spark.createDataFrame([("r1", "a"), ("r2", "gone")], "slug string, page string")
    lines = spark.createDataFrame([("d", 1, "r", "b"), ("d", 2, "r", "b"), ("d", 3, "r", "zz"), ("d", 4, "r", "d")], "page string, place long, rel string, dst string")
    return [pages, index, revisions, lines, spark.createDataFrame([("a",), ("zz",)], "slug string")]


def test_a_clean_up_is_refused_once_its_tables_have_changed(spark):
    tables, kinds = base(spark), ["pages", "rows", "edges", "graph"]
    plan = C.clean_up_rows(*tables)
    assert rows(plan.where("kind != 'init'"), "part", "subject", "place") == sorted([
        ("no_source", "a", None), ("mixed", "d", None), ("soft_deleted", "c", None), ("orphan_revision", "r2", None), ("repeated", "d", 2), ("dangling", "d", 3), ("self_loop", "d", 4), ("orphan_node", "zz", None),
    ], key=repr)
    told = C.plan_id(plan, kinds)
    assert told == C.plan_id(plan.orderBy(F.desc("subject")), kinds)
    left = C.apply_clean_up(*tables, kinds, told)
    assert rows(left["pages"], "slug") == [("b",), ("d",), ("index",)] and rows(left["lines"], "place") == [(1,)] and left["index"].count() == 1
    with pytest.raises(ValueError):
        C.apply_clean_up(tables[0].where("slug != 'a'"), *tables[1:], kinds, told)
    with pytest.raises(ValueError):
        C.plan_id(plan, ["init", "pages"])


def test_a_second_run_changes_no_folder(spark):
    pages = spark.createDataFrame([("p1", ["a", " b ", ""]), ("p2", ["a", "c"]), ("p3", [])], "slug string, category_path array<string>")
    old = spark.createDataFrame([("x", "a", "", 0, 0), ("y", "a", "", 0, 0), ("z", "gone", "", 0, 1)], "id string, path string, parent_id string, depth int, sort_order int")
    first = D.reconciled_folders(pages, old, "kb")
    assert rows(first, "path", "action") == [("a", "keep"), ("a", "prune"), ("a/b", "insert"), ("a/c", "insert"), ("gone", "prune")]
    again = D.reconciled_folders(pages, first.where("action != 'prune'").drop("action"), "kb")
    assert again.where("action != 'keep'").isEmpty() and again.count() == 3


def test_an_export_that_was_altered_is_refused(spark, tmp_path):
    folders = spark.createDataFrame([("f1", None, "a", False), ("f2", "f1", "a/b", True)], "id string, parent_id string, path string, deleted boolean")
    R.export_dataset({"folders": folders}, f"{tmp_path}/one")
    schemas = {"folders": "id string, parent_id string, path string"}
    assert rows(R.read_dataset(spark, f"{tmp_path}/one", schemas)["folders"], "id", "parent_id") == [("f1", None)]
    spark.createDataFrame([("f9", "x", "y")], schemas["folders"]).write.mode("append").json(f"{tmp_path}/one/folders")
    with pytest.raises(ValueError):
        R.read_dataset(spark, f"{tmp_path}/one", schemas)


def test_the_nearest_vector_must_stand_alone(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 1)
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [1.0])], "id long, vector array<double>")
    truth = spark.createDataFrame([(10, [5.0, 0.1]), (11, [0.0, 1.0]), (12, [0.0, 3.0]), (13, None)], "id long, vector array<double>")
    assert rows(N.nearest_alone(questions, truth), "question_id", "truth_id") == [(1, 10)]
