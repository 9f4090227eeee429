"""Semantics that a naive version gets wrong, on hand-written frames."""

from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import audits as A
from lorekeep.operators import documents as D
from lorekeep.operators import evaluation as E
from lorekeep.operators import graphs as G
from lorekeep.operators import lineage as L
from lorekeep.operators import pages as P
from lorekeep.operators import search as S
from lorekeep.operators import texts as X
from lorekeep.operators import windows as W
from lorekeep.operators.traces import common_substrings, match_truth
from lorekeep.sources.logs import read_context_log


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(*values):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def test_p90_takes_a_place(spark):
    for n, want in ((1, 1), (9, 8), (10, 9), (11, 9)):
        assert one(spark, E.p90(array(*range(1, n + 1)))) == want


def test_set_similarities_of_empty_sets(spark):
    empty, some = array(), array("a")
    assert one(spark, T.jaccard(empty, empty)) == 1.0
    assert one(spark, T.jaccard(empty, some)) == 0.0
    assert one(spark, T.set_cosine(empty, some)) == 0.0
    assert one(spark, T.count_cosine(array("a", "a", "b"), array("a"))) > one(spark, T.set_cosine(array("a", "a", "b"), array("a")))


def judged(spark, *sets):
    found = E.compare_sets(*sets)
    return spark.range(1).select(*[c.alias(n) for n, c in found.items()]).first()


def test_any_of_groups(spark):
    none = F.array().cast("array<array<string>>")
    groups = F.array(array("b", "x"), array("z"))
    row = judged(spark, array("a", "x", "q"), array("a", "b"), array("q"), groups)  # x clears b, its copy
    assert (row.n_missing, row.n_extra, row.n_forbidden) == (0, 2, 1)
    assert row.precision == 1 / 3 and row.recall == 1.0 and not row.strict
    row = judged(spark, array("a", "q"), array("a", "b"), array(), groups)
    assert (row.n_missing, row.n_extra, row.precision, row.recall) == (1, 1, 0.5, 0.5)
    assert judged(spark, array("r1", "r2", "r3"), array("r1", "r2", "r3"), array("r9"), none).strict
    assert judged(spark, array("r1", "r2"), array("r1", "r2", "r3"), array("r9"), none).n_missing == 1
    assert judged(spark, array("r1", "r2", "r3", "r4"), array("r1", "r2", "r3"), array("r9"), none).n_extra == 1
    wrong = judged(spark, array("r1", "r2", "r3", "r9"), array("r1", "r2", "r3"), array("r9"), none)
    assert wrong.n_forbidden == 1 and not wrong.strict
    nothing = judged(spark, array(), array(), array(), none)
    assert (nothing.precision, nothing.recall, nothing.f1, nothing.strict) == (0.0, 0.0, 0.0, True)


def test_evidence_score(spark):
    fact = "rule string, status string, confidence string, source_type string, quote string, locator string, required boolean"
    rows = [
        ("full", "present", "high", "doc_table", "q", "p", None),  # .45 + .30 + .15 + .06
        ("words", None, " Medium ", "table", "q", " ", True),  # coverage 1, trust .7, no locator
        ("number", "present", "1.7", "rumour", "q", "p", True),  # clamped to 1, unknown source .5
        ("blocked", "unavailable", "high", "graph", "q", "p", None), ("blocked", "present", "high", "graph", "q", "p", True),
        ("free", "unavailable", "high", "graph", "q", "p", False), ("free", "present", "high", "graph", "q", "p", True),
        ("odd", "guessed", "high", "graph", "q", "p", True), ("verified", "absent_verified", "high", "graph", "q", "p", True),
    ]
    checks = spark.createDataFrame([("number", "supported"), ("number", "unclear"), ("only", "supported")], "rule string, verdict string")
    got = {r.rule: (r.score, r.gate, r.level) for r in E.evidence_score(spark.createDataFrame(rows, fact), checks).collect()}
    assert got["full"] == (0.96, "ok", "high")
    assert got["words"] == (round(0.45 + 0.30 * 0.7 + 0.06, 6), "ok", "medium")
    assert got["number"] == (round(0.45 + 0.15 + 0.15 + 0.10 * 0.65, 6), "ok", "high")
    assert got["blocked"] == (round(0.45 * 0.6 + 0.30 * 0.95 + 0.15 + 0.06, 6), "insufficient", "low")
    assert got["free"][1:] == ("ok", "medium") and got["only"] == (0.1, "insufficient", "low")
    assert got["odd"][0] == round(0.45 * 0.5 + 0.15 + 0.06, 6) and got["verified"][0] == round(0.45 + 0.15 + 0.06, 6)


def test_conformance_keeps_intent_and_fitness_apart(spark):
    rows = [(1, "a", 1), (1, "b", 2), (2, "b", 1), (2, "a", 2), (2, "old", 3), (3, "a", 1), (3, "zzz", 2)]
    calls = spark.createDataFrame([(s, t, n, n) for s, t, n in rows], "session int, tool string, ts int, call_id int")
    got = {r.session: r for r in E.conformance(calls, {"first": ["a"], "second": ["b"]}, ["old"]).collect()}
    assert (got[1].intent, got[1].fitness, got[1].passed) == (1.0, 1.0, True)
    assert (got[2].retired, got[2].intent, got[2].fitness, got[2].passed) == (1, 0.6667, 1.0, False)
    assert (got[3].out_of_scope, got[3].intent, got[3].coverage, got[3].passed) == (1, 0.5, 0.5, False)


def test_common_ancestor_walks_first_parents(spark):
    tree = spark.createDataFrame([(4, 2, True), (5, 3, True), (5, 2, False), (2, 1, True), (3, 1, True)], "child int, parent int, first boolean")
    groups = spark.createDataFrame([("g", 4, True), ("g", 5, False), ("alone", 4, True)], "grp string, node int, first boolean")
    found = G.common_ancestor(groups, G.ancestors(tree.where("first"))).collect()
    assert [(r.grp, r.common) for r in found] == [("g", 1)]  # over all parents it would be 2


def test_context_log_keeps_the_last_value(spark):
    lines = ["request=1 session=old", "request=1 round=1 prompt=9 context=5", "request=1 round=1 prompt=4 actual=7", "request=1 round=1 context=8", "request=1 usage=3", "request=1 session=new usage=4"]
    row = read_context_log(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")).first()
    assert (row.prompt, row.actual, row.context, row.session, row.usages, row.used) == (4, 7, 5, "new", 2, 7)


def test_denied_claims(spark):
    texts = ["系统不存在越权问题。", "系统存在越权问题", "并非越权问题；但有越权问题", "无法符合", "判定符合", "不符合"]
    reports = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "case_id int, text string, steps string")
    cases = spark.createDataFrame([(i, "符合", [], ["越权问题"], [], []) for i in range(6)], "case_id int, expected string, patterns array<string>, forbidden array<string>, markers array<string>, required array<string>")
    got = {r.case_id: r for r in A.score_cases(reports, cases).collect()}
    assert [got[i].clean for i in range(3)] == [True, False, False]
    assert [got[i].verdict for i in (3, 4, 5)] == [True, True, False]


def test_context_signals_are_means_over_all_pairs(spark):
    import itertools
    import math
    from collections import Counter

    texts = ["one text here", "one text there", "", "quite another", "one text here"]
    rels = [["a", "b"], ["a"], [], [], ["b", "a"]]
    rows = spark.createDataFrame([(1, i, t, r) for i, (t, r) in enumerate(zip(texts, rels, strict=True))], "grp int, page_id int, summary string, relations array<string>")

    def cosine(x, y):
        a, b = (Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in (x, y))
        size = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return sum(a[g] * b[g] for g in a) / size if size else 0.0

    def alike(x, y):
        x, y = set(x), set(y)
        return len(x & y) / len(x | y) if x | y else 1.0

    pairs = list(itertools.combinations(range(5), 2))
    assert abs(A.mean_cosine(rows, "summary").first().definition - sum(cosine(texts[i], texts[j]) for i, j in pairs) / 10) < 1e-9
    assert abs(A.mean_jaccard(rows, "relations").first().relations - sum(alike(rels[i], rels[j]) for i, j in pairs) / 10) < 1e-9


def test_truth_is_matched_by_the_more_specific_anchor(spark):
    truth = spark.createDataFrame([
        ("T1", ["n-1"], ["moving servers", "xy"], [], ["which rules for moving servers"]),
        ("T2", ["N-1"], ["servers review"], ["rules"], ["all rules of the servers review policy"]),
    ], "truth_id string, qids array<string>, anchors array<string>, intent array<string>, questions array<string>")
    asked = [("by id", "n-1 ", "anything at all"), ("whole", "", "rules about moving servers please"), ("tie", "", "the rules: serv"), ("longer", "", "rules of a servers revue"), ("no intent", "", "about a servers review"), ("short", "", "xy"), ("none", "", "weather today"), ("blank", "n-1", "")]
    got = {r.question_id: (r.truth_id, r.how) for r in match_truth(spark.createDataFrame(asked, "question_id string, qid string, question string"), truth, 0.62).collect()}
    assert got == {"by id": ("T1", "qid"), "whole": ("T1", "anchor"), "tie": (None, "none"), "longer": ("T2", "anchor"), "no intent": ("T1", "anchor"), "short": ("T1", "anchor"), "none": (None, "none"), "blank": (None, "none")}


def test_groups_of_questions_as_in_one_pass(spark):
    import random

    r = random.Random(3)
    stems = ["which rules apply to moving servers", "who may sign a contract", "list all tasks of the review"]
    rows = []
    for n in range(160):
        text = list(r.choice(stems))
        for _ in range(r.randint(0, 9)):
            text[r.randrange(len(text))] = r.choice("abcdef ")
        rows.append((n, r.choice(["", "", "", "q1", "q2", "q3", "q4"]), "".join(text) if r.random() > 0.05 else "", r.randint(0, 40)))
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} or {t}
    leaders, by_qid, want = [], {}, {}
    for n, qid, core, _ in sorted(rows, key=lambda x: (x[3], x[0])):
        if not core:
            want[n] = by_qid.get(qid, "G0") if qid else "G0"
            continue
        name = by_qid.get(qid) if qid else None
        if name is None:
            scored = [(len(grams(core) & grams(c)) / len(grams(core) | grams(c)), -i) for i, (_, c) in enumerate(leaders)]
            best = max(scored, default=(0.0, 0))
            name = leaders[-best[1]][0] if best[0] >= 0.62 else f"G{n}"
            if best[0] < 0.62:
                leaders.append((name, core))
        if qid:
            by_qid[qid] = name
        want[n] = name
    got = {x.row_id: x.question_group for x in W.group_questions(spark.createDataFrame(rows, "row_id long, qid string, core string, ts int")).collect()}
    assert got == {n: ("G0" if not core else want[n]) for n, _, core, _ in rows} and len(leaders) > 5


def test_plain_text_sections(spark):
    long = "这是一句话。" * 30
    text = f"before\n1.2 First part\nbody one\n\n第三章 总则\n{long}\nShort line\n{'x' * 50}\n2 Empty\n3 Again\nbody one\n4 More\nbody one"
    docs = spark.createDataFrame([(1, text), (2, "no headings here.\nat all."), (3, None), (4, " ")], "doc int, text string")
    got = [(r.doc, r.title, r.number, r.text) for r in D.split_plain_text(docs, 100).orderBy("doc", "place", "part").collect()]
    parts = [long[i : i + 96] for i in range(0, 180, 96)]
    assert got[:1] == [(1, "1.2 First part", "1.2", "body one")]
    assert [g[3] for g in got[1:3]] == parts and {g[1] for g in got[1:3]} == {"第三章 总则"}
    assert got[3:] == [(1, "Short line", "", "x" * 50), (1, "3 Again", "3", "body one"), (2, "", "", "no headings here.\nat all.")]


def test_ties_are_refused(spark):
    scored = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 1.0), ("m", "a", 2.0), ("m", "b", 1.0)], "key string, item string, score double")
    assert [r["item"] for r in E.strict_best(scored, "key", "item").collect()] == ["a"]


def test_missing_is_not_deleted(spark):
    pages = spark.createDataFrame([(1, 1, "t", [1, 2, 3], None)], "kb_id int, slug int, page_type string, source_refs array<int>, updated timestamp")
    docs = spark.createDataFrame([(1, False), (2, True)], "doc_id int, deleted boolean")
    found = {r.doc_id: r.status for r in L.doc_index(pages, docs).collect()}
    assert found == {1: "live", 2: "deleted", 3: "missing"}


def test_session_gap_is_strict(spark):
    rows = [(i, "u", None, f"2024-01-01 00:0{m}:{s:02d}") for i, (m, s) in enumerate([(0, 0), (1, 30), (3, 1)])]
    calls = spark.createDataFrame(rows, "call_id int, user string, label string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.part for r in W.sessionize(calls, 90).orderBy("call_id").collect()] == ["s1", "s1", "s2"]


def test_denied_beats_allowed_and_expired_is_no_denial(spark):
    items = spark.createDataFrame([(1, "A", "1.2"), (2, "A", "1.10"), (3, "B", "1.0"), (4, "A", "9")], "item_id int, software string, version string")
    allow = spark.createDataFrame([(1, "a", "", "1.2", "2", ""), (2, "b", "1.0", None, None, "2020-01-01"), (3, "B", "1.0", None, None, "")], "pos int, software string, version string, low string, high string, expires_at string")
    deny = spark.createDataFrame([("a", "1.2")], "software string, version string")
    found = {r.item_id: r.verdict for r in S.catalog_check(items, allow, deny, "2024-01-01").collect()}
    assert found == {1: "denied", 2: "allowed", 3: "expired", 4: "unknown"}


def test_same_content_is_no_version(spark):
    pages = spark.createDataFrame([("k", "a", "x", ["r"], 3)], "kb_id string, slug string, content string, refs array<string>, version long")
    again = P.upsert_pages(pages, pages.drop("version")).first()
    assert (again.outcome, again.version) == ("skipped", 3)


def test_fingerprint_ignores_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    a = L.set_fingerprint(rows, ["k", "v"]).first()
    assert a == L.set_fingerprint(rows.orderBy(F.desc("k")), ["k", "v"]).first()
    assert a != L.set_fingerprint(rows.where("k > 1"), ["k", "v"]).first()


def test_cycles_and_diamonds(spark):
    tree = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (4, 5), (5, 6), (6, 4), (7, 8), (7, 9), (8, 10), (9, 10)] + [(20 + i, 20 + (i + 1) % 12) for i in range(12)], "child int, parent int")
    assert sorted(r.cycle for r in G.hierarchy_cycles(tree).collect()) == [[1], [2, 3], [4, 5, 6], list(range(20, 32))]
    closure = G.ancestors(tree)
    assert closure.where("node = 7 and ancestor = 10").first().distance == 2


def test_longest_name_first(spark):
    texts = spark.createDataFrame([(1, "a red apple pie"), (2, None)], "text_id long, text string")
    assert [r["name"] for r in W.mentions(texts, ["apple", "apple pie", "pie", "a"]).collect()] == ["apple pie"]


def test_page_ids_are_version_five(spark):
    import uuid

    assert one(spark, T.stable_id(F.lit("kb/a/b"))) == str(uuid.uuid5(uuid.UUID(T.PAGE_SPACE), "kb/a/b"))


def test_full_width_names(spark):
    assert one(spark, T.norm_slug(F.lit("ＡＢ c_d"))) == "abc_d"


def test_empty_tables(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert G.components(none).count() == 0


def test_names_inside_texts_against_brute_force(spark):
    import random

    r = random.Random(7)
    text = lambda most: "".join(r.choice("abcé 日") for _ in range(r.randint(0, most)))
    parts, wholes = [text(5) for _ in range(60)] + ["", "zz"], [text(30) for _ in range(80)] + ["", "é"]
    a = spark.createDataFrame(list(enumerate(parts)), "part_id int, part string")
    b = spark.createDataFrame(list(enumerate(wholes)), "whole_id int, whole string")
    got = sorted((x.part_id, x.whole_id) for x in S.contained(a, b).collect())
    assert got == sorted((i, j) for i, p in enumerate(parts) for j, w in enumerate(wholes) if p and p in w)


def test_similar_sets_against_brute_force(spark):
    import random

    r = random.Random(8)
    sets = [sorted(r.sample(range(40), r.randint(1, 12))) for _ in range(90)]
    sets += [sorted({*s, r.randrange(40)}) for s in sets[:40]]
    rows = spark.createDataFrame([(i, i % 2, len(s), s) for i, s in enumerate(sets)], "id long, kind int, n int, grams array<bigint>")
    alike = lambda i, j: len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]})
    for across in (False, True):
        got = sorted((x.id, x.id_b) for x in S.jaccard_pairs(rows, 0.6, across).collect())
        assert got == [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if alike(i, j) >= 0.6 and (not across or i % 2 != j % 2)]
        assert got


def test_common_substrings_against_brute_force(spark):
    import random

    r = random.Random(9)
    texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(30)]
    names = ["".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(20)]
    a = spark.createDataFrame(list(enumerate(texts)), "left_id int, text string")
    b = spark.createDataFrame(list(enumerate(names)), "right_id int, text string")
    got = {(x.left_id, x.right_id): x.common for x in common_substrings(a, b, 3).collect()}
    longest = lambda x, y: max((j - i for i in range(len(y)) for j in range(i + 1, len(y) + 1) if y[i:j] in x), default=0)
    want = {(i, j): longest(x, y) for i, x in enumerate(texts) for j, y in enumerate(names)}
    assert got == {k: n for k, n in want.items() if n >= 3}


def test_excerpts(spark):
    chunks = spark.createDataFrame([(1, 1, "nothing here"), (1, 2, "it says: a long\nquote of words, more"), (1, 3, "a longquote"), (2, 9, None)], "doc int, chunk int, content string")
    quotes = spark.createDataFrame([(1, 1, "a long quote of words"), (2, 1, "a longquote of no words"), (3, 1, "absent words at all"), (4, 2, "x"), (5, 1, "says"), (6, 3, "a long")], "quote_id int, doc int, quote string")
    got = {x.quote_id: (x.chunk, x.how) for x in X.locate_excerpts(quotes, chunks).collect()}
    assert got == {1: (2, "whole"), 2: (2, "start"), 3: (None, "none"), 4: (None, "none"), 5: (2, "whole"), 6: (None, "none")}
