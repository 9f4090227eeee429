"""What a review of odd inputs and larger tables found, on hand-written frames."""

import hashlib
import time

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from lorekeep.functions import text as T
from lorekeep.operators import audits as A
from lorekeep.operators import excerpts as X
from lorekeep.operators import folders as D
from lorekeep.operators import governance as V
from lorekeep.operators import graphs as G
from lorekeep.operators import search as S
from lorekeep.operators import texts as B
from lorekeep.operators import traces as R
from lorekeep.operators import transfers as X2
from lorekeep.operators import vectors as N
from lorekeep.operators import windows as W
from lorekeep.plans import audits as audit_plans
from lorekeep.plans import changes as change_plans
from lorekeep.plans import fixtures
from lorekeep.plans import graphs as graph_plans
from lorekeep.plans import search as search_plans


def test_upper_case_of_a_sharp_s_is_looked_up(spark, tmp_path):
    titles = ["Eine Straße am Fluss", "Eine Strasse am Berg"]
    rows = [(10 * n + 4, t, "web", "de", len(t)) for n, t in enumerate(titles)]
    pd.DataFrame(rows, columns=["doc_id", "text", "source", "lang", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    found = {(r.query, r.slug) for r in search_plans.j19_lookup_page(spark, str(tmp_path)).collect()}
    assert found == {(" STRAẞE AM F", "de/doc/4"), (" STRASSE AM ", "de/doc/14")}


def test_repeated_mappings_and_undecided_pages_meet_once(spark):
    """n mappings of one pair of ends and n rows of either page once made n * n * n rows."""
    n = 4000
    one = "k string, s string"
    pages = spark.createDataFrame([("a", "x", "h", 1, None, None, []), ("b", "y", "h", 1, None, None, [])], "kb_id string, slug string, hash string, version int, concept_kb string, concept string, links array<string>")
    ends = spark.createDataFrame([("a", "x")], one).crossJoin(spark.range(n))
    mappings = ends.selectExpr("k source_kb", "s source", "'b' target_kb", "'y' target", "'same' kind", "'' source_hash", "'' target_hash", "1 source_version", "1 target_version")
    twice = spark.createDataFrame([("a", "x"), ("b", "y")], one).crossJoin(spark.range(n)).selectExpr("'g' `group`", "k kb_id", "s slug")
    apart = spark.createDataFrame([("open", "a", "x"), ("open", "b", "z")], "`group` string, kb_id string, slug string")
    cached = pages.select("kb_id", "slug", "hash")
    start = time.monotonic()
    got = V.context_map_checks(pages, mappings, ["same"], twice.unionByName(apart), cached).collect()
    assert [(r.check, r.subject) for r in got] == [("G5", "open")]
    assert time.monotonic() - start < 120


def test_every_simple_cycle_is_listed(spark, monkeypatch):
    """A ring of four with a chord both ways: the long ring is no shortest cycle of any of its edges."""
    steps = [(1, 2), (2, 3), (3, 4), (4, 1), (2, 1), (3, 2), (4, 3), (1, 4), (7, 7), (8, 9), (1, 8)]
    tree = spark.createDataFrame(steps, "child long, parent long")
    monkeypatch.setattr(graph_plans, "_looped", lambda *_: tree)
    got = sorted((r.component, r.size, r.cycle, r.length) for r in graph_plans.g13_hierarchy_cycles(spark, "").collect())
    assert got == [(1, 4, "1,2", 2), (1, 4, "1,2,3,4", 4), (1, 4, "1,4", 2), (1, 4, "2,3", 2), (1, 4, "3,4", 2), (7, 1, "7", 1)]
    ring = spark.range(30).selectExpr("id child", "(id + 1) % 30 parent")
    assert [(r.size, r.length) for r in G.every_cycle(ring).collect()] == [(30, 30)]


def written(monkeypatch, *modules):
    """Counts the rows of every table that the modules store on their way."""
    counts = []

    def count(df, name):
        found = G.settled(df, name)
        counts.append(found.count())
        return found

    for module in modules:
        monkeypatch.setattr(module, "settled", count)
    return counts


def test_alike_sets_against_all_pairs(spark, monkeypatch):
    import random

    r = random.Random(4)
    for name, value in (("SETS", 16), ("ROWS", 5), ("GRAMS", 7)):
        monkeypatch.setattr(N, name, value)
    sets = {n: r.sample(range(14), r.randint(0, 9)) for n in range(70)}
    frame = spark.createDataFrame(list(sets.items()), "id long, grams array<bigint>")
    score = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a, b): score(x, y) for a, x in sets.items() for b, y in sets.items() if x and y and score(x, y) >= 0.5}
    assert {(x.id, x.id_b): x.score for x in N.alike_sets(frame, None, 0.5).collect()} == {k: v for k, v in want.items() if k[0] < k[1]}
    got = N.alike_sets(frame.where("id % 3 = 0"), frame.where("id % 3 > 0"), 0.5).collect()
    assert {(x.id, x.id_b): x.score for x in got} == {k: v for k, v in want.items() if k[0] % 3 == 0 and k[1] % 3}


def test_questions_of_common_grams_are_grouped_without_stored_candidates(spark, monkeypatch):
    """All texts share all their grams but a few: every pair was a candidate, kept in a shuffle before it was compared."""
    letters = "abcdefghijklmnop"
    rows = [(n, "", "".join(letters[(n * k + k * k) % 16] for k in range(60)), n) for n in range(300)]
    frame = spark.createDataFrame(rows, "row_id long, qid string, core string, ts long")
    from lorekeep.operators import search as S

    def none(*_):
        raise AssertionError("candidates by rare grams")

    monkeypatch.setattr(S, "prefix_pairs", none)
    assert W.group_questions(frame, 0.62).count() == 300


def test_matches_make_no_pairs_of_questions_and_anchors(spark, monkeypatch):
    """Entries that share their anchors with each other tie for every question; what is kept grows with texts, not with pairs."""
    asked = [(f"q{n:03}", "", f"which rule holds for server {'abcdefghij'[n % 10]}") for n in range(200)]
    truth = [(f"T{n:03}", [], ["server", f"rule{n % 5}"], [], []) for n in range(200)] + [("U", [], ["server c"], ["rule"], []), ("V", [], ["x" * 50 + "server d"], [], [])]
    truth = spark.createDataFrame(truth, "truth_id string, qids array<string>, anchors array<string>, intent array<string>, questions array<string>")
    monkeypatch.setattr(R, "PARTED", 20)
    counts = written(monkeypatch, R)
    got = {r.question_id: (r.truth_id, r.how) for r in R.match_truth(spark.createDataFrame(asked, "question_id string, qid string, question string"), truth, 0.62).collect()}
    assert got["q002"] == ("U", "anchor") and got["q003"] == (None, "none") and got["q001"] == (None, "none")
    assert max(counts) < 400


def test_near_duplicates_of_common_grams_store_no_candidates(spark, monkeypatch):
    """Few letters, so that every gram is common: candidates by rare grams were nearly all pairs, kept in a shuffle."""
    import random

    from lorekeep.operators import search as S

    def none(*_):
        raise AssertionError("candidates by rare grams")

    monkeypatch.setattr(S, "prefix_pairs", none)
    for name, value in (("SETS", 20), ("SKETCHES", 60), ("STRIP", 7)):
        monkeypatch.setattr(N, name, value)
    r = random.Random(5)
    bodies = ["".join(r.choice("abcd") for _ in range(r.randint(1, 90))) for _ in range(150)]
    bodies += [b[:k] + "a" + b[k:] for b in bodies for k in (3, len(b) // 2)] + ["", "a", "ab"]
    rows = [(n, "xy"[r.randint(0, 1)], b) for n, b in enumerate(bodies)]
    got = {(x.a, x.b): x.cosine for x in S.near_duplicates(spark.createDataFrame(rows, "page_id long, page_type string, body string")).collect()}
    classes = {}
    for n, kind, b in rows:
        classes.setdefault((kind, b), n) if b else None
    sets = [(n, k, {b[i : i + 3] for i in range(len(b) - 2)} or {b}) for (k, b), n in classes.items()]
    want = {}
    for a, k, x in sets:
        for b, m, y in sets:
            score = round(len(x & y) / (len(x) * len(y)) ** 0.5, 9)
            if a < b and score >= (0.86 if k == m else 0.93):
                want[a, b] = score
    assert got == want and len(want) > 100


class _State:
    """A value or a map of the state of one key; counts what is read of it."""

    def __init__(self, owner):
        self.owner, self.rows = owner, {}

    def _told(self, value):
        self.owner.read += sum(len(x) if isinstance(x, list) else 1 for x in value or ())
        return value

    def get(self):
        return self._told(self.rows.get(None))

    def update(self, value):
        self.rows[None] = value

    def clear(self):
        self.rows.clear()

    def exists(self):
        return bool(self.rows)

    def getValue(self, key):
        return self._told(self.rows.get(key))

    def containsKey(self, key):
        return key in self.rows

    def updateValue(self, key, value):
        self.rows[key] = value

    def removeKey(self, key):
        del self.rows[key]

    def iterator(self):
        return ((k, self._told(v)) for k, v in list(self.rows.items()))


class _Handle:
    """The state and timers of one key."""

    def __init__(self):
        self.read, self.timers, self.states = 0, set(), []

    def getValueState(self, *_):
        self.states.append(_State(self))
        return self.states[-1]

    getMapState = getValueState

    def registerTimer(self, ms):
        self.timers.add(ms)


def test_waiting_calls_of_a_key_are_read_a_few_times_each(monkeypatch):
    """A timer of each call once read all calls that waited: the square of a key's calls."""
    import random
    from types import SimpleNamespace as Bag

    from lorekeep.streaming import state as Y

    r = random.Random(6)
    for few, held in ((1000, 10_000), (20, 50), (5, 7)):
        for name, value in (("FEW", few), ("HELD", held)):
            monkeypatch.setattr(Y, name, value, raising=False)
        handle, made = _Handle(), Y.FirstWithin(60_000_000)
        made.init(handle)
        calls = [(r.randrange(3_000_000_000), n) for n in range(3000)]
        calls += calls[:300]
        got = []
        for mark, ahead in ((500_000, 700), (1_200_000, 900), (1_200_500, 400), (4_000_000, 9_000)):
            now = [c for c in calls if c[0] <= (mark + ahead * 1000) * 1000]
            calls = [c for c in calls if c not in set(now)]
            times = Bag(getCurrentWatermarkInMs=lambda mark=mark: mark)
            list(made.handleInputRows(("k",), iter([Bag(us=us, call_id=n, tool="t") for us, n in now]), times))
            for due in sorted(t for t in handle.timers if t < mark):
                handle.timers.discard(due)
                got += made.handleExpiredTimer(("k",), times, Bag(getExpiryTimeInMs=lambda due=due: due))
        for due in sorted(handle.timers):
            got += made.handleExpiredTimer(("k",), Bag(getCurrentWatermarkInMs=lambda: 9_000_000), Bag(getExpiryTimeInMs=lambda due=due: due))
        want, first = [], None
        for us, n in sorted((x["us"], x["call_id"]) for x in (g.asDict() for g in got)):
            opens = first is None or us - first[0] > 60_000_000
            first = (us, n) if opens else first
            want.append((us, n, opens, first[1]))
        assert [(g.us, g.call_id, g.opens, g.first_call) for g in got] == want and len(got) == 3300
        assert handle.read < 400 * len(got)
        assert not any(s.rows for s in handle.states)


def test_similarities_are_dealt_to_all_tasks(spark, tmp_path):
    """Names are short: adaptive execution merged them into one task, which made all their grams."""
    from lorekeep.plans import texts as text_plans

    pd.DataFrame([(n, f"part {n % 7}" if n % 5 else "", "ab"[n % 2] * (n % 4)) for n in range(400)], columns=["p_partkey", "p_name", "p_type"]).to_parquet(tmp_path / "part.parquet")
    rows = text_plans.t3_similarities(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 399 and len({r.task for r in rows}) == 4
    text = lambda n: (f"part {n % 7}" if n % 5 else "") + " " + "ab"[n % 2] * (n % 4)
    grams = lambda t, n: {t[i : i + n] for i in range(len(t) - n + 1)} or {t}
    for r in rows:
        (x, y), (v, w) = [[grams(text(k), n) for k in (r.a, r.b)] for n in (3, 2)]
        assert r.b == r.a + 1 and abs(r.set_cosine - len(x & y) / (len(x) * len(y)) ** 0.5) < 1e-12 and abs(r.jaccard - len(v & w) / len(v | w)) < 1e-12


def test_sets_meet_for_their_rare_elements_alone(spark):
    """Sets that shared one common element all met: n sets of a group once made n * n / 2 pairs."""
    n = 300
    sets = [sorted({"all", "most" if i % 10 else "few", f"own{i}", f"two{i // 2}"} | ({"odd"} if i % 97 == 0 else set())) for i in range(n)]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(sets + sets[:50])] + [(2, n + i, ["x", f"y{i}"]) for i in range(3)], "grp long, page_id long, relations array<string>")
    every = sets + sets[:50]
    alike = [len(set(a) & set(b)) / len(set(a) | set(b)) for i, a in enumerate(every) for b in every[:i]]
    got = {r.grp: r.relations for r in A.mean_jaccard(rows, "relations").collect()}
    assert abs(got[1] - sum(alike) / len(alike)) < 1e-9 and abs(got[2] - 1 / 3) < 1e-9
    kinds = rows.groupBy("grp", F.col("relations").alias("set")).agg(F.count("*").cast("double").alias("m")).withColumn("kind", F.xxhash64("set"))
    rare, _ = A.rare_and_common(kinds.select("grp", "kind", "m", F.size("set").alias("size"), F.explode("set").alias("x")), kinds)
    assert A.rare_pairs(rare).count() < 1000


def test_versions_do_not_meet_every_entry_of_their_name(spark):
    """n versions of a name and n allowed entries once made n * n rows, each version a list of n."""
    n = 6000
    items = spark.range(n).selectExpr("id item_id", "'Tool' software", "concat('1.', id) version")
    several = spark.createDataFrame([(-1, "few", "2.0"), (-2, "few", "9"), (-3, "few", ""), (-4, "few", "1.5")], "item_id long, software string, version string")
    allow = spark.range(n).selectExpr("id pos", "'tool' software", "if(id % 2 = 0, concat('1.', id div 4), '') version", "if(id % 2 = 1, '1.100', null) low", "if(id % 2 = 1, '1.200', null) high", "if(id = 3, '2020-01-01', '') expires_at")
    few = [(n, "few", "2.0", None, None, ""), (n + 1, "few", "", "2", "3", "2020-01-01"), (n + 2, "few", "", "1", "3", ""), (n + 3, "few", "2.0", None, None, "2020-01-01"), (n + 4, "few", "", "2", "3", "")]
    few += [(n + 5 + i, "few", f"7.{i}", None, None, "") for i in range(9)]
    allow = allow.unionByName(spark.createDataFrame(few, "pos long, software string, version string, low string, high string, expires_at string"))
    deny = spark.createDataFrame([("tool", "1.7")], "software string, version string")
    start = time.monotonic()
    got = {r.item_id: (r.verdict, r.match, r.near_misses) for r in S.catalog_check(items.unionByName(several), allow, deny, "2024-01-01").collect()}
    assert time.monotonic() - start < 60
    assert got[7] == ("denied", "deny", "1.0,,1.0,,1.1") and got[0] == ("allowed", "exact", ",,1.1,,1.1")
    assert got[150][:2] == ("allowed", "exact") and got[1499][:2] == ("allowed", "exact") and got[1500][0] == "unknown"
    assert got[-1] == ("allowed", "exact", ",,,7.0,7.1") and got[-2] == ("unknown", "", "2.0,,,2.0,") and got[-3] == ("expired", "exact", "2.0,2.0,7.0,7.1,7.2")
    assert got[-4] == ("allowed", "range", "2.0,,,2.0,")


def test_tasks_grow_in_number_with_the_lines(spark):
    """The lines of all documents once stood in as many sorts as there are shuffle partitions."""
    lines = spark.range(1200).selectExpr("id div 6 doc", "cast(id % 6 as int) place", "concat('line ', id) line")
    parts = X.dealt(lines, 100)
    counts = parts.select("doc", "place", F.spark_partition_id().alias("task")).groupBy("doc").agg(F.count("*").alias("n"), F.count_distinct("task").alias("tasks"))
    assert parts.rdd.getNumPartitions() == 12 and counts.where("n = 6 and tasks = 1").count() == 200
    assert X.dealt(lines).rdd.getNumPartitions() == lines.rdd.getNumPartitions()


def test_classes_are_not_sent_to_the_driver_in_each_round(spark):
    """The table of classes was once broadcast in every round of a walk to the top."""
    classes = spark.range(50).selectExpr("concat('c', id) class", "concat('L', id) label", "if(id > 0, concat('c', id div 2), null) parent")
    step = classes.selectExpr("class at", "label said", "parent above")
    plan = D.one_step(classes.selectExpr("class", "parent next"), step)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got = {r["class"]: r.labels for r in D.class_chains(classes).collect()}
    assert len(got) == 50 and got["c0"] == ["L0"] and got["c11"] == ["L0", "L1", "L2", "L5", "L11"]


def test_long_chunks_do_not_become_a_row_for_each_character(spark):
    """Every stretch of twelve characters of a body was once a string and a row of its own."""
    body = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: F.concat(F.lit("wörd"), i, F.lit("."), F.col("id"))))
    chunks = spark.range(24).select((F.col("id") % 2).alias("doc"), F.col("id").alias("chunk"), body.alias("content"))
    chunks = chunks.unionByName(spark.createDataFrame([(0, 90, "a 𝄞 b"), (0, 91, "Zum Anfang steht, dann anders."), (0, 92, "zum Ende: Zum Anfang steht das da"), (1, 93, None)], "doc long, chunk long, content string"))
    quotes = [(1, "wörd39999.7 wörd40000.7", 1), (2, "wörd39999.7", 0), (3, "a𝄞", 0), (4, "Zum Anfang steht das", 0), (5, "Zum Anfang steht nichts", 0), (6, "", 1), (7, None, 0), (8, "nowhere at all", 1)]
    quotes = spark.createDataFrame(quotes, "quote_id long, quote string, doc long")
    start = time.monotonic()
    got = {r.quote_id: (r.chunk, r.how) for r in B.locate_excerpts(quotes, chunks).collect()}
    assert time.monotonic() - start < 60
    assert got == {1: (7, "whole"), 2: (None, "none"), 3: (90, "whole"), 4: (92, "whole"), 5: (91, "start"), 6: (1, "whole"), 7: (0, "whole"), 8: (None, "none")}
    assert [len(r[0]) for r in quotes.where("quote_id in (1, 3)").orderBy("quote_id").select(B.stretch_codes(3)("quote")).collect()] == [17, 0]


def test_labels_of_components_are_not_sent_to_the_driver(spark, monkeypatch):
    """The label of every node was once broadcast in every round."""
    plans, settled = [], G.settled

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settled(df, name)

    monkeypatch.setattr(G, "settled", kept)
    rows = spark.range(40).selectExpr("id row", "id div 5 k1", "if(id % 10 = 4, null, concat('k', (id + 1) div 10)) k2")
    got = {r.row: r.component for r in G.key_components(rows, "row", ["k1", "k2"]).collect()}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    assert got == {n: 0 for n in range(40)}


def test_wholes_do_not_become_a_row_for_each_gram(spark):
    """Every stretch of three characters of a whole was once cut out as a string and a row of its own."""
    word = F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda i: F.concat(F.lit("wörd"), i, F.lit("."), F.col("id")))
    wholes = spark.range(24).select(F.col("id").alias("whole_id"), F.concat_ws(" ", word).alias("whole"))
    wholes = wholes.unionByName(spark.createDataFrame([(90, "a 𝄞文b"), (91, "文"), (92, ""), (93, None)], "whole_id long, whole string"))
    parts = [(1, "wörd59999.7 wörd60000.7"), (2, "𝄞文"), (3, "文"), (4, "é"), (5, ""), (6, None), (7, "rd60000.5"), (8, "b"), (9, "wörd7.77")]
    start = time.monotonic()
    got = {(r.part_id, r.whole_id) for r in S.contained(spark.createDataFrame(parts, "part_id long, part string"), wholes).collect()}
    assert time.monotonic() - start < 60
    assert got == {(1, 7), (2, 90), (3, 90), (3, 91), (7, 5), (8, 90)}


def test_grams_across_blocks_and_ends_of_texts(monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 4)
    texts = pa.array([b"x", b"abcdefghij", None, b"", b"abc"]).slice(1)
    found = [(row, code) for rows, codes, _ in S.byte_grams(texts, 3) for row, code in zip(rows.tolist(), codes.tolist(), strict=True)]
    code = lambda gram: int.from_bytes(b"\x03" + gram, "big")
    assert found == [(0, code(b"abcdefghij"[n : n + 3])) for n in range(8)] + [(3, code(b"abc"))]


def test_tables_of_a_clean_up_are_derived_once(spark, monkeypatch):
    """The tables were once derived anew, windows and all, for the plan, its check and each table that is left."""
    plans, applied = [], change_plans.C.apply_clean_up

    def kept(*given):
        plans.extend(t._jdf.queryExecution().executedPlan().toString() for t in given[:5])
        return applied(*given)

    monkeypatch.setattr(change_plans.C, "apply_clean_up", kept)
    assert change_plans.c21_clean_up_applied(spark, "/root/testdata/sf0.001").count() == 5
    assert len(plans) == 5 and not any("Exchange" in p or "Window" in p for p in plans)


def test_relations_are_compared_whole(spark, monkeypatch):
    """Only the words of a text's first 120 characters and the first 60 of its summary once told a group's pages apart."""
    start = "Overview of the storage protocol. " + "x y " * 40
    tails = ["", "latency replica", "latency replica", "replica quorums", "latency quorums election"]
    rows = [(10 * n + 1, start + t, f"src{n}", "en", 0) for n, t in enumerate(tails)]
    head = ("c d " * 10)[:40]
    rows += [(101 + 10 * n, f"{n}" + head[1:] + "a b " * 20 + f"{n}" * 20, f"src{n}", "en", 0) for n in range(2)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars int")
    monkeypatch.setattr(audit_plans, "kb_pages", lambda *_: fixtures.kb_pages(spark, ""))
    monkeypatch.setattr(fixtures, "table", lambda *_: documents)
    got = {r.grp: r for r in audit_plans.r1_context_scan(spark, "").collect()}
    sets = [{w for w in (start + t).split() if len(w) > 6} for t in tails]
    alike = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert list(got) == [1] and got[1].members == 5 and got[1].relations == round(sum(alike) / len(alike), 4)


def test_sums_of_jaccards_against_all_pairs(spark, monkeypatch):
    import random

    r = random.Random(8)
    for name, value in (("SETS", 9), ("ENTRIES", 40), ("ROWS", 4), ("GRAMS", 3), ("MET", 6), ("DENSE", 4)):
        monkeypatch.setattr(N, name, value)
    sets = {}
    for n in range(120):
        sets.setdefault((r.choice([1, 1, 1, 2, *range(3, 30)]), tuple(sorted(r.sample([f"wörd{k}" for k in range(16)], r.randint(0, 9))))), float(r.randint(1, 3)))
    frame = spark.createDataFrame([(g, m, list(w)) for (g, w), m in sets.items()], "grp long, m double, words array<string>")
    want = {}
    for i, ((g, x), m) in enumerate(sets.items()):
        for (h, y), k in list(sets.items())[:i]:
            if g == h:
                want[g] = want.get(g, 0.0) + m * k * len(set(x) & set(y)) / len(set(x) | set(y))
    got = {x.grp: x.total for x in N.jaccard_sums(frame.repartition(5)).collect()}
    assert all(abs(got[g] - want.get(g, 0.0)) < 1e-9 for g in got) and set(want) <= set(got)


def test_near_duplicates_meet_for_their_rare_grams(spark, monkeypatch):
    """Sketches of all texts once met in tiles, those of texts that share nothing too."""
    import random

    for name, value in (("SETS", 20), ("SKETCHES", 60), ("STRIP", 3), ("COLUMNS", 16), ("CELLS", 64)):
        monkeypatch.setattr(N, name, value, raising=False)
    tiles, dealt = [], N._tiles
    monkeypatch.setattr(N, "_tiles", lambda a, b, data, pairs: (tiles.append(pairs.count()), dealt(a, b, data, pairs))[1])
    r = random.Random(9)
    bodies = []
    for k in range(20):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(40)]
        some = ["".join(r.choice(letters) for _ in range(r.randint(1, 70))) for _ in range(8)]
        bodies += some + [b[:i] + r.choice(letters) * n + b[i + 1 :] for b in some for i, n in ((3, 1), (len(b) // 2, 0), (len(b), 12))]
    rows = [(n, "xy"[r.randint(0, 1)], b) for n, b in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "page_id long, page_type string, body string")
    classes = {}
    for n, kind, b in rows:
        classes.setdefault((kind, b), n) if b else None
    sets = [(n, k, {b[i : i + 3] for i in range(len(b) - 2)} or {b}) for (k, b), n in classes.items()]
    want = {}
    for a, k, x in sets:
        for b, m, y in sets:
            score = round(len(x & y) / (len(x) * len(y)) ** 0.5, 9)
            if a < b and score >= (0.86 if k == m else 0.93):
                want[a, b] = score
    assert {(x.a, x.b): x.cosine for x in S.near_duplicates(frame).collect()} == want and len(want) > 100
    assert sum(tiles) < 10
    # postings of one gram in several blocks and tasks
    for name, value in (("SKETCHES", 5), ("DEALT", 300)):
        monkeypatch.setattr(N, name, value, raising=False)
    assert {(x.a, x.b): x.cosine for x in S.near_duplicates(frame).collect()} == want and tiles[-1] > 0


def test_blocks_of_vectors_are_not_shuffled_for_each_pair(spark, monkeypatch):
    """Both blocks of every pair once went through a shuffle: blocks times blocks."""
    import numpy as np

    def none(*_):
        raise AssertionError("a row for each pair of blocks")

    monkeypatch.setattr(N, "_tiles", none)
    r = np.random.default_rng(3)
    for block, side, asked in ((2048, 1 << 24, 512), (3, 200, 2)):
        for name, value in (("BLOCK", block), ("SIDE", side), ("ASKED", asked)):
            monkeypatch.setattr(N, name, value, raising=False)
        asks, known = r.integers(-3, 4, (60, 3)).astype(float), r.integers(-3, 4, (80, 3)).astype(float)
        rows = lambda data: spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(data)] + [(900, [0.0, 0.0, 0.0]), (901, [1.0, 1.0]), (902, None)], "id long, vector array<double>").repartition(5)
        want = {901: (901, 1.0)}
        for n, v in enumerate(asks):
            if v.any():
                scores = {k: round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9) for k, w in enumerate(known) if w.any()}
                best = [k for k, s in scores.items() if s == max(scores.values())]
                if len(best) == 1 and scores[best[0]] >= 0.97:
                    want[n] = (best[0], scores[best[0]])
        got = {x.question_id: (x.truth_id, x.cosine) for x in N.nearest_alone(rows(asks), rows(known), 0.97).collect()}
        assert got == want and 5 < len(want) < 50


def test_an_import_stores_and_shuffles_old_ids(spark, monkeypatch, tmp_path):
    """Tables were derived twice for an export, and revisions, under long new ids, once for each key they replace."""
    from pyspark.sql import DataFrame

    told, stored = [], X2.manifest
    monkeypatch.setattr(X2, "manifest", lambda tables: (told.append(list(tables)), stored(tables))[1])
    pages = spark.createDataFrame([("p1", "f1", "a", "A", 1), ("p2", None, "b", "B", 1)], "id string, folder_id string, slug string, title string, version int")
    other = hashlib.sha1(b"kb/p1").hexdigest()
    rows = [(f"r{n}", "p1", "a", n // 2) for n in range(6)] + [("q1", other, "x", 0), ("q2", "gone", "y", 1), ("q3", None, "z", 1), ("q4", None, "z", 1)]
    tables = {
        "folders": spark.createDataFrame([("f1", None, "top", False), ("f2", "f1", "top/in", True)], "id string, parent_id string, path string, deleted boolean"),
        "pages": pages, "revisions": spark.createDataFrame(rows, "id string, page_id string, slug string, version int"),
    }
    tables["empty"] = tables["folders"].where("false")
    made = X2.export_dataset(tables, f"{tmp_path}/out")
    assert told == [] and {(r.table, r.rows) for r in made.collect()} == {("folders", 1), ("pages", 2), ("revisions", 10), ("empty", 0)}
    schemas = {"folders": "id string, parent_id string, path string", "pages": "id string, folder_id string, slug string, title string, version int", "revisions": "id string, page_id string, slug string, version int", "empty": "id string, parent_id string, path string"}
    read = X2.read_dataset(spark, f"{tmp_path}/out", schemas)
    target = {n: read[n].withColumn("kb_id", F.lit("other")) for n in ("folders", "pages", "revisions")}
    plans = []
    monkeypatch.setattr(X2, "settled", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), G.settled(df, name))[1], raising=False)
    got = X2.import_dataset(read, target, "kb", keep_ids=True)["revisions"].where("kb_id = 'kb'")
    new = lambda x: hashlib.sha1(f"kb/{x}".encode()).hexdigest()
    first = {}
    for i, page, slug, version in rows:
        key = (new(page) if page in ("p1", "p2") else page, version)
        first[key] = min(first.get(key, ("~",)), (new(i), slug))
    assert isinstance(got, DataFrame) and sorted((r.page_id or "", r.version, r.id, r.slug) for r in got.collect()) == sorted((p or "", v, i, s) for (p, v), (i, s) in first.items())
    assert len(plans) == 1 and all("sha1" not in line for line in plans[0][plans[0].index("Exchange hashpartitioning(page_id") :].splitlines())
