"""The training-data operators against brute force, with nulls, ties, repeated rows, clashing names and empty tables."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import exact_dedup, jaccard, licences, mixing, neighbours, packing, pii, quality, urls, wavelet
from lorekeep.llm.licence_texts import CONFIRM, LEARN, NAMES, SAID_ELSEWHERE, UNVERSIONED, said_by
from lorekeep.llm.tokens import WordTokenizer, public_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "a  b", "a   b", " a", "a ", "a  ", "\n  x", " \xa0 b", "\xa0 \xa0b", "a\x1c b", "<|endoftext|> a", "ΑΣ Σ. σς", "é ́a", "  ", "it's 'll", "12 345 ab12", "日本語 テスト", "A.- ß... Ÿ µ ªº! İ, (a) don't!", "x" * 3000]


def frame(spark, rows):
    """doc_id, text, source and names that operators use inside."""
    full = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).withColumns({"digest": F.lit(1), "rid": F.lit("x"), "rep": F.lit(2), "key": F.lit(None).cast("string"), "shard": F.lit(0)})


def corpus(seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 6))) for _ in range(400)]
    rows, bases = [], [[r.choice(words) for _ in range(r.randint(3, 120))] for _ in range(25)]
    for i in range(220):
        text = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((i, r.choice([" ", "  ", "\n"]).join(text).upper() if r.random() < 0.1 else " ".join(text), r.choice(["s1", "s1", "s2", None])))
    rows += [(300 + i, t, "s3") for i, t in enumerate(ODD)] + [(0, rows[0][1], "s1"), (0, rows[0][1], "s1"), (None, "lost row", "s1"), (None, "lost row", None)]
    return rows


def normal(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    rows = corpus()
    digest = (lambda n: F.length(n).cast("string")) if weak else exact_dedup.sha256
    got = exact_dedup.exact_dedup(frame(spark, rows), digest).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[normal(t)].append((-len(t or ""), i is None, i or 0, i))
    want = sorted((str(i), str(min(groups[normal(t)])[3]), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_word_tokens_equal_the_library():
    texts = [t or "" for _, t, _ in corpus()]
    for name, blanks in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        tool = WordTokenizer(public_path(name), blanks)
        want = [e.ids for e in tool.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in tool.encode(texts)] == want
        assert [x.tolist() for x in tool.encode(texts)] == want  # from the cache


def test_added_tokens_equal_the_untouched_library():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y <|EndOfText|>", "  <|endoftext|>  a", "plain", "< |endoftext|>"]
    for name, blanks in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        want = [e.ids for e in Tokenizer.from_file(public_path(name)).encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in WordTokenizer(public_path(name), blanks).encode(texts)] == want


def test_wavelet_matrix():
    ids = np.random.default_rng(2).integers(0, 40, 3000).astype(np.uint16) * 997
    m = wavelet.WaveletMatrix(wavelet.WaveletMatrix.build(ids).to_bytes())
    assert (m.all() == ids).all()
    for v in (0, 997, 5 * 997, 7):
        places = np.flatnonzero(ids == v)
        assert m.rank(v, 1700) == (places < 1700).sum()
        assert [m.select(v, n) for n in range(3)] == [int(p) for p in places[:3]] + [-1] * (3 - len(places[:3]))
    assert [m.access(i) for i in (0, 511, 512, 2999)] == ids[[0, 511, 512, 2999]].tolist()
    assert wavelet.WaveletMatrix.build(ids[:0]).all().size == 0


def test_wavelet_matrix_reads_a_chunk_of_each_plane(monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK_BITS", 1024)
    ids = (np.random.default_rng(4).zipf(1.3, 20_000) % 49_000).astype(np.uint16)
    data = wavelet.WaveletMatrix.build(ids).to_bytes()
    places = defaultdict(list)
    for n, v in enumerate(ids.tolist()):
        places[v].append(n)
    for v in (int(ids[0]), int(ids[777]), 48_999):
        for nth in {0, len(places[v]) // 2, len(places[v])}:
            m, read = wavelet.WaveletMatrix(data), []
            expand = m.expand
            m.expand = lambda chunk, expand=expand, read=read: read.append(1) or expand(chunk)
            assert m.select(v, nth) == (places[v][nth] if nth < len(places[v]) else -1)
            assert len(read) <= 3 * wavelet.PLANES  # of 320 chunks
            assert m.rank(v, 12_345) == sum(p < 12_345 for p in places[v])


def test_wavelet_documents(spark):
    rows = corpus()
    got = wavelet.read_documents(wavelet.write_shards(frame(spark, rows), shard_ids=500)).collect()
    tool = WordTokenizer(public_path("word_bpe_49k.json"), False).tokenizer
    ids = {i: [tool.encode(t or "", add_special_tokens=False).ids + [1] for j, t, _ in rows if i == j] for i, _, _ in rows}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        assert r.ids_crc32 in [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids[r.doc_id]]
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d)) and len(got) == len(rows)


def brute_windows(ids, df, n, mean, window):
    """The first window of each seed, with BM25 scores added up term by term."""
    from collections import Counter

    tfs = [Counter(one.tolist()) for one in ids]
    idf = lambda t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) if df[t] > 1 else 0.0

    def score(seed, doc):
        norm = packing.K1 * (1 - packing.B + packing.B * len(ids[doc]) / mean)
        return sum(idf(t) * tfs[doc][t] * (packing.K1 + 1) / (tfs[doc][t] + norm) for t in tfs[seed] if tfs[doc][t])

    unused, order, seed, room = set(range(len(ids))), [], None, window
    while unused:
        best = max(unused, key=lambda d: (round(score(seed, d), 9), -d)) if seed is not None else None
        doc = best if best is not None and score(seed, best) > 0 else min(unused)
        unused.discard(doc)
        order.append(doc)
        seed = doc if room == window else seed
        left = len(ids[doc])
        while left:
            take = min(room, left)
            left, room = left - take, room - take
            if not room:
                room, seed = window, doc if left else None
    return order


def test_lexical_windows():
    r = np.random.default_rng(6)
    ids = [np.append(r.integers(1 + 40 * (i % 5), 60 + 40 * (i % 5), r.integers(1, 50)), 0).astype(np.uint16) for i in range(120)]
    df = np.bincount(packing.term_counts(ids)[1], minlength=packing.TERMS)
    assert [df[t] for t in range(300)] == [sum(t in one for one in ids) for t in range(300)]
    tokens = sum(map(len, ids))
    pieces = packing.fill_windows(ids, packing.Corpus.of(df, len(ids), tokens), 64)
    order = list(dict.fromkeys(d for d, *_ in pieces))
    assert order == brute_windows(ids, df, len(ids), tokens / len(ids), 64)


def test_corpus_statistics_cover_all_documents(spark):
    docs = frame(spark, corpus()).repartition(5)
    encoded = wavelet.tokenised(docs, public_path("byte_bpe_50k.json"), True, 0, frequencies=True).cache()
    ids = [np.frombuffer(r.ids, "<u2").tolist() for r in encoded.collect()]
    found = packing.corpus_of(encoded)
    want = packing.Corpus.of(np.bincount([t for one in ids for t in set(one)], minlength=packing.TERMS), len(ids), sum(map(len, ids)))
    assert np.allclose(found.idf, want.idf) and found.mean == want.mean


def test_packing(spark):
    rows = corpus()
    got = packing.pack(frame(spark, rows), shard_ids=2000, with_ids=True).collect()
    tool = WordTokenizer(public_path("byte_bpe_50k.json"), True).tokenizer
    want = sorted(((i, tuple(tool.encode(t or "", add_special_tokens=False).ids + [0])) for i, t, _ in rows), key=repr)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(ids) == r.length
        pieces[r.doc_id].append((r.start, tuple(ids.tolist())))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 1024 or at & (at - 1) == 0  # no padding at all
    single = [(i, ids) for i, ids in want if i]  # 0 and null stand several times
    assert single == sorted(((i, sum((p for _, p in sorted(ps)), ())) for i, ps in pieces.items() if i), key=repr)
    lost = sorted(sum((p for _, p in pieces[None]), ()))
    assert lost == sorted(sum((ids for i, ids in want if i is None), ()))
    assert sum(n for parts in sequences.values() for _, n in parts) == sum(len(ids) for _, ids in want)


def test_mixing(spark):
    rows = corpus()
    got = mixing.mix_sizes(frame(spark, rows)).collect()
    size = lambda t: len((t or "").encode().split())
    totals = defaultdict(int)
    for _, t, s in rows:
        totals[s] += size(t)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: n % 3 + 1 for n, s in enumerate(order)}
    target, left = {}, sum(totals.values())
    free = set(order)
    while True:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * unit > 3 * totals[s]}
        if not full:
            break
        for s in full:
            target[s] = 3 * totals[s]
            left -= target[s]
        free -= full
    target.update({s: weight[s] * unit for s in free})
    by_target = defaultdict(list)
    for r in got:
        by_target[round(r.target, 6), r.source_size].append(r)
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
    assert sorted(by_target) == sorted({(round(t, 6), totals[s]) for s, t in target.items()})
    for (t, _), rs in by_target.items():
        assert abs(sum(r.taken for r in rs) - t) <= 2 * max(r.size for r in rs)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sizes(frame(spark, rows)).collect()), key=repr)
    emitted = mixing.mixed_documents(frame(spark, rows))
    assert emitted.count() == sum(r.copies for r in got) and emitted.columns == frame(spark, rows).columns


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


@pytest.mark.parametrize("width,num,den,small", [(4, 85, 100, 12), (4, 85, 100, 2), (5, 80, 100, 2)])
def test_jaccard(spark, monkeypatch, width, num, den, small):
    monkeypatch.setattr(jaccard, "SMALL_GROUP", small)
    rows = [(i, t, s) for i, t, s in corpus(5) if i is not None]
    got = {r.doc_id: r for r in jaccard.jaccard_classes(frame(spark, rows), width, num, den).collect()}
    sets = {i: shingles(t, width) for i, t, _ in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), find(i)) for i in ids}
    assert len({find(i) for i in ids}) > 20


def test_parity_bands():
    bands = jaccard.Bands(85, 100)
    for n in (1, 6, 7, 40, 147, 5000):
        for m in range(n, n * 100 // 85 + 1):
            common = -(-85 * (n + m) // 185)
            assert n + m - 2 * common <= min(bands.differ(n), bands.differ(m))
            assert set(bands.of(n)) & set(bands.of(m))


def test_nearest(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(400, 16)).astype(np.float32)
    v[50:80] = v[7]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(500, None), (600, [0.0] * 16), (700, [float("nan")] * 16), (800, [None] + [1.0] * 15), (900, [1.0, 2.0]), (None, v[0].tolist()), (100, v[100].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit(2), "block": F.lit(3)})
    got = defaultdict(list)
    for x in neighbours.nearest(table, "vec_id % 50 = 0 and vec_id != 100").orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.score, x.vec_id))
    d = np.concatenate([v, v[100:101]]).astype(np.float64)
    ids = [*range(400), 100]
    assert set(got) == set(range(0, 400, 50)) - {100}
    for q, found in got.items():
        scores = neighbours.exact_distance(np.repeat(d[q][None], len(ids), 0), d)
        assert found == sorted((float(s), i) for n, (i, s) in enumerate(zip(ids, scores, strict=True)) if n != q)[:10]


def test_nearest_of_repeated_ids_and_wide_vectors(spark):
    r = np.random.default_rng(8)
    v = np.sign(r.normal(size=(60, 4096)))  # codes of 127 everywhere: the largest products
    v[:30, :40] *= r.uniform(0.99, 1, size=(30, 40))
    rows = [(i % 50, x.tolist()) for i, x in enumerate(v)]  # ids 0 to 9 stand twice
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 5, 4)
    found = sorted((x["rank"], x.vec_id, x.score) for x in got.collect())
    want = []
    for n in (5, 55):
        scores = neighbours.exact_distance(np.repeat(v[n][None], 60, 0), v)
        best = sorted((float(s), i % 50) for i, s in enumerate(scores) if i != n)[:4]
        want += [(k + 1, i, s) for k, (s, i) in enumerate(best)]
    assert found == sorted(want)
    a, b = r.integers(-127, 128, (3, 5000)).astype(np.int8), r.integers(100, 128, (4, 5000)).astype(np.int8)
    assert (neighbours.code_products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def brute_spans(text):
    import re

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s[::-1])) % 10 == 0
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


def test_personal_data(spark):
    r = random.Random(4)
    alphabet = ["a", "b.", "@", ".", "-", "+", "1", "25", "256", " ", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "+1 (555) 123-4567", "é", "\n", "%"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(1500)] + [t or "" for t in ODD]
    assert all(pii.base_spans(t) == brute_spans(t) for t in texts)
    rows = [(i, f"agent Zorblat met bob{i % 2}@x.org today", "s") for i in range(4)] + [(10 + i, f"plain words {i}", "s") for i in range(40)] + [(99, None, "s")]
    found = {x.doc_id: x for x in pii.personal_data(frame(spark, rows)).collect()}
    assert len(found) == len(rows) and [s.kind for s in found[0].base] == ["email"] and not found[99].spans
    clean = pii.sanitise(frame(spark, rows), pii.personal_data(frame(spark, rows), threshold=0.5)).where("doc_id = 0").first().clean_text
    assert "bob0" not in clean and "<email>" in clean and "zorblat" not in clean.lower()


def test_disclosure_covers_whole_texts(spark):
    far = "wrote a very long letter about nothing much at all to"
    rows = [(i, f"王五 u7 Zorblat {far} bob@x.org", "s") for i in range(3)]
    rows += [(3, "only (Zorblat), u7 and 王五 here", "s")] + [(10 + i, f"plain words {i} {far}", "s") for i in range(60)]
    rows += [(0, "another text of the id: amy@x.org", "s"), (0, "a short one", "s")]
    docs = frame(spark, rows)
    found = pii.personal_data(docs)
    clean = {r.text: r.clean_text for r in pii.sanitise(docs, found).collect()}
    assert len(clean) == len({t for _, t, _ in rows})
    assert clean[rows[0][1]].split() == [*far.split(), "<email>"]  # eleven words lie between name and value
    assert clean[rows[3][1]] == "only (),  and  here"  # the terms without the value
    assert clean["another text of the id: amy@x.org"] == "another text of the id: <email>" and clean["a short one"] == "a short one"
    got = {t.term: t.disclosure for t in pii.revealing_terms(docs, 0.5, 2).collect()}
    n = len(rows)
    assert set(got) == {"王五", "u7", "zorblat"}
    assert all(abs(d - np.log(3 / 4 * n / 3) / np.log(n / 3)) < 1e-9 for d in got.values())


def test_disclosure_by_shuffle_is_the_same(spark, monkeypatch):
    rows = [(i, f"{'Zorblat, ' * (i % 3)}met bob{i % 2}@x.org with İnci", "s") for i in range(9)] + [(20 + i, f"plain words {i} zorblat"[: 14 + i], "s") for i in range(30)]
    rows += [(None, None, "s"), (None, "bob1@x.org Zorblat", "s"), (3, "", "s"), (3, "Zorblat " * 5000, "s")]
    docs = frame(spark, rows)
    told = lambda: sorted(map(str, pii.digest(pii.personal_data(docs, 0.3)).collect()))
    few = told()
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert told() == few and len(few) == len(rows)
    # against plain Python
    sets = [({pii.entity(k, t[a:b]) for k, a, b in brute_spans(t)}, set(pii.words_of(pii.blanked(t, brute_spans(t)))) - {""}) for t in ((t or "") for _, t, _ in rows)]
    n, want = len(rows), {}
    for e in set().union(*(es for es, _ in sets)):
        for w in set().union(*(ws for _, ws in sets)):
            we, ww, both = (sum(1 for es, ws in sets if ok(es, ws)) for ok in (lambda es, ws: e in es, lambda es, ws: w in ws, lambda es, ws: e in es and w in ws))
            if min(we, ww, both) >= 2 and (d := np.log(both / ww * n / we) / -np.log(we / n)) >= 0.3:
                want[e, w] = d
    got = {(r.entity, r.term): r.disclosure for r in pii.revealing_terms(docs, 0.3, 2).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and got


def test_sanitise_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a bob@x.org", "k", "m", "old")], "doc_id long, text string, key string, marks string, clean_text string")
    row = pii.sanitise(docs, pii.personal_data(docs)).first()
    assert row.asDict() == {"doc_id": 1, "text": "a bob@x.org", "key": "k", "marks": "m", "clean_text": "a <email>"}


def test_temporal_list(spark):
    entries = spark.createDataFrame([("x.org", "block", "2024-01-02"), ("x.org", "remove", "2024-01-05"), ("a.x.org", "review", "2024-01-03"), (None, "block", "2024-01-01"), ("y.org", "block", None)], "domain string, action string, at string")
    cases = [("http://a.x.org/p", "2024-01-01"), ("http://a.x.org/p", "2024-01-02"), ("http://a.x.org:80/p", "2024-01-04"), ("http://b.x.org", "2024-01-05"), ("no url", "2024-01-03"), (None, None), ("http://b.x.org", "2024-01-04")]
    captures = spark.createDataFrame([(n, u, f) for n, (u, f) in enumerate(cases)], "id long, url string, fetched string")
    got = {r.id: r.action for r in urls.filter_captures(captures, entries).collect()}
    assert [got[n] for n in range(len(cases))] == ["none", "block", "review", "none", "none", "none", "block"]


def test_temporal_list_of_any_depth(spark):
    deep = ".".join("abcdefghijklmno") + ".x.org"  # 17 labels
    entries = spark.createDataFrame([(deep, "block", "2024-01-01"), ("x.org", "review", "2024-01-01"), ("zip", "block", "2024-01-01")], "domain string, action string, at string")
    captures = spark.createDataFrame([(0, f"http://{deep}/", "2024-02-01"), (1, "http://a.b.zip", "2024-02-01"), (2, "http://n.x.org", "2024-02-01"), (3, "http://zip.org", "2024-02-01")], "id long, url string, fetched string")
    got = {r.id: (r.matched, r.action) for r in urls.filter_captures(captures, entries).collect()}
    assert got == {0: (deep, "block"), 1: ("zip", "block"), 2: ("x.org", "review"), 3: (None, "none")}


#: Notices as they stand in files.
PROBES = [
    ("mit", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE'),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appear in all copies."),
    ("apache-2.0", 'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("gpl-3.0", "Distributed under GPLv3."), ("cc-by-sa", "CC-BY-SA 3.0 licence"), ("mit", "Released under MIT"),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("proprietary", "All rights reserved."),
]


def brute_licences(model, text):
    """Windows scored one by one, neighbours of one family joined."""
    import re

    out, at = [], 0
    for part in re.split(r"\n[ \t\r\f\v]*(?=\n)", text):
        words = licences.words_of(part)
        starts = range(0, max(1, len(words) - licences.HALF), licences.HALF) if words else []
        runs = []
        for s in starts:
            own = words[s : s + 2 * licences.HALF]
            inner = words[s:]  # an n-gram may run past its window, not past its paragraph
            grams = [" ".join(inner[i : i + n]) for i in range(len(own)) for n in (1, 2, 3) if i + n <= len(inner)]
            z = model.bias.copy()
            for g in grams:
                ws = g.split(" ")
                b = model.grams.buckets(ws, np.arange(len(ws), 0, -1))[0, len(ws) - 1]
                z = z + model.weights[b] / np.sqrt(len(grams))
            family = licences.FAMILIES[int(z.argmax())]
            beside = runs and runs[-1][2] == s - licences.HALF
            if beside and (runs[-1][0] == family or runs[-1][0] in UNVERSIONED.get(family, ())):
                runs[-1][2] = s
            elif beside and family in UNVERSIONED.get(runs[-1][0], ()):
                runs[-1] = [family, runs[-1][1], s]
            else:
                runs.append([family, s, s])
        for family, low, high in runs:
            if family != "unknown":
                own = words[low : high + 2 * licences.HALF]
                family = said_by(family, own)
                out.append((family, own, licences.confirmed(own, family)))
    return out


def test_licences():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    plain = lambda n: " ".join(r.choice(words) for _ in range(n))
    model = licences.train([plain(60) for _ in range(60)])
    bsd = LEARN["bsd"][0]
    wrapped = bsd[:70].rsplit(" ", 1)[0] + "\n" + bsd[len(bsd[:70].rsplit(" ", 1)[0]) + 1 :]
    # names amid words that no reference was learned with
    texts = [(f, f"{plain(n)} {said.format(name)} {plain(m)}") for n, m in ((0, 0), (3, 40), (500, 30)) for f, names in NAMES.items() for name in names for said in SAID_ELSEWHERE]
    families, texts = [f for f, _ in texts], [t for _, t in texts]
    found = model.scan(texts)
    caught = [any(x[0] == f and x[2] for x in fs) for f, fs in zip(families, found, strict=True)]
    assert sum(caught) / len(caught) > 0.85
    # passages that nothing was learned from
    held = [(f, t) for f, ts in CONFIRM.items() for t in ts]
    met = [any(f == x[0] or f in UNVERSIONED.get(x[0], ()) or x[0] in UNVERSIONED.get(f, ()) for x in fs) for (f, _), fs in zip(held, model.scan([t for _, t in held]), strict=True)]
    assert sum(met) / len(met) > 0.55
    odd = ["", "İİ " + plain(20) + "\n\n" + wrapped + "\n \nİ Released under the MIT License.", "word " * 5000, plain(400), "no license, no copyright, no permission"]
    for text, fs in zip(odd + texts[:5], model.scan(odd + texts[:5]), strict=True):
        want = brute_licences(model, text)
        assert [(f[0], f[2], licences.words_of(text[f[3] : f[4]])) for f in fs] == [(f, sure, own) for f, own, sure in want]
    assert [f[0] for f in model.scan(odd)[1]] == ["bsd", "mit"] and model.scan(odd)[1][1][2]
    for family, text in PROBES:
        assert family in {f[0] for f in model.scan([text])[0]}, text
    assert not any(f[2] for fs in model.scan(odd[2:]) for f in fs)


def test_licence_findings(spark):
    rows = [(i, f"plain words number {i} and some more of them", "s") for i in range(30)] + [(1, "Released under the MIT License.", "s")] * 2
    rows += [(None, "x " * 20_000 + "Licensed under the Apache License, Version 2.0.", "s"), (None, None, "s"), (50, "", "s")]
    docs = frame(spark, rows).withColumn("findings", F.lit(1))
    found = licences.summary(licences.licence_findings(docs)).collect()
    assert len(found) == len(rows)
    assert sorted(r.families for r in found if r.families) == ["apache-2.0", "mit", "mit"]
    assert len(licences.sample_of(docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))) == 31


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs.unionByName(frame(spark, [(-1, None, "s"), (-2, "", "s")]).select(docs.columns)), labels)
    rows = scored.join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count() + 2 and all(0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and r.quality is not None]
    assert sum(r.predicted == r.quality for r in judged) / len(judged) > 0.9
    assert len({r.score for r in rows if r.doc_id in (-1, -2)}) == 1


def test_quality_sample_is_bounded(spark):
    docs = frame(spark, [(1, f"copy {i}", "s") for i in range(50)] + [(2, "two", "s"), (3, "three", "s"), (3, "x" * 99, "s")])
    known = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, quality int")
    got = quality.sample_of(docs, known, 5, 20)
    assert got.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, got.collect())) == [(1, 0, "copy 0"), (2, 1, "two"), (3, 1, "three")]


def brute_score(net, text):
    """The network's answer window by window, in double precision."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n = max(1, -(-len(text) // quality.HALF))
    data = text + bytes((n + 1) * quality.HALF - len(text))
    pooled = []
    for half in range(n):
        best = np.full(quality.FILTERS, -np.inf)
        for spot in range(quality.SPOTS):
            at = half * quality.HALF + spot * quality.STEP
            window = np.concatenate([p["embed"][b] for b in data[at : at + quality.WINDOW]])
            best = np.maximum(best, window @ p["filter"])
        pooled.append(best + p["bias"])
    chunks = [np.maximum(a, b) for a, b in zip(pooled, pooled[1:], strict=False)] or pooled
    fill = min(1.0, len(text) / (2 * quality.HALF))
    scores = [np.maximum(np.append(np.maximum(h, 0), fill) @ p["hidden"] + p["hidden_bias"], 0) @ p["out"] for h in chunks]
    return p["mix"][0] * np.mean(scores) + p["mix"][1] * min(scores) + p["mix"][2]


def test_network_against_plain_sums():
    r = random.Random(12)
    net = quality.ByteConv.fresh(3)
    texts = [b"", b"a", b"x" * 128, b"y" * 129, bytes(r.randrange(256) for _ in range(1000)), "é ü 日本".encode() * 40]
    assert np.allclose(net.logits(texts), [brute_score(net, t) for t in texts], atol=1e-4)
    assert np.allclose(quality.ByteConv.from_bytes(net.to_bytes()).logits(texts), net.logits(texts))


def test_quality_of_odd_rows(spark):
    rows = [(i, ("good words here " if i % 2 else "@@@@ #### ") * 20 + str(i), "s") for i in range(60)]
    rows += [(1, rows[1][1], "s"), (1, rows[1][1], "s"), (None, None, "s"), (None, "", "s"), (99, "x" * 300_000, "s")]
    docs = frame(spark, rows).withColumn("quality_score", F.lit("mine")).withColumn("score", F.lit(5))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, None), (None, 1), (5, 7)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and len({r.score for r in got if r.doc_id is None}) == 1
    one_class = quality.quality_scores(docs, labels.where("quality = 1")).collect()
    assert len(one_class) == len(rows) and all(0 <= r.score <= 1 for r in one_class)


def test_jaccard_of_rows_without_ids(spark):
    text = lambda stem, last: " ".join([f"{stem}{i}" for i in range(60)] + [last])
    rows = [(None, text("a", "x"), "s"), (None, text("a", "y"), "s"), (7, text("a", "z"), "s"), (None, text("b", "x"), "s"), (None, text("b", "y"), "s"), (None, None, "s"), (3, "", "s"), (4, " \n", "s")]
    rows += [(9, "word " * 40_000, "s"), (8, "word " * 30_000, "s"), (5, "word word", "s")]  # one shingle over and over
    got = sorted(map(str, jaccard.jaccard_classes(frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()))
    want = [(None, 58, 7), (None, 58, 7), (7, 58, 7), (None, 58, None), (None, 58, None), (None, 0, None), (3, 0, 3), (4, 0, 4), (9, 1, 8), (8, 1, 8), (5, 1, 5)]
    assert got == sorted(f"Row(doc_id={d}, n_shingles={n}, component_id={c})" for d, n, c in want)


def test_temporal_list_of_odd_rows(spark):
    entries = [("x.org", "block", "2024-01-01"), ("x.org", "allow", "2024-01-01"), ("2.3.4", "block", "2024-01-01"), ("1.2.3.5", "block", "2024-01-01"), ("[::1]", "block", "2024-01-01"), ("X.com ", "block", "2024-01-01"), ("x.org", None, "2024-02-01"), ("x.org", "block", "2024-01-01")]
    entries = spark.createDataFrame(entries, "domain string, action string, at string").withColumn("id", F.lit(1)).withColumn("host", F.lit("y"))
    cases = ["http://x.org/" + "p" * 100_000, "http://a.x.org", "http://a.x.org", "http://1.2.3.4/", "http://1.2.3.5:80/", "http://user@[::1]:8080/x", "HTTP://WWW.X.COM./", "", "http://", "ftp://x.org"]
    captures = spark.createDataFrame([(n, u, "2024-03-01") for n, u in enumerate(cases)] + [(None, "http://x.org", None)] * 2, "id long, url string, fetched string")
    captures = captures.withColumns({"matched": F.lit("z"), "action": F.lit("z"), "domain": F.lit("z"), "rid": F.lit("z")})
    got = urls.filter_captures(captures, entries).collect()
    assert len(got) == len(cases) + 2
    found = {r.id: (r.matched, r.action) for r in got if r.id is not None}
    none = (None, "none")
    assert [found[n] for n in range(len(cases))] == [("x.org", "block"), ("x.org", "block"), ("x.org", "block"), none, ("1.2.3.5", "block"), ("[::1]", "block"), ("x.com", "block"), none, none, ("x.org", "block")]
    assert all(r.action == "none" for r in got if r.id is None)


def test_empty_tables(spark):
    docs = frame(spark, [(1, "x", "s")]).where("doc_id > 1")
    for made in (
        exact_dedup.exact_dedup(docs), wavelet.wavelet_round_trip(docs), packing.pack(docs), mixing.mix_sizes(docs), mixing.mixed_documents(docs),
        jaccard.jaccard_classes(docs), pii.digest(pii.personal_data(docs)), licences.summary(licences.licence_findings(docs)),
        quality.quality_scores(docs, spark.createDataFrame([], "doc_id long, quality int")),
        neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 100 = 0"),
        urls.filter_captures(spark.createDataFrame([], "id long, url string, fetched timestamp"), spark.createDataFrame([], "domain string, action string, at timestamp")),
    ):
        assert made.count() == 0
