"""Main text of pages: alignment against the textbook recursion, templates, articles and odd markup."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import html_text


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("kept", [256, 2])
def test_longest_common_subsequence(monkeypatch, kept):
    monkeypatch.setattr(html_text, "KEPT_ROWS", kept)
    r = random.Random(kept)
    for _ in range(400):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 14))] for _ in range(2))
        pairs = html_text.common_lines(np.array(a, np.int64), np.array(b, np.int64))
        assert len(pairs) == longest(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x < y and u < v for (x, u), (y, v) in zip(pairs, pairs[1:]))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><nav><ul><li>Home</ul></nav><div class="wrap"><article class="post"><header><h1>Title &eacute;</h1></header>
<p>One <b>two</b>
 three&nbsp;four<br>five<p>Second <a href="x>y">link</a><div class="ad">Buy</div><table><tr><td>a</td><td>b</td></tr></table>
<script>var x="</p>"</script><p>a < b &lt; c &#8212; &am</p><section id="comments"><p>Nice post</p></section></article></div>
<aside>side</aside><form><label>Email</label><input></form><div hidden>no</div><footer>f</footer><p class"""


def test_elements():
    got = html_text.main_text(html_text.lines_of(PAGE), set())
    assert got == "Title é\n\nOne two three four five\n\nSecond link\n\na b\n\na < b < c — &am"
    for odd in ("", "<", "<<", "<!--", "<p", "</", "<script>", "<p title='", "&", "<a <b>", "\x00<p>\x0b</p>", "<![CDATA[x"):
        html_text.lines_of(odd)
    assert html_text.main_text(html_text.lines_of("plain &amp; simple"), set()) == "plain & simple"
    assert html_text.main_text(html_text.lines_of("<h1>T</h1><main><p>x</p><nav>n</nav></main><div>y</div>"), set()) == "T\n\nx"
    many = "<div><p>" * 20000 + "deep"
    assert html_text.main_text(html_text.lines_of(many), set()) == "deep"


def site():
    """Pages without an article: a host's menu and footer around own lines; own lines of two pages may be alike."""
    r, rows = random.Random(1), []
    for n in range(60):
        own = [f"own {n} line {j} {r.random()}" for j in range(r.randint(2, 5))] + ["said by many"] * (n % 2)
        host = r.choice(["a.com", "b.com"]) if n < 50 else f"c{n}.com"
        lines = [f"{host} menu", f"{host} home", *own, f"all rights {host}", f"built {host}"]
        html = "".join(f"<div>{x}</div>" for x in lines)
        rows.append((n, f"http://{host}/x/{r.randint(0, 999):03d}.html", html, own, lines))
    return rows


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_templates_are_found_across_tasks(spark, tasks):
    rows = [(n, u, h.replace("<div>said by many</div>", "<article>said by many</article>") if n % 2 else h, own, lines) for n, u, h, own, lines in site()]
    extra = [(60, None, None), (61, None, "<p>alone"), (62, "http://d.com/1", "<article>same</article>"), (63, "http://d.com/2", "<article>same</article>")]
    frame = spark.createDataFrame([r[:3] for r in [*rows, rows[3], rows[3]]] + extra, "page_id long, url string, html string")
    frame = frame.withColumns({"host": F.lit(1), "key": F.lit("k"), "text": F.lit("t"), "page_key": F.lit(2), "marks": F.lit(3)})
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        got = html_text.extract(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows) + 2 + len(extra)
    texts = {r.page_id: r.text for r in got}
    for n, url, _, own, lines in rows:
        want = ["said by many"] if n % 2 else own if not url.startswith("http://c") else lines
        assert texts[n] == "\n\n".join(want), n
    assert [texts[n] for n in (60, 61, 62, 63)] == ["", "alone", "same", "same"]
    assert all(r.n_chars == len(r.text) and r.key == "k" and r.marks == 3 for r in got)


def test_copies_are_no_template_and_empty_tables(spark):
    text = "".join(f"<p>line {n}</p>" for n in range(10))
    rows = [(1, "http://a.com/a", text), (2, "http://a.com/b", text), (3, "http://a.com/c", text + "<p>more</p>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.n_chars for r in html_text.extract(frame).collect()} == {1: 78, 2: 78, 3: 84}
    assert html_text.extract(frame.limit(0)).collect() == []
