"""Lines that all pages of a site have go from pages with an article too."""

from lorekeep.llm import html_text


def test_a_site_heading_is_no_title_of_an_article(spark):
    rows = [(n, f"http://a.com/x/{n}.html", f"<div><h1>Site name</h1><p>menu</p></div><article><p>own words of page {n} {'abc' * n}</p></article>") for n in range(1, 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {n: f"own words of page {n} {'abc' * n}" for n in range(1, 9)}
    alone = html_text.extract(pages.limit(1)).first()
    assert alone.text == "Site name\n\nown words of page 1 abc"
