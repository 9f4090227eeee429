"""Long histories of a domain, hot domains, and pairs of a document with many entities."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from lorekeep.llm import pii, urls

DAY = datetime(2024, 1, 1)


def in_force(entries, host, at):
    """The most specific entry of a host in force, by looking at all of them."""
    labels = host.split(".")
    for n in range(len(labels)):
        domain = ".".join(labels[n:])
        past = sorted((when, action) for d, action, when in entries if d == domain and when <= at)
        if past and past[-1][1] != "remove":
            return domain, past[-1][1]
    return None, "none"


@pytest.mark.parametrize("hot", [1000, 3])
def test_a_capture_meets_one_interval_of_a_long_history(spark, monkeypatch, hot):
    monkeypatch.setattr(urls, "HOT_CAPTURES", hot)
    r = random.Random(3)
    entries = [("hot.com", r.choice(["block", "review", "remove"]), DAY + timedelta(hours=n)) for n in range(400)]
    entries += [("a.hot.com", r.choice(["allow", "remove"]), DAY + timedelta(hours=n * 7)) for n in range(40)]
    hosts = ["hot.com", "a.hot.com", "b.a.hot.com", "cold.com"]
    captures = [(n, f"http://{r.choice(hosts)}/{n}", DAY + timedelta(minutes=r.randint(-600, 25000))) for n in range(300)]
    captures += [(400, "http://hot.com/", DAY + timedelta(hours=5)), (400, "http://hot.com/", DAY + timedelta(hours=5))]
    frame = spark.createDataFrame(captures, "id long, url string, fetched timestamp")
    got = urls.filter_captures(frame, spark.createDataFrame(entries, "domain string, action string, at timestamp")).collect()
    want = [(n, *in_force(entries, url.split("/")[2], at)) for n, url, at in captures]
    assert sorted((x.id, str(x.matched), x.action) for x in got) == sorted((n, str(m), a) for n, m, a in want)


def test_the_filter_passes_all_admissible_terms(spark):
    words = [f"w{n}" for n in range(500)] + ["é", "日本", "x" * 300]
    bits = pii.term_filter(spark.createDataFrame([(w,) for w in words], "term string"))
    assert bits.dtype == np.int64 and len(bits) == pii.FILTER_WORDS
    assert set(pii.passed(bits, set(words))) == set(words)
    assert len(pii.passed(bits, {f"other{n}" for n in range(5000)})) < 50
    assert pii.passed(pii.term_filter(spark.createDataFrame([], "term string")), {"a"}) == []
