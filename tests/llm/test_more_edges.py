"""Graphs of dangling hosts, hosts of very many links, long pages and ties of rules; labels that stand twice."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import common, pu_quality, url_filter

PAGES = "page_id long, url string, html string"


def links(*hosts):
    return "".join(f"<a href='https://{h}/p'>x</a>" for h in hosts)


def test_dangling_hosts_only(spark):
    """No host that is linked to has links of its own: all rank returns to the seeds."""
    rows = [(1, "http://good.org/", links("a.net", "b.net")), (2, "http://bad.com/de/", links("b.net"))]
    got = {r.host: r for r in url_filter.host_verdicts(spark.createDataFrame([("good.org", rows[0][2], "allow"), ("bad.com", rows[1][2], "block")], "host string, html string, verdict string"), iterations=5).collect()}
    assert got["a.net"].trust == pytest.approx(got["b.net"].trust) and got["a.net"].trust > 0 and got["bad.com"].distrust > 0
    assert sum(r.trust for r in got.values()) == pytest.approx(1) and got["good.org"].distrust == 0
    assert {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(rows, PAGES), iterations=5).collect()} == {1: "allow", 2: "block"}


def test_a_host_of_many_links(spark, monkeypatch):
    rows = [(1, "http://hub.org/", links(*(f"h{i}.net" for i in range(60)))), (2, "http://h1.net/", links("hub.org", "h2.net")), (3, "http://bad.com/de/1", links("h2.net")), (4, "http://h3.net/", links("bad.com"))]
    pages = spark.createDataFrame(rows, PAGES)
    whole = lambda: sorted((r.page_id, r.verdict, round(r.trust, 9), round(r.distrust, 9)) for r in url_filter.judged(pages, iterations=4).collect())
    want = whole()
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    assert whole() == want and {v for _, v, _, _ in want} == {"allow", "block"}


def test_long_pages_and_ties(spark):
    rules = (("net", "/aa", "allow"), ("b.net", "/", "block"), ("net", "/ab", "block"))
    rows = [(1, "http://b.net/aa", "<p>" * 200_000), (1, "http://b.net/aa", None), (2, "http://b.net/" + "x" * 100_000, ""), (3, "HTTP://X.NET/ab?http://b.net/", "")]
    got = sorted((r.page_id, r.host, len(r.path), r.rule, r.verdict) for r in url_filter.judged(spark.createDataFrame(rows, PAGES), rules).collect())
    # "net/aa" and "b.net/" are equally long: the later by code point wins
    assert got == [(1, "b.net", 3, "net/aa", "allow"), (1, "b.net", 3, "net/aa", "allow"), (2, "b.net", 100_001, "b.net/", "block"), (3, "x.net", 3, "net/ab", "block")]


def test_labels_that_stand_twice(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.expr("concat('clean words in a row about topic ', id, ' and more of it')")).otherwise(F.expr("concat('### $$$ ', id, ' %% || ')")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality"))
    once = {r.doc_id: round(r.score, 6) for r in pu_quality.classified(docs, labels).collect()}
    twice = {r.doc_id: round(r.score, 6) for r in pu_quality.classified(docs, labels.unionByName(labels)).collect()}
    assert once == twice and all((once[i] >= 0.5) == (i % 2 == 0) for i in once)
    # labelled both good and bad: no positive
    both = labels.unionByName(labels.withColumn("quality", F.lit(0)))
    assert {r.score for r in pu_quality.classified(docs, both).collect()} == {0.5}
