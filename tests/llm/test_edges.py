"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from docloom.llm import fingerprint, html_extract, license_scan, mixing, near_dup, pieces, pu_quality, quality_rules, secret_scan, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, n long, key long, id long, size long, copies long, kept boolean, score double, html string"


def _row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, len(text or ""), "h", 1, 2, 3, 4, 5, False, 0.5, "x")


@pytest.fixture(scope="module")
def docs(spark):
    long_text = " ".join(f"w{i}" for i in range(60_000))
    rows = [_row(1, None), _row(2, ""), _row(3, "one"), _row(3, "one"), _row(4, "one two three four five six"), _row(5, "one two three four five six", None), _row(None, "no id here at all"), _row(None, None, None), _row(6, long_text), _row(7, long_text + " end"), _row(8, " \n\t\n "), _row(9, "Released under the MIT License. token=abcdefgh1 ▁ x")]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(docs, nothing):
    got = quality_rules.judge(docs).collect()
    assert len(got) == 12 and sum(r.kept for r in got) == 2
    assert {r.doc_id for r in got if r.kept} == {6, 7}
    assert quality_rules.judge(nothing).count() == 0
    kept = quality_rules.filtered(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {6, 7}
    assert quality_rules.filtered(nothing).count() == 0


def test_secrets(docs, nothing):
    got = secret_scan.scan_digest(docs).collect()
    assert len(got) == 12 and sum(r.n_assign for r in got) == 1
    assert secret_scan.scan(docs).where("size(spans) > 0").count() == 1
    clean = secret_scan.redacted(docs)
    assert clean.columns == docs.columns and clean.where("text LIKE '%abcdefgh1%'").count() == 0
    assert clean.where("doc_id = 1 AND text IS NULL").count() == 1
    assert secret_scan.scan_digest(nothing).count() == secret_scan.redacted(nothing).count() == 0


def test_mixing(docs, nothing):
    sized = docs.select("doc_id", mixing.word_count("text").alias("size"), F.array("source").alias("sources"))
    got = mixing.mix(sized).collect()
    assert len(got) == 12 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(sized.limit(0)).count() == 0
    out = mixing.mixed_documents(docs, floor=1.0)
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 10
    assert mixing.mixed_documents(nothing).count() == 0


def test_near_duplicates(docs, nothing):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(8, 0)] == (8, True)
    assert got[(4, 4)] == (4, True) and got[(5, 4)] == (4, False)
    assert got[(6, 59_998)] == (6, True) and got[(7, 59_999)] == (6, False)
    assert got[(3, 1)] == (3, True)
    assert near_dup.near_duplicates(nothing).count() == 0
    once = near_dup.deduplicated(docs)
    assert once.columns == docs.columns
    assert sorted(r.doc_id for r in once.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 4, 6, 8, 9]
    assert once.where("doc_id IS NULL").count() == 2
    assert near_dup.deduplicated(nothing).count() == 0


def test_pieces(docs, nothing):
    got = pieces.encoded(docs).collect()
    assert len(got) == 12 and all(r.round_trip for r in got)
    assert [r.n_pieces for r in got if r.doc_id in (1, 2)] == [0, 0]
    assert pieces.encoded(nothing).count() == 0
    back = {r.doc_id: r.text for r in pieces.decoded(pieces.encoded(docs)).collect()}
    assert back[4] == "one two three four five six" and back[8] == " \n\t\n "


def test_fingerprints(docs, nothing):
    got = fingerprint.compared(docs).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert by[4] == by[5] and by[1] == by[2] and len(by[3]) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.compared(nothing).count() == 0
    assert fingerprint.compared(docs.where("doc_id = 4")).collect()[0].near_next == 1.0


def test_fingerprints_of_shifted_words(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(["new", *words])), (3, " ".join(words[:30] + words[31:])), (4, " ".join(f"v{i}" for i in range(60)))]
    got = {r.doc_id: r.near_next for r in fingerprint.compared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] > 0.8 and got[2] > 0.8 and got[3] < 0.4
    runs = fingerprint.fingerprints(spark.createDataFrame([(1, "a b c d e\n\nf")], "doc_id long, text string")).first().fp.runs
    assert runs == 6


def test_licenses(docs, nothing):
    got = license_scan.licenses(docs).collect()
    assert [(r.doc_id, r.license) for r in got] == [(9, "MIT-short")]
    assert license_scan.licenses(nothing).count() == 0


def test_pu_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(6, 1, 0), (4, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = pu_quality.classified(docs, labels).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    flat = pu_quality.classified(docs, labels.limit(0)).collect()
    assert {r.score for r in flat} == {0.5} and {r.predicted for r in flat} == {1}
    assert pu_quality.classified(nothing, labels).count() == 0


PAGES = "page_id long, url string, html string, host string, path string, text string, n long"


def _pages(spark):
    rows = [(1, None, None, "a", "b", "c", 1), (2, "nohost", "", "a", "b", "c", 1), (3, "http://X.org/a?b", "<p>hi", "a", "b", "c", 1), (3, "http://X.org/a?b", "<p>hi", "a", "b", "c", 1), (None, "http://y.net#z", "<article><p>a&amp;b</p><p> c\n d</p></article>" * 2000, "a", "b", "c", 1)]
    return spark.createDataFrame(rows, PAGES)


def test_url_filter(spark):
    got = {r.page_id: r for r in url_filter.judged(_pages(spark)).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow")
    assert (got[3].host, got[3].path, got[3].rule) == ("x.org", "/a", "org/")
    assert (got[None].host, got[None].path) == ("y.net", "")
    assert url_filter.judged(_pages(spark)).count() == 5
    assert url_filter.judged(spark.createDataFrame([], PAGES)).count() == 0


def test_html(spark):
    got = {r.page_id: r for r in html_extract.extracted(_pages(spark)).collect()}
    assert got[1].text == got[2].text == "" and got[3].text == "hi"
    assert got[None].text.startswith("a&b\n\nc d\n\na&b") and got[None].n_chars == len(got[None].text)
    assert html_extract.extracted(spark.createDataFrame([], PAGES)).count() == 0
