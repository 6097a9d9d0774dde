import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import text as T


def one(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", f(F.col("t")).alias("x")).orderBy("i").collect()]


def test_encoding_and_controls(spark):
    assert one(spark, T.fix_encoding, "‘a’ “b” – — … x y​z", None) == ["'a' \"b\" - - ... x yz", None]
    assert one(spark, T.remove_control_chars, "a\x07b\x0cc\n\t\rd‍") == ["abc\n\t\rd"]
    assert one(spark, T.nfkc, "ﬁ①", "plain", None) == ["fi1", "plain", None]


def test_hyphens_and_spaces(spark):
    assert one(spark, T.fix_hyphenation, "pre-\n trial", "pre-\n\n trial", "é-\nè", "a - b") == ["pretrial", "pretrial", "éè", "a - b"]
    assert one(spark, T.normalize_whitespace, "a\tb  c\r\nd\n\n\n\ne") == ["a b c \nd\n\ne"]


def repeated(text):
    lines = text.split("\n")
    counts = {}
    for line in lines:
        counts[line.strip()] = counts.get(line.strip(), 0) + 1
    return "\n".join(x for x in lines if not (x.strip() and counts[x.strip()] > 3 and len(x.strip()) < 100))


@pytest.mark.parametrize("text", ["a\nb\na\n a \na", "a\na\na", "\n\n\n\n\n", "x" * 120 + ("\n" + "x" * 120) * 5, "a\nb\nc\nd\na\nb\na\nb\na\nb"])
def test_repeated_lines(spark, text):
    assert one(spark, T.remove_repeated_lines, text) == [repeated(text)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n", max_size=40), min_size=1, max_size=20))
def test_repeated_lines_any(spark, texts):
    assert one(spark, T.remove_repeated_lines, *texts) == [repeated(t) for t in texts]


def test_pdf_noise(spark):
    got = one(spark, T.clean_pdf_noise, "Page 1\nCONFIDENTIAL x\nbody draft text\nconvicted under Section 302\n12\nend  of", "")
    assert got == ["body text\n\nend of", ""]


def test_annotate(spark):
    assert one(spark, T.annotate_sections, "see Section 3.2 now", "## Section 3", "# Section 3", "x# Section 3") == ["see \n## Section 3.2\n now", "## Section 3", "# Section 3", "x# Section 3"]


def test_headings(spark):
    md = "intro\n# A\ntext\n#### deep\n## B\n| a | b |"
    assert one(spark, T.split_headings, md) == [["intro", "# A\ntext\n#### deep", "## B\n| a | b |"]]
    assert one(spark, T.section_titles, md) == [["A", "deep", "B"]] and one(spark, T.has_tables, md, "none") == [True, False]


def test_preview_and_sentences(spark):
    long = "word " * 100
    assert one(spark, T.preview, " a \n b ", long) == ["a b", ("word " * 48)[:237].rstrip() + "..."]
    assert one(spark, T.sentences, "One. Two!  Three? four\nfive.", "  ", "") == [["One.", "Two!", "Three? four\nfive."[:6], "four\nfive."], [], []]
    assert one(spark, T.clean_sentence, " 12. - Hello   there - ") == ["Hello there"]


def test_tokens(spark):
    assert one(spark, T.tokens, "The Law. A-b/c 3.2, é x") == [["the", "law.", "a-b/c", "3.2", "x"]]
    assert one(spark, T.word_set, "B a  b\nA") == [["b", "a"]]
    assert one(spark, T.suffix, "a.PDF", "noext") == [".pdf", "unknown"]


def test_clean(spark):
    raw = "“Quoted”\t text here\x0c pre-\ntrial ﬁne\n\n\n\nsame\nsame\nsame\nsame\n"
    assert one(spark, T.clean, raw, None) == [unicodedata.normalize("NFKC", '"Quoted" text here pretrial ﬁne'), ""]


def test_table_markdown(spark):
    rows = spark.createDataFrame([([["h", None], ["a\nb", " c "]],), ([],)], "r array<array<string>>")
    assert [r.x for r in rows.select(T.table_markdown("r").alias("x")).collect()] == ["| h |  |\n| --- | --- |\n| a b | c |", None]
