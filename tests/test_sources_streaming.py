import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import corpus
from docloom.schema import CHUNKS, HISTORY
from docloom.sources import files, tables
from docloom.streaming import ingest as stream


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("docs")
    (d / "b.txt").write_bytes("plain é".encode() + b"\xff end")
    (d / "a.json").write_text(json.dumps({"content": "from content"}))
    (d / "l.json").write_text(json.dumps([{"text": "one"}, 5, {"content": "two"}]))
    (d / "x.pdf").write_bytes(b"%PDF")
    (d / "skip.TXT").write_text("no")
    (d / "sub").mkdir()
    (d / "sub" / "deep.txt").write_text("no")
    return str(d)


def test_documents_of_a_folder(spark, folder):
    got = {r.doc_name: r for r in files.read_documents(spark, folder).collect()}
    assert sorted(got) == ["a.json", "b.txt", "l.json", "x.pdf"]
    assert got["b.txt"].text == "plain é end" and got["a.json"].text == "from content" and got["l.json"].text == "one\n\ntwo"
    assert got["x.pdf"].error == "no PDF parser given"
    listed = files.listing(files.scan(spark, folder)).collect()
    assert [(r.doc_name, r.doc_type) for r in listed][:2] == [("a.json", ".json"), ("b.txt", ".txt")]


def test_pdf_plug_in(spark, folder):
    good = files.read_documents(spark, folder, lambda: lambda b: ["Page 1 of 2\nSee Section 3 now", "second\n12\n"]).where("doc_name = 'x.pdf'").first()
    assert [p.page_num for p in good.pages] == [1, 2] and good.text == "See \n## Section 3\n now\n\nsecond"
    assert good.pages[0].metadata.sections == ["Section 3"] and good.error is None

    def broken():
        def parse(b):
            raise ValueError("bad file")

        return parse

    assert files.read_documents(spark, folder, broken).where("doc_name = 'x.pdf'").first().error == "ValueError: bad file"


@pytest.mark.parametrize("raw,want", [('{"text": "t", "content": "c"}', "t"), ('{"a": 1}', '{"a": 1}'), ("[]", ""), ("3", "3"), ("not json", ""), (None, "")])
def test_json_text(raw, want):
    assert files.json_text(raw) == want


def test_markdown_pages(spark):
    rows = spark.createDataFrame([("# A\nx\n## B\n| t |",), ("plain",)], "t string").select(files.pages_of_markdown(F.col("t"), F.lit("f.pdf")).alias("p")).collect()
    assert [(p.page_num, p.text, p.metadata.has_tables, p.metadata.total_pages) for p in rows[0].p] == [(1, "# A\nx", False, 2), (2, "## B\n| t |", True, 2)]
    assert len(rows[1].p) == 1


def test_tables(spark, tmp_path):
    path = str(tmp_path / "chunks")
    assert tables.load(spark, path, CHUNKS).count() == 0
    tables.save(spark.createDataFrame([("c", "d", 0, 1, None, None, None, "t", [])], CHUNKS), path)
    assert tables.load(spark, path, CHUNKS).first().chunk_id == "c"
    tables.clear(spark, path, CHUNKS)
    assert tables.load(spark, path, CHUNKS).count() == 0


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    for i in range(3):
        tables.append_history(spark.createDataFrame([(f"q{i}", "a", f"2024-01-0{i + 1} 00:00:00", 0.5, 1)], HISTORY), path)
    assert [r.question for r in tables.history(spark, path, 2).collect()] == ["q2", "q1"]


def test_delete_cascades(spark):
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d2")], "chunk_id string, doc_name string")
    postings = spark.createDataFrame([("k", "c1"), ("k", "c2")], "key string, chunk_id string")
    left = tables.delete_documents({"chunks": chunks, "postings": postings}, spark.createDataFrame([("d1",)], "doc_name string"))
    assert [r.chunk_id for r in left["chunks"].collect()] == ["c2"] == [r.chunk_id for r in left["postings"].collect()]


def test_qa_and_ner_files(spark, tmp_path):
    (tmp_path / "qa.json").write_text(json.dumps([{"question": "q", "answer": "a", "contexts": ["c"]}]))
    assert tables.read_qa(spark, str(tmp_path / "qa.json")).first().contexts == ["c"]
    (tmp_path / "ner.json").write_text(json.dumps([{"text": "t", "entities": [[0, 1, "ACT"]]}]))
    assert tuple(tables.read_ner(spark, str(tmp_path / "ner.json")).first().entities[0]) == (0, 1, "ACT")


def test_stream_appends_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    text = "SECTION 1. " + "The Supreme Court of India granted bail. " * 10
    for i in range(2):
        spark.createDataFrame([(f"d{i}.txt", text)], stream.DOCUMENTS).write.mode("append").parquet(source)
        stream.start(stream.document_stream(spark, source), out, check).awaitTermination()
    chunks = spark.read.parquet(f"{out}/chunks")
    assert sorted(r.doc_name for r in chunks.collect()) == ["d0.txt", "d1.txt"]
    assert spark.read.parquet(f"{out}/mentions").where("label = 'COURT'").count() == 2


def test_corpus(spark):
    chunks = spark.createDataFrame([("a.txt", 1, "x" * 10, 0, "SECTION", "1"), ("a.txt", 1, "y" * 5, 1, None, None), ("b.pdf", 2, "z", 0, None, None)], "doc_name string, page_num int, text string, chunk_index int, section string, section_num string")
    mentions = spark.createDataFrame([("a.txt", 0, 0, "ACT", "X Act"), ("a.txt", 0, 1, "DATE", "d")], "doc_name string, chunk_index int, pos int, label string, text string")
    m = corpus.metrics(chunks, mentions, chunks.select("doc_name").distinct()).first()
    assert (m.total_chunks, m.avg_chunk_chars, m.max_chunk_chars, m.distinct_pages, m.total_entities, m.entities_by_label, m.documents_by_type) == (3, 5.3, 10, 2, 2, {"ACT": 1, "DATE": 1}, {".txt": 1, ".pdf": 1})
    assert corpus.entity_rollup(mentions).first().samples == ["X Act (ACT)", "d (DATE)"]
    docs = spark.createDataFrame([("a.txt", "raw text", "clean"), ("none", "", "")], "doc_name string, raw string, clean string")
    got = {r.doc_name: r for r in corpus.traces(docs, chunks).collect()}
    assert got["none"].total_chunks == 0 and len(got["a.txt"].chunk_samples) == 2
    assert (got["a.txt"].section_titles, got["a.txt"].parser, got["a.txt"].page_count, got["a.txt"].raw_preview) == ([], "text", 1, "raw text")
    # titles come from the pages' headings; missing pages are no page reference, empty sections no section
    paged = docs.withColumn("pages", files.pages_of_markdown(F.lit("# B\nx\n# A\n| a |\n# B\ny"), F.col("doc_name")))
    t = {r.doc_name: r for r in corpus.traces(paged, chunks).collect()}["a.txt"]
    assert (t.section_titles, t.parser, t.page_count, [p.has_tables for p in t.page_samples]) == (["A", "B"], "markdown", 3, [False, True, False])
    more = chunks.unionByName(spark.createDataFrame([("a.txt", None, "z", 2, "", None), ("b.pdf", None, "z", 1, "PART", "2")], chunks.schema))
    assert corpus.metrics(more, mentions, docs).first().distinct_pages == 2
    listed = {r.doc_name: (r.chunks, r.sections, r.chars) for r in corpus.by_document(more, docs.select("doc_name").unionByName(spark.createDataFrame([("b.pdf",)], "doc_name string"))).collect()}
    assert listed == {"a.txt": (3, 1, 16), "none": (0, 0, 0), "b.pdf": (2, 1, 2)}
    assert spark.range(1).select(corpus.progress(F.lit(1), F.lit(4)).alias("p")).first().p == 25.0


def test_parsers_give_way(spark):
    def fails(content):
        raise RuntimeError("no")

    assert files.parse_first(b"x", (("a", fails), ("b", lambda c: []), ("c", lambda c: ["page"]))) == ("c", ["page"], None)
    assert files.parse_first(b"x", (("a", fails), ("b", lambda c: []))) == (None, [], "a: RuntimeError: no")
    row = spark.createDataFrame([(bytearray(b"x"),)], "content binary")
    load = lambda: lambda b: [("CONFIDENTIAL\nbody", [[["h", None], ["1", "a\nb"]]]), ("two", [])]
    pages = row.select(files.parse_pdf("content", load).alias("p")).select(files.pages_of_texts(F.col("p.texts"), F.lit("d.pdf"), "x", F.col("p.tables")).alias("pages")).first().pages
    assert pages[0].text == "body\n\n| h |  |\n| --- | --- |\n| 1 | a b |" and pages[1].text == "two" and [p.metadata.has_tables for p in pages] == [True, False]


def test_datasets_with_errors(spark, tmp_path):
    assert tables.qa_dataset(spark, str(tmp_path)).first().error == "No QA evaluation data found"
    (tmp_path / "b.json").write_text("[]")
    assert tables.qa_dataset(spark, str(tmp_path)).first().error == "QA evaluation data is empty"
    (tmp_path / "a.json").write_text(json.dumps([{"question": "q"}, {"question": "r", "answer": "s"}]))
    rows = tables.qa_dataset(spark, str(tmp_path)).collect()
    assert [(r.question, r.answer, r.error) for r in rows] == [("q", None, None), ("r", "s", None)]
    (tmp_path / "0.json").write_text("{broken")
    assert tables.ner_dataset(spark, str(tmp_path)).first().error.startswith("Failed to load NER training data")
