"""The pipeline on odd documents: no rows, one row, null ids and texts, repeated rows, extra columns."""

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, id long, copies long"


def run(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    return corpus_pipeline.run(spark, str(tmp_path)).collect()


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, len(text or ""), "h", 1, 2)


@pytest.mark.parametrize("rows", [[], [row(1, None)], [row(1, "a b c")]])
def test_nothing_is_left(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == []


def test_one_row(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    got = run(spark, tmp_path, [row(1, text)])
    assert {r.doc_id for r in got} == {1} and all(r.round_trip for r in got)


def test_null_ids_copies_and_extra_columns(spark, tmp_path):
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    rows = [row(None, text("a")), row(None, text("a")), row(None, text("b"), None), row(3, text("c")), row(3, text("d")), row(4, text("c")), row(5, None), row(6, "")]
    got = run(spark, tmp_path, rows)
    assert {r.doc_id for r in got} == {None, 3} and len({(r.doc_id, r.n_chars, tuple(r.ids)) for r in got}) == 4
