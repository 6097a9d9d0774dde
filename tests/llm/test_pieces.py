"""Piece encoding against the library on short, odd and long texts, and in a worker that has met others."""

import random

import pytest
import sentencepiece

from docloom.llm import pieces

ALPHABET = ["a", "b", "e", "t", "h", " ", "  ", " " * 15, "\n", "\t", "é", "日", "本", "🎉", "ΩＡ", "1", "-", "the ", "ing", "==", "Ā", "и", "ab" * 20]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def fresh():
    return pieces.Encoder(pieces.default_model())


@pytest.mark.parametrize("n", range(1, 41))
def test_one_short_run(library, n):
    for text in ("x" * n, "g-ΩＡ,2"[:n], "日本語テスト"[:n] * 3, "ab" * n):
        assert fresh().encode([text])[0].tolist() == library.encode(text)


def test_random_texts(library):
    rng = random.Random(1)
    own = fresh()
    for i in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14)))
        own = fresh() if i % 100 == 0 else own
        assert own.encode([text])[0].tolist() == library.encode(text), text


def test_long_runs(library):
    rng = random.Random(2)
    for text in ("日本語のテキストは長い" * 400, "abab" * 1000, "中文" * 900 + "  x", " " * 3000, "".join(rng.choice("abcdefghij") for _ in range(4000))):
        assert fresh().encode([text])[0].tolist() == library.encode(text)


def test_new_run_after_a_warm_cache(library):
    own = fresh()
    own.encode(["some words that are met first " * 20])
    own.forget(10, 2)
    for text in ("z", "zq zq", "some new"):
        assert own.encode([text])[0].tolist() == library.encode(text)


def test_one_row_tables(spark, library):
    for text in ("g-ΩＡ,2", "", None, "q"):
        row = pieces.encoded(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert list(row.ids) == library.encode(text or "") and row.round_trip


def test_a_texts_runs_dont_stay_while_others_are_split():
    import tracemalloc

    own = pieces.Encoder(pieces.default_model())
    texts = ["the cat and the dog in a house of wood " * 400 for _ in range(50)]
    own.encode(texts)
    tracemalloc.start()
    ids, at = own.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(at) == 51 and own.decode(ids[: at[1]].tolist()) == texts[0]
    # bytes a run: numbers and offsets of all runs, not the runs themselves
    assert peak / (50 * 10 * 400) < 100
