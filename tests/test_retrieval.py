import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import lexical, retrieval, vectors

DOCS = [(1, "bail was granted by the court"), (2, "the court refused bail bail"), (3, "a treaty of peace"), (4, ""), (5, None), (6, "the the the")]


def okapi(query, docs, k1=1.5, b=0.75, eps=0.25):
    tf = {d: Counter((t or "").lower().split()) for d, t in docs}
    n, avg = len(docs), sum(sum(c.values()) for c in tf.values()) / len(docs)
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else floor for w, v in idf.items()}
    out = {d: sum(idf.get(w, 0) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / avg)) for w in query.split() if c[w]) for d, c in tf.items()}
    return {d: s for d, s in out.items() if s > 0}


def test_bm25(spark):
    built = lexical.build(spark.createDataFrame(DOCS, "id long, text string"))
    queries = spark.createDataFrame([(1, "bail court"), (2, "the peace the"), (3, "unknown")], "query_id long, text string")
    got = {}
    for r in lexical.scores(built, queries).collect():
        got.setdefault(r.query_id, {})[r.id] = r.score
    assert got[1] == pytest.approx(okapi("bail court", DOCS)) and got[2] == pytest.approx(okapi("the peace the", DOCS)) and 3 not in got


def test_min_max_and_best(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (1, 3, 4.0), (2, 9, 7.0)], "query_id int, id int, score double")
    assert {(r.query_id, r.id): r.norm for r in vectors.min_max(rows).collect()} == {(1, 1): 0.0, (1, 2): 1.0, (1, 3): 1.0, (2, 9): 1.0}
    assert [(r.id, r.rank) for r in vectors.best(rows, 2).where("query_id = 1").orderBy("rank").collect()] == [(2, 1), (3, 2)]


def test_vector_search(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").cache()
    asked = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    want = {q: set(np.argsort(-(v @ v[q]))[:10].tolist()) for q in range(0, 300, 20)}
    exact, cells = {}, {}
    for r in vectors.search(corpus, asked, 10).collect():
        exact.setdefault(r.query_id, set()).add(r.id)
    assert exact == want
    for r in vectors.CellIndex(corpus).search(asked, 10).collect():
        cells.setdefault(r.query_id, set()).add(r.id)
    assert np.mean([len(cells[q] & want[q]) / 10 for q in want]) >= 0.9
    with pytest.raises(ValueError):
        vectors._checked(asked, 3)


def test_more_queries_than_are_broadcast(spark, sf, monkeypatch):
    from docloom.plans import catalog

    v = np.random.default_rng(4).normal(size=(200, 8))
    corpus = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>").cache()
    asked = corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    cells = vectors.CellIndex(corpus)
    runs = (lambda: vectors.search(corpus, asked, 5), lambda: cells.search(asked, 5), lambda: catalog.precision_recall_at_k(spark, sf), lambda: catalog.mrr(spark, sf), lambda: vectors.best(vectors.scores(corpus, asked), 5))
    # products of other blocks differ in their last digits
    rows = lambda f: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in f().select(*sorted(f().columns)).collect())
    want = [rows(f) for f in runs]
    assert want[0] == want[4]
    monkeypatch.setattr(vectors, "MAX_QUERIES", 3)
    monkeypatch.setattr(vectors, "MAX_BYTES", 400)  # a few queries a block
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(vectors._blocks(asked)) > 2
        plan = vectors.scores(corpus, asked)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Broadcast" not in plan
        assert [rows(f) for f in runs] == want and all(want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_fallback_vectors(spark):
    got = [r.v for r in spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(vectors.embed_fallback("t", 16).alias("v")).collect()]
    assert got[0] == got[1] != got[2] and sum(x * x for x in got[0]) == pytest.approx(1, abs=1e-5)


def test_intents(spark):
    cases = {"What is bail?": "definition", "Which section applies": "section", "Why so": "reasoning", "the significance": "condition", "steps to file": "procedure", "compare x": "comparison", "the ruling": "case_based", "who sat": "factual", "hello": "general"}
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "q string, want string")
    assert [r.q for r in rows.select("q", "want", retrieval.intent(F.col("q")).alias("got")).where("want <> got").collect()] == []
    assert rows.select(retrieval.intent(F.lit("hello"), F.lit(True)).alias("x")).first().x == "section"


def test_bonus_and_overlap(spark):
    row = spark.createDataFrame([("This section means it, provided that a prayer",)], "t string")
    at = lambda intent, i, n: round(row.select(retrieval.structure_bonus(F.col("t"), F.lit(intent), F.lit(i), F.lit(n)).alias("b")).first().b, 6)
    assert (at("section", 9, 10), at("definition", 0, 10), at("condition", 1, 0), at("general", 3, 10)) == (0.0, 0.01, -0.02, -0.08)
    over = row.select(retrieval.entity_overlap(F.lit("the Supreme Court"), F.array(F.lit("supreme"), F.lit("court x"), F.lit("none"))).alias("o")).first().o
    assert over == 0.5


def test_fusion(spark):
    a = spark.createDataFrame([(1, "x", 1, 0.9), (1, "y", 2, 0.8), (2, "z", 1, 0.1)], "query_id int, id string, rank int, score double")
    b = spark.createDataFrame([(1, "y", 1, 5.0), (1, None, 2, 4.0)], "query_id int, id string, rank int, score double")
    got = {(r.query_id, r.id): (r.score, r.original_score, r.rank) for r in retrieval.fuse([a, b]).collect()}
    assert got[(1, "y")] == (pytest.approx(1 / 62 + 1 / 61), 5.0, 1) and got[(1, "x")][2] == 2 and len(got) == 3
    again = {(r.query_id, r.id): r.score for r in retrieval.fuse([b, a]).collect()}
    assert again == pytest.approx({k: v[0] for k, v in got.items()})
    mixed = {(r.query_id, r.id): r.score for r in retrieval.combined(a, b, top=5).collect()}
    assert mixed[(2, "z")] == 0.1 and mixed[(1, "y")] == pytest.approx(1 / 62 + 1 / 61)


def test_rerank(spark):
    import pandas as pd

    rows = spark.createDataFrame([(1, "a", 0.5, 2, "q", "long text"), (1, "b", 0.9, 1, "q", "t")], "query_id int, id string, score double, rank int, question string, text string")
    assert [(r.id, r.rank) for r in retrieval.rerank(rows, 1).collect()] == [("b", 1)]
    got = retrieval.rerank(rows, 2, lambda: lambda q, t: pd.Series([float(len(x)) for x in t])).orderBy("rank").collect()
    assert [(r.id, r.score, r.original_score) for r in got] == [("a", 9.0, 0.5), ("b", 1.0, 0.9)]


def test_expansion_keeps_the_best(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.7), (1, "b", 0.6)], "query_id int, id string, score double")
    assert [(r.id, r.score) for r in retrieval.expanded(rows, 5).orderBy("rank").collect()] == [("a", 0.7), ("b", 0.6)]
