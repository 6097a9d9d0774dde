import pytest
from pyspark.sql import functions as F

from docloom.functions.constants import NO_CONTEXT, WEAK_SUPPORT
from docloom.operators import answer, evaluate, explain

ENTITY = "array<struct<text: string, label: string>>"


@pytest.fixture(scope="module")
def passages(spark):
    rows = [
        (1, 1, "c1", "Bail is granted by the court. Bail is granted by the court. It rained all day in the village.", 0.8, "d1", 3, "ARTICLE", "local", [("Bail", "LEGAL_ACTION"), ("bail", "LEGAL_ACTION")]),
        (1, 2, "c2", "The court may grant bail in some cases of this kind.", 0.6, "d2", None, None, None, [("court", "COURT")]),
        (2, 1, "c3", "1. - Nothing useful here", 0.4, "d1", None, None, "local", []),
    ]
    return spark.createDataFrame(rows, f"query_id int, rank int, chunk_id string, text string, score double, doc_name string, page_num int, section string, source string, entities {ENTITY}")


@pytest.fixture(scope="module")
def told(spark, passages):
    asked = spark.createDataFrame([(1, "When is bail granted by a court?", "general", []), (2, "unrelated question", "general", []), (3, "x", "general", [])], "query_id int, question string, intent string, entity_texts array<string>")
    return {r.query_id: r for r in answer.answers(passages, asked).collect()}


def test_grounded(told):
    r = told[1]
    assert r.answer_type == "grounded_extractive"
    assert [s.text for s in r.segments] == ["Bail is granted by the court.", "The court may grant bail in some cases of this kind."]
    assert [(c.citation_id, c.chunk_id, c.source) for c in r.citations] == [(1, "c1", "local"), (2, "c2", "local")]
    assert r.key_entities == ["Bail (LEGAL_ACTION)", "court (COURT)"]
    assert r.markdown_answer.startswith("## Answer\n\nBail is granted by the court. [1] The court may") and "- Bail is granted by the court. [1] (ARTICLE, p.3)" in r.markdown_answer
    assert r.markdown_answer.endswith("- [1] d1, section ARTICLE, page 3, source local\n- [2] d2, source local")
    assert 0 < r.confidence <= 1 and [p.chunk_id for p in r.supporting_passages] == ["c1", "c2"]


def test_weak_and_none(told):
    assert (told[2].answer_type, told[2].simple_answer, told[2].answer_text, told[2].confidence) == ("weak_support", WEAK_SUPPORT, "Nothing useful here.", 0.4)
    assert (told[3].answer_type, told[3].simple_answer, told[3].confidence) == ("insufficient_context", NO_CONTEXT, 0.0)


def test_sentence_score(spark):
    row = spark.createDataFrame([("The court shall grant bail.",)], "s string")
    terms = F.array(F.lit("bail"), F.lit("court"))
    score = lambda **k: row.select(answer.sentence_score(F.col("s"), terms, F.lit(k.get("intent", "general")), k.get("sim")).alias("x")).first().x
    # tokens keep their full stop: only "court" is shared
    assert score() == pytest.approx(0.7 * 0.5 + 0.3 * 0.2)
    assert score(intent="condition") == pytest.approx(0.41 + 0.12) and score(sim=F.lit(0.5)) == pytest.approx(0.35 * 0.41 + 0.325, abs=1e-4)


def test_route(spark):
    row = spark.range(1)
    get = lambda c: row.select(c.alias("x")).first().x
    lits = lambda *xs: F.array(*map(F.lit, xs)).cast("array<double>")
    assert get(answer.route_confidence(lits(1.0, 0.5))) == pytest.approx(0.8333) and get(answer.route_confidence(lits())) == 0.0
    assert tuple(get(answer.route_info(lits(0.2), True))) == (0.2, 0.75, True, "web_search")
    assert get(answer.route(F.lit(0.5), True)) == "web_search" and get(answer.route(F.lit(0.5))) == "local"


def test_external_passages_lead(spark, passages):
    web = spark.createDataFrame([(2, 1, "w1", "text")], "query_id int, rank int, chunk_id string, text string")
    got = answer.with_external(passages, web).where("query_id = 2").orderBy("rank").collect()
    assert [(r.chunk_id, r.rank) for r in got] == [("w1", 1), ("c3", 2)]
    assert answer.with_external(passages, None).select("error").distinct().collect()[0].error == "web_search_unavailable"


def test_claims(spark):
    rows = spark.createDataFrame([(1, "**Bold** The court granted bail today [1]. Short.", "Note: this sentence is left out of it. The court granted bail today.")], "query_id int, simple_answer string, answer_text string")
    got = [r.claim for r in explain.claim_table(rows).orderBy("claim_idx").collect()]
    assert got == ["The court granted bail today .", "The court granted bail today."]


def test_best_source(spark):
    claims = spark.createDataFrame([(1, 0, "court granted bail"), (1, 1, "zebra giraffe"), (1, 2, "the of")], "query_id int, claim_idx int, claim string")
    rows = spark.createDataFrame([(1, 1, "a", "Peace treaty signed. The court granted bail here."), (1, 2, "b", "court granted bail")], "query_id int, rank int, chunk_id string, text string")
    got = explain.best_sources(claims, rows).collect()
    assert [(r.claim_idx, r.source_passage_idx, r.chunk_id, r.similarity, r.evidence_snippet) for r in got] == [(0, 1, "b", 1.0, "court granted bail")]
    assert spark.range(1).select(explain.snippet(F.lit("court bail"), F.lit("Peace treaty. The court sat.")).alias("s")).first().s == "The court sat."


def test_confidence(spark):
    row = spark.range(1)
    get = lambda c: row.select(c.alias("x")).first().x
    arr = lambda *xs, t="double": F.array(*map(F.lit, xs)).cast(f"array<{t}>")
    assert get(explain.retrieval_quality(arr(0.5, 0.7))) == pytest.approx(0.6 * 0.6 + 0.4 * 0.7)
    assert get(explain.retrieval_quality(arr(5.0, 3.0))) == pytest.approx(0.6 * 0.7 + 0.4 * 0.75) and get(explain.retrieval_quality(arr(-5.0))) == pytest.approx(0.6 * 0.25 - 2.0)
    assert get(explain.entity_coverage(arr("Bail", "x", t="string"), arr("the bail", t="string"), arr("y", t="string"))) == 0.5
    assert get(explain.claim_alignment(arr(0.2, 0.4))) == pytest.approx(0.5 * 0.3 + 0.25) and get(explain.claim_alignment(arr())) == 0.3
    assert [get(explain.source_diversity(arr(*d, t="string"))) for d in ((), ("a",), ("a", "b", "a"), ("a", "b", "c"))] == [0.0, 0.5, 0.8, 1.0]
    assert tuple(get(explain.claim_confidence(F.lit(0.3)))) == (0.45, True) and get(explain.display_score(F.lit(2.0))) == pytest.approx(0.880797)


def test_highlight(spark):
    rows = spark.createDataFrame([("Bail by court", [("Bail", "LEGAL_ACTION", 0, 4), ("il by", "X", 2, 7), ("court", "COURT", None, None)]), ("", [])], "t string, e array<struct<text: string, label: string, start: int, end: int>>")
    marked = rows.withColumn("a", explain.annotations(F.col("t"), F.col("e")))
    got = marked.select("a", explain.highlight_markdown(F.col("t"), F.col("a")).alias("m"), explain.highlight_html(F.col("t"), F.col("a")).alias("h")).collect()
    assert got[0].m == "**Bail** `[LEGAL_ACTION]` by **court** `[COURT]`" and got[1].m == ""
    assert got[0].h.startswith('<span class="entity" style="background:#ffedd5;') and got[0].h.count("<sup") == 2


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_rouge(spark):
    cases = [("the cat sat on the mat", "the cat the mat sat"), ("a b c d", "d c b a"), ("", "x"), ("x", ""), ("A  b", "a B")]
    rows = spark.createDataFrame(cases, "p string, r string").select("p", "r", evaluate.rouge_l(F.col("p"), F.col("r")).alias("x")).collect()
    for r in rows:
        a, b = r.p.lower().split(), r.r.lower().split()
        n = lcs(a, b)
        assert r.x.precision == pytest.approx(n / len(a) if a and b else 0, abs=1e-4) and r.x.recall == pytest.approx(n / len(b) if a and b else 0, abs=1e-4)


def test_entity_f1(spark):
    rows = spark.createDataFrame([([("A", "X"), ("b", "Y")], [("a", "X")]), ([], []), ([("a", "X")], [])], f"p {ENTITY}, g {ENTITY}")
    got = [tuple(r.f) for r in rows.select(evaluate.entity_f1(F.col("p"), F.col("g")).alias("f")).collect()]
    assert got == [(0.5, 1.0, 0.6667), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)]


def test_retrieval_metrics(spark):
    got = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 7, "c"), (2, 1, "z")], "query_id int, rank int, id string")
    rel = spark.createDataFrame([(1, "b"), (1, "c"), (3, "q")], "query_id int, id string")
    rows = {r.query_id: (r.precision, r.recall, r.reciprocal_rank) for r in evaluate.retrieval_metrics(got, rel, spark.createDataFrame([(1,), (2,), (3,)], "query_id int")).collect()}
    assert rows == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_checks(spark):
    rows = spark.createDataFrame([(1, "The court granted bail to him. Zebras eat green grass daily.", "", "the court granted bail to him"), (2, "", "", "x"), (3, "The court granted bail to him.", "", " ")], "query_id int, simple_answer string, answer_text string, evidence string")
    got = {r.query_id: (r.total_claims, r.supported, r.hallucination_rate) for r in evaluate.hallucination(rows).collect()}
    assert got == {1: (2, 1, 0.5), 2: (0, 0, 0.0), 3: (1, 0, 1.0)}
    get = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert tuple(get(evaluate.check_claim(F.lit("the of"), F.lit("x")))) == ("NEUTRAL", 0.5)
    assert get(evaluate.trim_evidence(F.lit("bail"), F.lit("Peace came. The bail was set."))) == "The bail was set. Peace came."
    assert [get(evaluate.nli_label(F.lit(x))) for x in ("entailment", "LABEL_0", "neutral", "other")] == ["ENTAILMENT", "CONTRADICTION", "NEUTRAL", None]


def test_datasets(spark):
    from docloom.schema import QA_ROWS

    rows = spark.createDataFrame([("q a", "a b", ["b c"], None, None, None), ("q", "z", None, None, None, None), ("", "z", None, None, None, None)], QA_ROWS)
    got = evaluate.evaluate_dataset(rows).first()
    assert (got.total_samples, got.faithfulness_mean, got.context_precision_mean, got.error) == (2, 0.75, 0.0, None)
    assert evaluate.evaluate_dataset(rows.limit(0)).first().error == "QA dataset is empty"


def test_models_plug_in(spark):
    import pandas as pd

    rows = spark.createDataFrame([("claim here", "evidence here")], "claim string, evidence string")
    load = lambda: lambda e, c: pd.Series([[{"label": "LABEL_2", "score": 0.9}, {"label": "x", "score": 1.0}] for _ in e])
    assert tuple(evaluate.check_with_model(rows, load).first().check) == ("ENTAILMENT", 0.9)


def test_weak_answers_cite_their_first_passages(spark):
    rows = [(7, i, f"c{min(i, 3)}", f"- #{i}", 0.9 - i / 10, f"d{i}", i, None, None, [(f"E{i}", "ACT")]) for i in range(1, 5)]
    passages = spark.createDataFrame(rows, f"query_id int, rank int, chunk_id string, text string, score double, doc_name string, page_num int, section string, source string, entities {ENTITY}")
    asked = spark.createDataFrame([(7, "bail", "general", [])], "query_id int, question string, intent string, entity_texts array<string>")
    r = answer.answers(passages, asked).first()
    assert (r.answer_type, r.answer_text, r.confidence) == ("weak_support", "#1.", 0.8)
    assert [(c.citation_id, c.chunk_id, c.doc_name, c.source) for c in r.citations] == [(1, "c1", "d1", "local"), (2, "c2", "d2", "local"), (3, "c3", "d3", "local")]
    assert [(p.chunk_id, p.score) for p in r.supporting_passages] == [("c1", 0.8), ("c2", 0.7), ("c3", 0.6)]
    assert r.key_entities == ["E1 (ACT)", "E2 (ACT)"] and r.segments is None
    assert [(e.text, e.citation_ids, e.chunk_id) for e in r.evidence_points] == [("#1.", [1], "c1")]


def test_evidence_and_missing_ids(spark, told):
    assert [(e.text, e.citation_ids, e.page_num, e.section, e.source) for e in told[1].evidence_points][0] == ("Bail is granted by the court.", [1], 3, "ARTICLE", "local")
    assert told[3].evidence_points == told[3].citations == told[3].supporting_passages == []
    rows = [(1, 1, "", "Bail is granted by the court.", 0.8, "d1", 3, None, None, [])]
    passages = spark.createDataFrame(rows, f"query_id int, rank int, chunk_id string, text string, score double, doc_name string, page_num int, section string, source string, entities {ENTITY}")
    asked = spark.createDataFrame([(1, "When is bail granted?", "general", [])], "query_id int, question string, intent string, entity_texts array<string>")
    r = answer.answers(passages, asked).first()
    assert [(c.citation_id, c.doc_name) for c in r.citations] == [(1, "d1")] and len(r.segments) == 1


def test_sentence_vectors_lead(spark, passages):
    import pandas as pd

    asked = spark.createDataFrame([(1, "weather", "general", [])], "query_id int, question string, intent string, entity_texts array<string>")

    def load():
        return lambda texts: pd.Series([[1.0, 0.0] if "rain" in t or "weather" in t else [0.0, 1.0] for t in texts])

    got = {r.sentence: r.score for r in answer.scored_sentences(passages.where("query_id = 1"), asked, model=load).collect()}
    assert got["It rained all day in the village."] == pytest.approx(0.65) and got["Bail is granted by the court."] == 0.0


def test_question_path_with_a_search(spark):
    from docloom.config import EngineConfig
    from docloom.operators import index
    from docloom.plans import ingest, query
    from docloom.session import materialize

    docs = spark.createDataFrame([("a.txt", "The Supreme Court of India granted bail to the accused in this matter. " * 4), ("b.txt", "Contracts are made by offer and acceptance between the parties to them. " * 4)], "doc_name string, text string")
    chunks = materialize(ingest.tagged(ingest.chunks_of(docs)), "chunks")
    postings = index.postings(ingest.mentions_of(chunks))
    asked = spark.createDataFrame([(1, "Who granted bail to the accused?"), (2, "What is the tariff of llamas?")], "query_id long, question string")
    web = spark.createDataFrame([(2, 1, "http://x", "The tariff of llamas is ten coins for every llama.", 3.0, "X")], "query_id long, rank int, chunk_id string, text string, score double, doc_name string")
    config = EngineConfig(web_fallback=True, web_threshold=0.3)
    got = {r.query_id: r for r in query.run(asked, chunks, postings, config=config, external=web).collect()}
    assert (got[2].route, got[2].intent, got[2].web_results_count, got[2].web_error) == ("web_search", "external_web", 1, None)
    assert "tariff of llamas" in got[2].simple_answer and got[2].citations[0].source == "web"
    assert got[1].answer_type == "grounded_extractive" and got[1].web_results_count == 0
    alone = {r.query_id: r for r in query.run(asked, chunks, postings, config=config).collect()}
    assert alone[2].web_error == "web_search_unavailable" and alone[2].answer_type in ("insufficient_context", "weak_support", "grounded_extractive")
