"""The whole question path for a batch of questions: tag, retrieve, fuse, rerank, answer, map claims, rate, highlight."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, EngineConfig
from docloom.functions.text import clamp, round4
from docloom.operators import answer, entities, explain, index, lexical, retrieval, vectors
from docloom.session import materialize


def prepared(questions: DataFrame) -> DataFrame:
    """query_id, question, entity_texts, has_statute, intent. questions: query_id, question."""
    tagged = questions.withColumn("entities", entities.merge(entities.extract_spans("question")))
    statute = F.exists("entities", lambda e: e["label"] == "STATUTE")
    return tagged.select("query_id", "question", "entities", F.transform("entities", lambda e: e["text"]).alias("entity_texts"), retrieval.intent(F.col("question"), statute).alias("intent"))


def retrieve(questions: DataFrame, chunks: DataFrame, bm25: lexical.Bm25Index, postings: DataFrame, dense: DataFrame | None = None, config: EngineConfig = DEFAULTS, use_entities: bool = True) -> DataFrame:
    """query_id, id, score, rank over chunks; `dense` has query_id, id, score of vector search where there is one."""
    words = lexical.scores(bm25, questions.select("query_id", F.col("question").alias("text")), config=config)
    near = dense if dense is not None else words.limit(0)
    pool = chunks.select(F.col("chunk_id").alias("id"), "text", "chunk_index", "total_chunks", F.transform("entities", lambda e: e["text"]).alias("entity_texts"))
    found = retrieval.hybrid(near, words, pool, questions.select("query_id", F.col("question").alias("text"), "intent"), config.dense_top_k)
    if not use_entities:
        return found
    wanted = questions.select("query_id", F.explode("entity_texts").alias("entity"))
    tagged = index.retrieve(postings, wanted, config.entity_top_k).withColumnRenamed("chunk_id", "id")
    return retrieval.combined(found, tagged.select("query_id", "id", "score", "rank"), top=config.dense_top_k)


def respond(questions: DataFrame, results: DataFrame, chunks: DataFrame, config: EngineConfig = DEFAULTS, scorer: Callable | None = None, external: DataFrame | None = None, model: Callable | None = None) -> DataFrame:
    """One row per question: the answer's fields, claims with their sources, confidence, highlighted text, route.

    external: passages of a web search (query_id, rank, chunk_id, text, score, doc_name), which lead the answer of
    questions that are routed to it; model: an embedding plug-in for the sentences' scores.
    """
    ranked = retrieval.rerank(results.join(chunks.select(F.col("chunk_id").alias("id"), "text"), "id").join(questions.select("query_id", "question"), "query_id"), config.rerank_top_k, scorer)
    place = "place" if "place" in ranked.columns else "rank"
    passages = ranked.select("query_id", F.col(place).alias("rank"), F.col("id").alias("chunk_id"), "score").join(chunks.select("chunk_id", "text", "doc_name", "page_num", "section", F.lit("local").alias("source"), "entities"), "chunk_id")
    # a few rows per question that five steps read
    passages = materialize(passages, "passages")
    if external is not None:
        bare = {"page_num": F.lit(None).cast("int"), "section": F.lit(None).cast("string"), "source": F.lit("web"), "entities": F.array().cast(passages.schema["entities"].dataType)}
        external = external.withColumns({c: v for c, v in bare.items() if c not in external.columns})
    passages, routes = answer.routed(passages, questions, external, config.web_fallback, config.web_threshold, config.web_max_results)
    passages, routes = materialize(passages, "context"), materialize(routes, "routes")
    asked = questions.join(routes.select("query_id", "web_results_count"), "query_id").withColumn("intent", F.when(F.col("web_results_count") > 0, "external_web").otherwise(F.col("intent")))
    told = materialize(answer.answers(passages, asked, model=model), "answers")
    mapped = explain.best_sources(explain.claim_table(told.where("answer_type <> 'insufficient_context'")), passages)
    per_claim = mapped.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("claim_idx", "claim", "source_passage_idx", "chunk_id", "similarity", "evidence_snippet"))).alias("claims"))
    seen = passages.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "doc_name", "text"))), lambda p: p).alias("ps"), F.flatten(F.collect_list(F.transform("entities", lambda e: e["text"]))).alias("passage_entities"))
    rows = told.join(asked.select("query_id", "question", "intent", "entity_texts"), "query_id").join(routes, "query_id").join(per_claim, "query_id", "left").join(seen, "query_id", "left")
    scores = F.coalesce(F.transform("ps", lambda p: p["score"].cast("double")), F.array().cast("array<double>"))
    sims = F.coalesce(F.transform("claims", lambda c: c["similarity"]), F.array().cast("array<double>"))
    rated = explain.overall_confidence(
        explain.retrieval_quality(scores),
        explain.entity_coverage(F.col("entity_texts"), F.transform("ps", lambda p: p["text"]), F.col("passage_entities")),
        explain.claim_alignment(sims),
        explain.source_diversity(F.transform("ps", lambda p: p["doc_name"])),
        passages=F.size(scores),
    )
    rows = rows.withColumn("spans", entities.extract_spans("answer_text"))
    marks = explain.annotations(F.col("answer_text"), F.col("spans"))
    return rows.select(
        "query_id", "question", "intent", "answer_type", "simple_answer", "answer_text", "markdown_answer", "segments", "evidence_points", "citations", "key_entities", "supporting_passages", "claims",
        "route", "router_confidence", "web_results_count", "web_error", round4(clamp(F.greatest("confidence", rated))).alias("confidence"),
        explain.highlight_markdown(F.col("answer_text"), marks).alias("highlighted"), F.size(scores).alias("num_sources"),
    )


def run(questions: DataFrame, chunks: DataFrame, postings: DataFrame, bm25: lexical.Bm25Index | None = None, dense: DataFrame | None = None, config: EngineConfig = DEFAULTS, external: DataFrame | None = None, model: Callable | None = None) -> DataFrame:
    asked = materialize(prepared(questions), "questions")
    own = bm25
    if own is None:
        built = lexical.build(chunks, "chunk_id", config=config)
        own = lexical.of_postings(materialize(built.postings, "terms"), lexical.document_count(chunks), config)
    found = materialize(retrieve(asked, chunks, own, postings, dense, config), "retrieved")
    return respond(asked, found, chunks, config, external=external, model=model)


def best_by_vector(chunk_vectors: DataFrame, question_vectors: DataFrame, config: EngineConfig = DEFAULTS) -> DataFrame:
    """Vector scores for `retrieve`: the 3k best chunks of each question."""
    return vectors.search(chunk_vectors, question_vectors, 3 * config.dense_top_k)
