"""Hybrid retrieval: blending, fusion, reranking, intents. Ranked tables are keyed by (query_id, id)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULTS
from docloom.functions.constants import CHUNK_MARKERS, INTENT_MARKERS
from docloom.functions.text import clamp, contains_any, let, round4, tokens
from docloom.operators.vectors import best, min_max


def intent(question: Column, has_statute: Column | None = None) -> Column:
    """The first intent one of whose markers the question contains, as substrings."""
    q = F.lower(question)
    out = F
    for name, markers in INTENT_MARKERS:
        hit = contains_any(q, markers)
        out = out.when(hit | has_statute if name == "section" and has_statute is not None else hit, F.lit(name))
    return out.otherwise(F.lit("general"))


def structure_bonus(text: Column, query_intent: Column, chunk_index: Column, total_chunks: Column) -> Column:
    t = F.lower(text)
    bonus = F.lit(0.0)
    for name, (markers, value) in CHUNK_MARKERS.items():
        bonus = bonus + F.when((query_intent == name) & contains_any(t, markers), F.lit(value)).otherwise(F.lit(0.0))
    early = chunk_index / F.greatest(F.coalesce(total_chunks, F.lit(1)), F.lit(1)) <= 0.15
    return bonus + F.when(early, F.lit(0.03)).otherwise(F.lit(0.0)) - F.when(F.contains(t, F.lit("prayer")), F.lit(0.08)).otherwise(F.lit(0.0))


def entity_overlap(question: Column, entity_texts: Column) -> Column:
    """A quarter for each entity that shares a token with the question, 1 at most."""
    met = let(tokens(question), lambda q: F.filter(entity_texts, lambda e: F.arrays_overlap(tokens(e), q)))
    return F.least(F.lit(1.0), 0.25 * F.size(met))


def blend(semantic: Column, lexical: Column, entity: Column, bonus: Column) -> Column:
    return round4(clamp(0.7 * semantic + 0.2 * lexical + 0.08 * entity + bonus))


def candidates(dense: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """query_id, id, semantic, lexical: the 3k best dense rows and the 2k best lexical ones.

    Both inputs have query_id, id, score. Lexical scores are scaled over all positive rows before they are cut, and a
    dense row keeps its lexical score wherever it stands.
    """
    near = min_max(best(dense, 3 * k)).select("query_id", "id", F.col("norm").alias("semantic"))
    scaled = min_max(lexical).select("query_id", "id", F.col("norm").alias("lexical"))
    top = best(scaled, 2 * k, score="lexical").select("query_id", "id", "lexical")
    held = near.join(scaled, ["query_id", "id"], "left")
    more = top.join(near, ["query_id", "id"], "left_anti").withColumn("semantic", F.lit(0.0))
    return held.select("query_id", "id", "semantic", F.coalesce("lexical", F.lit(0.0)).alias("lexical")).unionByName(more.select("query_id", "id", "semantic", "lexical"))


def hybrid(dense: DataFrame, lexical: DataFrame, chunks: DataFrame, queries: DataFrame, k: int = DEFAULTS.dense_top_k) -> DataFrame:
    """query_id, id, score, rank. chunks: id, text, chunk_index, total_chunks, entity_texts; queries: query_id, text, intent."""
    found = candidates(dense, lexical, k).join(chunks.select("id", F.col("text").alias("chunk"), "chunk_index", "total_chunks", "entity_texts"), "id").join(queries.select("query_id", "text", "intent"), "query_id")
    bonus = structure_bonus(F.col("chunk"), F.col("intent"), F.col("chunk_index"), F.col("total_chunks"))
    score = blend(F.col("semantic"), F.col("lexical"), entity_overlap(F.col("text"), F.col("entity_texts")), bonus)
    return best(found.select("query_id", "id", score.alias("score")), k)


def expanded(results: DataFrame, k: int = DEFAULTS.dense_top_k) -> DataFrame:
    """The best score of each (query_id, id) over a query's own results and those of its expansions."""
    return best(results.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)


def fuse(lists: list[DataFrame], k: int = DEFAULTS.rrf_k, weights: list[float] | None = None, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank, score): query_id, id, score, original_score, rank.

    Lists without a weight weigh 1; rows without an id are skipped.
    """
    parts = []
    for i, ranked in enumerate(lists):
        w = weights[i] if weights and i < len(weights) else 1.0
        parts.append(ranked.where("id IS NOT NULL").select("query_id", "id", (F.lit(w) / (k + F.col("rank"))).alias("part"), F.col("score").cast("double").alias("original")))
    every = reduce(DataFrame.unionByName, parts)
    fused = every.groupBy("query_id", "id").agg(F.sum("part").alias("score"), F.max("original").alias("original_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= top) if top else ranked


def combined(dense: DataFrame, entity: DataFrame, method: str = "hybrid", top: int = DEFAULTS.dense_top_k) -> DataFrame:
    """Search by one method, or fusion of both where a query has results of both, else whichever it has."""
    if method == "dense":
        return dense.where(F.col("rank") <= top)
    if method == "entity":
        return entity.where(F.col("rank") <= top)
    both = dense.select("query_id").distinct().join(entity.select("query_id").distinct(), "query_id")
    fused = fuse([dense.join(both, "query_id", "left_semi"), entity.join(both, "query_id", "left_semi")], top=top)
    single = dense.select("query_id", "id", "score", "rank").unionByName(entity.select("query_id", "id", "score", "rank"))
    single = single.join(both, "query_id", "left_anti").where(F.col("rank") <= top)
    return fused.select("query_id", "id", "score", "rank").unionByName(single)


PairScorer = Callable[[pd.Series, pd.Series], pd.Series]


def rerank(results: DataFrame, k: int = DEFAULTS.rerank_top_k, scorer: Callable[[], PairScorer] | None = None) -> DataFrame:
    """The k best per query by a pair scorer over (question, text), or by the score they have.

    results: query_id, id, score, rank (and question, text for a scorer). With a scorer the old score stays as
    original_score and ranks are new; without one ranks stay.
    """
    if scorer is None:
        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
        return results.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    @F.pandas_udf("double")
    def pair_scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        loaded = scorer()
        for questions, texts in batches:
            yield loaded(questions, texts)

    scored = results.withColumnRenamed("score", "original_score").drop("rank").withColumn("score", pair_scores("question", "text"))
    return best(scored, k)
