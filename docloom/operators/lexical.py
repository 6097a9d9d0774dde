"""BM25 as tables: term frequencies, document lengths and term weights, scored by joins.

The index keeps one row per term and document. Queries bring their terms, so postings are cut to those before anything
else is joined, and a term that most documents hold costs its own postings only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.config import DEFAULTS, EngineConfig
from docloom.functions.text import run_lengths, tokens
from docloom.operators.vectors import best, min_max

#: Bytes of query terms (with repeats over queries) up to which they are broadcast.
MAX_TERM_BYTES = 32 << 20


@dataclass(frozen=True)
class Bm25Index:
    postings: DataFrame  # term, id, tf, dl
    terms: DataFrame  # term, df
    stats: DataFrame  # n, avgdl (one row)
    weights: DataFrame  # term, idf


def build(corpus: DataFrame, key: str = "id", text: str = "text", config: EngineConfig = DEFAULTS) -> Bm25Index:
    """Index of a corpus. A document's terms are counted within its row, so postings need no shuffle.

    Write `postings` and continue with `of_postings` to read the texts once only.
    """
    held = corpus.select(F.col(key).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    counted = held.select("id", F.size("tokens").cast("long").alias("dl"), F.explode(run_lengths(F.col("tokens"))).alias("t"))
    return of_postings(counted.select("t.term", "id", "dl", "t.tf"), document_count(corpus), config)


def document_count(corpus: DataFrame) -> DataFrame:
    return corpus.agg(F.count("*").alias("n"))


def of_postings(postings: DataFrame, documents: DataFrame, config: EngineConfig = DEFAULTS) -> Bm25Index:
    """documents: n, the number of documents, those without terms included (one row)."""
    stats = documents.crossJoin(postings.agg(F.sum("tf").alias("total"))).select("n", (F.col("total") / F.nullif("n", F.lit(0))).alias("avgdl"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    # stats is one row
    raw = terms.crossJoin(F.broadcast(stats)).select("term", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((F.avg("raw") * config.bm25_epsilon).alias("floor"))
    weights = raw.crossJoin(F.broadcast(floor)).select("term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    return Bm25Index(postings, terms, stats, weights)


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """query_id, term, qtf."""
    return queries.select("query_id", F.explode(tokens(text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(index: Bm25Index, queries: DataFrame, text: str = "text", config: EngineConfig = DEFAULTS) -> DataFrame:
    """query_id, id, score for every pair with a positive score."""
    k1, b = config.bm25_k1, config.bm25_b
    wanted = query_terms(queries, text)
    # the queries' terms are sized; if few, postings are cut to them where they lie and are not shuffled
    size = wanted.agg(F.sum(F.length("term") * 4 + 48)).first()[0] or 0
    few = (lambda df: F.broadcast(df)) if size <= MAX_TERM_BYTES else (lambda df: df)
    weighted = index.weights.join(few(wanted), "term").select("query_id", "term", "qtf", "idf")
    rows = index.postings.join(few(weighted), "term").crossJoin(F.broadcast(index.stats))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("query_id", "id").agg(F.sum(part).alias("score")).where("score > 0")


def normalized_scores(scored: DataFrame) -> DataFrame:
    return min_max(scored)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    return best(scored, k)
