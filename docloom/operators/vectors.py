"""Vector search over tables with a vector column: exact top-k, cells by k-means, embedding plug-ins.

Dot products are taken in double precision. A search multiplies blocks of rows with a block of queries and keeps only the
best of every query in each partition, so what is shuffled grows with queries and partitions, not with pairs. Queries
beyond a block of MAX_BYTES go in further blocks, one pass over the corpus each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULTS
from docloom.session import materialize

#: Queries that are broadcast at most, and bytes of vectors in one block of queries.
MAX_QUERIES, MAX_BYTES = 10_000, 32 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v.cast("array<double>"), lambda x: x / norm)).otherwise(v.cast("array<double>"))


def fallback_vector(text: str, dim: int = DEFAULTS.embedding_dim) -> list[float]:
    """A vector that only depends on the text's digest: equal texts meet, nothing else does."""
    v = np.random.RandomState(int(hashlib.md5(text.encode()).hexdigest()[:8], 16)).randn(dim).astype(np.float32)
    return (v / np.linalg.norm(v)).tolist()


def embed_fallback(c: Column | str, dim: int = DEFAULTS.embedding_dim) -> Column:
    return embed(c, lambda: lambda texts: texts.map(lambda t: fallback_vector(t or "", dim)))


def embed(c: Column | str, model: Callable[[], Callable[[pd.Series], pd.Series]]) -> Column:
    """Vectors of a plugged-in model; `model()` is called once per worker and maps a batch of texts to vectors."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        loaded = model()
        for texts in batches:
            yield loaded(texts)

    return vectors(c)


def _checked(queries: DataFrame, most: int = MAX_QUERIES) -> DataFrame:
    if queries.count() > most:
        raise ValueError(f"more than {most} queries to broadcast")
    return F.broadcast(queries)


def joinable(queries: DataFrame) -> DataFrame:
    """queries to be joined to all rows: marked for broadcast up to MAX_QUERIES, else written once and not marked."""
    try:
        return _checked(queries, MAX_QUERIES)
    except ValueError:
        return materialize(queries, "queries")


def scores(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score for a stated set of queries against all rows. corpus: id, vector; queries: query_id, vector."""
    q = joinable(queries.select("query_id", F.col("vector").cast("array<double>").alias("qv")))
    rows = corpus.select("id", F.col("vector").cast("array<double>").alias("cv")).crossJoin(q)
    return rows.select("query_id", "id", dot(F.col("qv"), F.col("cv")).alias("score"))


def best(scored: DataFrame, k: int, digits: int = 9, score: str = "score") -> DataFrame:
    """The k best per query with their rank; ties go by id. Each partition keeps only its own k best."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, digits)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> list[DataFrame]:
    """queries (query_id, vector, ...) dealt by a hash to blocks whose vectors take MAX_BYTES at most, about."""
    r = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim")).first()
    n = max(1, -(-r.n * r.dim * 8 * 2 // MAX_BYTES)) if r.n else 0
    if n <= 1:
        return [queries] * n
    held = materialize(queries.withColumn("__block", F.pmod(F.xxhash64("query_id"), F.lit(n))), "queries")
    return [held.where(F.col("__block") == i).drop("__block") for i in range(n)]


def _nearest_rows(corpus: DataFrame, block: DataFrame, k: int, cell: str | None) -> DataFrame:
    """query_id, id, score: each partition's k best rows of every query of a block, ties by id. With a cell column, a
    query (query_id, vector, cells) meets the rows of its cells only."""
    asked = block.collect()  # MAX_BYTES at most
    names = [r.query_id for r in asked]
    matrix = np.array([r.vector for r in asked], dtype=np.float64).reshape(len(asked), -1)
    probing: dict[int, list[int]] = {}
    for i, r in enumerate(asked if cell else ()):
        for c in r.cells:
            probing.setdefault(c, []).append(i)
    ids = corpus.schema["id"].dataType.simpleString()
    queries = block.schema["query_id"].dataType.simpleString()

    def nearest(batches):
        import pyarrow as pa

        held: dict[int, tuple[list, np.ndarray]] = {}

        def offer(which: list[int] | range, own: list, scores: np.ndarray) -> None:
            """scores: rows by queries of which."""
            rounded = np.round(scores, 9)
            for column, q in enumerate(which):
                mine = rounded[:, column]
                if len(mine) > k:
                    keep = np.flatnonzero(mine >= np.partition(mine, len(mine) - k)[len(mine) - k])
                else:
                    keep = np.arange(len(mine))
                before = held.get(q, ([], np.empty(0)))
                every = before[0] + [own[i] for i in keep]
                values = np.concatenate([before[1], scores[keep, column]])
                order = sorted(range(len(every)), key=lambda i: (-round(values[i], 9), every[i]))[:k]
                held[q] = ([every[i] for i in order], values[order])

        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            own = batch.column(0).to_pylist()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            if cell is None:
                offer(range(len(names)), own, x @ matrix.T)
                continue
            cells = batch.column(2).to_numpy(zero_copy_only=False)
            for c in np.unique(cells):
                which = probing.get(int(c), [])
                rows = np.flatnonzero(cells == c)
                if which:
                    offer(which, [own[i] for i in rows], x[rows] @ matrix[which].T)
        found = [(names[q], i, s) for q, (some, scores) in held.items() for i, s in zip(some, scores.tolist(), strict=True)]
        if found:
            yield pa.RecordBatch.from_pylist([{"query_id": q, "id": i, "score": s} for q, i, s in found], schema=to_arrow_schema(out))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = _parse_datatype_string(f"query_id {queries}, id {ids}, score double")
    return corpus.select("id", F.col("vector").cast("array<float>" if "float" in corpus.schema["vector"].dataType.simpleString() else "array<double>").alias("vector"), *([cell] if cell else [])).mapInArrow(nearest, out)


def _searched(corpus: DataFrame, queries: DataFrame, k: int, cell: str | None = None) -> DataFrame:
    parts = [_nearest_rows(corpus, block, k, cell) for block in _blocks(queries)]
    if not parts:
        return best(scores(corpus, queries).limit(0), k)
    return best(reduce(DataFrame.unionByName, parts), k)


def search(corpus: DataFrame, queries: DataFrame, k: int = DEFAULTS.dense_top_k) -> DataFrame:
    """query_id, id, score, rank: the k best rows of the corpus (id, vector) for each query (query_id, vector)."""
    held = corpus.where("vector IS NOT NULL AND id IS NOT NULL")
    return _searched(held, queries.where("vector IS NOT NULL").select("query_id", "vector"), k)


def min_max(scored: DataFrame, value: str = "score", by: str = "query_id", out: str = "norm") -> DataFrame:
    """Scores between 0 and 1 per query; where all are equal, 1. Ends come from an aggregate, so no query's scores meet in
    one task; there is one row of them per query."""
    ends = scored.groupBy(by).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    low, high = F.col("__low"), F.col("__high")
    scaled = F.when(high == low, F.lit(1.0)).otherwise((F.col(value) - low) / (high - low))
    return scored.join(ends, by).withColumn(out, scaled).drop("__low", "__high")


class CellIndex:
    """Inverted cells: k-means on at most `sample_rows` vectors, every row filed under its nearest centre."""

    def __init__(self, corpus: DataFrame, cells: int | None = None, sample_rows: int = 50_000, seed: int = 7):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        n = corpus.count()
        self.cells = cells or max(1, min(100, int(n**0.5)))
        self.probes = min(10, self.cells)
        kept = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 32)) < min(1 << 32, (sample_rows << 32) // max(n, 1))
        sample = corpus.where(kept).select(array_to_vector(normalized(F.col("vector"))).alias("features"))
        centres = KMeans(k=self.cells, seed=seed, maxIter=10).fit(sample).clusterCenters()
        self.centres = corpus.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        self.filed = self._nearest(corpus.select("id", "vector"), "id", 1)

    def _nearest(self, rows: DataFrame, key: str, k: int) -> DataFrame:
        """rows with their k nearest cells; the centres are few and picked within each row."""
        centres = [(r.cell, r.centre) for r in self.centres.collect()]
        table = F.array(*(F.struct(F.lit(i).alias("cell"), F.array(*map(F.lit, c)).alias("centre")) for i, c in centres))
        ranked = F.array_sort(F.transform(table, lambda c: F.struct((-dot(c["centre"], F.col("vector"))).alias("far"), c["cell"].alias("cell"))))
        return rows.withColumn("cell", F.explode(F.transform(F.slice(ranked, 1, k), lambda c: c["cell"])))

    def search(self, queries: DataFrame, k: int = DEFAULTS.dense_top_k) -> DataFrame:
        near = self._nearest(queries.where("vector IS NOT NULL").select("query_id", "vector"), "query_id", self.probes)
        asked = near.groupBy("query_id").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("cell")).alias("cells"))
        return _searched(self.filed, asked, k, "cell")


def add_vectors(store: DataFrame, more: DataFrame) -> DataFrame:
    return store.unionByName(more)
