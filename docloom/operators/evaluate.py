"""Evaluation: ranked retrieval, entities, ROUGE-L, faithfulness, claim checking, whole QA datasets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.constants import CHECK_STOP_WORDS
from docloom.functions.text import let, round4, sentences, word_set, words
from docloom.operators.explain import claims
from docloom.operators.vectors import joinable


def retrieval_metrics(retrieved: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, precision, recall, reciprocal_rank. retrieved: query_id, rank, id; relevant: query_id, id.

    Precision is over what was retrieved up to k; queries without results or without relevant ids have 0.
    """
    good = relevant.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    marked = retrieved.select("query_id", "rank", "id").join(good, ["query_id", "id"], "left")
    first_k = F.col("rank") <= k
    per = marked.groupBy("query_id").agg(
        F.sum(F.when(first_k, F.lit(1)).otherwise(0)).alias("n"),
        F.sum(F.when(first_k & F.col("hit").isNotNull(), F.lit(1)).otherwise(0)).alias("hits"),
        F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first"),
    )
    total = good.groupBy("query_id").agg(F.count("*").alias("total"))
    rows = queries.select("query_id").distinct().join(per, "query_id", "left").join(total, "query_id", "left")
    ratio = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    return rows.select("query_id", ratio("hits", "n").alias("precision"), ratio("hits", "total").alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def containing(docs: DataFrame, items: DataFrame, gram: int = 5) -> DataFrame:
    """query_id, id: the documents (id, text) whose text holds an item's (query_id, text), character by character.

    A text that holds an item holds its inner words whole, so candidates are found by the first run of `gram` of them, an
    equi-join, and then compared. Items of too few words are compared with every text.
    """
    split = lambda c: F.split(c, r"(?U)\s+")
    run = lambda ws, i: F.xxhash64(F.array_join(F.slice(ws, i, gram), " "))
    asked = items.where("text <> ''").select("query_id", F.col("text").alias("item"), split("text").alias("ws"))
    long_ = asked.where(F.size("ws") >= gram + 2).select("query_id", "item", run(F.col("ws"), F.lit(2)).alias("g"))
    short = asked.where(F.size("ws") < gram + 2).select("query_id", "item")
    rows = docs.where("id IS NOT NULL").select("id", F.col("text").alias("t"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - gram + 1, F.lit(1))), lambda i: run(F.col("ws"), i))
    held = rows.withColumn("ws", split("t")).withColumn("g", F.explode(runs)).drop("ws")
    near = held.join(joinable(long_), "g").where(F.contains("t", F.col("item"))).select("query_id", "id")
    every = rows.join(joinable(short), F.contains("t", F.col("item"))).select("query_id", "id")
    return near.unionByName(every).distinct()


def mean_reciprocal_rank(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.avg("reciprocal_rank").alias("mrr"))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def entity_f1(predicted: Column, gold: Column) -> Column:
    """struct (precision, recall, f1) of two arrays of (text, label) as sets of lower-cased texts with labels."""
    keys = lambda es: F.array_distinct(F.transform(es, lambda e: F.concat_ws("\x01", F.lower(e["text"]), F.coalesce(e["label"], F.lit("")))))
    a, b = keys(predicted), keys(gold)
    both = F.size(F.array_intersect(a, b))
    p, r = both / F.nullif(F.size(a), F.lit(0)), both / F.nullif(F.size(b), F.lit(0))
    none, one = (F.size(a) == 0) & (F.size(b) == 0), (F.size(a) == 0) | (F.size(b) == 0)
    pick = lambda x: F.when(none, F.lit(1.0)).when(one, F.lit(0.0)).otherwise(round4(x))
    return F.struct(pick(p).alias("precision"), pick(r).alias("recall"), pick(_f1(p, r)).alias("f1"))


def _lcs(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common subsequence, in a bit vector over the first sequence."""
    for left, right in batches:
        out = []
        for x, y in zip(left, right, strict=True):
            where: dict[str, int] = {}
            for i, w in enumerate(x if x is not None else ()):
                where[w] = where.get(w, 0) | 1 << i
            full = (1 << (len(x) if x is not None else 0)) - 1
            row = full
            for w in y if y is not None else ():
                met = row & where.get(w, 0)
                row = ((row + met) | (row - met)) & full
            out.append((full & ~row).bit_count())
        yield pd.Series(out, index=left.index, dtype="int64")


def rouge_l(predicted: Column, reference: Column) -> Column:
    """struct (precision, recall, f1) over the longest common subsequence of lower-cased words."""
    a, b = words(predicted), words(reference)
    n = F.pandas_udf(_lcs, "long")(a, b)
    p, r = n / F.nullif(F.size(a), F.lit(0)), n / F.nullif(F.size(b), F.lit(0))
    fill = lambda x: F.coalesce(round4(x), F.lit(0.0))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    pick = lambda x: F.when(some, fill(x)).otherwise(F.lit(0.0))
    return F.struct(pick(p).alias("precision"), pick(r).alias("recall"), pick(_f1(p, r)).alias("f1"))


def faithfulness(answer: Column, contexts: Column) -> Column:
    """Share of the answer's distinct words that the contexts hold."""
    mine = word_set(answer)
    met = F.size(F.array_intersect(mine, word_set(F.array_join(contexts, " "))))
    return F.when((F.size(mine) > 0) & (F.size(contexts) > 0), round4(met / F.size(mine))).otherwise(F.lit(0.0))


def context_precision(question: Column, contexts: Column) -> Column:
    """Share of the contexts that share a word with the question."""
    met = F.size(let(word_set(question), lambda q: F.filter(contexts, lambda c: F.size(F.array_intersect(q, word_set(c))) > 0)))
    return F.when((question != "") & (F.size(contexts) > 0), round4(met / F.size(contexts))).otherwise(F.lit(0.0))


def evaluate(rows: DataFrame) -> DataFrame:
    """rows (question, answer, contexts, reference_answer) with faithfulness, context_precision and rouge_l.

    Rows without a question or an answer go; missing contexts are the answer itself, and so is a missing reference.
    """
    kept = rows.where((F.coalesce("question", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != ""))
    contexts = F.when(F.size(F.coalesce("contexts", F.array().cast("array<string>"))) > 0, F.col("contexts")).otherwise(F.array("answer"))
    reference = F.coalesce("reference_answer", "answer")
    return kept.withColumns({"faithfulness": faithfulness(F.col("answer"), contexts), "context_precision": context_precision(F.col("question"), contexts), "rouge_l": rouge_l(F.col("answer"), reference)})


def evaluate_dataset(rows: DataFrame) -> DataFrame:
    """total_samples and the means of faithfulness and context precision; an empty dataset gives an error text."""
    done = evaluate(rows)
    means = done.agg(F.count("*").alias("total_samples"), F.coalesce(round4(F.avg("faithfulness")), F.lit(0.0)).alias("faithfulness_mean"), F.coalesce(round4(F.avg("context_precision")), F.lit(0.0)).alias("context_precision_mean"))
    return means.crossJoin(rows.agg(F.when(F.count("*") == 0, F.lit("QA dataset is empty")).alias("error")))


def check_claim(claim: Column, evidence: Column) -> Column:
    """struct (label, score): how many of the claim's words, stop words aside, the evidence holds."""
    return check_words(claim, checked_words(evidence))


def checked_words(text: Column) -> Column:
    return F.array_except(word_set(text), F.array(*map(F.lit, CHECK_STOP_WORDS)))


def check_words(claim: Column, held: Column) -> Column:
    """check_claim with the evidence's words at hand."""
    share = let(checked_words(claim), lambda mine: F.size(F.array_intersect(mine, held)) / F.nullif(F.size(mine), F.lit(0)))
    label = F.when(share.isNull(), "NEUTRAL").when(share >= 0.6, "ENTAILMENT").when(share >= 0.3, "NEUTRAL").otherwise("UNSUPPORTED")
    return F.struct(label.alias("label"), F.coalesce(round4(share), F.lit(0.5)).alias("score"))


def hallucination_claims(simple_answer: Column, answer_text: Column) -> Column:
    return claims(simple_answer, answer_text, note="Note", starred=False)


def hallucination(answers: DataFrame) -> DataFrame:
    """query_id, total_claims, supported, unsupported, hallucination_rate. answers: query_id, simple_answer, answer_text, evidence.

    Neutral claims count as unsupported; no claims give 0, no evidence gives 1.
    """
    held = answers.select("query_id", hallucination_claims(F.col("simple_answer"), F.col("answer_text")).alias("claims"), F.coalesce("evidence", F.lit("")).alias("evidence"))
    held = held.select("query_id", "claims", checked_words(F.col("evidence")).alias("held"), (F.trim("evidence") == "").alias("blank"))
    checked = F.transform("claims", lambda c: F.when(F.col("blank"), F.struct(F.lit("UNSUPPORTED").alias("label"), F.lit(0.0).alias("score"))).otherwise(check_words(c, F.col("held"))))
    rows = held.select("query_id", checked.alias("checked"))
    n, good = F.size("checked"), F.size(F.filter("checked", lambda c: c["label"] == "ENTAILMENT"))
    return rows.select("query_id", n.cast("long").alias("total_claims"), good.cast("long").alias("supported"), (n - good).cast("long").alias("unsupported"), F.when(n > 0, round4((n - good) / n)).otherwise(F.lit(0.0)).alias("hallucination_rate"))


def trim_evidence(claim: Column, evidence: Column, most: int = 8, width: int = 1500) -> Column:
    """The evidence's sentences that share the most words with the claim, best first, cut to a width."""
    shared = lambda mine: F.transform(sentences(evidence), lambda s, i: F.struct((-F.size(F.array_intersect(mine, word_set(s)))).alias("n"), i.alias("i"), s.alias("s")))
    ranked = F.array_sort(let(word_set(claim), shared))
    return F.substring(F.array_join(F.transform(F.slice(ranked, 1, most), lambda r: r["s"]), " "), 1, width)


def nli_label(label: Column) -> Column:
    """An inference model's label under its common name; null for one that isn't known."""
    u = F.upper(label)
    return F.when(F.contains(u, F.lit("ENTAIL")) | (u == "LABEL_2"), "ENTAILMENT").when(F.contains(u, F.lit("CONTRAD")) | (u == "LABEL_0"), "CONTRADICTION").when(F.contains(u, F.lit("NEUTRAL")) | (u == "LABEL_1"), "NEUTRAL")


NliModel = Callable[[pd.Series, pd.Series], pd.Series]


def check_with_model(rows: DataFrame, model: Callable[[], NliModel]) -> DataFrame:
    """rows (claim, evidence, ...) with check (label, score) of a plugged-in model.

    `model()` is called once per task and maps (evidence, claim) to lists of (label, score); the best known label wins.
    """
    given = rows.withColumn("__trimmed", trim_evidence(F.col("claim"), F.col("evidence")))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded = model()
        for batch in batches:
            found = loaded(batch["__trimmed"], batch["claim"])
            yield batch.drop(columns="__trimmed").assign(__found=[[{"label": x["label"], "score": x["score"]} for x in scores] for scores in found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    held = given.mapInPandas(scored, f"{fields}, __found array<struct<label: string, score: double>>")
    named = F.filter(F.transform("__found", lambda s: F.struct((-s["score"]).alias("o"), nli_label(s["label"]).alias("label"), round4(s["score"]).alias("score"))), lambda s: s["label"].isNotNull())
    top = F.try_element_at(F.array_sort(named), F.lit(1))
    check = F.struct(F.coalesce(top["label"], F.lit("NEUTRAL")).alias("label"), F.coalesce(top["score"], F.lit(0.0)).alias("score"))
    return held.withColumn("check", check).drop("__found")


def ranked(rows: DataFrame, by: str = "score") -> DataFrame:
    """rows (query_id, id, score) with their rank, ties by id."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "id")))
