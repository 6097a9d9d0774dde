"""Entities: rule-based spans and counts, mapping of model labels, merging, canonical names, a knowledge base."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.constants import COURT_WORDS, ENTITY_PATTERNS, ENTITY_STARTS, JUDGE_STARTS, JUDGE_TITLES, MODEL_LABELS, UNBOUNDED_LABELS
from docloom.functions.text import contains_any, let, strip
from docloom.schema import ENTITY
from docloom.session import materialize

#: Bytes of stated names up to which they are broadcast.
MAX_TARGET_BYTES = 8 << 20


def _bounded(label: str, pattern: str, strict: bool) -> str:
    return rf"\b(?:{pattern})\b" if strict and label in UNBOUNDED_LABELS else pattern


def find_spans(text: str | None, patterns: list[tuple[str, re.Pattern]]) -> list[dict]:
    """Matches of all labels by start, longer first; of one label's overlapping spans the first stays.

    Text is stripped, offsets are the whole match's; matches of fewer than two characters are dropped.
    """
    found = []
    for label, pattern in patterns:
        for m in pattern.finditer(text or ""):
            if len(m[0].strip()) >= 2:
                found.append({"text": m[0].strip(), "label": label, "start": m.start(), "end": m.end(), "source": "rule_based"})
    found.sort(key=lambda e: (e["start"], e["start"] - e["end"]))
    reach: dict[str, int] = {}
    kept = []
    for e in found:
        if e["start"] >= reach.get(e["label"], 0):
            kept.append(e)
            reach[e["label"]] = max(reach.get(e["label"], 0), e["end"])
    return kept


def extract_spans(c: Column | str, strict: bool = False) -> Column:
    """array of (text, label, start, end, source); strict keeps labels from matching inside words."""
    sources = [(label, _bounded(label, p, strict), re.I if fold else 0) for label, p, fold in ENTITY_PATTERNS]

    @F.pandas_udf(f"array<{ENTITY}>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [(label, re.compile(p, flags)) for label, p, flags in sources]
        for texts in batches:
            yield texts.map(lambda t: find_spans(t, compiled))

    return spans(c)


def jvm_pattern(pattern: str, fold: bool, label: str | None = None) -> str:
    """The pattern under Python's rules, behind a look at the first characters where the label has some."""
    return ("(?iuUd)" if fold else "(?Ud)") + _ahead(label, fold) + pattern


def _ahead(label: str | None, fold: bool) -> str:
    """Each of the next characters against all that can stand there; if folded, in either case and what else folds to s, i, k."""
    if label not in ENTITY_STARTS:
        return ""
    starts, digits = ENTITY_STARTS[label]
    other = {"s": "\u017f", "i": "\u0130\u0131", "k": "\u212a"}
    sets = ("".join(c + c.upper() + other.get(c, "") if fold else c for c in sorted(set(at))) for at in zip(*starts.split(), strict=True))
    return "(?-i:(?=" + (r"\d|" if digits else "") + "".join(f"[{chars}]" for chars in sets) + "))"


def label_matches(c: Column | str, strict: bool = False) -> Column:
    """array of (label, texts): all matched texts per label, without Python."""
    parts = []
    for label, pattern, fold in ENTITY_PATTERNS:
        found = F.regexp_extract_all(c, F.lit(jvm_pattern(_bounded(label, pattern, strict), fold, label)), F.lit(0))
        parts.append(F.struct(F.lit(label).alias("label"), F.filter(F.transform(found, strip), lambda t: F.length(t) >= 2).alias("texts")))
    return F.array(*parts)


def matches(docs: DataFrame, key: str, text: str = "text", strict: bool = False) -> DataFrame:
    """key, label, pos, text: every match of every label."""
    held = docs.select(key, F.explode(label_matches(text, strict)).alias("m"))
    return held.select(key, "m.label", F.posexplode("m.texts").alias("pos", "text"))


def with_context(text: Column, start: Column, end: Column, window: int = 50) -> Column:
    """What surrounds a span, up to `window` characters on either side."""
    low = F.greatest(F.lit(0), start - window)
    return F.substring(text, low + 1, end + window - low)


def merge(*lists: Column) -> Column:
    """Entities of the lists in order; of equal lower-cased texts with one label the first stays."""
    joined = F.concat(*(F.coalesce(x, F.array().cast(f"array<{ENTITY}>")) for x in lists))
    name = lambda e: F.concat_ws("\x01", F.lower(e["text"]), e["label"])
    keyed = lambda every: F.array_sort(F.transform(every, lambda e, i: F.struct(name(e).alias("k"), i.alias("i"))))
    # sorted by name and place, an entity is its name's first if the one before it has another name
    firsts = lambda keys: F.filter(keys, lambda x, at: (at == 0) | (F.element_at(keys, F.greatest(at, F.lit(1)))["k"] != x["k"]))
    places = lambda every: let(keyed(every), lambda keys: F.array_sort(F.transform(firsts(keys), lambda x: x["i"])))
    return let(joined, lambda every: let(places(every), lambda kept: F.transform(kept, lambda i: F.element_at(every, i + 1))))


def model_label(label: Column, text: Column) -> Column:
    """What a general model's label becomes; null drops the entity; labels that aren't known pass."""
    lowered = F.lower(text)
    first = F.element_at(F.filter(F.split(F.replace(lowered, F.lit(","), F.lit(" ")), r"(?U)\s+"), lambda w: w != ""), 1)
    judge = reduce(lambda a, s: a | lowered.startswith(s), JUDGE_STARTS, F.lit(False)) | F.coalesce(first.isin(*JUDGE_TITLES), F.lit(False))
    out = F.when((label == "ORG") & contains_any(lowered, COURT_WORDS), "COURT").when((label == "PERSON") & judge, "JUDGE")
    for known, mapped in MODEL_LABELS.items():
        out = out.when(label == known, F.lit(mapped).cast("string"))
    return out.otherwise(label)


NerModel = Callable[[pd.Series], pd.Series]


def extract_with_model(c: Column | str, model: Callable[[], NerModel]) -> Column:
    """Spans of a plugged-in model: `model()` is called once per worker and maps texts to lists of entities."""

    @F.pandas_udf("array<struct<text: string, label: string, start: int, end: int, source: string>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        loaded = model()
        for texts in batches:
            yield loaded(texts)

    found = spans(c)
    mapped = F.transform(found, lambda e: F.struct(strip(e["text"]).alias("text"), model_label(e["label"], e["text"]).alias("label"), e["start"].alias("start"), e["end"].alias("end"), F.lit("ml_based").alias("source")))
    return F.filter(mapped, lambda e: e["label"].isNotNull())


def canonical(text: Column, label: Column) -> Column:
    """A name under which spellings of one entity meet."""
    t = strip(text)
    plain = F.replace(F.upper(t), F.lit(" "), F.lit("_"))
    number = F.upper(F.regexp_extract(t, r"(\d+[A-Za-z]?)", 1))
    act = strip(F.regexp_extract(t, r"(?iU)(?:of|under)\s+(?:the\s+)?(.+)", 1))
    court = F.upper(F.regexp_extract(F.lower(t), r"(?U)high\s+court\s+of\s+(\w+)", 1))
    judge = strip(F.replace(F.regexp_replace(t, r"(?U)(?:Hon'?ble|Honourable|Chief)?\s*Justice\s*", ""), F.lit("."), F.lit("")))
    return (
        F.when((label == "STATUTE") & (number != ""), F.regexp_replace(F.concat(F.lit("SECTION_"), number, F.lit("_"), act), r"\A_+|_+\z", ""))
        .when((label == "PROVISION") & (number != ""), F.concat(F.lit("ARTICLE_"), number))
        .when((label == "COURT") & F.contains(F.lower(t), F.lit("supreme")), F.lit("SUPREME_COURT_OF_INDIA"))
        .when((label == "COURT") & F.contains(F.lower(t), F.lit("high court")), F.when(court != "", F.concat(F.lit("HIGH_COURT_"), court)).otherwise(F.lit("HIGH_COURT")))
        .when(label == "JUDGE", F.concat(F.lit("JUSTICE_"), F.replace(F.upper(judge), F.lit(" "), F.lit("_"))))
        .otherwise(plain)
    )


def link(mentions: DataFrame) -> DataFrame:
    """mentions (text, label, chunk columns) with canonical and linked_to (document, section, section_num, page_num)."""
    where = F.struct(F.col("doc_name").alias("document"), "section", "section_num", "page_num")
    return mentions.withColumns({"linked_to": where, "canonical": canonical(F.col("text"), F.col("label")), "related": F.array().cast("array<string>")})


def knowledge_base(linked: DataFrame, spellings: int = 5) -> DataFrame:
    """canonical, label (of the first mention), mention_count, n_docs, mentions (distinct, `spellings` at most), first_doc.

    A name's documents are a table of their own (`documents_of`): the commonest name stands in most of them. Mentions are
    counted, and spellings cut, before anything is gathered.
    """
    spelled = linked.groupBy("canonical", "text").agg(F.count("*").alias("n"), F.min(F.struct("doc_name", "label")).alias("first"))
    place = Window.partitionBy("canonical").orderBy("text")
    few = spelled.select("canonical", "text").withColumn("r", F.row_number().over(place)).where(F.col("r") <= spellings)
    few = few.groupBy("canonical").agg(F.array_sort(F.collect_list("text")).alias("mentions"))
    names = spelled.groupBy("canonical").agg(F.min("first").alias("first"), F.sum("n").alias("mention_count"))
    counts = documents_of(linked).groupBy("canonical").agg(F.count("*").alias("n_docs"))
    return names.join(counts, "canonical").join(few, "canonical").select("canonical", F.col("first.label").alias("label"), "mention_count", "n_docs", "mentions", F.col("first.doc_name").alias("first_doc"))


def documents_of(linked: DataFrame) -> DataFrame:
    """canonical, doc_name: each document of a name once."""
    return linked.select("canonical", "doc_name").distinct()


def related(linked: DataFrame, targets: DataFrame, most: int = 10) -> DataFrame:
    """target, canonical, rank: names that share a document with a target, first seen first, `most` of them.

    targets (canonical) are the stated names; only their documents are joined. They are sized, and broadcast if few; no
    other side ever is: names repeat, so a table of millions of mentions takes a few MB on disk, and Spark would take it
    for a small one.
    """
    seen = materialize(documents_of(linked), "seen")
    asked = materialize(targets.select(F.col("canonical").alias("target")).distinct(), "targets")
    size = asked.agg(F.sum(F.length("target") * 4 + 48)).first()[0] or 0
    asked = F.broadcast(asked) if size <= MAX_TARGET_BYTES else asked.hint("merge")
    docs = seen.join(asked, F.col("canonical") == F.col("target")).select("target", "doc_name")
    first = seen.groupBy("canonical").agg(F.min("doc_name").alias("first_doc"))
    pairs = docs.join(seen.hint("merge"), "doc_name").where("target <> canonical").select("target", "canonical").distinct().join(first.hint("merge"), "canonical")
    order = Window.partitionBy("target").orderBy("first_doc", "canonical")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("target", "canonical", "rank")
