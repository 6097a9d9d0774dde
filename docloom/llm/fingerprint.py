"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is a multiset of paragraphs (its lines). Each paragraph is hashed to a wide vector and a text's fingerprint is
the sum of its paragraphs' vectors modulo powers of two, so it doesn't depend on their order, and a paragraph is
inserted or deleted by adding or subtracting its vector (`combined`).

- EQUAL lanes of 32 bits, from hashes of the whole paragraph: equal texts have equal lanes, others differ.
- SIGNS lanes of 24 bits: counts of set bits in hashes of the paragraph's runs of up to four words, one from every word
  on, so that a word put in or taken out changes only the runs it lies in. Read as sums of plus and minus one they are
  a tug-of-war sketch: their distance estimates how many runs two texts don't share, which gives `likeness` from 0 to 1
  without the texts.

The lanes are fast public hashes (xxHash64): made against chance, not against an adversary.

Defined cases: null text is empty, an empty text has one empty paragraph; null ids come first; equal ids follow the
order of their texts; the only row's next row is itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EQUAL_SEEDS, SIGN_SEEDS = 8, 2
EQUAL, SIGNS = 2 * EQUAL_SEEDS, 64 * SIGN_SEEDS
#: Group 1 has up to four words of a line; only the first is consumed, so that a run starts at every word.
RUN = r"(?=([^\x20\x09-\x0D]++(?:[\x20\x09\x0B-\x0D]++[^\x20\x09-\x0D]++){0,3}+))[^\x20\x09-\x0D]++"
_LOW, _PAIR, _SIGN_MASK = 0xFFFFFFFF, 0x100000001, 0xFFFFFF


def units(text: Column, side: int = 0) -> Column:
    """The text's hashed parts: array of (side, whole, unit), whole for paragraphs and not for runs of words."""
    t = F.coalesce(text, F.lit(""))
    paragraphs = F.transform(F.split(t, "\n", -1), lambda p: F.struct(F.lit(side).alias("side"), F.lit(True).alias("whole"), p.alias("unit")))
    runs = F.transform(F.regexp_extract_all(t, F.lit(RUN), F.lit(1)), lambda u: F.struct(F.lit(side).alias("side"), F.lit(False).alias("whole"), u.alias("unit")))
    return F.concat(paragraphs, runs)


def _sums(whole: Column, unit: Column) -> list[Column]:
    out = []
    for seed in range(EQUAL_SEEDS):
        h = F.when(whole, F.xxhash64(F.lit(seed), unit)).otherwise(F.lit(0))
        out += [F.sum(h.bitwiseAND(F.lit(_LOW))).alias(f"e{2 * seed}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"e{2 * seed + 1}")]
    for seed in range(SIGN_SEEDS):
        # bits i and i + 32 are counted in the two halves of one long
        h = F.when(whole, F.lit(0)).otherwise(F.xxhash64(F.lit(100 + seed), unit))
        out += [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_PAIR))).alias(f"s{32 * seed + i}") for i in range(32)]
    return out


def summed(exploded: DataFrame, *keys: str) -> DataFrame:
    """keys and fp for rows (keys, whole, unit): the sums of each group's vectors."""
    sums = exploded.groupBy(*keys).agg(*_sums(F.col("whole"), F.col("unit")), F.sum((~F.col("whole")).cast("long")).alias("runs"))
    equal = F.array(*(F.col(f"e{i}").bitwiseAND(F.lit(_LOW)) for i in range(EQUAL)))
    halves = [c for i in range(SIGNS // 2) for c in (F.col(f"s{i}").bitwiseAND(F.lit(_SIGN_MASK)), F.shiftrightunsigned(F.col(f"s{i}"), 32).bitwiseAND(F.lit(_SIGN_MASK)))]
    return sums.select(*keys, F.struct(equal.alias("equal"), F.array(*halves).alias("signs"), F.col("runs").alias("runs")).alias("fp"))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of the multisets' sum (sign 1) or difference (sign -1)."""
    return F.struct(
        F.zip_with(a["equal"], b["equal"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(_LOW))).alias("equal"),
        F.zip_with(a["signs"], b["signs"], lambda x, y: (x + sign * y).bitwiseAND(F.lit(_SIGN_MASK))).alias("signs"),
        (a["runs"] + sign * b["runs"]).alias("runs"),
    )


def written(fp: Column) -> Column:
    """Hexadecimal string of a fingerprint."""
    hexed = lambda lanes, n: F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")
    return F.concat(hexed(fp["equal"], 8), hexed(fp["signs"], 6))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else 1 - |A - B|^2 / (|A|^2 + |B|^2) of the sign sums, within 0 and 1."""
    zero = F.lit(0.0)
    square = lambda lanes: F.aggregate(lanes, zero, lambda s, x: s + x * x)
    signs = lambda fp: F.transform(fp["signs"], lambda x: (2 * x - fp["runs"]).cast("double"))
    both = F.aggregate(F.zip_with(signs(a), signs(b), lambda x, y: x * y), zero, lambda s, x: s + x)
    norms = square(signs(a)) + square(signs(b))
    near = F.when(norms > 0, F.greatest(zero, F.least(F.lit(1.0), 2 * both / norms))).otherwise(zero)
    return F.when((a["equal"] == b["equal"]) & (a["signs"] == b["signs"]), F.lit(1.0)).otherwise(near)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fp of every text; rows that share a doc_id are added up as one document."""
    return summed(docs.select("doc_id", F.explode(units(F.col(text))).alias("u")).select("doc_id", "u.whole", "u.unit"), "doc_id")


def _bucket(key: Column, bounds: list[int], step: int = 128) -> Column:
    """How many of the sorted bounds are at most key, by two steps over short arrays."""
    long_array = lambda xs: F.array(*map(F.lit, xs)).cast("array<long>")
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    coarse = below(long_array([g[0] for g in groups]))
    inner = F.element_at(F.array(*map(long_array, groups)), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + below(inner))


def with_next(docs: DataFrame, text: str = "text", bucket_rows: int = 2000, max_buckets: int = 4096) -> DataFrame:
    """bucket, row, extra, doc_id, text, next_text: every row beside the next one by doc_id, the last beside the first.

    Rows are dealt to ranges of ids (bounds from quantiles, at most max_buckets) and ordered within each. A range's
    first row also stands at the end of the range before it, marked extra, so no order of all rows is needed.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"))
    n = rows.count()
    buckets = max(1, min(max_buckets, n // bucket_rows))
    bounds = rows.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 100_000)).first()[0] if buckets > 1 else []
    rows = rows.withColumn("bucket", _bucket(F.col("key"), sorted(set(bounds))))
    firsts = sorted((r.key, r.bucket) for r in rows.groupBy("bucket").agg(F.min("key").alias("key")).collect())
    ahead = [(key, firsts[i - 1][1]) for i, (key, _) in enumerate(firsts)]
    # one row per range: at most max_buckets
    ahead = docs.sparkSession.createDataFrame(ahead, "first long, before int")
    rows = rows.join(F.broadcast(ahead), F.col("key") == F.col("first"), "left")
    places = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("extra")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("extra")), F.struct(F.col("before").alias("b"), F.lit(1).alias("extra")))
    )
    rows = rows.select("doc_id", "text", "key", F.explode(places).alias("p")).select(F.col("p.b").alias("bucket"), F.col("p.extra").alias("extra"), "key", "doc_id", "text")
    order = Window.partitionBy("bucket").orderBy("extra", "key", "text")
    return rows.select("bucket", F.row_number().over(order).alias("row"), "extra", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """text with its last quarter (rounded down) replaced by as much of the following text's beginning."""
    cut = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring(F.coalesce(following, F.lit("")), F.lit(1), cut))


def compared(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts are shuffled once, by ranges of ids; all later steps keep that partitioning.
    """
    rows = with_next(docs, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    keys = ("bucket", "row", "side", "extra", "doc_id", "n_chars", "edited_sha256")
    rows = rows.select("bucket", "row", "extra", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.concat(units(F.col("text"), 0), units(F.col("edited"), 1)).alias("units"))
    # exploded in a step of its own, else the digest would be taken again for every unit
    rows = rows.select("bucket", "row", "extra", "doc_id", "n_chars", "edited_sha256", F.explode("units").alias("u"))
    fps = summed(rows.select("bucket", "row", "u.side", "extra", "doc_id", "n_chars", "edited_sha256", "u.whole", "u.unit"), *keys)
    order = Window.partitionBy("bucket").orderBy("row", "side")
    fps = fps.withColumns({"edited_fp": F.lead("fp").over(order), "next_fp": F.lead("fp", 2).over(order)}).where("side = 0 AND extra = 0")
    return fps.select("doc_id", "n_chars", "edited_sha256", written(F.col("fp")).alias("fingerprint"), written(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
