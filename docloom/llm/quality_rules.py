"""Quality rules per document, and per host by shrunken failure rates.

Every document is measured over its whole text and fails if it breaks a rule: too few words or too many repeated ones
(the base rules), or more symbols than one in `symbol_words` words. Failures are counted per host; each host's rate is
shrunk towards a beta prior fitted to all hosts, so that few documents say little about a host. The host's verdict goes
back to its documents:

- rejected (rate of `host_rate` or more): all its documents go;
- suspect (rate of `suspect_rate` or more, and two standard deviations of the prior above its mean): its documents have
  to keep twice as far from every limit;
- else only documents that fail by themselves go, so clean documents of ordinary hosts stay.

The prior is beta-binomial, by moments: the pooled rate m, and the correlation that is left of the hosts' weighted
spread around m after what binomial chance alone gives is taken off.

Defined cases: null or empty text has no words (all counts 0, base_failed); a null host is a host of its own; rows
with equal doc_id are judged one by one; one host or none, or hosts that all fail or all pass, give a prior of strength
1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_texts, small, stage, words_of

_SYMBOLS = regex.compile(r"[#*$%&|<>]+")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = words_of(text)
    n = len(words)
    if not n:
        return (0, 0, sum(map(len, _SYMBOLS.findall(text or ""))), 0, 0)
    # code points of UTF-8 words: bytes that don't continue a character
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    lines = [x for x in text.split("\n") if words_of(x)]
    return (n, chars, sum(map(len, _SYMBOLS.findall(text))), len(lines) - len(set(lines)), repeated(words))


def repeated(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text holds at least twice."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + 3 - max(i, reach)
            reach = i + 3
    return total


def _columns(texts: list) -> list:
    return list(zip(*map(measure, texts), strict=True)) or [()] * len(MEASURES)


def measures(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host and the measures, one row per input row; texts travel one Arrow batch at a time."""
    rows = docs.select("doc_id", F.col(host).alias("host"), F.col(text).alias("text"))
    return map_texts(rows, _columns, ", ".join(f"{m} long" for m in MEASURES))


@dataclass(frozen=True)
class Limits:
    """What a document may have: the contract's base limits, and at most one symbol in so many words."""

    min_words: int = 50
    max_repeat: int = 50
    symbol_words: int = 10
    host_rate: float = 0.9
    suspect_rate: float = 0.3

    def base_failed(self, strict: int = 1) -> Column:
        return (F.col("n_words") < strict * self.min_words) | (strict * 100 * F.col("n_repeat_words") > self.max_repeat * F.col("n_words"))

    def failed(self, strict: int = 1) -> Column:
        return self.base_failed(strict) | (strict * self.symbol_words * F.col("n_symbols") > F.col("n_words"))


def host_rates(measured: DataFrame, limits: Limits) -> DataFrame:
    """host, n, bad (failed documents), rate (posterior mean), verdict (rejected, suspect or null). measured: host, failed."""
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("bad"))
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    # sums over hosts of: documents, failures, squares of both by documents, hosts
    sums = hosts.agg(F.sum(n).alias("all"), F.sum(bad).alias("bad"), F.sum(bad * bad / n).alias("bb"), F.sum(n * n).alias("nn"), F.count("*").alias("k"))
    m, k = F.col("m"), F.col("k")
    spread = F.col("bb") - F.col("all") * m * m  # sum of n * (rate - m)^2
    rest = F.col("all") - F.col("nn") / F.col("all") - (k - 1)
    rho = (spread - m * (1 - m) * (k - 1)) / (m * (1 - m) * rest)
    strength = F.when((m > 0) & (m < 1) & (rest > 0), 1 / F.greatest(F.lit(1e-6), F.least(F.lit(0.5), rho)) - 1).otherwise(F.lit(1.0))
    prior = sums.withColumn("m", F.col("bad") / F.col("all")).select("m", strength.alias("s"))
    prior = prior.select("m", "s", (m + 2 * F.sqrt(m * (1 - m) / (F.col("s") + 1))).alias("far"))
    # the prior is one row by construction
    rated = hosts.crossJoin(F.broadcast(prior)).withColumn("rate", (bad + m * F.col("s")) / (n + F.col("s")))
    verdict = F.when(F.col("rate") >= limits.host_rate, "rejected").when(F.col("rate") >= F.greatest(F.lit(limits.suspect_rate), "far"), "suspect")
    return rated.select("host", "n", "bad", "rate", verdict.alias("verdict"))


def _with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """rows (with host and the measures) beside host_verdict and kept. verdicts: host, verdict, those that have one."""
    verdicts = verdicts.select(F.col("host").alias("__bad"), F.col("verdict").alias("host_verdict"))
    return rows.join(small(verdicts, 96), F.col("host").eqNullSafe(F.col("__bad")), "left").drop("__bad")


def _kept(limits: Limits) -> Column:
    verdict = F.coalesce("host_verdict", F.lit(""))
    return ~limits.failed() & (verdict != "rejected") & ((verdict != "suspect") | ~limits.failed(2))


def _verdicts(measured: DataFrame, limits: Limits) -> DataFrame:
    return stage(host_rates(measured, limits).where("verdict IS NOT NULL").select("host", "verdict"), "hosts")


def judge(docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """doc_id, host, the measures, base_failed, failed, host_verdict, host_rejected, kept."""
    measured = measures(docs, text, host).withColumns({"base_failed": limits.base_failed(), "failed": limits.failed()})
    measured = stage(measured, "rules")
    rejected = F.coalesce(F.col("host_verdict") == "rejected", F.lit(False))
    return _with_verdicts(measured, _verdicts(measured, limits)).withColumns({"host_rejected": rejected, "kept": _kept(limits)})


def filtered(docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that judge() keeps. Texts are measured once and travel with their measures, so that no join by id
    is needed: all rows are written once, beside what they were measured as."""
    names = {f"__{c}": c for c in docs.columns}
    rows = docs.select(*(F.col(c).alias(n) for n, c in names.items() if c != text), F.col(host).alias("host"), F.col(text).alias(f"__{text}"))
    rows = map_texts(rows, _columns, ", ".join(f"{m} long" for m in MEASURES), keep=True)
    measured = stage(rows.withColumn("failed", limits.failed()), "measured")
    kept = _with_verdicts(measured.where("NOT failed"), _verdicts(measured, limits)).where(_kept(limits))
    return kept.select(*(F.col(f"__{c}").alias(c) for c in docs.columns))
