"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows of the training folds that are labelled good; unlabelled text is a sample of all documents.
Rows labelled bad are not used. A linear model on features of the whole text minimises the non-negative unbiased PU risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))
with the sigmoid loss; where the second part falls below zero the step goes back along it. The score is the logistic
function of the margin, so the cut at 0.5 is the risk's own.

The class prior is estimated from positives and unlabelled rows alone, by the best bin: a classifier that tells them
apart is fitted on one half of both; on the other half, the share of unlabelled rows above a score over the share of
positives above it bounds the prior from above, for every score. The score with the least such ratio, chance included,
gives the estimate.

Features are made once for every document and written; their means and deviations are those of all documents. The fit
uses at most about `sample_rows` labelled and as many unlabelled rows, chosen by a hash; scores cover every row.

Defined cases: null text is empty and gets a score; rows with equal ids are scored alike if their texts are; a null id
is not held out; a document labelled both good and bad is no positive; without any positive (or with an empty table) the
model is flat and every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import map_texts, shingle_hashes, stage, words_of

NAMES = (
    "log_words", "log_bytes", "word_bytes", "symbols", "bangs", "upper", "digits", "stops", "beyond_ascii", "lines", "pipes",
    "same_next", "distinct_words", "distinct_windows", "dup_lines", "longest", "one_byte", "shouted", "plain_words", "odd_bytes",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>@^~=_\\{}[]", np.uint8)
_STOPS = np.frombuffer(b".,;:", np.uint8)


def features(text: str | None) -> list[float]:
    """Numbers of one text in the order of NAMES; an empty text has zeros."""
    words = words_of(text)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    raw = text.encode("utf-8", "surrogatepass")
    size = len(raw)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    windows = shingle_hashes(words, 3)
    lines = [x for x in text.split("\n") if x]
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        math.log1p(n), math.log1p(size), float(lengths.mean()), seen[_SYMBOLS].sum() / size, seen[33] / size, seen[65:91].sum() / size,
        seen[48:58].sum() / size, seen[_STOPS].sum() / size, seen[128:].sum() / size, len(lines) / n, seen[124] / size,
        sum(map(operator.eq, words, words[1:])) / n, len(set(words)) / n, len(np.unique(windows)) / len(windows),
        1 - len(set(lines)) / len(lines) if lines else 0.0, math.log1p(int(lengths.max())), float((lengths == 1).mean()),
        sum(map(bytes.isupper, words)) / n, sum(map(bytes.isalpha, words)) / n, seen[:9].sum() / size,
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(_spread((x - self.mean) / self.scale) @ self.weights + self.bias)


FLAT = Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(3 * len(NAMES)), 0.0, 0.5)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _spread(x: np.ndarray) -> np.ndarray:
    """Each feature, and its distances above and below the mean, so that either end can count."""
    x = np.clip(x, -6, 6)
    return np.concatenate([x, np.maximum(x - 1, 0), np.maximum(-x - 1, 0)], axis=1)


def told_apart(a: np.ndarray, b: np.ndarray, steps: int = 30, decay: float = 1e-3) -> np.ndarray:
    """Weights, the bias last, of a logistic regression that tells rows of a from rows of b, both weighing the same."""
    x = np.c_[np.concatenate([a, b]), np.ones(len(a) + len(b))]
    y = np.r_[np.ones(len(a)), np.zeros(len(b))]
    weight = np.where(y > 0, 0.5 / len(a), 0.5 / len(b))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = _sigmoid(x @ w)
        slope = x.T @ (weight * (q - y)) + decay * w
        curve = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + decay * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, chance: float = 0.1, slack: float = 0.01) -> float:
    """The share of positives among unlabelled rows, from both sides' scores: the least upper bound over all cuts."""
    cuts = np.unique(positive)
    above = lambda s: 1 - np.searchsorted(np.sort(s), cuts, side="left") / len(s)
    p, u = above(positive), above(unlabelled)
    noise = sum(math.sqrt(math.log(4 / chance) / (2 * n)) for n in (len(positive), len(unlabelled)))
    best = int(np.argmin((u + (1 + slack) * noise) / p))
    return float(np.clip(u[best] / p[best], 1e-3, 1 - 1e-3))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows; half of both fits the scores, the other half is counted."""
    rng = np.random.default_rng(5)
    mixed = [x[rng.permutation(len(x))] for x in (positive, unlabelled)]
    half = lambda x, k: x[k::2] if len(x) > 1 else x
    w = told_apart(*(half(x, 0) for x in mixed))
    scores = [half(x, 1) @ w[:-1] for x in mixed]
    return best_bin(*scores)


def fit(positive: np.ndarray, unlabelled: np.ndarray, mean: np.ndarray | None = None, scale: np.ndarray | None = None, prior: float | None = None, steps: int = 600, rate: float = 0.03, decay: float | None = None) -> Model:
    """Minimise the non-negative PU risk by Adam over all rows; the prior is estimated unless it is given, and so are the
    features' means and deviations. Weights decay by one part in the number of positives."""
    decay = 1 / len(positive) if decay is None else decay
    mean = unlabelled.mean(axis=0) if mean is None else mean
    scale = unlabelled.std(axis=0) + 1e-9 if scale is None else scale
    p, u = _spread((positive - mean) / scale), _spread((unlabelled - mean) / scale)
    prior = class_prior(p, u) if prior is None else prior
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)

    def slopes(x: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
        """Mean sigmoid loss of sign * margin, and its gradient by (w, b)."""
        loss = _sigmoid(-sign * (x @ w + b))
        g = -sign * loss * (1 - loss) / len(x)
        return float(loss.mean()), np.append(x.T @ g, g.sum())

    for t in range(1, steps + 1):
        _, gp = slopes(p, 1)
        rn, gn = slopes(p, -1)
        ru, gu = slopes(u, -1)
        rest, grest = ru - prior * rn, gu - prior * gn
        g = prior * gp + grest if rest >= 0 else -grest
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(mean, scale, w, b, prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _part(rows: int, of: int, seed: int) -> Column:
    """About rows of so many rows, by a hash of what they hold."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "x"), F.lit(1 << 32)) < min(1 << 32, (rows << 32) // max(of, 1))


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and x, the features of every whole text, written."""
    made = map_texts(docs.select("doc_id", F.col(text).alias("text")), lambda texts: [[features(t) for t in texts]], "x array<double>")
    return stage(made, "features")


def train(rows: DataFrame, labels: DataFrame, sample_rows: int = 20_000, seed: int = 11) -> Model:
    """A model of the labels' training folds. rows: doc_id, x. The driver gets at most about 2 * sample_rows rows."""
    at = [F.col("x")[i] for i in range(len(NAMES))]
    # one row: counts and moments over all documents
    whole = rows.agg(F.count("*").alias("n"), F.array(*map(F.avg, at)).alias("mean"), F.array(*map(F.stddev_pop, at)).alias("scale")).first()
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    good = stage(known.where("quality > 0").select("doc_id"), "positives")
    n_good = good.count()
    if not whole.n or not n_good:
        return FLAT
    few = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 32)) < min(1 << 32, (sample_rows << 32) // n_good)
    # about sample_rows ids
    found = rows.join(F.broadcast(good.where(few).limit(2 * sample_rows)), "doc_id", "left_semi").select("x").limit(2 * sample_rows).collect()
    plain = rows.where(_part(sample_rows, whole.n, seed + 1)).select("x").limit(2 * sample_rows).collect()
    if not found or not plain:
        return FLAT
    positive, unlabelled = (np.array([r.x for r in part], dtype=float) for part in (found, plain))
    return fit(positive, unlabelled, np.array(whole.mean), np.array(whole.scale) + 1e-9)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of rows (doc_id, x)."""

    def scored(batches):
        import pyarrow as pa

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "x").mapInArrow(scored, f"doc_id {kind}, score double")


def classified(docs: DataFrame, labels: DataFrame, text: str = "text", **kwargs) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    rows = featured(docs, text)
    found = score(rows, train(rows, labels, **kwargs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
