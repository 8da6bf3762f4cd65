"""Quality classifier by positive-unlabelled learning.

A linear model over a piecewise-linear basis of text statistics minimises the non-negative unbiased PU risk
``p R+(P) + max(0, R-(U) - p R-(P))`` with logistic loss: trusted positives are labelled good rows outside
the held-out fold, the unlabelled side is plain documents (labels unused). The class prior p is estimated
from the two samples: the least ratio of unlabelled to positive mass over regions where a first model is
confident, on rows which that model has not seen. Fitting uses bounded samples (``FIT_ROWS`` a side); every text is scored whole.

Inputs of a score are the text's own statistics; never labels, lang, source or doc_id.

Defined results: a null or empty text scores like a text whose statistics are all zero; equal texts get equal
scores; without any positive label every score is the prior of one half; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import bound_batches, fold

#: Rows at most (in expectation) in each of the two samples the model is fitted on.
FIT_ROWS = 20_000
KNOTS = (0.05, 0.25, 0.5, 0.75, 0.95)
PREDICT = 0.3
_MARKS = b"!*$#&%|.,;:?'\"()[]{}<>/\\@=+-_~^`"


def _classes() -> np.ndarray:
    table = np.zeros((256, 6), dtype=np.float64)
    for b in range(256):
        c = chr(b)
        table[b] = [b < 128 and c.isupper(), b < 128 and c.islower(), b < 128 and c.isdigit(), c in " \t\r\f\v", c == "\n", b >= 128]
    return table


_CLASS = _classes()
_MARK = np.frombuffer(_MARKS, dtype=np.uint8)
N_STATS = 6 + len(_MARKS) + 12


def statistics(text: str | None) -> np.ndarray:
    """Shares of byte classes and marks, word and line repetition, lengths."""
    data = (text or "").encode("utf-8")
    if not data:
        return np.zeros(N_STATS)
    hist = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    n = len(data)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(1, len(words))
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:])) if len(words) > 1 else 0
    upper = sum(map(bytes.isupper, words))
    alnum = sum(map(bytes.isalnum, words))
    tails = {w[-3:] for w in words}
    first = len({w[:1] for w in words})
    return np.concatenate(
        [
            hist @ _CLASS / n,
            hist[_MARK] / n,
            [np.log1p(n), np.log1p(len(words)), n / k / 10, distinct / k, np.log1p(distinct) / np.log1p(k), again / k, upper / k, alnum / k, len(tails) / k, np.log1p(first), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines)))],
        ]
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    prior: float

    def basis(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.ones((len(x), 1)), x, *(np.maximum(0, x - k) for k in self.knots)], axis=1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return _sigmoid(self.basis(stats) @ self.weights)


def pu_risk(margin_p: np.ndarray, margin_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The positive part and the (unclipped) negative part of the PU risk under logistic loss."""
    loss = lambda z: np.logaddexp(0, -z).mean()
    return prior * loss(margin_p), loss(-margin_u) - prior * loss(-margin_p)


def _minimise(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> np.ndarray:
    """Adam on the non-negative risk; where the negative part falls below zero only its ascent is followed."""
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        _, negative = pu_risk(gp, gu, prior)
        d_neg = u.T @ _sigmoid(gu) / len(u) - prior * (p.T @ _sigmoid(gp)) / len(p)
        grad = -prior * (p.T @ _sigmoid(-gp)) / len(p) + d_neg if negative >= 0 else -d_neg
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def class_prior(score_p: np.ndarray, score_u: np.ndarray, least: float = 0.1) -> float:
    """Share of positives in U: the least ratio U(A) / P(A) over upper sets A of the score with P(A) >= least.

    U(A) = p P(A) + (1 - p) N(A) >= p P(A), with equality where no negatives score as high.
    """
    cuts = np.quantile(score_p, np.linspace(0, 1 - least, 60))
    a = np.array([(score_p >= c).mean() for c in cuts])
    b = np.array([(score_u >= c).mean() for c in cuts])
    slack = 1 / np.sqrt(max(1, len(score_p))) + 1 / np.sqrt(max(1, len(score_u)))
    return float(np.clip(((b + slack * np.sqrt(b)) / a).min(), 0.05, 0.98))


def fit_arrays(p: np.ndarray, u: np.ndarray) -> Model:
    p, u = (x[np.lexsort(x.T[::-1])] for x in (p, u))  # the order in which rows arrive does not matter
    both = np.concatenate([p, u])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    z = np.clip((both - mean) / scale, -6, 6)
    model = Model(mean, scale, np.quantile(z, KNOTS, axis=0), np.zeros(0), 0.5)
    bp, bu = model.basis(p), model.basis(u)
    # the prior comes from rows that the first model has not seen, or it would fit its own positives too well
    first = _minimise(bp[::2], bu[::2], 0.5) if len(bp) > 1 else _minimise(bp, bu, 0.5)
    rest = (bp[1::2], bu[1::2]) if len(bp) > 1 and len(bu) > 1 else (bp, bu)
    model.prior = class_prior(rest[0] @ first, rest[1] @ first, least=0.3)
    model.weights = _minimise(bp, bu, model.prior)
    return model


def _sample(docs: DataFrame, rows: int, n: int, salt: int) -> DataFrame:
    """About rows of n, by a hash of the doc_id: the same at every run.

    Rows that share a doc_id (or have none) share a hash; where they swell the sample beyond four times ``rows``, it
    is thinned row by row, so what reaches the driver stays bounded.
    """
    out = docs.where(F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, rows / max(n, 1)))))
    got = out.count()
    return out if got <= 4 * rows else out.where(F.rand(salt) < rows / got)


def _stats_of(docs: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([statistics(t).tolist() for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))], names=["x"])

    got = docs.select("text").mapInArrow(run, "x array<double>").toArrow().column("x").to_pylist()
    return np.array(got, dtype=np.float64).reshape(-1, N_STATS)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """Learn from rows whose fold is not held out; None without a positive label."""
    bound_batches(docs.sparkSession)
    good = labels.where((F.col("quality") == 1) & (fold("doc_id", 5) != 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    n_good, n = good.count(), docs.count()
    chosen = _sample(good, rows, n_good, 11)
    few = chosen.count() <= 4 * rows
    p = _stats_of(docs.join(F.broadcast(chosen) if few else chosen, "doc_id", "left_semi"))
    if not len(p):
        return None
    return fit_arrays(p, _stats_of(_sample(docs, rows, n, 13)))


def score(model: Model | None, text: str = "text") -> Column:
    """Score column of a text column; an Arrow-batched function of the text alone."""

    @F.pandas_udf("double")
    def apply(texts: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(model.score(np.stack([statistics(t) for t in texts])) if len(texts) else np.zeros(0))

    return apply(F.coalesce(F.col(text).cast("string"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    s = score(fit(docs, labels, rows))
    out = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), s.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= PREDICT).cast("int"))
