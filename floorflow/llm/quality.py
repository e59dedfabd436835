"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_text, crc_mod, draw, label_of, materialize, released, small
from .rules import FEATURES, _measure

#: Bounds: labelled rows (those with the smallest id hash) and preference
#: pairs that the ranking is fitted on.
SAMPLE_ROWS, PAIRS = 20_000, 40_000
ROUNDS, RIDGE = 30, 1e-3


@dataclass
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float  # the score quantile that parts the labels
    slope: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        s = ((_terms(x) - self.mean) / self.scale) @ self.weight
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.cut), -40, 40)))


def _terms(x: np.ndarray) -> np.ndarray:
    """Features, their roots (small ratios matter) and squares."""
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x], axis=1)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Ranking | None:
    """Weights from pairs of a row labelled 1 and a row labelled 0: the chance
    that the first is preferred is the logistic of the difference of scores.
    Newton steps on the logistic loss of feature differences.  The cut is the
    score quantile at the share of zeros, moved to where most labels agree."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    t = _terms(x)
    mean, scale = t.mean(axis=0), t.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1)
    t = (t - mean) / scale
    rng = np.random.default_rng(seed)
    d = t[rng.choice(good, PAIRS)] - t[rng.choice(bad, PAIRS)]
    w = np.zeros(d.shape[1])
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = d.T @ p / len(d) - RIDGE * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = t @ w
    ranks = np.linspace(0, 1, 1001)
    cuts = np.quantile(s, ranks)
    right = np.array([((s >= c) == (y == 1)).mean() for c in cuts])
    best = np.flatnonzero(right == right.max())
    near = best[np.abs(ranks[best] - len(bad) / len(y)).argmin()]
    cut = float(cuts[near])
    below, above = s[s < cut], s[s >= cut]
    if len(below) and len(above):  # in the middle of the gap
        cut = float((below.max() + above.min()) / 2)
    spread = max(float(s[good].mean() - s[bad].mean()), 1e-6)
    return Ranking(mean, scale, w, cut, 8.0 / spread)


def _score(model: Ranking | None):
    def run(batches):
        for batch in _measure(batches):
            x = np.asarray(batch.column(6).flatten()).reshape(batch.num_rows, len(FEATURES))
            score = model.probability(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return run


def learn(docs: DataFrame, labels: DataFrame, training: Column) -> Ranking | None:
    """Fit on at most SAMPLE_ROWS labelled rows for which ``training`` (on
    doc_id) holds; None unless both labels occur.  Of several labels of one id
    the lower counts, and of several texts the one with the least features."""
    labelled = materialize(label_of(labels).where(training), "labels")
    picked = materialize(draw(labelled, SAMPLE_ROWS, "doc_id"), "labelled")
    rows = (
        docs.select(F.col("doc_id").cast("long"), binary_text().alias("text"))
        .join(small(picked.select("doc_id")), "doc_id", "left_semi")
        .mapInArrow(
            released(_measure),
            "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>",
        )
        .join(small(picked), "doc_id")
        .groupBy("doc_id")
        .agg(F.min(F.struct("quality", "features")).alias("x"))
        .select("doc_id", "x.quality", "x.features")
        .orderBy("doc_id")
        .toPandas()
    )
    if not len(rows):
        return None
    return fit(np.stack(rows["features"].to_numpy()), rows["quality"].to_numpy())


def score(docs: DataFrame, model: Ranking | None) -> DataFrame:
    """doc_id, score (0 to 1, higher is likelier good) and predicted for every
    whole text.  Null and empty texts have the score of an empty text; equal
    texts get equal scores; without a model all scores are 0.5.  Texts of any
    length are read whole, repeated rows count as rows, a null doc_id stays,
    and an empty table gives no rows.  Columns but doc_id and text play no
    part."""
    return docs.select(F.col("doc_id").cast("long"), binary_text().alias("text")).mapInArrow(
        released(_score(model)), "doc_id long, score double, predicted int"
    )


def ranked(docs: DataFrame, labels: DataFrame, mod: int = 3, out: int = 1) -> DataFrame:
    """Learn from labels of ids whose crc32 modulo ``mod`` is not ``out``;
    score all documents."""
    model = learn(docs, labels, crc_mod("doc_id", mod) != out)
    return score(docs, model).select("doc_id", (crc_mod("doc_id", mod) == out).alias("held_out"), "score", "predicted")
