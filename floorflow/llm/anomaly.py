"""Quality rules by an isolation forest over rule statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_numpy, draw, label_of, materialize, released
from .rules import FEATURES, measure

TREES, DEPTH, LEAF_ROWS = 100, 8, 256
#: Bound of the rows that the trees are grown on (LEAF_ROWS for each tree, as
#: the method has it), those with the smallest id hash.
SAMPLE_ROWS = TREES * LEAF_ROWS
#: How much more a good row lost weighs than a bad row caught, as shares of
#: the labelled rows of either kind.
GOOD_WEIGHT = 10.0
BINS = 4096
#: The length of a text is no anomaly by itself.
USED = [k for k, name in enumerate(FEATURES) if name not in ("log_words", "dup_line_ratio", "line_words")]


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Complete binary trees in arrays: feature and cut of each inner node,
    path length of each leaf."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        inner = 2**DEPTH - 1
        self.feature = np.zeros((TREES, inner), np.int16)
        self.cut = np.full((TREES, inner), np.inf)
        self.path = np.zeros((TREES, inner + 1))
        self.unit = _average_path(min(LEAF_ROWS, max(len(x), 2)))
        for t in range(TREES):
            rows = x[rng.permutation(len(x))[:LEAF_ROWS]]
            self._grow(rng, t, 0, 0, rows)

    def _grow(self, rng, tree: int, node: int, depth: int, rows: np.ndarray) -> None:
        if depth == DEPTH:
            self.path[tree, node - (2**DEPTH - 1)] = depth + _average_path(len(rows))
            return
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) > 1 else np.zeros(rows.shape[1])
        open_ = np.flatnonzero(spread > 0)
        if len(rows) <= 1 or not len(open_):
            # nothing to split: the whole subtree has this path
            value, first, last = depth + _average_path(len(rows)), node, node
            for _ in range(DEPTH - depth):
                first, last = 2 * first + 1, 2 * last + 2
            base = 2**DEPTH - 1
            self.path[tree, first - base : last - base + 1] = value
            return
        f = int(rng.choice(open_))
        cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
        self.feature[tree, node], self.cut[tree, node] = f, cut
        left = rows[:, f] <= cut
        self._grow(rng, tree, 2 * node + 1, depth + 1, rows[left])
        self._grow(rng, tree, 2 * node + 2, depth + 1, rows[~left])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1."""
        total = np.zeros(len(x))
        at = np.arange(len(x))
        for t in range(TREES):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[at, self.feature[t, node]] > self.cut[t, node])
            total += self.path[t, node - (2**DEPTH - 1)]
        return 2.0 ** (-total / TREES / self.unit)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("features"))
    return np.asarray(column.flatten()).reshape(batch.num_rows, len(FEATURES))[:, USED]


def _score(forest: Forest | None):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            score = forest.score(_matrix(batch)) if forest is not None and n else np.zeros(n)
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(score)], names=[*names, "anomaly"]
            )

    return run


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, base rule and verdict of every document.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (fewer than 20 words, or more than 30 % of them in repeated
    8-word windows), kept and anomaly (0 to 1).  ``labels``: doc_id, quality.
    The threshold is the anomaly at which the share of rows labelled 0 that
    fail, less GOOD_WEIGHT times that of rows labelled 1, is largest; it takes
    all labelled rows, and one row more or less moves it no farther in a small
    table than its share of the rows.  Without labels of both kinds nothing but
    the base rule fails.

    Null and empty texts have no words and fail the base rule; equal texts get
    equal verdicts, and of neighbouring thresholds that are equally good the middle
    one holds; a null
    doc_id stays (and has no label); repeated rows count as rows; of several
    labels of one id the lower counts; texts of any length are read whole; an
    empty table gives no rows; extra columns are not looked at.
    """
    measured = materialize(measure(docs), "rules")
    key = ("doc_id", "n_words", "word_chars", "n_symbols")
    rows = draw(measured.where("n_words > 0"), SAMPLE_ROWS, *key).select("features").toPandas()
    forest = Forest(np.stack(rows["features"].to_numpy())[:, USED]) if len(rows) else None
    scored = materialize(
        measured.mapInArrow(
            released(_score(forest)),
            "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, anomaly double",
        ).withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")),
        "anomalies",
    )
    known = (
        scored.where("not base_failed")
        .join(label_of(labels), "doc_id")
        .groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"))
        .agg(F.sum((F.col("quality") == 0).cast("long")).alias("bad"), F.sum((F.col("quality") == 1).cast("long")).alias("good"))
        .collect()
    )
    cut = _threshold(known)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("anomaly") < F.lit(cut))).alias("kept"), "anomaly",
    )


def _threshold(known) -> float:
    """The cut for counts of bad and good rows by bin: rows from it on fail."""
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in known:
        good[r.bin], bad[r.bin] = r.good, r.bad
    if not good.sum() or not bad.sum():
        return 2.0
    lost = np.cumsum(good[::-1])[::-1] / good.sum()
    caught = np.cumsum(bad[::-1])[::-1] / bad.sum()
    gain = caught - GOOD_WEIGHT * lost
    first = last = int(gain.argmax())
    if gain[first] <= 0:
        return 2.0
    while last < BINS and gain[last + 1] == gain[first]:
        last += 1
    return (first + last) / 2 / BINS
