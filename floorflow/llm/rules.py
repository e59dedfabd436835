"""Rule statistics of texts, in numpy over whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_list, binary_text, chunks, mix, released, spread, word_hashes

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_PLACE = spread(31, WINDOW)
_SPACES = bytes([0x20, *range(0x09, 0x0E)])

#: What the models look at, all bounded ratios or logarithms.
FEATURES = (
    "log_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio",
    "mark_ratio", "distinct_ratio", "line_words", "bang_ratio", "pipe_ratio", "symbol_words", "long_words",
)


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside windows of WINDOW words that occur twice or more."""
    n = len(hashes) - WINDOW + 1
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        total = hashes[:n] * _PLACE[0]
        for k in range(1, WINDOW):
            total = total + hashes[k : n + k] * _PLACE[k]
        total = mix(total)
    order = np.argsort(total, kind="stable")
    same = total[order[1:]] == total[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    step = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(step, at, 1)
    np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def statistics(raw: bytes) -> tuple[list[int], list[float]]:
    """[n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words] and the
    FEATURES of one text."""
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0], [0.0] * len(FEATURES)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    points = len(raw) - int(counts[0x80:0xC0].sum())
    chars = points - int(counts[list(_SPACES)].sum())
    symbols = int(counts[list(SYMBOLS)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    hashes = word_hashes(words)
    repeats = repeated_words(hashes)
    ends = np.array([w[-1] for w in words], np.uint8)
    odd = sum(int((ends == s).sum()) for s in SYMBOLS)
    sizes = np.array(list(map(len, words)))
    features = [
        float(np.log1p(n)),
        min(chars / n, 40.0) / 10,
        symbols / chars,
        dup / len(lines),
        repeats / n,
        int(counts[65:91].sum()) / chars,
        int(counts[48:58].sum()) / chars,
        int(counts[[33, 44, 46, 58, 59, 63]].sum()) / chars,
        len(np.unique(hashes)) / n,
        float(np.log1p(n / len(lines))),
        int(counts[33]) / n,
        int(counts[124]) / n,
        odd / n,
        float((sizes > 14).mean()),
    ]
    return [n, chars, symbols, dup, repeats], features


def _measure(batches):
    for batch in chunks(batches):
        found = [statistics(t) for t in as_list(batch, "text")]
        base = np.array([b for b, _ in found], np.int64).reshape(-1, 5)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(base[:, k]) for k in range(5)), pa.array([f for _, f in found], pa.list_(pa.float64()))],
            names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "features"],
        )


def measure(docs: DataFrame) -> DataFrame:
    """Counts and features of every whole text; null texts count as empty."""
    return docs.select(F.col("doc_id").cast("long"), binary_text().alias("text")).mapInArrow(
        released(_measure),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "features array<double>",
    )
