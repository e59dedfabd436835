"""Approximate nearest neighbours by multi-index hashing.

Vectors become learned binary codes: principal axes, then rotations fitted so
that signs keep the most (iterative quantization), several rotations side by
side.  A code is split into substrings, each with an index from its values to
rows.  A code within Hamming radius R of a query's differs from it by at most
R / m in one of the m substrings, so probing each index up to that distance
finds every code within R; those are reranked by exact distance.

Rows are dealt into blocks by id; each block holds its indexes, and a batch of
queries meets each block once, which gives the block's nearest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import draw, materialize, small

#: Bound of the sample that rotations and the radius are fitted on.
SAMPLE_ROWS = 4096
TRIALS = 200
ROTATIONS, ROUNDS, PART_BITS = 4, 20, 16
BLOCK_ROWS, QUERY_ROWS = 16_384, 16_384
#: Recall on the sample that the radius is chosen for.
RECALL = 0.985
K = 10


@dataclass
class Codes:
    mean: np.ndarray
    turn: np.ndarray  # dims x bits
    radius: int

    def of(self, x: np.ndarray) -> np.ndarray:
        """rows x parts of 16-bit substrings."""
        bits = (x - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1, bitorder="little").view("<u2")


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_ONES16 = (_ONES[np.arange(1 << 16) & 255] + _ONES[np.arange(1 << 16) >> 8]).astype(np.uint8)


def fit(sample: np.ndarray, k: int = K, seed: int = 9) -> Codes:
    rng = np.random.default_rng(seed)
    n, dims = sample.shape
    mean = sample.mean(axis=0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    x = x @ axes
    turns = []
    for _ in range(ROTATIONS):
        r, _ = np.linalg.qr(rng.normal(size=(dims, dims)))
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(x @ r > 0, 1.0, -1.0).T @ x)
            r = (u @ v).T
        turns.append(axes @ r)
    turn = np.concatenate(turns, axis=1)
    spare = -turn.shape[1] % PART_BITS
    turn = np.concatenate([turn, np.zeros((dims, spare))], axis=1)
    codes = Codes(mean, turn, turn.shape[1])
    # the radius that finds RECALL of the sample's own nearest
    asked = rng.permutation(n)[:TRIALS]
    all_codes = codes.of(sample)
    far = []
    for i in asked.tolist():
        dist = ((sample - sample[i]) ** 2).sum(axis=1)
        dist[i] = np.inf
        near = np.argsort(dist, kind="stable")[: min(k, n - 1)]
        far += _ONES16[all_codes[near] ^ all_codes[i]].sum(axis=1).tolist()
    codes.radius = int(np.quantile(far, RECALL)) if far else turn.shape[1]
    return codes


class Index:
    """One block: for each substring, rows sorted by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.parts = []
        for p in range(codes.shape[1]):
            order = np.argsort(codes[:, p], kind="stable")
            values, starts = np.unique(codes[order, p], return_index=True)
            self.parts.append((order, values, np.append(starts, len(order))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Numbers of all rows whose code is within the radius."""
        hit = np.zeros(len(self.codes), bool)
        most = radius // len(self.parts)
        for p, (order, values, starts) in enumerate(self.parts):
            near = _ONES16[values ^ code[p]] <= most
            marks = np.repeat(near, np.diff(starts))
            hit[order[marks]] = True
        rows = np.flatnonzero(hit)
        return rows[_ONES16[self.codes[rows] ^ code].sum(axis=1) <= radius]


def _finite(name: str) -> Column:
    good = F.forall(name, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    some = F.exists(name, lambda v: v != 0)
    return F.col(name).isNotNull() & (F.size(name) > 0) & good & some


def _stack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def _probe(codes: Codes, k: int, radius: int | None):
    reach = codes.radius if radius is None else radius

    def run(index, asked):
        names = ["query_id", "vec_id", "d2"]
        types = [pa.int64(), pa.int64(), pa.float64()]
        if not index.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        x, ids = _stack(index.column("v")), np.array(index.column("vec_id").to_pylist())
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        held = Index(codes.of(x))
        q, asker = _stack(asked.column("v")), asked.column("query_id").to_pylist()
        code = codes.of(q)
        out_q, out_v, out_d = [], [], []
        for i, name in enumerate(asker):
            rows = held.within(code[i], reach)
            rows = rows[ids[rows] != name]
            if not len(rows):
                continue
            d2 = ((x[rows] - q[i]) ** 2).sum(axis=1)
            best = np.lexsort((ids[rows], d2))[:k]
            out_q += [name] * len(best)
            out_v += ids[rows][best].tolist()
            out_d += d2[best].tolist()
        return pa.table([pa.array(a, t) for a, t in zip((out_q, out_v, out_d), types)], names=names)

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = K) -> DataFrame:
    """The k nearest rows of each query row.

    ``vectors``: vec_id, embedding.  ``queries`` tells the query rows.
    Returns query_id, rank (from 1), vec_id and score, the Euclidean distance
    in double precision; ties go to the smaller id.

    Vectors that are null, empty, zero, or hold null or non-finite components
    take no part, nor do null ids or vectors of another length than the most
    common one; a repeated id counts once.  Of equal vectors only the k + 1
    with the smallest ids can be among a query's nearest, so no others are
    sent to the blocks.  A query that finds fewer than k within the radius is
    asked again without one.  Extra columns are not looked at; an empty table
    gives no rows.
    """
    clean = vectors.where(F.col("vec_id").isNotNull() & _finite("embedding")).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"), queries.alias("asks")
    )
    lengths = clean.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = clean.where(F.size("v") == lengths.dims).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    asked = materialize(clean.where("asks").select(F.col("vec_id").alias("query_id"), "v"), "queries")
    copies = Window.partitionBy("v").orderBy("vec_id")
    rows = materialize(
        clean.select("vec_id", "v").withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "vectors"
    )
    sample = draw(rows, SAMPLE_ROWS, "vec_id").select("v").toPandas()
    codes = fit(np.stack(sample["v"].to_numpy()), k)
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    indexed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))

    def ask(which: DataFrame, radius: int | None) -> DataFrame:
        # bounded batches of queries, each of which meets every block once
        batches = max(1, -(-which.count() // QUERY_ROWS))
        everywhere = which.withColumn("batch", F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int")).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        )
        held = indexed.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
        found = (
            held.groupBy("block", "batch")
            .cogroup(everywhere.groupBy("block", "batch"))
            .applyInArrow(_probe(codes, k, radius), "query_id long, vec_id long, d2 double")
        )
        by = Window.partitionBy("query_id").orderBy("d2", "vec_id")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    first = materialize(ask(asked, None), "nearest")
    enough = materialize(first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k), "enough")
    short = materialize(asked.join(small(enough.select("query_id")), "query_id", "left_anti"), "short")
    found = first.join(small(enough.select("query_id")), "query_id", "left_semi")
    if short.limit(1).count():
        found = found.unionByName(ask(short, codes.turn.shape[1]))
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", F.sqrt("d2").alias("score"))
