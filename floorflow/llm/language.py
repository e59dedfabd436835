"""Language identification: nearest of several clustered centroids a language.

Texts become TF-IDF vectors of hashed character grams; each language has a few
centroids from spherical k-means, and a text gets the language of the centroid
with the largest cosine.  A text that is far from every centroid of its
language is marked rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_list, chunks, crc_mod, free_names, materialize, released, small

ONES, DIMS = 512, 4096
#: Bound of the sample that centroids are fitted on: rows for each language.
SAMPLE_PER_LANGUAGE = 300
CLUSTERS, ROUNDS = 4, 12
#: A text is rejected below this part of its language's 1 % quantile cosine.
REJECT = 0.5
#: Letters below which the distance is held against a text in proportion only.
SHORT = 200
SHARPNESS = 30.0
PIECE = 1 << 20
#: Rows that share one block of gram counts (16 KB a row).
BLOCK = 256
#: Rows expected below the hash bound that a language's sample is taken from.
DRAWN = 2 * SAMPLE_PER_LANGUAGE + 200
_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _TABLE:
        _TABLE.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _TABLE[0]


def _pieces(texts: list[str]):
    """(text number, code points, chars before that only give context)."""
    for k, text in enumerate(texts):
        low = text.lower()
        for at in range(0, max(len(low), 1), PIECE):
            lead = min(2, at)
            yield k, low[at - lead : at + PIECE], lead


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed single letters and letter triples of whole texts
    (everything but letters counts as a word's edge), and letters a text."""
    table = _letters()
    out = np.zeros((len(texts), DIMS), np.float32)
    letters = np.zeros(len(texts), np.int64)
    held, size = [], 0

    def flush():
        if not held:
            return
        first, n = held[0][0], held[-1][0] - held[0][0] + 1
        points = np.concatenate([np.frombuffer(("\0" + p + "\0").encode("utf-32-le", "surrogatepass"), "<u4") for _, p, _ in held])
        lens = np.array([len(p) + 2 for _, p, _ in held])
        doc = np.repeat(np.array([k - first for k, _, _ in held]), lens)
        lead = np.repeat(np.array([x for _, _, x in held]), lens)
        place = np.arange(len(points)) - np.repeat(np.cumsum(lens) - lens, lens)
        is_letter = table[points]
        c = np.where(is_letter, points, 0).astype(np.uint32)
        counted = is_letter & (place > lead)
        ones = doc[counted] * DIMS + (c[counted] & np.uint32(ONES - 1))
        letters[first : first + n] += np.bincount(doc[counted], minlength=n)
        h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(7)
        # a triple belongs to the piece that holds its last character anew
        triple = is_letter[1:-1] & (place[2:] > np.maximum(lead[2:], 1))
        three = doc[1:-1][triple] * DIMS + ONES + (h[triple] % np.uint32(DIMS - ONES)).astype(np.int64)
        got = np.bincount(np.concatenate([ones, three]), minlength=n * DIMS)
        out[first : first + n] += got.reshape(n, DIMS)
        held.clear()

    for k, piece, lead in _pieces(texts):
        if held and (size + len(piece) > PIECE or k - held[0][0] >= 128):
            flush()
            size = 0
        held.append((k, piece, lead))
        size += len(piece)
    flush()
    return out, letters


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts)
    v *= idf.astype(np.float32)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v /= np.where(norm > 0, norm, 1)
    return v


def _blocks(batches):
    """Slices of record batches of at most BLOCK rows and a chunk's bytes."""
    for batch in chunks(batches):
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


@dataclass
class LanguageModel:
    languages: list[str]
    owner: np.ndarray  # language number of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # least cosine of each language


def _document_counts(batches):
    total, n = np.zeros(DIMS, np.int64), 0
    for batch in _blocks(batches):
        counts, _ = gram_counts(as_list(batch, "text"))
        total += (counts > 0).sum(axis=0)
        n += len(counts)
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64())), pa.array([n])], names=["df", "n"])


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    picks = [0]
    for _ in range(1, min(k, len(x))):
        picks.append(int(np.argmin((x @ x[picks].T).max(axis=1))))
    centre = x[picks].copy()
    for _ in range(ROUNDS):
        near = np.argmax(x @ centre.T, axis=1)
        for j in range(len(centre)):
            if (near == j).any():
                mean = x[near == j].mean(axis=0)
                centre[j] = mean / max(np.linalg.norm(mean), 1e-12)
    return centre


def _count_rows(batches):
    for batch in _blocks(batches):
        counts, letters = gram_counts(as_list(batch, "text"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(as_list(batch, "lang")), pa.array(letters), pa.array([c.tobytes() for c in counts], pa.binary())],
            names=["lang", "letters", "counts"],
        )


def fit(docs: DataFrame, training: Column) -> LanguageModel | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) where ``training``
    holds and lang is not null.  Gram weights count every training row;
    centroids are fitted on SAMPLE_PER_LANGUAGE rows a language, those with the
    smallest id hash.  None without rows."""
    rows = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = (
        rows.select("text")
        .mapInArrow(released(_document_counts), "df array<long>, n long")
        .select("n", F.posexplode("df").alias("dim", "df"))
        .groupBy("dim")
        .agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
        .collect()
    )
    if not sums or not sums[0].n:
        return None
    df = np.zeros(DIMS)
    for r in sums:
        df[r.dim] = r.df
    idf = np.log((1 + sums[0].n) / (1 + df)) + 1
    sizes = materialize(rows.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    # only rows of small hashes, some times as many as the sample needs at every size, meet in a language's task
    draw = F.xxhash64("doc_id", F.when(F.isnull("doc_id"), F.xxhash64("text")))
    place = draw / F.lit(2.0**64) + 0.5
    order = Window.partitionBy("lang").orderBy(draw, "doc_id", F.xxhash64("text"))
    sample = (
        rows.select("doc_id", "lang", "text")
        .join(small(sizes), "lang")
        .where(place * F.col("rows") < DRAWN)
        .withColumn("k", F.row_number().over(order))
        .where(F.col("k") <= SAMPLE_PER_LANGUAGE)
        .select("lang", "text")
        .mapInArrow(released(_count_rows), "lang string, letters long, counts binary")
        .where("letters > 0")
        .collect()
    )
    if not sample:
        return None
    x = unit_vectors(np.stack([np.frombuffer(r.counts, np.float32) for r in sample]), idf)
    lang = np.array([r.lang for r in sample])
    languages = sorted(set(lang.tolist()))
    centres, owner, floor = [], [], []
    for k, name in enumerate(languages):
        own = x[lang == name]
        own = own[np.lexsort(own.T[:2])]
        found = _kmeans(own, CLUSTERS)
        centres.append(found)
        owner += [k] * len(found)
        floor.append(REJECT * np.quantile((own @ found.T).max(axis=1), 0.01))
    return LanguageModel(languages, np.array(owner), np.concatenate(centres), idf, np.array(floor))


def _predict(model: LanguageModel | None):
    def run(batches):
        for batch in _blocks(batches):
            texts = [t or "" for t in as_list(batch, "text")]
            n = len(texts)
            names, score, cosine, rejected = ["und"] * n, np.zeros(n), np.zeros(n), [True] * n
            if model is not None:
                counts, letters = gram_counts(texts)
                near = unit_vectors(counts, model.idf) @ model.centroids.T
                best = np.stack([near[:, model.owner == k].max(axis=1) for k in range(len(model.languages))], axis=1)
                top = best.argmax(axis=1)
                odds = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
                share = 1 / odds.sum(axis=1)
                for i in np.flatnonzero(letters > 0).tolist():
                    k = top[i]
                    names[i], score[i], cosine[i] = model.languages[k], min(1.0, share[i]), best[i, k]
                    rejected[i] = bool(best[i, k] < model.floor[k] * min(1.0, letters[i] / SHORT))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names), pa.array(score), pa.array(cosine), pa.array(rejected)],
                names=["key", "tid", "lang_pred", "score", "cosine", "rejected"],
            )

    return run


def _told(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """What ``identify`` tells, with tid, the text's xxhash64."""
    return (
        docs.select(F.col("doc_id").cast("long").alias("key"), F.xxhash64("text").alias("tid"), F.col("text"))
        .mapInArrow(
            released(_predict(model)),
            "key long, tid long, lang_pred string, score double, cosine double, rejected boolean",
        )
        .withColumnRenamed("key", "doc_id")
    )


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), cosine and rejected for each row.

    Null texts, empty texts and texts without a letter are ``und`` with score
    0 and rejected.  Whole texts count, however long; equal texts get equal
    results; of equal cosines the alphabetically first language wins.  Without
    training rows all are ``und``.  Columns but doc_id and text play no part.
    """
    return _told(docs, model).drop("tid")


def drop_rejected(docs: DataFrame, mod: int = 5, out: int = 0) -> DataFrame:
    """``docs`` without the rows whose language is rejected; the columns stay.
    Rows are told by id (null ids too) and text together."""
    model = fit(docs, crc_mod("doc_id", mod) != out)
    gone = materialize(_told(docs, model).where("rejected").select("doc_id", "tid").distinct(), "rejected")
    doc, tid = free_names(docs, "doc", "tid")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(tid))
    return docs.join(small(gone).toDF(doc, tid), same, "left_anti")


def identified(docs: DataFrame, mod: int = 5, out: int = 0) -> DataFrame:
    """Learn from documents whose id's crc32 modulo ``mod`` is not ``out`` and
    predict all; held_out marks the others."""
    model = fit(docs, crc_mod("doc_id", mod) != out)
    return identify(docs, model).select(
        "doc_id", (crc_mod("doc_id", mod) == out).alias("held_out"), "lang_pred", "score", "cosine", "rejected"
    )
