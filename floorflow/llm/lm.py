"""Language-model scores: a log-bilinear model trained by noise contrast.

Every word belongs to a class: each of the HEAD most frequent words is one,
and all others share TAILS classes by their last letters.  The log-bilinear
model gives P(class | two preceding classes), normalised by matrix products
over all classes; inside a tail class a word has (count + 1) over the class's
sum of these and one for unseen words.  Counts, classes' sums, the base score and
the counts of (class, two preceding classes) that the matrices are fitted on
cover every training document; the classes bound the latter's number.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_text, chunks, crc_mod, materialize, released

HEAD, TAILS = 320, 64
CLASSES = HEAD + TAILS
START = CLASSES
#: Words whose counts go to every task; the counts of the rest are joined.
KNOWN_ROWS = 100_000
DIMS, NOISE, BATCH, EPOCHS, RATE = 24, 128, 256, 6, 0.2
#: Parts in which the counts of class triples come to the driver.
PARTS = 16
#: Rows of words, and tokens of triples, that a task adds up at once.
HELD_WORDS, HELD_TRIPLES = 1_000_000, 1 << 21
#: Bytes of texts that a task splits into words at once.
SPLIT_BYTES = 2 << 20
#: Stripped from a word's end before its last letters are taken.
MARKS = ".,;:!?|$%&*#"


def tail_class(word: bytes) -> int:
    return HEAD + zlib.crc32(word.rstrip(MARKS.encode())[-2:]) % TAILS


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


@dataclass
class Tokens:
    sizes: np.ndarray  # tokens of each text
    word: np.ndarray  # each token's place among the distinct words
    hash: np.ndarray  # of each distinct word
    tail: np.ndarray  # its tail class

    @classmethod
    def of(cls, texts: pa.Array) -> Tokens:
        """The words of binary texts, each text's followed by the end token,
        the empty word.  What is done for a word is done once for all texts."""
        kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
        text = pc.ascii_trim_whitespace(pc.ascii_lower(texts.view(kind)))
        # a space at the end leaves an empty word behind it, as an empty text is one
        none, space = pa.scalar("", kind), pa.scalar(" ", kind)
        lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(text, none), none, pc.binary_join_element_wise(text, space, none)))
        coded = pc.dictionary_encode(pc.list_flatten(lists))
        words = coded.dictionary.view(texts.type)
        ends = pc.binary_slice(pc.ascii_rtrim(coded.dictionary, MARKS).view(texts.type), -2, None).dictionary_encode()
        return cls(
            pc.list_value_length(lists).to_numpy().astype(np.int64),
            coded.indices.to_numpy(),
            np.fromiter(map(word_hash, words.to_numpy(zero_copy_only=False)), np.uint64, len(words)),
            np.array(list(map(tail_class, ends.dictionary.to_pylist())), np.int64)[ends.indices.to_numpy()],
        )

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def _tokens(batches):
    """Slices of batches and their texts' tokens."""
    for batch in chunks(batches, size=SPLIT_BYTES):
        yield batch, Tokens.of(batch.column(batch.schema.get_field_index("text")))


def _count(batches):
    def table(found: list[tuple]) -> pa.RecordBatch:
        hashes, tails, n = map(np.concatenate, zip(*found))
        hashes, first, own = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.bincount(own, n, len(hashes))
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(tails[first].astype(np.int32)), pa.array(n.astype(np.int64))],
            names=["h", "tail", "n"],
        )

    found: list[tuple] = []
    for _, t in _tokens(batches):
        found.append((t.hash, t.tail, np.bincount(t.word, minlength=len(t.hash))))
        if sum(len(f[0]) for f in found) > HELD_WORDS:
            yield table(found)
            found = []
    if found:
        yield table(found)


@dataclass
class Model:
    tokens: int  # N
    words: int  # V
    known: np.ndarray  # sorted hashes
    count: np.ndarray  # their counts
    head: np.ndarray  # their class, or -1
    log_tail: np.ndarray  # log10 of each class's sum (0 for head classes)
    context: np.ndarray  # 2 x (CLASSES + 1) x DIMS
    target: np.ndarray  # CLASSES x DIMS
    bias: np.ndarray
    log_z: np.ndarray  # (CLASSES + 1)^2, natural

    def look_up(self, hashes: np.ndarray, tails: np.ndarray):
        """(position among the known or -1, class) of each token."""
        if not len(self.known):
            return np.full(len(hashes), -1), tails
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        at = np.where(self.known[at] == hashes, at, -1)
        head = np.where(at >= 0, self.head[at], -1)
        return at, np.where(head >= 0, head, tails)

    @cached_property
    def products(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each of the two context classes with each class: product of
        their vectors, the first with the bias; what a token adds up."""
        first = self.context[0] @ self.target.T + self.bias
        return first.ravel(), (self.context[1] @ self.target.T).ravel()

    def class_log10(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised log10 P(target | last class, class before it)."""
        first, second = self.products
        s = first[one * CLASSES + target] + second[two * CLASSES + target]
        return (s - self.log_z[one * (CLASSES + 1) + two]) / np.log(10)


def log_normalisers(context: np.ndarray, target: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """log of the sum over classes, for every pair of context classes."""
    out = np.empty((CLASSES + 1, CLASSES + 1))
    for one in range(CLASSES + 1):
        s = (context[0, one] + context[1]) @ target.T + bias
        top = s.max(axis=1)
        out[one] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
    return out.ravel()


def triples(sequences: list[np.ndarray]) -> np.ndarray:
    """(last class, class before it, class) of each token, as one number."""
    out = []
    for s in sequences:
        padded = np.concatenate([[START, START], s]).astype(np.int64)
        out.append((padded[1:-1] * (CLASSES + 1) + padded[:-2]) * CLASSES + padded[2:])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def train(sequences: list[np.ndarray], share: np.ndarray, seed: int = 4):
    """Matrices fitted on class sequences."""
    return train_counts(*np.unique(triples(sequences), return_counts=True), share, seed)


def train_counts(key: np.ndarray, times: np.ndarray, share: np.ndarray, seed: int = 4):
    """Matrices by noise-contrastive estimation: every class triple with its
    count, against NOISE expected draws from the class frequencies ``share``.
    ``key`` ascends; a batch is BATCH pairs of context classes."""
    rng = np.random.default_rng(seed)
    context = rng.normal(0, 0.05, (2, CLASSES + 1, DIMS))
    target = rng.normal(0, 0.05, (CLASSES, DIMS))
    bias = np.log(share)
    if not len(key):
        return context, target, bias
    begin = np.searchsorted(key, (np.arange((CLASSES + 1) ** 2 + 1) * CLASSES).astype(key.dtype))
    pairs = np.flatnonzero(np.diff(begin))
    typical = times.sum(dtype=np.float64) / len(pairs)
    log_noise = np.log(NOISE * share)
    sums = [np.full(a.shape, 1e-8) for a in (context, target, bias)]
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch)
        order = rng.permutation(pairs)
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            c1, c2 = pick // (CLASSES + 1), pick % (CLASSES + 1)
            n = np.zeros((len(pick), CLASSES))
            for row, k in enumerate(pick):
                own = slice(begin[k], begin[k + 1])
                n[row, key[own] % CLASSES] = times[own]
            h = context[0, c1] + context[1, c2]
            data = 1 / (1 + np.exp(-np.clip(h @ target.T + bias - log_noise, -30, 30)))  # P(data)
            g = n * (1 - data) - n.sum(axis=1, keepdims=True) * NOISE * share * data
            g /= len(pick) * typical
            gh = g @ target
            g_context = np.zeros_like(context)
            np.add.at(g_context[0], c1, gh)
            np.add.at(g_context[1], c2, gh)
            for a, d, s in zip((context, target, bias), (g_context, g.T @ h, g.sum(axis=0)), sums):
                s += d * d
                a += rate * d / np.sqrt(s)
    return context, target, bias


def _contexts(cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last class and the one before it of each token of texts that begin
    at ``starts``, which have a token at least."""
    one, two = np.empty_like(cls), np.empty_like(cls)
    one[1:], two[2:] = cls[:-1], cls[:-2]
    one[starts] = two[starts] = START
    second = starts + 1
    two[second[second < np.append(starts[1:], len(cls))]] = START
    return one, two


def _triple_counts(model: Model):
    def table(found: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    def run(batches):
        found: list[np.ndarray] = []
        for _, t in _tokens(batches):
            cls = model.look_up(t.hash, t.tail)[1][t.word]
            one, two = _contexts(cls, t.starts)
            found.append(((one * (CLASSES + 1) + two) * CLASSES + cls).astype(np.int32))
            if sum(map(len, found)) >= HELD_TRIPLES:
                yield table(found)
                found = []
        if found:
            yield table(found)

    return run


def _most_frequent(counts: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of the most frequent words: those above a count, and of
    the next lower counts (a 32nd part of a doubling) those of the least hash.
    Which of them are among these changes no score; the rest is joined."""
    step = F.floor(F.log2("n") * 32).cast("int")
    held, above = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), 0
    for r in sorted(held, key=lambda r: -r.step):
        if above + r.n > rows:
            place = F.col("h") / F.lit(2.0**64) + 0.5
            return counts.where((step > r.step) | ((step == r.step) & (place * r.n < rows - above)))
        above += r.n
    return counts


def fit(docs: DataFrame, training: Column) -> tuple[Model, DataFrame]:
    """The model, and the table (h, n) of all training words' counts."""
    rows = docs.where(training).select(F.col("doc_id").cast("long"), binary_text().alias("text"))
    counts = materialize(
        rows.select("text")
        .mapInArrow(released(_count), "h long, tail int, n long")
        .groupBy("h")
        .agg(F.sum("n").alias("n"), F.min("tail").alias("tail")),
        "word-counts",
    )
    top = _most_frequent(counts, KNOWN_ROWS).toPandas().sort_values(["n", "h"], ascending=[False, True], ignore_index=True)
    head = {int(h): k for k, h in enumerate(top["h"][:HEAD])}
    whole = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    # of each class: tokens, words (a tail class loses those in the head)
    mass, words = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in whole:
        mass[r.tail], words[r.tail] = r.n, r.v
    for k, (n, tail) in enumerate(zip(top["n"][:HEAD], top["tail"][:HEAD])):
        mass[tail] -= n
        words[tail] -= 1
        mass[k], words[k] = n, 1
    log_tail = np.zeros(CLASSES)
    log_tail[HEAD:] = np.log10(mass[HEAD:] + words[HEAD:] + 1)
    share = (mass + 1) / (mass + 1).sum()
    order = np.argsort(top["h"].to_numpy().view(np.uint64)) if len(top) else np.empty(0, int)
    known = top["h"].to_numpy().astype(np.int64).view(np.uint64)[order]
    model = Model(
        tokens=int(sum(r.n for r in whole)),
        words=int(sum(r.v for r in whole)),
        known=known,
        count=top["n"].to_numpy().astype(np.int64)[order],
        head=np.array([head.get(int(h), -1) for h in known.view(np.int64)], np.int64),
        log_tail=log_tail,
        context=np.zeros((2, CLASSES + 1, DIMS)),
        target=np.zeros((CLASSES, DIMS)),
        bias=np.log(share),
        log_z=np.zeros(0),
    )
    seen = materialize(
        rows.select("text")
        .mapInArrow(released(_triple_counts(model)), "key long, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("n")),
        "lm-triples",
    )
    step = -(-((CLASSES + 1) ** 2) // PARTS) * CLASSES
    total = seen.count()
    key, times, at = np.empty(total, np.int32), np.empty(total, np.float32), 0
    for k in range(PARTS):
        part = seen.where(F.col("key").between(k * step, (k + 1) * step - 1)).select(
            F.col("key").cast("int"), F.col("n").cast("float")
        ).toArrow()
        own = part.column("key").to_numpy()
        order = np.argsort(own)
        key[at : at + len(own)] = own[order]
        times[at : at + len(own)] = part.column("n").to_numpy()[order]
        at += len(own)
    model.context, model.target, model.bias = train_counts(key, times, share)
    model.log_z = log_normalisers(model.context, model.target, model.bias)
    return model, counts


def _score(model: Model):
    def run(batches):
        log_count = np.log10(np.append(model.count, 0) + 1.0)  # the last: of words not among the known
        for batch, t in _tokens(batches):
            at, classes = model.look_up(t.hash, t.tail)
            value, starts, cls = log_count[at], t.starts, classes[t.word]
            inside = np.where(classes >= HEAD, value - model.log_tail[classes], 0.0)
            token = model.class_log10(*_contexts(cls, starts), cls) + inside[t.word]
            known = (at >= 0)[t.word]
            # of each text and word beyond the known: a row
            text = np.repeat(np.arange(len(starts)), t.sizes)[~known]
            pair, times = np.unique(text * len(at) + t.word[~known], return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(len(starts) + 1) * len(at)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(t.sizes),
                    pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(value[t.word], starts)),
                    pa.array(np.add.reduceat(token, starts)),
                    pa.ListArray.from_arrays(ends, pa.array(t.hash.view(np.int64)[pair % len(at)])),
                    pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64))),
                ],
                names=["doc_id", "n_tokens", "known0", "base0", "score0", "h", "times"],
            )

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every
    whole text; null texts are empty (the end token alone), repeated rows count
    as rows, a null doc_id stays, and other columns are not looked at.

    Words beyond the KNOWN_ROWS most frequent are joined with their counts, a
    row for each distinct one of a document."""
    part = materialize(
        docs.select(F.col("doc_id").cast("long"), binary_text().alias("text"))
        .mapInArrow(
            released(_score(model)),
            "doc_id long, n_tokens long, known0 long, base0 double, score0 double, h array<long>, times array<long>",
        )
        .withColumn("row", F.monotonically_increasing_id()),
        "lm-parts",
    )
    rare = part.where(F.size("h") > 0).select("row", F.explode(F.arrays_zip("h", "times")).alias("x")).select(
        "row", "x.h", "x.times"
    )
    found = (
        rare.join(counts.select("h", "n"), "h")
        .groupBy("row")
        .agg(F.sum("times").alias("known1"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("log1"))
    )
    extra = F.coalesce("log1", F.lit(0.0))
    return part.join(found, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("known0") + F.coalesce("known1", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base0") + extra - F.col("n_tokens") * float(np.log10(model.tokens + model.words + 1))).alias("base_score"),
        (F.col("score0") + extra).alias("score"),
    )


def scored(docs: DataFrame, mod: int = 7, out: int = 2) -> DataFrame:
    """Learn from documents whose id's crc32 modulo ``mod`` is not ``out``;
    score all of them."""
    model, counts = fit(docs, crc_mod("doc_id", mod) != out)
    return score(docs, model, counts).select(
        "doc_id", (crc_mod("doc_id", mod) == out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
