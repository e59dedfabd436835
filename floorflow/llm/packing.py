"""Cost-balanced packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, release, released

CAPACITY = 4096
END = 2
#: Characters of text in a packing group: some millions of tokens, of which
#: less than one sequence is padding.
GROUP_CHARS = 12_000_000
#: What a row counts besides its text's characters, so that groups of empty
#: texts are bounded too.
ROW_CHARS = 32
#: Weight of a piece's squared length over the capacity (attention) against
#: its length (everything else).
ATTENTION = 1.0
#: Letters and other runs that a task keeps, and words in one call of the
#: tokenizer; they bound memory, not results.
CACHE_PARTS, ENCODE_WORDS = 250_000, 5_000
#: Bytes of text in one step of the tokenizing task.
STEP_BYTES = 1_000_000
PLAIN = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-įĲ-ž]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"
SEPARATORS = "[\x1c-\x1f]"
_STATE: dict = {}


def _strings(words: pa.Array) -> list[str]:
    """What ``to_pylist`` gives, without a scalar object for each word."""
    return words.to_numpy(zero_copy_only=False).tolist()


class WordTokens:
    """Token ids of texts by a tokenizers file that drops white space.

    The vocabulary splits at white space, so a text's ids are those of its
    runs of other characters in order.  A run of Latin letters with marks
    behind it has the ids of its lower-cased letters and of the marks.  Arrow
    names the distinct runs of a step, only those are looked up (in a bounded
    cache) or encoded, and the texts' ids are gathered by number.  New letters
    are encoded together in one string, whose tokens with a word end tell them
    apart; any other run is encoded by itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[v for k, v in vocab.items() if k.endswith("</w>")]] = True
        self.width = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.parts: dict[str, bytes] = {"": b""}

    def _single(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.width).tobytes()

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of runs of letters, each of which ends with one word end."""
        out = {}
        for at in range(0, len(words), ENCODE_WORDS):
            some = words[at : at + ENCODE_WORDS]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, self.width)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                out.update((w, self._single(w)) for w in some)
                continue
            raw, stops = ids.tobytes(), (ends * ids.itemsize).tolist()
            out.update((w, raw[a:b]) for w, a, b in zip(some, [0, *stops], stops))
        return out

    def _looked_up(self, words: list[str], letters: bool) -> list[bytes]:
        found = list(map(self.parts.get, words))
        new = [k for k, x in enumerate(found) if x is None]
        if new:
            fresh = [words[k] for k in new]
            ids = self._letters(fresh) if letters else {w: self._single(w) for w in fresh}
            for k, w in zip(new, fresh):
                found[k] = ids[w]
            if len(self.parts) < CACHE_PARTS:
                self.parts.update(ids)
        return found

    def encode_array(self, texts: pa.Array, end: int | None = None) -> pa.Array:
        """Ids of each text (null: none) as bytes, with ``end`` behind them."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        runs = pc.utf8_split_whitespace(texts)
        flat, bounds = runs.flatten(), runs.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        odd = np.flatnonzero(pc.match_substring_regex(texts, SEPARATORS).to_numpy(zero_copy_only=False))
        if len(odd):
            # these characters are no white space to the vocabulary
            split = runs.to_pylist()
            for k in odd.tolist():
                split[k] = [w.decode("utf-8", "replace") for w in texts[k].as_py().encode("utf-8").split()]
            flat = pa.array([w for words in split for w in words], pa.large_string())
            bounds = np.concatenate([[0], np.cumsum([len(words) for words in split])]).astype(np.int64)
        named = flat.dictionary_encode()
        words, number = named.dictionary, named.indices.to_numpy()
        halves = pc.extract_regex(words, PLAIN)
        plain = pc.is_valid(halves).to_numpy(zero_copy_only=False)
        low = pc.utf8_lower(halves.field("letters").filter(pa.array(plain))).dictionary_encode()
        marks = halves.field("marks").filter(pa.array(plain)).dictionary_encode()
        others = _strings(words.filter(pa.array(~plain)))
        n_low, n_marks = len(low.dictionary), len(marks.dictionary)
        ids = self._looked_up(_strings(low.dictionary), True)
        ids += self._looked_up(_strings(marks.dictionary), False)
        ids += self._looked_up(others, False)
        # a distinct word is two pieces, a text its words and the end
        none, held = len(ids), pa.array([*ids, b""], pa.large_binary())
        first, second = np.full(len(words), none), np.full(len(words), none)
        first[plain], second[plain] = low.indices.to_numpy(), n_low + marks.indices.to_numpy()
        first[~plain] = n_low + n_marks + np.arange(len(others))
        close = pa.array([b"" if end is None else np.array([end], self.width).tobytes()], pa.large_binary())
        empty = pa.scalar(b"", pa.large_binary())
        whole = pc.binary_join_element_wise(held.take(pa.array(first)), held.take(pa.array(second)), empty)
        out = pa.concat_arrays([whole, close]).take(pa.array(np.insert(number, bounds[1:], len(words))))
        upto = np.frombuffer(out.buffers()[1], np.int64)  # take starts at 0
        offsets = np.concatenate([[0], upto[bounds[1:] + np.arange(1, len(texts) + 1)]])
        return pa.Array.from_buffers(
            pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.astype(np.int64)), out.buffers()[2] or pa.py_buffer(b"")]
        ).cast(pa.binary())

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()


def tokens_of(path: str) -> WordTokens:
    if path not in _STATE:
        _STATE[path] = WordTokens(path)
    return _STATE[path]


def _tokenize(path: str, end: int):
    def run(batches):
        tool = tokens_of(path)
        for batch in chunks(batches, size=STEP_BYTES):
            ids = tool.encode_array(batch.column(2), end)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["doc_id", "part", "ids"])
        tool.parts = {"": b""}

    return run


def assign(lengths: np.ndarray, capacity: int = CAPACITY, attention: float = ATTENTION):
    """Pieces (document, start, length, sequence, offset) of one group.

    Whole sequences of long documents come first.  What remains is taken in
    descending length: to the sequence of lowest cost that has room for all of
    it, or else cut to fill the sequence with most room.  As many sequences as
    the tokens need are open, so padding is less than one sequence."""
    lengths = np.asarray(lengths, np.int64)
    pieces = []
    sequence = 0
    for doc in np.flatnonzero(lengths >= capacity).tolist():
        for k in range(int(lengths[doc]) // capacity):
            pieces.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
    left = lengths % capacity
    count = -(-int(left.sum()) // capacity)
    cost, room = np.zeros(count), np.full(count, capacity, np.int64)
    order = np.lexsort((np.arange(len(left)), -left))
    for doc in order.tolist():
        rest = int(left[doc])
        start = int(lengths[doc]) - rest
        while rest:
            fit = np.where(room >= rest, cost, np.inf)
            best = int(fit.argmin())
            take = rest
            if not np.isfinite(fit[best]):
                best = int(room.argmax())
                take = int(room[best])
            pieces.append((doc, start, take, sequence + best, capacity - int(room[best])))
            cost[best] += take + attention * take * take / capacity
            room[best] -= take
            start, rest = start + take, rest - take
    return pieces


def _pack(capacity: int, attention: float, width: str):
    def pieces_of(key, table):
        part = int(key[0].as_py())
        ids = [np.frombuffer(x, width) for x in table.column("ids").to_pylist()]
        docs = table.column("doc_id").to_pylist()
        names = np.array([zlib.crc32(x.tobytes()) for x in ids])
        sort = np.lexsort((names, np.array([d if d is not None else -1 for d in docs], np.int64)))
        ids, docs = [ids[k] for k in sort], [docs[k] for k in sort]
        pieces = assign(np.array([len(x) for x in ids]), capacity, attention)
        crc = [zlib.crc32(ids[d][s : s + n].astype("<u4").tobytes()) for d, s, n, _, _ in pieces]
        return pa.table(
            {
                "doc_id": pa.array([docs[p[0]] for p in pieces], pa.int64()),
                "start": pa.array([p[1] for p in pieces], pa.int64()),
                "length": pa.array([p[2] for p in pieces], pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array([len(ids[p[0]]) for p in pieces], pa.int64()),
                "sequence_id": pa.array([(part << 32) + p[3] for p in pieces], pa.int64()),
                "offset": pa.array([p[4] for p in pieces], pa.int64()),
            }
        )

    def run(key, table):
        out = pieces_of(key, table)
        release()
        return out

    return run


SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack(
    docs: DataFrame,
    path: str,
    end: int = END,
    capacity: int = CAPACITY,
    attention: float = ATTENTION,
    group_chars: int = GROUP_CHARS,
) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into sequences.

    ``path`` is a tokenizers file whose vocabulary is split at white space.
    Rows are dealt by a hash of their place in the table, id and text size into
    groups of about ``group_chars`` characters, so no group depends on a source
    or on copies; each group is packed by itself with less than one sequence of
    padding.  ``docs`` should be read from files, whose rows keep their places
    when a task runs again.

    A row per piece.  Null and empty texts are the end token alone; repeated
    rows are packed as often as they come; a null doc_id stays null; an empty
    table gives no rows.  Other columns are not looked at.
    """
    weight = F.coalesce(F.length("text"), F.lit(0)).cast("long") + ROW_CHARS
    chars = docs.agg(F.sum(weight).alias("n")).first().n or 0
    parts = max(1, -(-chars // group_chars))
    width = "<u2" if tokens_of(path).width == np.uint16 else "<u4"
    dealt = docs.select(
        F.col("doc_id").cast("long"),
        F.pmod(F.xxhash64("doc_id", F.length("text"), F.monotonically_increasing_id()), F.lit(parts)).cast("int").alias("part"),
        F.col("text"),
    )
    return (
        dealt.mapInArrow(released(_tokenize(path, end)), "doc_id long, part int, ids binary")
        .groupBy("part")
        .applyInArrow(_pack(capacity, attention, width), SCHEMA)
    )
