"""Passages that repeat across documents: paragraph MinHash banding.

Two kinds of paragraphs are looked at.  Lines of ``LINE_WORDS`` words or more
go through MinHash bands, a signature check, exact Jaccard over their 5-word
shingle sets, and components.  Because a passage may also stand in the middle
of a line or be made of short lines, every run of ``SPAN_WORDS`` words has a
hash, and of each ``WINDOW`` such runs in a row the least is kept: two copies of
a passage of ``SPAN_WORDS + WINDOW - 1`` words or more keep a run in common,
whatever its words are and wherever it stands.  Equal runs are joined by hash
and extended word by word to the passage's ends.  Shorter passages of
``SPAN_WORDS`` words or more are found if they keep a run in common, are whole
lines, or stand at both documents' starts or ends.  The copy in the document with the smallest id stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_list, as_numpy, binary_text, chunks, discard, free_names, materialize, mix, release, released, small, spread, word_hashes
from .components import components
from .minhash import SHINGLE, Signer, doc_shingles, loose_edges, shingles, tight_edges

#: Nothing shorter than this is a passage, for lines and for runs alike.
LINE_WORDS = SPAN_WORDS = 20
#: Runs of words of which one is kept; a passage's first kept run starts less
#: than so many words behind its start, and likewise at its end.
WINDOW = 16
AROUND = WINDOW - 1
#: Bytes of a word's hash that are kept to tell words in like places apart.
WORD_BYTES = 3
_SHIFTS = np.arange(WORD_BYTES, dtype=np.uint64) * np.uint64(8)
#: Paragraph bands: a pair at Jaccard 0.75 is missed by all with chance 0.0014;
#: of those that meet, the signature check drops 0.0001 more.
BANDS, ROWS = 12, 3
PERCENT = 75
_NEAR = np.concatenate([np.arange(-WINDOW, 0), np.arange(1, WINDOW + 1)])
_POWER = np.uint64(0x9FB21C651E98DF25)
_PLACES = spread(41, 4096)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def run_names(hashes: np.ndarray) -> np.ndarray:
    """The 64-bit hash of the SPAN_WORDS words from each word on (wherever
    there are as many)."""
    with np.errstate(over="ignore"):
        power, run, size, four = _POWER, hashes, 1, hashes
        while size < 16:
            run = run[:-size] + power * run[size:]
            power, size = power * power, 2 * size
            four = run if size == 4 else four
        return mix(run[: len(hashes) - SPAN_WORDS + 1] + power * four[16:])


def cut(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the kept runs of one document and the runs' 64-bit hashes: the
    least of each WINDOW runs (the last of equal ones), the first and the last."""
    if len(hashes) < SPAN_WORDS:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    names = run_names(hashes)
    last = len(names) - 1
    held = np.lib.stride_tricks.sliding_window_view(names[::-1], min(WINDOW, len(names)))
    least = np.unique(last - np.arange(len(held)) - held.argmin(axis=1))
    near = np.clip(least[:, None] + _NEAR, 0, last)
    again = ((names[near] == names[least][:, None]) & (near != least[:, None])).any(axis=1)
    ends = _chain_ends(names, np.unique(names[least[again]])) if again.any() else []
    if again.any():
        least = _thinned(least, names)
    at = np.unique(np.concatenate([[0, last], ends, least]).astype(np.int64))
    return at, names[at]


def cut_all(hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``cut`` gives for each of many documents that lie one behind the
    other in ``hashes``: document number, start in it and hash of each kept
    run.  Documents in which a kept run recurs nearby, or that have fewer runs
    than a window, are cut one by one."""
    runs = size - SPAN_WORDS + 1
    single = (runs > 0) & (runs < WINDOW)
    found = np.empty(0, np.int64)
    if len(hashes) >= SPAN_WORDS + WINDOW - 1:
        names = run_names(hashes)
        # the place of the least of 2, 4, 8, 16 runs from each run on
        at, width = np.arange(len(names), dtype=np.int32), 1
        while width < WINDOW:
            one, two = at[:-width], at[width:]
            at = np.where(names[two] <= names[one], two, one)
            width *= 2
        whole = np.flatnonzero(runs >= WINDOW)
        inside = np.zeros(len(at) + 1, np.int64)
        inside[begin[whole]] += 1
        ends = begin[whole] + runs[whole] - WINDOW + 1
        np.subtract.at(inside, ends, 1)
        within = np.cumsum(inside)[:-1] > 0
        marks = np.zeros(len(names), bool)
        marks[at[within]] = True
        found = np.flatnonzero(marks)
    if len(found):
        doc = np.searchsorted(begin, found, side="right") - 1
        low, high = begin[doc], begin[doc] + runs[doc] - 1
        again = np.zeros(len(found), bool)
        for step in _NEAR.tolist():
            near = np.clip(found + step, low, high)
            again |= (names[near] == names[found]) & (near != found)
        single[doc[again]] = True
        both = np.flatnonzero((runs >= WINDOW) & ~single)
        found = np.unique(np.concatenate([found[~single[doc]], begin[both], begin[both] + runs[both] - 1]))
        doc = np.searchsorted(begin, found, side="right") - 1
        parts = [(doc, found - begin[doc], names[found])]
    else:
        parts = [(found, found, found.astype(np.uint64))]
    for k in np.flatnonzero(single).tolist():
        place, name = cut(hashes[begin[k] : begin[k] + size[k]])
        parts.append((np.full(len(place), k), place, name))
    doc, start, name = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, doc))
    return doc[order], start[order], name[order]


def _chain_ends(names: np.ndarray, values: np.ndarray) -> list[int]:
    """First and last of the equal runs that follow within a window of each
    other, of each value: both copies of such a passage have these in common."""
    out = []
    for v in values:
        at = np.flatnonzero(names == v)
        far = np.flatnonzero(np.diff(at) > WINDOW)
        out += [*at[np.append(0, far + 1)].tolist(), *at[np.append(far, len(at) - 1)].tolist()]
    return out


def _thinned(least: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Of kept runs that are equal (where few words recur), those that every
    window which kept one still holds one of."""
    out = [int(least[0])]
    for p, after in zip(least[1:].tolist(), [*least[2:].tolist(), -1]):
        if names[p] == names[out[-1]] and after >= 0 and names[after] == names[p] and after - out[-1] <= WINDOW:
            continue
        out.append(p)
    return np.array(out)


def _cumulated(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def _listed(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(_cumulated(sizes), values)


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` elements each."""
    ends = _cumulated(sizes * values.itemsize)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(values))])


#: Marks between texts and lines; no UTF-8 text holds these bytes.
_TEXT_END, _LINE_END = b"\xff", b"\xfe"
_BROKEN = bytes.maketrans(b"\xfe\xff", b"\xfd\xfd")


def _split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts one behind the other, the number of words of
    each text, and of each line its text, words and first word (in the text)."""
    whole = b" \xff ".join([*texts, b""])
    if whole.count(_TEXT_END) > len(texts) or _LINE_END in whole:  # broken texts
        whole = b" \xff ".join([*(t.translate(_BROKEN) for t in texts), b""])
    hashes = word_hashes(whole.lower().replace(b"\n", b" \xfe ").split())
    text_mark, line_mark = word_hashes([_TEXT_END, _LINE_END])
    ends_text = hashes == text_mark
    ends_line = ends_text | (hashes == line_mark)
    places = np.flatnonzero(ends_line)
    # words before each mark
    before = places - np.arange(len(places))
    text_of_line = np.cumsum(ends_text[places]) - ends_text[places]
    last = ends_text[places]
    size = np.diff(before[last], prepend=0)
    words = np.diff(before, prepend=0)
    begin = np.cumsum(size) - size
    first = before - words - begin[text_of_line]
    return hashes[~ends_line], size, text_of_line, words, first


def _digested(line_words: int):
    """Of each text, from one pass over it: its kept runs, its words' hashes
    and its lines of ``line_words`` words or more with name, band keys and
    signature."""

    def run(batches):
        signer = Signer(BANDS, ROWS)
        for batch in chunks(batches):
            hashes, size, text, words, first = _split(as_list(batch, "text"))
            begin = np.cumsum(size) - size
            doc, start, names = cut_all(hashes, begin, size)
            long = np.flatnonzero(words >= line_words)
            text, words, first = text[long], words[long], first[long]
            cid, keys, sig = _lines_signed(signer, hashes, begin[text] + first, words)
            n_runs, n_lines = (np.bincount(x, minlength=len(size)) for x in (doc, text))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    batch.column(2),
                    _listed(pa.array(names.view(np.int64)), n_runs),
                    _listed(pa.array(start.astype(np.int32)), n_runs),
                    _packed(_short_names(hashes), size * WORD_BYTES),
                    _listed(pa.array(first.astype(np.int32)), n_lines),
                    _listed(pa.array(words.astype(np.int32)), n_lines),
                    _listed(pa.array(cid), n_lines),
                    _listed(pa.array(keys.ravel()), n_lines * BANDS),
                    _packed(sig, n_lines * sig.shape[1]),
                ],
                names=["doc_id", "tid", "row", "h", "start", "words", "line_start", "line_n", "line_cid", "line_keys", "line_sig"],
            )

    return run


_DIGESTED = (
    "doc_id long, tid long, row long, h array<long>, start array<int>, words binary, line_start array<int>, "
    "line_n array<int>, line_cid array<long>, line_keys array<long>, line_sig binary"
)


def _lines_signed(signer: Signer, hashes: np.ndarray, begin: np.ndarray, words: np.ndarray):
    """Name, band keys and signature of each line, given as the place of its
    first word and its number of words."""
    minima = signer.bands * signer.rows
    if not len(begin):
        return np.empty(0, np.int64), np.empty((0, signer.bands), np.int64), np.empty((0, minima), np.uint8)
    within = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
    own = hashes[np.repeat(begin, words) + within]
    offsets = np.cumsum(words) - words
    with np.errstate(over="ignore"):
        total = np.add.reduceat(own * _PLACES[np.minimum(within, len(_PLACES) - 1)], offsets)
        cid = mix(total + words.astype(np.uint64)).view(np.int64)
    for k in np.flatnonzero(words > len(_PLACES)).tolist():
        cid[k] = line_name(own[offsets[k] : offsets[k] + words[k]])
    every = shingles(own)
    full = np.maximum(words - SHINGLE + 1, 1)  # a line under SHINGLE words is one shingle
    place = np.repeat(offsets, full) + np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    found = every[np.minimum(place, len(every) - 1)]
    short = np.flatnonzero(words < SHINGLE)
    heads = np.cumsum(full) - full
    for k in short.tolist():
        found[heads[k]] = shingles(own[offsets[k] : offsets[k] + words[k]])[0]
    found = signer.minima_of(found, full)
    return cid, signer.keys(found), (found & np.uint32(255)).astype(np.uint8)


def _short_names(hashes: np.ndarray) -> np.ndarray:
    """The high WORD_BYTES bytes of each word's hash, in a row each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES :]


def _around(batches):
    """The words on either side of each wanted run, and how many there are."""
    reach = np.concatenate([np.arange(-AROUND, 0), np.arange(SPAN_WORDS, SPAN_WORDS + AROUND)])
    for batch in chunks(batches, "words"):
        words = as_list(batch, "words")
        wanted = batch.column(batch.schema.get_field_index("wanted"))
        times = wanted.value_lengths().to_numpy()
        wanted = wanted.flatten()
        start = wanted.field("start").to_numpy()
        sizes = np.array([len(w) // WORD_BYTES for w in words])
        pad = bytes(WORD_BYTES * AROUND)
        flat = np.frombuffer(b"".join([pad, *words, pad]), np.uint8).reshape(-1, WORD_BYTES)
        place = np.repeat(AROUND + np.cumsum(sizes) - sizes, times) + start
        data = flat[np.clip(place[:, None] + reach, 0, len(flat) - 1)]
        before = np.minimum(start, AROUND).astype(np.int32)
        after = np.minimum(np.repeat(sizes, times) - start - SPAN_WORDS, AROUND).astype(np.int32)
        ends = np.arange(len(start) + 1, dtype=np.int32) * WORD_BYTES * len(reach)
        around = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(as_numpy(batch, "doc_id"), times)),
                pa.array(np.repeat(as_numpy(batch, "tid"), times)),
                wanted.field("h"),
                wanted.field("start"),
                wanted.field("first"),
                pa.array(before),
                pa.array(after),
                around,
            ],
            names=["doc_id", "tid", "h", "start", "first", "before", "after", "around"],
        )


def _extended(batches):
    """Each run with the words on either side that both copies share."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own, other = (
            np.frombuffer(b"".join(as_list(batch, c)), np.uint8).reshape(-1, 2 * AROUND, WORD_BYTES)
            for c in ("around", "first_around")
        )
        same, k = (own == other).all(axis=2), np.arange(AROUND)
        before = np.minimum(as_numpy(batch, "before"), as_numpy(batch, "first_before"))
        after = np.minimum(as_numpy(batch, "after"), as_numpy(batch, "first_after"))
        left = np.logical_and.accumulate(same[:, :AROUND][:, ::-1] & (k < before[:, None]), axis=1).sum(axis=1)
        right = np.logical_and.accumulate(same[:, AROUND:] & (k < after[:, None]), axis=1).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(as_numpy(batch, "doc_id")),
                pa.array(as_numpy(batch, "tid")),
                pa.array((as_numpy(batch, "start") - left).astype(np.int32)),
                pa.array((SPAN_WORDS + left + right).astype(np.int32)),
                pa.array(as_numpy(batch, "first")),
            ],
            names=["doc_id", "tid", "start", "n", "first"],
        )


def line_name(hashes: np.ndarray) -> int:
    """A signed 64-bit name of a sequence of words."""
    with np.errstate(over="ignore"):
        total = (hashes * _PLACES[: len(hashes)]).sum(dtype=np.uint64) if len(hashes) <= len(_PLACES) else mix(
            hashes + mix(np.arange(len(hashes), dtype=np.uint64))
        ).sum(dtype=np.uint64)
        return int(mix(total + np.uint64(len(hashes))).astype(np.int64))


def _line_sets(batches):
    for batch in chunks(batches, "words"):
        out = []
        for words, wanted in zip(as_list(batch, "words"), as_list(batch, "wanted")):
            held = np.frombuffer(words, np.uint8).reshape(-1, WORD_BYTES).astype(np.uint64)
            hashes = mix((held << _SHIFTS).sum(axis=1, dtype=np.uint64))
            for w in wanted:
                own = doc_shingles(hashes[w["start"] : w["start"] + w["n"]])
                out.append((w["cluster"], w["cid"], own.tobytes()))
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
            names=["cluster", "cid", "shingles"],
        )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long"),
        F.xxhash64("text").alias("tid"),
        F.monotonically_increasing_id().alias("row"),
        binary_text().alias("text"),
    )


def _words_of(cuts: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, tid, row and words of the rows of ``cuts`` that ``wanted`` (a
    written table) names.  A bit a row tells them before anything is shuffled:
    32,768 neighbouring rows have a bitmap of 4 KB."""
    named = wanted.select(F.bitmap_bucket_number("row").alias("bucket"), F.bitmap_bit_position("row").alias("bit"))
    bits = materialize(
        named.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "wanted-bits"
    )
    held = cuts.select("doc_id", "tid", "row", "words", F.bitmap_bucket_number("row").alias("bucket"))
    octet = F.expr("cast(conv(hex(substring(bits, cast(bitmap_bit_position(row) div 8 + 1 as int), 1)), 16, 10) as int)")
    found = F.getbit(octet, F.expr("cast(bitmap_bit_position(row) % 8 as int)")) == 1
    return held.join(small(bits), "bucket").where(found).drop("bucket", "bits")


def _short_hits(cuts: DataFrame) -> DataFrame:
    repeated = materialize(
        cuts.select("doc_id", F.explode("h").alias("h"))
        .groupBy("h")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("h", "first"),
        "repeated",
    )
    # repeated runs and their firsts grow as the input: shuffled at every size
    each = cuts.select("row", F.explode(F.arrays_zip("h", "start")).alias("x")).select("row", "x.*")
    wanted = materialize(
        each.join(repeated, "h").groupBy("row").agg(F.collect_list(F.struct("h", "start", "first")).alias("wanted")),
        "wanted",
    )
    discard(repeated)
    around = materialize(
        _words_of(cuts, wanted)
        .join(wanted, "row")
        .mapInArrow(
            released(_around),
            "doc_id long, tid long, h long, start int, first long, before int, after int, around binary",
        ),
        "around",
    )
    discard(wanted)
    firsts = materialize(
        around.where("doc_id = first")
        .groupBy("h")
        .agg(F.min(F.struct("tid", "start", "before", "after", "around")).alias("x"))
        .select(
            "h", F.col("x.before").alias("first_before"), F.col("x.after").alias("first_after"),
            F.col("x.around").alias("first_around"),
        ),
        "around-firsts",
    )
    hits = materialize(
        around.where("doc_id > first")
        .join(firsts, "h")
        .mapInArrow(released(_extended), "doc_id long, tid long, start int, n int, first long"),
        "short-hits",
    )
    discard(around)
    discard(firsts)
    return hits


def _lines(cuts: DataFrame) -> DataFrame:
    """A row for each line: doc_id, tid, row, start, n and cid."""
    zipped = F.explode(F.arrays_zip("line_start", "line_n", "line_cid")).alias("x")
    return cuts.select("doc_id", "tid", "row", zipped).select(
        "doc_id", "tid", "row", F.col("x.line_start").alias("start"), F.col("x.line_n").alias("n"), F.col("x.line_cid").alias("cid")
    )


def _line_hits(cuts: DataFrame) -> DataFrame:
    entries = cuts.select(F.posexplode("line_keys").alias("i", "g"), "line_cid").select(
        "g", F.expr(f"line_cid[i div {BANDS}]").alias("cid")
    )
    k = BANDS * ROWS
    sigs = cuts.select(F.posexplode("line_cid").alias("i", "cid"), "line_sig").select(
        "cid", F.expr(f"substring(line_sig, i * {k} + 1, {k})").alias("sig")
    )
    clusters = materialize(components(materialize(loose_edges(entries, sigs), "line-loose")), "line-clusters")
    met = materialize(
        _lines(cuts)
        .join(small(clusters.withColumnRenamed("node", "cid")), "cid")
        .groupBy("cid")
        .agg(F.min(F.struct("doc_id", "tid", "start", "n", "row")).alias("x"), F.min("component").alias("cluster")),
        "line-met",
    )
    wanted = materialize(
        met.groupBy("x.row").agg(F.collect_list(F.struct("x.start", "x.n", "cid", "cluster")).alias("wanted")),
        "line-wanted",
    )
    members = (
        _words_of(cuts, wanted)
        .join(small(wanted), "row")
        .select("words", "wanted")
        .mapInArrow(released(_line_sets), "cluster long, cid long, shingles binary")
    )
    joined = components(materialize(tight_edges(members, PERCENT), "line-links")).withColumnRenamed("node", "cid")
    heads = joined.join(met.select("cid", F.col("x.doc_id").alias("first")), "cid")
    alike = heads.join(heads.groupBy("component").agg(F.min("first").alias("head")), "component").select("cid", "head")
    # equal lines have one name, which meets no other in a bucket
    equal = (
        cuts.select("doc_id", F.explode("line_cid").alias("cid"))
        .groupBy("cid")
        .agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last"))
        .where("head < last")
        .select("cid", "head")
    )
    named = materialize(equal.unionByName(alike).groupBy("cid").agg(F.min("head").alias("head")), "line-heads")
    return (
        _lines(cuts)
        .join(small(named), "cid")
        .where("doc_id > head")
        .select("doc_id", "tid", "start", "n", F.col("head").alias("first"))
    )


def repeated_spans(docs: DataFrame, line_words: int = LINE_WORDS) -> DataFrame:
    """Word spans of ``docs`` (doc_id, text) that repeat an earlier document.

    doc_id, tid (xxhash64 of the text), start (number of the span's first
    word), n (words) and first (smallest id of the documents that it repeats).
    Spans of one text do not overlap.  Null ids or texts and wordless texts
    give no spans; repeats within one document and between rows of one id are
    left alone; of equal documents the smallest id stays whole.  Repeated rows
    are one document; texts of any length are read whole.  Other columns are
    not looked at, and an empty table gives no spans.

    ``line_words``: lines of fewer words are no paragraphs of their own (they
    take part in runs of words).  A word changed well inside a line under 39
    words leaves its 5-word shingles below a Jaccard of 0.75; one near an end
    does not, and such lines are found.
    """
    cuts = materialize(_keyed(docs).mapInArrow(released(_digested(line_words)), _DIGESTED), "cuts")
    spans = materialize(_short_hits(cuts).unionByName(_line_hits(cuts)), "spans")
    spans = spans.repartition("doc_id", "tid").distinct()
    by = Window.partitionBy("doc_id", "tid").orderBy("start", "n", "first")
    reach = F.max(F.col("start") + F.col("n")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return (
        spans.withColumn("fresh", F.when(reach >= F.col("start"), 0).otherwise(1))
        .withColumn("run", F.sum("fresh").over(by))
        .groupBy("doc_id", "tid", "run")
        .agg(
            F.min("start").alias("start"),
            (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("n"),
            F.min("first").alias("first"),
        )
        .drop("run")
    )


def _without(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Each text without its spans."""

    def one(t: str, found) -> str:
        raw = t.encode()
        words = [m.span() for m in _WORD.finditer(raw)]
        out, at = [], 0
        for s in sorted(found, key=lambda x: x["start"]):
            out.append(raw[at : words[s["start"]][0]])
            at = words[s["start"] + s["n"] - 1][1]
        out.append(raw[at:])
        return b"".join(out).decode()

    for text, spans in columns:
        yield pa.array([one(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist())], text.type)
    release()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the repeated spans; n_chars (where there is one)
    follows, the columns stay, and texts of which no word is left by that go.

    Rows without an id or a text, and texts without words, stay as they are.
    Rows of one id are told apart by their texts; repeated rows are cut alike.
    """
    spans = materialize(
        repeated_spans(docs)
        .groupBy("doc_id", "tid")
        .agg(F.collect_list(F.struct(F.col("start").alias("start"), F.col("n").alias("n"))).alias("spans")),
        "spans-by-text",
    )
    doc, tid, own = free_names(docs, "span_doc", "span_tid", "spans")
    marked = docs.join(
        small(spans).toDF(doc, tid, own),
        (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(tid)),
        "left",
    )
    kept = marked.where(F.col(own).isNull()).select(*docs.columns)
    # a deterministic function would be run again by the filter below, in a second Python worker of each task
    without = F.arrow_udf(_without, "string").asNondeterministic()
    cut_rows = marked.where(F.col(own).isNotNull()).withColumn("text", without("text", own))
    if "n_chars" in docs.columns:
        cut_rows = cut_rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.unionByName(cut_rows.where(F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select(*docs.columns))
