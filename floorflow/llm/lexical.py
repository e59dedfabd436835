"""Ranked lexical search over a tiered index.

The index holds, for each document, its items' terms and their impacts (what a
posting adds to a score before the term's weight).  A tier is cut per term: the
postings of highest impact, some share of all documents, so that a term's
residual, the most that a posting below the cut can have, is known.  Items are
scored on the first tier; those of which the best ten are proven there (no
unseen document and no partial score can still reach the tenth) are done, the
others fall through to the next tier, the last of which is the whole index.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_list, as_numpy, binary_text, chunks, discard, materialize, released, small

#: Documents returned for an item.
TOP = 10
#: Shares of all documents that a term has in the upper tiers, at most.
SHARES = (1 / 64, 1 / 8)
#: Impacts are below a million; cuts lie on multiples of this.
STEP = 8192
#: Bytes of item terms that one index is built for; more items take turns.
INDEX_BYTES = 16 << 20
#: Cells (terms times items) of the weights that a task holds.
CELLS = 4_000_000
#: Products that a task has at once.
PRODUCTS = 2_000_000
#: Stands for a null id, which sorts behind all others.
NO_ID = 2**63 - 1

#: Letters and digits of ASCII (A-Z to lower case) and all other bytes stay.
FOLD = bytes(b if b >= 0x80 else ord(chr(b).lower()) if chr(b).isalnum() else 0x20 for b in range(256))


def _item_terms(batches):
    for batch in chunks(batches):
        found = [sorted(set(t.translate(FOLD).split())) for t in as_list(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its terms, once each; rows of one id are one item."""
    rows = items.select(F.col("item_id").alias("item_id"), binary_text().alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    terms = rows.mapInArrow(released(_item_terms), f"item_id {kind}, terms array<binary>")
    return terms.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where("size(terms) > 0")


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values))


def _index(vocabulary: dict[bytes, int]):
    """doc, n (all terms), tids and tfs (terms of the vocabulary) of each text."""
    size = len(vocabulary)

    def task(batches):
        for batch in chunks(batches):
            n, keys = [], []
            for row, text in enumerate(as_list(batch, "text")):
                words = text.translate(FOLD).split()
                n.append(len(words))
                ids = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
                keys.append(ids[ids >= 0] + row * size)
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            counts = np.bincount(key // size, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), _lists((key % size).astype(np.int32), counts), _lists(tf.astype(np.int32), counts)],
                names=["doc", "n", "tids", "tfs"],
            )

    return released(task)


def _flat(batch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).flatten().to_numpy()


def _counts(batch) -> np.ndarray:
    return np.diff(batch.column(batch.schema.get_field_index("tids")).offsets.to_numpy())


def _frequencies(size: int):
    def task(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch, "tids"), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["tid", "df"])

    return released(task)


class _Impact:
    """Impacts of the postings of an index batch."""

    def __init__(self, docs: int, terms: int):
        self.docs, self.terms = docs, terms

    def __call__(self, batch) -> np.ndarray:
        m = 10 + 90 * as_numpy(batch, "n") * self.docs // self.terms
        tf = _flat(batch, "tfs").astype(np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, _counts(batch)))


def _levels(impact: _Impact):
    """How many postings of a term have an impact in each step."""
    wide = 1_000_000 // STEP + 1

    def task(batches):
        key, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            new, count = np.unique(_flat(batch, "tids") * np.int64(wide) + impact(batch) // STEP, return_counts=True)
            key, where = np.unique(np.concatenate([key, new]), return_inverse=True)
            n = np.bincount(where, np.concatenate([n, count]), len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key // wide), pa.array(key % wide), pa.array(n)], names=["tid", "step", "n"])

    return released(task)


def _tiers(impact: _Impact, cuts: np.ndarray):
    """For each tier and document its postings at or above the cuts."""

    def task(batches):
        for batch in batches:
            tids, value, counts = _flat(batch, "tids"), impact(batch), _counts(batch)
            row = np.repeat(np.arange(batch.num_rows), counts)
            for tier, cut in enumerate(cuts):
                in_it = value >= cut[tids]
                held = np.bincount(row[in_it], minlength=batch.num_rows)
                some = np.flatnonzero(held)
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), tier, np.int32)), batch.column(0).take(some), batch.column(1).take(some),
                         _lists(tids[in_it], held[some]), _lists(value[in_it], held[some])],
                        names=["tier", "rid", "doc", "tids", "impacts"],
                    )

    return released(task)


class _Items:
    """Some items as a table of weights, terms by items."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray):
        used = np.unique(np.concatenate(terms))
        self.place = np.full(len(weight), -1, np.int32)
        self.place[used] = np.arange(len(used))
        self.table = np.zeros((len(used), len(terms)), np.int64)
        for k, t in enumerate(terms):
            self.table[self.place[t], k] = weight[t]

    def sums(self, batch, value: np.ndarray):
        """(first row, sums by row and item) for slices of a batch."""
        tids, counts = _flat(batch, "tids"), _counts(batch)
        row, place = np.repeat(np.arange(batch.num_rows), counts), self.place[tids]
        row, value, place = row[place >= 0], value[place >= 0], place[place >= 0]
        first = np.flatnonzero(np.diff(row, prepend=-1))
        ends = np.append(first[1:], len(row))
        most = max(1, PRODUCTS // self.table.shape[1])
        at = 0
        while at < len(first):
            # whole documents, as many as the bound allows and one at least
            end = max(at + 1, int(np.searchsorted(ends, first[at] + most, "right")))
            stop = ends[end - 1]
            total = None
            for low in range(first[at], stop, most):  # a document longer than the bound goes in parts
                part = slice(low, min(low + most, stop))
                products = self.table[place[part]]
                products *= value[part, None]
                if stop - first[at] <= most:
                    total = np.add.reduceat(products, first[at:end] - first[at], axis=0)
                else:
                    total = products.sum(axis=0, keepdims=True) + (0 if total is None else total)
            yield row[first[at:end]], total
            at = end


def _best(items: _Items, floor: np.ndarray, top: int, impact: _Impact | None = None):
    """The ``top`` rows of this task for each item that reach the floor;
    equal sums by id, then by row."""

    def task(batches):
        least = floor.copy()
        held = [np.zeros(0, np.int64) for _ in range(4)]
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, doc = as_numpy(batch, "rid"), as_numpy(batch, "doc")
            for rows, sums in items.sums(batch, impact(batch) if impact else _flat(batch, "impacts")):
                at, item = np.nonzero(sums >= least)
                if not len(at):
                    continue
                new = (item, sums[at, item], doc[rows[at]], rid[rows[at]])
                item, score, docs, rids = (np.concatenate(p) for p in zip(held, new))
                order = np.lexsort((rids, docs, -score, item))
                item, score, docs, rids = (x[order] for x in (item, score, docs, rids))
                start = np.flatnonzero(np.diff(item, prepend=-1))
                place = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
                last = place == top - 1
                least[item[last]] = np.maximum(least[item[last]], score[last])
                held = [x[place < top] for x in (item, score, docs, rids)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["item", "score", "doc", "rid"])

    return released(task)


def _open(items: _Items, residual: np.ndarray, rest: np.ndarray, last: np.ndarray):
    """Rows whose partial sum, with a residual for each term that the tier does
    not show, can still reach the last place."""

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rid = as_numpy(batch, "rid")
            for rows, sums in items.sums(batch, _flat(batch, "impacts") - residual[_flat(batch, "tids")]):
                at, item = np.nonzero(sums + rest >= last)
                yield pa.RecordBatch.from_arrays([pa.array(rid[rows[at]]), pa.array(item)], names=["rid", "item"])

    return released(task)


def _exact(items: _Items, impact: _Impact):
    """Whole scores of the rows for the items that they are open for."""

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rid, doc = as_numpy(batch, "rid"), as_numpy(batch, "doc")
            wanted = np.zeros((batch.num_rows, items.table.shape[1]), bool)
            column = batch.column(batch.schema.get_field_index("items"))
            wanted[np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy())), column.flatten().to_numpy()] = True
            for rows, sums in items.sums(batch, impact(batch)):
                at, item = np.nonzero(wanted[rows] & (sums > 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item), pa.array(sums[at, item]), pa.array(doc[rows[at]]), pa.array(rid[rows[at]])], names=["item", "score", "doc", "rid"]
                )

    return released(task)


FOUND = "item long, score long, doc long, rid long"


def _ranked(found: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc", "rid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top)


class Index:
    """The tiered index of ``docs`` for the terms of some items."""

    def __init__(self, docs: DataFrame, vocabulary: dict[bytes, int], shares=SHARES):
        size = len(vocabulary)
        rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), binary_text().alias("text"))
        rows = rows.mapInArrow(_index(vocabulary), "doc long, n long, tids array<int>, tfs array<int>").where("n > 0")
        self.rows = materialize(rows.select(F.monotonically_increasing_id().alias("rid"), "doc", "n", "tids", "tfs"), "lexical-index")
        whole = self.rows.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        self.docs = whole.docs
        if not self.docs:
            return
        self.impact = _Impact(whole.docs, whole.terms)
        # one row for each term of the items: bounded like the vocabulary
        found = self.rows.select("tids").mapInArrow(_frequencies(size), "tid long, df long").groupBy("tid").agg(F.sum("df").alias("df")).collect()
        df = np.zeros(size, np.int64)
        for r in found:
            df[r.tid] = r.df
        self.weight = np.array([math.floor(1000 * math.log((2 * whole.docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        down = Window.partitionBy("tid").orderBy(F.desc("step"))
        steps = (
            self.rows.select("n", "tids", "tfs").mapInArrow(_levels(self.impact), "tid long, step long, n long")
            .groupBy("tid", "step").agg(F.sum("n").alias("n")).withColumn("above", F.sum("n").over(down))
        )
        depth = [max(1, int(s * whole.docs)) for s in shares]
        cuts = [F.min(F.when(F.col("above") <= d, F.col("step") * STEP)).alias(f"c{k}") for k, d in enumerate(depth)]
        lows = [F.max(F.when(F.col("above") > d, F.col("step") * STEP + STEP - 1)).alias(f"r{k}") for k, d in enumerate(depth)]
        #: by tier and term: the least impact shown, and the most that is not
        self.cuts, self.residual = np.full((len(depth), size), 1 << 30, np.int64), np.zeros((len(depth), size), np.int64)
        for r in steps.groupBy("tid").agg(*cuts, *lows).collect():
            for k in range(len(depth)):
                self.residual[k, r.tid] = r[f"r{k}"] or 0
                if r[f"c{k}"] is not None:
                    self.cuts[k, r.tid] = r[f"c{k}"]
        tiers = self.rows.mapInArrow(_tiers(self.impact, self.cuts), "tier int, rid long, doc long, tids array<int>, impacts array<long>")
        self.tiers = materialize(tiers, "lexical-tiers", "tier")

    def search(self, terms: list[np.ndarray], top: int = TOP) -> tuple[list[DataFrame], list[int]]:
        """Tables of item (its place in ``terms``), score, doc, rid and rank,
        and how many items each tier was asked for."""
        out, asked = [], []
        left, floor = np.arange(len(terms)), np.ones(len(terms), np.int64)
        for tier in range(len(self.cuts)):
            asked.append(len(left))
            items = _Items([terms[k] for k in left], self.weight)
            shown = self.tiers.where(F.col("tier") == tier).select("rid", "doc", "tids", "impacts")
            lasts = _ranked(shown.mapInArrow(_best(items, floor[left], top), FOUND), top).where(F.col("rank") == top).select("item", "score").collect()
            last = np.zeros(len(left), np.int64)
            for r in lasts:
                last[r.item] = r.score
            floor[left] = np.maximum(floor[left], last)
            rest = np.array([int((self.weight[terms[k]] * self.residual[tier][terms[k]]).sum()) for k in left], np.int64)
            # no document that the tier does not show can reach the last place
            proven = rest < np.maximum(last, 1)
            if proven.any():
                sure = left[proven]
                items = _Items([terms[k] for k in sure], self.weight)
                cand = shown.mapInArrow(_open(items, self.residual[tier], rest[proven], floor[sure]), "rid long, item long")
                cand = materialize(cand.groupBy("rid").agg(F.collect_list("item").alias("items")), "lexical-open")
                whole = self.rows.join(small(cand), "rid").select("rid", "doc", "n", "tids", "tfs", "items")
                out.append(self._named(_ranked(whole.mapInArrow(_exact(items, self.impact), FOUND), top), sure))
                left = left[~proven]
            if not len(left):
                break
        else:
            asked.append(len(left))
            items = _Items([terms[k] for k in left], self.weight)
            found = self.rows.mapInArrow(_best(items, floor[left], top, self.impact), FOUND)
            out.append(self._named(_ranked(found, top), left))
        return out, asked

    def _named(self, found: DataFrame, places: np.ndarray) -> DataFrame:
        named = F.get(F.lit(places.tolist()), F.col("item").cast("int"))
        return materialize(found.withColumn("item", named.cast("long")), "lexical-found")


def _blocks(terms: list[np.ndarray]):
    """Items in turns of at most CELLS weights (one item at least)."""
    block, used = [], set()
    for k, t in enumerate(terms):
        both = used | set(t.tolist())
        if block and len(both) * (len(block) + 1) > CELLS:
            yield block
            block, both = [], set(t.tolist())
        block, used = [*block, k], both
    if block:
        yield block


def search(items: DataFrame, docs: DataFrame, top: int = TOP, shares=SHARES) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every item.

    Null and termless texts match nothing; of an item they give no rows.  Rows
    of one item_id, null included, are one item with the terms of all; a
    repeated document ranks once for each of its rows.  Equal scores go by
    doc_id, null last.  Very long texts are read whole; empty tables give no
    rows; other columns are not looked at.

    Items go through one index in turns of bounded weights, and as many
    indexes are built as INDEX_BYTES of their terms need.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    each = F.aggregate("terms", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x) + 33)
    wanted = materialize(item_terms(items).withColumn("bytes", each), "lexical-items")
    turns = -(-(wanted.agg(F.sum("bytes").alias("n")).first().n or 0) // INDEX_BYTES)
    out = []
    for turn in range(turns):
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).select("item_id", "terms").collect()
        if not own:
            continue
        vocabulary = {w: k for k, w in enumerate(sorted({bytes(t) for r in own for t in r.terms}))}
        terms = [np.array([vocabulary[bytes(t)] for t in r.terms], np.int64) for r in own]
        index = Index(docs, vocabulary, shares)
        if not index.docs:
            break
        for block in _blocks(terms):
            found, _ = index.search([terms[k] for k in block], top)
            names = spark.createDataFrame([(i, own[k].item_id) for i, k in enumerate(block)], f"item long, item_id {kind}")
            for f in found:
                doc = F.when(F.col("doc") != NO_ID, F.col("doc"))
                out.append(f.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), doc.alias("doc_id"), "score"))
        discard(index.rows)
        discard(index.tiers)
    discard(wanted)
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    whole = out[0]
    for f in out[1:]:
        whole = whole.unionByName(f)
    return whole


def oracle_sql() -> str:
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = f"unnest(regexp_extract_all({fold}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
WITH q AS (SELECT DISTINCT item_id, {terms} AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
t AS (SELECT rid, doc_id, {terms} AS term FROM d),
docs AS (SELECT rid, doc_id, count(*) AS n FROM t GROUP BY ALL),
whole AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM docs),
p AS (SELECT rid, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM p, whole GROUP BY term),
s AS (
  SELECT q.item_id, docs.doc_id, docs.rid,
         sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * docs.n * nd) // l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN docs USING (rid), whole GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= {TOP}
"""
