"""MinHash signatures, banding, signature check, and exact Jaccard links.

The steps that near-dedup of documents (op 2) and of paragraphs (op 1) share:

* ``doc_shingles`` / ``signatures``: 5-word shingle sets as 64-bit hashes and
  many universal hash minima over them, in numpy.
* ``loose_edges``: distinct sets meet in band buckets; inside a bucket each
  newly joined member is compared, by signature, with those still alone only,
  so a bucket of n copies costs about n comparisons and yields n - 1 edges,
  never all pairs.
* ``tight_edges``: the sets of each loose cluster are compared exactly in the
  same manner.

A bucket or cluster beyond the block bound is dealt out in blocks which share
anchors; then every member outside its largest component is compared with every
block, so no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_list, as_numpy, materialize, mix, released, small, spread
from .components import components

SHINGLE = 5
BANDS, ROWS = 40, 5
#: A pair at Jaccard 0.75 is missed by all 40 bands of 5 with chance 2e-5.
SEED = 20_241
#: The exact limit, and by how many standard errors of its minima a signature
#: may fall below it before a pair is no longer looked at exactly.
LIMIT, ERRORS = 0.75, 4.0
BUCKET_ROWS = 4_000
BLOCK_ROWS, BLOCK_SHINGLES = 4_000, 2_000_000
ANCHORS = 16

_PLACE = spread(11, SHINGLE)


def shingles(hashes: np.ndarray) -> np.ndarray:
    """The shingles of one word-hash array in order, repeats included."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        if n < SHINGLE:
            return mix((hashes * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
        total = hashes[: n - SHINGLE + 1] * _PLACE[0]
        for k in range(1, SHINGLE):
            total = total + hashes[k : n - SHINGLE + 1 + k] * _PLACE[k]
        return mix(total)


def doc_shingles(hashes: np.ndarray) -> np.ndarray:
    """The sorted distinct shingles of one word-hash array."""
    return np.unique(shingles(hashes))


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that name a shingle set."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(shingles))
        a = mix(mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + n)
        b = mix(mix(shingles + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64) ^ n)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


class Signer:
    """Universal hash minima of shingle sets, and their band keys."""

    def __init__(self, bands: int, rows: int, seed: int = SEED):
        self.bands, self.rows = bands, rows
        k = bands * rows
        self.a = (spread(seed, k) >> np.uint64(16)).astype(np.uint32) | np.uint32(1)
        self.b = (spread(seed + 1, k) >> np.uint64(20)).astype(np.uint32)
        self.place = spread(seed + 2, rows)
        self.band = spread(seed + 3, bands)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """len(sets) x K minima; no set may be empty."""
        return self.minima_of(np.concatenate(sets), np.array(list(map(len, sets))))

    def minima_of(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The same of sets that lie one behind the other in ``values``."""
        out = np.empty((self.bands * self.rows, len(sizes)), np.uint32)
        ends = np.cumsum(sizes)
        x = (values >> np.uint64(32)).astype(np.uint32)
        at = 0
        while at < len(sizes):
            low = ends[at] - sizes[at]
            stop = max(at + 1, int(np.searchsorted(ends, low + 32_768, side="right")))
            own = x[low : ends[stop - 1]]
            starts = ends[at:stop] - sizes[at:stop] - low
            buffer = np.empty_like(own)
            for k in range(len(out)):
                np.multiply(own, self.a[k], out=buffer)
                np.add(buffer, self.b[k], out=buffer)
                out[k, at:stop] = np.minimum.reduceat(buffer, starts)
            at = stop
        return out.T

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """len x bands signed 64-bit bucket keys."""
        with np.errstate(over="ignore"):
            m = minima.reshape(len(minima), self.bands, self.rows).astype(np.uint64) + np.uint64(1)
            return mix((m * self.place).sum(axis=2, dtype=np.uint64) * self.band[None, :] + self.band).view(np.int64)


def _grouped(batches, columns: list[str]):
    """Whole groups of rows with equal first columns (``g``, ``s``) from
    batches sorted by them: (g, dict of column -> list)."""
    held: dict[str, list] = {}
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        g, s = as_numpy(batch, "g"), as_numpy(batch, "s")
        cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(s) != 0)) + 1).tolist(), batch.num_rows]
        data = {c: as_list(batch, c) for c in columns}
        for start, stop in zip(cuts, cuts[1:]):
            now = (g[start], s[start])
            if key is not None and now != key:
                yield key[0], held
                held = {}
            key = now
            for c in columns:
                held.setdefault(c, []).extend(data[c][start:stop])
    if key is not None:
        yield key[0], held


def _absorb(n: int, linked) -> list[tuple[int, int]]:
    """Edges of a spanning forest: ``linked(i, rest)`` tells which of ``rest``
    are linked with i.  Each member is compared with those not yet joined."""
    rest, out, queue = np.arange(n), [], []
    while len(rest):
        if queue:
            i = queue.pop()
        else:
            i, rest = int(rest[0]), rest[1:]
            if not len(rest):
                break
        hit = linked(i, rest)
        if hit.any():
            for j in rest[hit].tolist():
                out.append((i, j))
                queue.append(j)
            rest = rest[~hit]
    return out


def _pair_table(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=["u", "v"])


def least_equal(minima: int) -> int:
    """Equal minima, of so many, from which a pair is looked at exactly."""
    return int(np.ceil(LIMIT * minima - ERRORS * np.sqrt(LIMIT * (1 - LIMIT) * minima)))


def _deal(df: DataFrame) -> DataFrame:
    return df.repartition("g", "s").sortWithinPartitions("g", "s")


def _alike(signatures: list[bytes]):
    """linked(i, rest) by equal minima."""
    sig = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
    need = least_equal(sig.shape[1])
    return lambda i, rest: (sig[rest] == sig[i]).sum(axis=1) >= need


def loose_edges(entries: DataFrame, sigs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges between sets that may be similar.

    ``entries``: g, cid (long), a row for each band key of each set, repeats
    allowed; ``sigs``: cid, sig binary (a byte of each minimum), repeats
    allowed.  A bucket beyond ``bucket_rows`` sets is dealt out in parts with
    shared anchors; then every member outside the bucket's largest component is
    compared with every part, so no link between components is lost."""
    buckets = materialize(
        entries.groupBy("g").agg(F.min("cid").alias("a"), F.max("cid").alias("b")).where("a < b").select("g"), "buckets"
    )
    met = materialize(entries.join(small(buckets), "g").select("g", "cid").distinct(), "bucket-members")
    sized = met.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
    hot = materialize(sized.select("g", F.ceil(F.col("n") / bucket_rows).cast("int").alias("parts")), "hot-buckets")
    wanted = materialize(met.select("cid").distinct(), "signed-members")
    signed = materialize(
        sigs.join(small(wanted), "cid").groupBy("cid").agg(F.any_value("sig").alias("sig")), "signatures"
    )
    members = (
        met.join(small(hot), "g", "left")
        .select(F.col("g").alias("cluster"), "cid", F.coalesce("parts", F.lit(1)).alias("parts"))
        .join(signed.withColumnRenamed("sig", "held"), "cid")
    )
    return _linked_in_blocks(members, bool(hot.limit(1).count()), _alike).distinct()


def _exact(members: list[bytes], percent: int):
    """linked(i, rest) by exact Jaccard over whole sets."""
    sets = [np.frombuffer(m, np.uint64) for m in members]
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return lambda i, rest: np.array([100 * both >= percent * (sizes.sum() - both)])
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = ids.astype(np.int32)
    ends = np.cumsum(sizes)
    own = [ids[e - n : e] for e, n in zip(ends, sizes)]
    flag = np.zeros(len(values), np.uint8)
    state: dict = {"key": None}

    def linked(i, rest):
        # the rest only shrinks: rebuild its joined ids when it halves
        if state["key"] is None or len(rest) * 2 < len(state["key"]) or not np.isin(rest, state["key"]).all():
            state["key"] = rest
            state["ids"] = np.concatenate([own[j] for j in rest])
            state["starts"] = np.cumsum([0, *sizes[rest][:-1]])
        flag[own[i]] = 1
        both = np.add.reduceat(flag[state["ids"]], state["starts"], dtype=np.int64)
        flag[own[i]] = 0
        both = both[np.searchsorted(state["key"], rest)]
        return 100 * both >= percent * (sizes[i] + sizes[rest] - both)

    return linked


def _in_blocks(links):
    """Groups of block members: a spanning forest of each."""

    def run(batches):
        for _, rows in _grouped(batches, ["cid", "held"]):
            seen = dict(zip(rows["cid"], rows["held"]))
            cid, held = list(seen), list(seen.values())
            if len(cid) < 2:
                continue
            out = [(cid[i], cid[j]) for i, j in _absorb(len(cid), links(held))]
            if out:
                yield _pair_table(out)

    return run


def _across_blocks(links):
    """Groups of block members (asks false) and outside members (asks true):
    each of the latter against all with another label."""

    def run(batches):
        for _, rows in _grouped(batches, ["cid", "held", "label", "asks"]):
            cid, label = np.array(rows["cid"]), np.array(rows["label"])
            asks = np.array(rows["asks"], bool)
            if not asks.any() or asks.all():
                continue
            linked = links(rows["held"])
            block = np.flatnonzero(~asks)
            out = []
            for i in np.flatnonzero(asks).tolist():
                hit = block[linked(i, block)]
                other = hit[label[hit] != label[i]]
                # one edge to each component that it links
                _, at = np.unique(label[other], return_index=True)
                out += [(int(cid[i]), int(cid[j])) for j in other[at]]
            if out:
                yield _pair_table(out)

    return run


def tight_edges(
    members: DataFrame,
    percent: int = 75,
    block_rows: int = BLOCK_ROWS,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``members``: cluster, cid (long), shingles binary (sorted 64-bit).
    Edges that connect exactly the members whose sets are linked by chains of
    100 * intersection >= percent * union."""
    members = materialize(members.withColumnRenamed("shingles", "held"), "cluster-members")
    sizes = materialize(
        members.groupBy("cluster")
        .agg(F.count("*").alias("n"), F.sum(F.length("held") / 8).alias("m"))
        .withColumn("parts", F.ceil(F.greatest(F.col("n") / block_rows, F.col("m") / block_shingles)).cast("int"))
        .where("parts > 1")
        .select("cluster", "parts"),
        "cluster-sizes",
    )
    sized = members.join(small(sizes), "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return _linked_in_blocks(sized, bool(sizes.limit(1).count()), lambda held: _exact(held, percent))


def _linked_in_blocks(members: DataFrame, split: bool, links) -> DataFrame:
    """Edges that connect the members of each cluster which are linked by
    chains.  ``members``: cluster, cid, held (what ``links`` compares) and
    parts, the number of blocks the cluster is dealt out in."""
    sized = members.withColumn("s", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    own = sized.select(F.col("cluster").alias("g"), "s", "cid", "held")
    if not split:
        return _deal(own).mapInArrow(released(_in_blocks(links)), "u long, v long")
    first = Window.partitionBy("cluster").orderBy("cid")
    anchors = (
        sized.where("parts > 1")
        .withColumn("k", F.row_number().over(first))
        .where(F.col("k") <= ANCHORS)
        .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.col("cluster").alias("g"), "s", "cid", "held")
    )
    found = materialize(
        _deal(own.unionByName(anchors)).mapInArrow(released(_in_blocks(links)), "u long, v long"), "links"
    )
    label = materialize(components(found), "labels")
    named = (
        sized.where("parts > 1")
        .join(label.withColumnRenamed("node", "cid"), "cid", "left")
        .withColumn("label", F.coalesce("component", "cid"))
    )
    weight = named.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    lead = materialize(
        weight.groupBy("cluster").agg(F.max(F.struct("n", F.col("label").alias("lead"))).alias("x")).select("cluster", "x.lead"),
        "leads",
    )
    named = named.join(small(lead), "cluster").select("cluster", "parts", "s", "cid", "held", "label", "lead")
    # blocks of all members x blocks of those outside the largest component
    outside = named.where("label <> lead")
    block = named.select(
        F.col("cluster").alias("g"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda t: F.col("s") * F.col("parts") + t)).alias("s"),
        "cid", "held", "label", F.lit(False).alias("asks"),
    )
    wanted = outside.select(F.col("cluster").alias("g"), F.col("s").alias("t"), "parts").distinct()
    wanted = wanted.select(
        "g", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda b: b * F.col("parts") + F.col("t"))).alias("s")
    )
    block = block.join(wanted, ["g", "s"], "left_semi")
    asking = outside.select(
        F.col("cluster").alias("g"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda b: b * F.col("parts") + F.col("s"))).alias("s"),
        "cid", "held", "label", F.lit(True).alias("asks"),
    )
    more = _deal(block.unionByName(asking)).mapInArrow(released(_across_blocks(links)), "u long, v long")
    return found.unionByName(more)
