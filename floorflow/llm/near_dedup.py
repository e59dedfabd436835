"""Near-duplicate documents: MinHash banding, exact confirmation, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_list, binary_text, chunks, free_names, materialize, released, small, word_hashes
from .components import components
from .minhash import BANDS, ROWS, Signer, digest, doc_shingles, loose_edges, tight_edges

PERCENT = 75


def _sign(bands: int, rows: int):
    def run(batches):
        signer = Signer(bands, rows)
        for batch in chunks(batches):
            texts = as_list(batch, "text")
            sets = [doc_shingles(word_hashes(t.lower().split())) for t in texts]
            names = [digest(s) for s in sets]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            sigs: list = [None] * len(sets)
            if full:
                minima = signer.minima([sets[k] for k in full])
                low = (minima & np.uint32(255)).astype(np.uint8)
                for k, row, sig in zip(full, signer.keys(minima), low):
                    keys[k], sigs[k] = row, sig.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([a for a, _ in names], pa.int64()),
                    pa.array([b for _, b in names], pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                    pa.array(sigs, pa.binary()),
                ],
                names=["doc_id", "tid", "n_shingles", "cid", "cid2", "keys", "sig"],
            )

    return run


def _sets_of(batches):
    for batch in chunks(batches):
        out = []
        for cid, cluster, text in zip(as_list(batch, "cid"), as_list(batch, "cluster"), as_list(batch, "text")):
            found = doc_shingles(word_hashes(text.lower().split()))
            if digest(found)[0] == cid:
                out.append((cluster, cid, found.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.int64()),
                pa.array([x[2] for x in out], pa.binary()),
            ],
            names=["cluster", "cid", "shingles"],
        )


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), binary_text().alias("text")
    )


def _classified(docs: DataFrame, percent: int, bands: int, rows: int) -> DataFrame:
    """doc_id, tid (xxhash64 of the text), n_shingles, class (a number that the
    documents of a class share, null without words) and component_id."""
    signed = materialize(
        _read(docs).mapInArrow(
            released(_sign(bands, rows)),
            "doc_id long, tid long, n_shingles long, cid long, cid2 long, keys array<long>, sig binary",
        ),
        "signed",
    )
    # a class without any id is met by its text instead
    classes = materialize(
        signed.where("n_shingles > 0")
        .groupBy("cid", "cid2")
        .agg(
            F.min("doc_id").alias("rep"), F.min("tid").alias("rep_tid"),
            F.any_value("keys").alias("keys"), F.any_value("sig").alias("sig"),
        ),
        "classes",
    )
    loose = loose_edges(classes.select(F.explode("keys").alias("g"), "cid"), classes.select("cid", "sig"))
    clusters = materialize(components(materialize(loose, "loose")), "clusters")
    wanted = materialize(
        clusters.join(classes.select(F.col("cid").alias("node"), "rep", "rep_tid"), "node").select(
            F.col("rep").alias("doc_id"), F.col("rep_tid").alias("tid"), F.col("node").alias("cid"),
            F.col("component").alias("cluster"),
        ),
        "wanted",
    )
    with_id, without = wanted.where("doc_id is not null").drop("tid"), wanted.where("doc_id is null").drop("doc_id")
    texts = _read(docs)
    found = texts.join(small(with_id), "doc_id").select("cluster", "cid", "text")
    if without.limit(1).count():
        found = found.unionByName(
            texts.where("doc_id is null").join(small(without), "tid").select("cluster", "cid", "text")
        )
    members = found.mapInArrow(released(_sets_of), "cluster long, cid long, shingles binary")
    links = materialize(tight_edges(members, percent), "links")
    joined = components(links).withColumnRenamed("node", "cid")
    named = classes.select("cid", "cid2", "rep").join(joined, "cid", "left")
    heads = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("head"))
    named = materialize(
        named.join(heads, "component", "left").select(
            "cid", "cid2", F.coalesce("component", "cid").alias("class"), F.coalesce("head", "rep").alias("head")
        ),
        "named",
    )
    return (
        signed.select("doc_id", "tid", "n_shingles", "cid", "cid2")
        .join(small(named), ["cid", "cid2"], "left")
        .select(
            "doc_id",
            "tid",
            "n_shingles",
            "class",
            F.when(F.col("n_shingles") > 0, F.col("head")).otherwise(F.col("doc_id")).alias("component_id"),
        )
    )


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Classes of near-duplicate documents.

    A document's set holds its distinct 5-word shingles (words lower-cased in
    A-Z; with fewer words, the whole sequence).  Documents are linked where
    ``100 * intersection >= percent * union``.  Returns doc_id, n_shingles,
    component_id (smallest doc_id reachable) and kept, a row per input row.

    Null or wordless texts: n_shingles 0, linked with nothing.  Repeated rows
    and equal texts are one class; rows of one id with different texts are told
    apart.  A null doc_id stays null, links like any other, and is kept only
    if no row of its class has an id.  Texts of any length are read whole; an
    empty table gives an empty table.  Other columns of ``docs`` are not looked
    at.  Equal sets are told by 128-bit digests and shingles by 64-bit hashes.
    """
    return (
        _classified(docs, percent, bands, rows)
        .select("doc_id", "n_shingles", "component_id")
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without all but one row of each class; the columns stay.

    The row of the smallest id stays (rows without an id come last), of rows
    with that id the one whose text has the least hash, and of rows equal in
    both any one.  Rows without words are in no class and stay.  Rows are told
    by id and text together, so a text that shares its id with a copy of
    another document stays.
    """
    rows = materialize(_classified(docs, percent, BANDS, ROWS).where("class is not null").drop("n_shingles"), "classified")
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "tid")
    many = materialize(
        rows.groupBy("class").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copied"
    )
    met = rows.join(small(many), "class").select("doc_id", "tid", (order == F.col("first")).alias("stays"))
    # whether a (doc_id, text) goes, or stays once of several rows
    told = materialize(met.groupBy("doc_id", "tid").agg(F.max("stays").alias("stays"), F.count("*").alias("n")), "told")
    told = told.where("not stays or n > 1")
    doc, tid, stays, n = free_names(docs, "doc", "tid", "stays", "n")
    marked = docs.join(
        small(told).toDF(doc, tid, stays, n),
        docs["doc_id"].cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(tid)),
        "left",
    )
    kept = marked.where(F.col(n).isNull()).select(*docs.columns)
    if not told.where("stays").limit(1).count():
        return kept
    once = marked.where(F.col(stays)).dropDuplicates([doc, tid]).select(*docs.columns)
    return kept.unionByName(once)
