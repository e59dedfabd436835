"""How far sources drift from their language: an audit by term counts.

Terms, p and f are the contract's: p is a group's smoothed probability in
billionths, q the one it is held against, f = floor((p - q) ** 2 / q).  A
group's terms are searched by upper bound: all terms of a group with one count
share p, and the least lang probability among them bounds f for the bucket.
Buckets are evaluated by falling bound until what is left cannot reach the
last place.  Sums over pairs of sources come from count histograms, set right
by the postings of terms that both sources have.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import as_list, as_numpy, binary_text, chunks, discard, materialize, released, small

#: Documents of a language that a kept term occurs in, at least.
LEAST_DOCS = 3
#: Ranks of the part ``term``.
TOP = 200
#: Terms that a task counts before it hands them on.
HELD_TERMS = 300_000
#: Postings that a task pairs at once, and pairs of one step.
HELD_ROWS, STEP_PAIRS = 100_000, 1_000_000
#: A bucket round reaches this many times the terms of the round before.
GROWTH = 8
SCALE = 1_000_000_000

_BREAKS = [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Letters of A-Z to lower case, other ASCII that is no letter to spaces.
FOLD = bytes(0x20 if b in _BREAKS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _handed(seen: dict) -> pa.RecordBatch:
    langs, sources, terms, n, df = [], [], [], [], []
    for (lang, source), (words, docs) in seen.items():
        size = len(words) + 1  # and one row that says the group occurs
        langs += [lang] * size
        sources += [source] * size
        terms += [None, *words]
        n += [0, *words.values()]
        df += [0, *(docs[w] for w in words)]
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()), pa.array(n, pa.int64()), pa.array(df, pa.int64())],
        names=["lang", "source", "term", "n", "df"],
    )


def _count(batches):
    seen: dict = {}
    for batch in chunks(batches):
        for lang, source, text in zip(as_list(batch, "lang"), as_list(batch, "source"), as_list(batch, "text")):
            words = text.translate(FOLD).split()
            if (lang, source) not in seen:
                seen[lang, source] = (Counter(), Counter())
            totals, docs = seen[lang, source]
            totals.update(words)
            docs.update(set(words))
        if sum(len(c) for c, _ in seen.values()) > HELD_TERMS:
            yield _handed(seen)
            seen = {}
    if seen:
        yield _handed(seen)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents); a row with a null
    term for each (lang, source) that occurs."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    parts = docs.select(*named, binary_text().alias("text")).mapInArrow(
        released(_count), "lang string, source string, term binary, n long, df long"
    )
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).withColumn("term", F.col("term").cast("string"))


def probability(n: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / whole), exact for any count."""
    top = (n + 1).cast("decimal(20,0)") * F.lit(SCALE)
    return F.call_function("div", top, whole.cast("decimal(20,0)")).cast("long") + 1


def deviation(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class Audit:
    """The tables that both parts are drawn from."""

    def __init__(self, docs: DataFrame):
        counts = materialize(term_counts(docs), "audit-counts")
        term = Window.partitionBy("lang", "term")
        kept = counts.where("term is not null").select(
            "*", F.sum("df").over(term).alias("docs"), F.sum("n").over(term).alias("lang_n"),
            (F.col("source") == F.min("source").over(term)).alias("first"),
        ).where(F.col("docs") >= LEAST_DOCS)
        self.rows = materialize(kept.select("lang", "source", "term", "n", "lang_n", "first"), "audit-postings")
        langs = self.rows.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("v"))
        own = self.rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
        zero = F.lit(0).cast("long")
        groups = (
            counts.where("term is null").select("lang", "source").join(own, ["lang", "source"], "left").join(langs, "lang", "left")
            .select(
                "lang", "source", F.coalesce("terms", zero).alias("terms"), F.coalesce("v", zero).alias("v"),
                (F.coalesce("total", zero) + F.coalesce("v", zero)).alias("whole"),
                (F.coalesce("lang_total", zero) + F.coalesce("v", zero)).alias("lang_whole"),
            )
        )
        self.groups = materialize(
            groups.select("*", F.monotonically_increasing_id().alias("gid"), F.when(F.col("v") > 0, probability(zero, F.col("whole"))).alias("p0")),
            "audit-groups",
        )
        discard(counts)
        self.postings = self.rows.join(small(self.groups.drop("terms", "v")), ["lang", "source"]).select(
            "lang", "source", "gid", "term", "n", "p0",
            probability(F.col("n"), F.col("whole")).alias("p"), probability(F.col("lang_n"), F.col("lang_whole")).alias("q"),
        )
        #: terms of a group with one count, and the least probability they have in the language
        self.buckets = materialize(
            self.postings.groupBy("lang", "source", "gid", "n", "p").agg(F.count("*").alias("terms"), F.min("q").alias("q")), "audit-buckets"
        )

    def terms(self, top: int = TOP) -> DataFrame:
        """lang, source, item, value, rank: the terms that a group has more
        often than its language, the ``top`` of largest f."""
        group = ["lang", "source"]
        before = Window.partitionBy(*group).orderBy(F.desc("bound"), "n").rowsBetween(Window.unboundedPreceding, -1)
        queue = materialize(
            self.buckets.where("p > q")
            .withColumn("bound", deviation(F.col("p"), F.col("q")))
            .select(*group, "n", "bound", F.coalesce(F.sum("terms").over(before), F.lit(0)).alias("before")),
            "audit-queue",
        )
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))
        best, waiting, lower, upper = None, queue, 0, top
        while True:
            chosen = small(waiting.where((F.col("before") >= lower) & (F.col("before") < upper)).select(*group, "n"))
            found = self.postings.join(chosen, [*group, "n"]).where("p > q")
            found = found.select(*group, F.col("term").alias("item"), deviation(F.col("p"), F.col("q")).alias("value"))
            rows = found if best is None else found.unionByName(best.drop("rank"))
            now = materialize(rows.withColumn("rank", rank).where(F.col("rank") <= top), "audit-best")
            if best is not None:
                discard(best)
            best = now
            # groups whose unseen buckets can still reach the last place, ties included
            last = small(best.where(F.col("rank") == top).select(*group, F.col("value").alias("last")))
            left = queue.where(F.col("before") >= upper).join(last, group, "left").where("last is null or bound >= last")
            still = materialize(left.select(*group).distinct(), "audit-open")
            if still.isEmpty():
                break
            waiting = queue.join(small(still), group, "left_semi")
            lower, upper = upper, upper * GROWTH
        discard(queue)
        return best

    def pairs(self) -> DataFrame:
        """lang, source, item, value, rank: every other source of the language
        and the sum of f over all kept terms."""
        bars = self.buckets.groupBy("gid").agg(F.collect_list(F.struct("p", "terms")).alias("bars"))
        sides = materialize(
            self.groups.join(bars, "gid", "left").select("lang", "source", "gid", "v", "p0", F.coalesce("bars", F.array().cast("array<struct<p:bigint,terms:bigint>>")).alias("bars")),
            "audit-sides",
        )
        a = small(sides).select("lang", "source", F.col("gid").alias("a"), "v", F.col("p0").alias("pa"), F.col("bars").alias("bars_a"))
        b = small(sides).select("lang", F.col("source").alias("item"), F.col("gid").alias("b"), F.col("p0").alias("pb"), F.col("bars").alias("bars_b"))
        mend = materialize(
            self.postings.select("lang", "term", "gid", "p", "p0")
            .repartition("lang", "term")
            .sortWithinPartitions("lang", "term")
            .mapInArrow(released(_both), "a long, b long, mend long")
            .groupBy("a", "b")
            .agg(F.sum("mend").alias("mend")),
            "audit-mends",
        )
        zero = F.lit(0).cast("long")
        none = deviation(F.col("pa"), F.col("pb"))
        alone_a = F.aggregate("bars_a", zero, lambda s, x: s + x.terms * (deviation(x.p, F.col("pb")) - none))
        alone_b = F.aggregate("bars_b", zero, lambda s, x: s + x.terms * (deviation(F.col("pa"), x.p) - none))
        value = F.when(F.col("v") > 0, none * F.col("v") + alone_a + alone_b + F.coalesce("mend", zero)).otherwise(zero)
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        met = a.join(b, "lang").where("a <> b").join(small(mend), ["a", "b"], "left")
        return met.select("lang", "source", "item", value.alias("value")).withColumn("rank", rank)


def _mends(gid: np.ndarray, p: np.ndarray, p0: np.ndarray, starts: np.ndarray) -> pa.RecordBatch | None:
    """For runs of postings of one term: what each pair of groups in a run
    changes in the sums that take each as alone."""
    n = len(gid)
    lengths = np.diff(np.append(starts, n))
    size, start = np.repeat(lengths, lengths), np.repeat(starts, lengths)
    names, local = np.unique(gid, return_inverse=True)
    keys, sums = [], []
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // STEP_PAIRS)) + 1
    for rows in np.split(np.arange(n), cuts):
        total = int(size[rows].sum())
        a = np.repeat(rows, size[rows])
        first = np.cumsum(size[rows]) - size[rows]
        b = np.arange(total) - np.repeat(first, size[rows]) + np.repeat(start[rows], size[rows])
        a, b = a[local[a] != local[b]], b[local[a] != local[b]]
        d = (p[a] - p[b]) ** 2 // p[b] - (p[a] - p0[b]) ** 2 // p0[b] - (p0[a] - p[b]) ** 2 // p[b] + (p0[a] - p0[b]) ** 2 // p0[b]
        key, where = np.unique(local[a] * len(names) + local[b], return_inverse=True)
        each = np.zeros(len(key), np.int64)
        np.add.at(each, where, d)
        keys.append(key)
        sums.append(each)
    key, each = np.concatenate(keys), np.concatenate(sums)
    return pa.RecordBatch.from_arrays([pa.array(names[key // len(names)]), pa.array(names[key % len(names)]), pa.array(each)], names=["a", "b", "mend"])


def _both(batches):
    """Sorted postings in; whole runs of a term are paired, the last one of a
    load waits for its rest."""
    held: list = []

    def paired(last: bool):
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        lang, term = as_list(table, "lang"), as_list(table, "term")
        new = np.array([True] + [x != y or u != w for x, y, u, w in zip(lang, lang[1:], term, term[1:])])
        starts = np.flatnonzero(new)
        cut = table.num_rows if last else int(starts[-1])
        held[:] = [] if last else [table.slice(cut)]
        if cut:
            yield _mends(*(as_numpy(table, c)[:cut] for c in ("gid", "p", "p0")), starts[starts < cut])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_ROWS:
                yield from paired(False)
    if held:
        yield from paired(True)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank.

    Null texts, langs and sources are read as ''; texts without terms, empty
    and very long ones (read whole) and repeated rows count as they are.  A
    language of which no term is in LEAST_DOCS documents has pairs of value 0.
    Equal values go by the item's UTF-8 bytes.  An empty table gives no rows;
    other columns are not looked at.
    """
    tables = Audit(docs)
    parts = [d.select("lang", "source", F.lit(n).alias("part"), "item", "value", "rank") for n, d in (("pair", tables.pairs()), ("term", tables.terms()))]
    return parts[0].unionByName(parts[1])


def oracle_sql() -> str:
    p = f"(1 + ({SCALE} * (%s::HUGEINT + 1)) // (%s))"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(n)::HUGEINT + count(*) AS whole FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
cell AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n,
         {p % ("coalesce(c.n, 0)", "coalesce(gn.total, 0) + (SELECT count(*) FROM kept k WHERE k.lang = g.lang)")} AS p,
         {p % ("kept.n", "l.whole")} AS q
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN gn USING (lang, source)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM cell WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= {TOP}
"""
