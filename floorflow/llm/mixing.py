"""Mixing sources to target weights: hierarchical budgets, seeded prefixes.

DataFrame expressions only.  The tree is domain > language > source; integer
weights set each node's share among its siblings.  A node that cannot use its
share leaves the rest to its siblings, and only what a whole subtree lacks goes
up to the ancestors' siblings.  A leaf's budget is spent in whole epochs and a
token prefix of one more, in an order that a seed, the epoch and the id give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_names, materialize, small

LEVELS = ("domain", "lang", "source")
SPACE = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def source_domain(source: Column) -> Column:
    """A domain by the number that ends a source's name."""
    number = F.try_to_number(F.regexp_extract(source, "([0-9]+)$", 1), F.lit("999999999"))
    return F.coalesce(F.concat(F.lit("d"), (number.cast("long") % 4).cast("string")), F.lit("none"))


def _weight(name: str, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.element_at(table, F.col(name)), F.lit(1)).cast("long")


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """nodes: parents, name, weight, cap, budget (the parent's, at most its
    capacity).  Adds ``own``: each node's part.  Nodes in order of capacity
    over weight are filled while that is less than an even part of the rest;
    the others divide the rest by weight, to the token."""
    key = parents or [F.lit(0)]
    order = Window.partitionBy(*key).orderBy(F.col("cap") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*key)
    zero = F.lit(0).cast("long")
    full = nodes.select(
        "*",
        F.sum("weight").over(whole).alias("w"),
        F.coalesce(F.sum("cap").over(before), zero).alias("cb"),
        F.coalesce(F.sum("weight").over(before), zero).alias("wb"),
    ).withColumn(
        "filled",
        F.col("cap").cast("decimal(38,0)") * (F.col("w") - F.col("wb"))
        <= (F.col("budget") - F.col("cb")).cast("decimal(38,0)") * F.col("weight"),
    )
    rest = full.select(
        "*",
        (F.col("budget") - F.coalesce(F.sum(F.when(F.col("filled"), F.col("cap"))).over(whole), zero)).alias("rest"),
        F.coalesce(F.sum(F.when(~F.col("filled"), F.col("weight"))).over(whole), zero).alias("rw"),
        F.coalesce(F.sum(F.when(~F.col("filled"), F.col("weight"))).over(upto), zero).alias("cw"),
    )
    own = F.expr("(rest * cw) div nullif(rw, 0) - (rest * (cw - weight)) div nullif(rw, 0)")
    return rest.withColumn("own", F.when(F.col("filled"), F.col("cap")).otherwise(F.least(own, F.col("cap"))).cast("long"))


def budgets(leaves: DataFrame, total: int, max_epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """leaves: domain, lang, source, supply (tokens).  Adds budget (tokens)."""
    capped = leaves.withColumn("cap", F.col("supply") * F.lit(max_epochs).cast("long"))
    parents: list[str] = []
    above = None
    for name in LEVELS:
        path = [*parents, name]
        nodes = capped.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(name, weights.get(name, {})))
        if above is None:
            all_cap = F.sum("cap").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("budget", F.least(all_cap, F.lit(total).cast("long")))
        else:
            nodes = nodes.join(above, parents)
        above = _share(nodes, parents, name).select(*path, F.col("own").alias("budget"))
        parents = path
    return leaves.join(above, list(LEVELS))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, dict[str, int]],
    fraction: float = 0.5,
    max_epochs: int = 2,
    seed: int = 7,
    domain: Column | None = None,
) -> DataFrame:
    """Choose documents so that tokens (words) follow the weights.

    ``fraction`` of all tokens is the total; ``max_epochs`` bounds how often a
    leaf repeats.  Returns doc_id, domain, lang, source, epoch, n_tokens and
    take_tokens (less than n_tokens for the document that a prefix ends in).

    Null lang or source: the name ``none``.  Null or wordless texts have no
    tokens; they come with each whole epoch, and with a prefix where one
    reaches them.  Ties in the seeded order go by id, and repeated rows count
    as rows.  An empty table gives no rows; other columns are not looked at.

    A leaf may hold a third of all rows: its prefix is found by counts of 256
    and again 256 ranges of the seeded order, so only 1/65536 of a leaf is ever
    sorted in one place.
    """
    domain = source_domain(F.col("source")) if domain is None else domain
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long"),
            domain.alias("domain"),
            F.coalesce("lang", F.lit("none")).alias("lang"),
            F.coalesce("source", F.lit("none")).alias("source"),
            word_count(F.col("text")).alias("n_tokens"),
        ),
        "mix-rows",
    )
    leaves = materialize(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("supply")), "mix-leaves")
    supply = leaves.agg(F.sum("supply").alias("n")).first().n or 0
    plan = materialize(
        budgets(leaves, int(supply * fraction), max_epochs, weights).select(
            *LEVELS,
            F.expr("coalesce(budget div nullif(supply, 0), 0)").alias("whole"),
            F.expr("coalesce(budget % nullif(supply, 0), 0)").alias("part"),
        ),
        "mix-plan",
    )
    planned = rows.join(small(plan), list(LEVELS)).withColumn(
        "h",
        F.md5(
            F.concat_ws(":", F.lit(seed), (F.col("whole") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")
        ),
    )
    whole = planned.where("whole > 0").select(
        "doc_id", *LEVELS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole"))).alias("epoch"),
        "n_tokens", F.col("n_tokens").alias("take_tokens"),
    )
    # the range that a leaf's prefix ends in, then the range within that range
    open_rows, spent, out = planned.where("part > 0"), F.lit(0).cast("long"), whole
    for level in range(2):
        bucket = F.substring("h", 1 + 2 * level, 2)
        marked = open_rows.withColumn("b", bucket).withColumn("spent", spent)
        run = Window.partitionBy(*LEVELS).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        ranges = (
            marked.groupBy(*LEVELS, "b")
            .agg(F.sum("n_tokens").alias("n"), F.first("part").alias("goal"), F.first("spent").alias("s0"))
            .withColumn("end", F.col("s0") + F.sum("n").over(run))
        )
        edge = materialize(
            ranges.where(F.col("end") >= F.col("goal"))
            .groupBy(*LEVELS)
            .agg(F.min(F.struct("b", (F.col("end") - F.col("n")).alias("before"))).alias("x"))
            .select(*LEVELS, F.col("x.b").alias("edge"), F.col("x.before").alias("before")),
            "mix-edges",
        )
        split = marked.join(small(edge), list(LEVELS), "left")
        inside = split.where(F.col("edge").isNull() | (F.col("b") < F.col("edge")))
        out = out.unionByName(
            inside.select("doc_id", *LEVELS, (F.col("whole") + 1).alias("epoch"), "n_tokens", F.col("n_tokens").alias("take_tokens"))
        )
        open_rows = split.where(F.col("b") == F.col("edge")).drop("b", "spent", "edge").withColumnRenamed("before", "s1")
        open_rows = open_rows.withColumn("s", F.col("s1")).drop("s1")
        spent = F.col("s")
        if level == 0:
            open_rows = open_rows.select("doc_id", *LEVELS, "n_tokens", "whole", "part", "h", "s")
    order = Window.partitionBy(*LEVELS).orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        open_rows.withColumn("start", F.col("s") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
        .where(F.col("start") < F.col("part"))
        .select(
            "doc_id", *LEVELS, (F.col("whole") + 1).alias("epoch"), "n_tokens",
            F.least(F.col("n_tokens"), F.col("part") - F.col("start")).alias("take_tokens"),
        )
    )
    return out.unionByName(last)


def keep_mix(docs: DataFrame, weights: dict[str, dict[str, int]], fraction: float, seed: int = 7) -> DataFrame:
    """``docs`` without the documents that the mix leaves out, each taken once
    at most and whole; the columns stay.  Texts without words and rows without
    an id stay; rows of one id stay or go together."""
    mixed = mix_sources(docs, weights, fraction, max_epochs=1, seed=seed)
    chosen = materialize(mixed.where("doc_id is not null").select("doc_id").distinct(), "mixed")
    (name,) = free_names(docs, "chosen")
    free = docs["doc_id"].isNull() | (word_count(docs["text"]) == 0)
    taken = docs.join(small(chosen).toDF(name), docs["doc_id"].cast("long") == F.col(name), "left")
    return taken.where(F.col(name).isNotNull() | free).select(*docs.columns)


#: Weights of the registered query and of the pipeline.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}

ORACLE = r"""
WITH rows AS (
  SELECT doc_id,
         coalesce('d' || CAST(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) % 4 AS VARCHAR), 'none') AS domain,
         coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply FROM rows GROUP BY ALL),
total AS (SELECT CAST(floor(sum(supply) * 0.5::DOUBLE) AS BIGINT) AS t, CAST(sum(supply) * 2 AS BIGINT) AS c FROM leaves),
n1 AS (SELECT domain, CAST(sum(supply) * 2 AS BIGINT) AS cap, CAST(CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END AS BIGINT) AS weight,
              (SELECT least(t, c) FROM total) AS budget FROM leaves GROUP BY domain),
{b1}
n2 AS (SELECT l.domain, l.lang, CAST(sum(supply) * 2 AS BIGINT) AS cap, CAST(CASE l.lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS BIGINT) AS weight,
              any_value(b1.own) AS budget FROM leaves l JOIN b1 USING (domain) GROUP BY l.domain, l.lang),
{b2}
n3 AS (SELECT l.domain, l.lang, l.source, CAST(supply * 2 AS BIGINT) AS cap, CAST(1 AS BIGINT) AS weight, b2.own AS budget
       FROM leaves l JOIN b2 USING (domain, lang)),
{b3}
plan AS (SELECT domain, lang, source, coalesce(own // nullif(supply, 0), 0) AS whole, coalesce(own % nullif(supply, 0), 0) AS part
         FROM leaves JOIN b3 USING (domain, lang, source)),
planned AS (SELECT rows.*, whole, part, md5('7:' || CAST(whole + 1 AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM rows JOIN plan USING (domain, lang, source)),
prefix AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
           FROM planned WHERE part > 0)
SELECT doc_id, domain, lang, source, unnest(range(1, whole + 1)) AS epoch, n_tokens, n_tokens AS take_tokens FROM planned WHERE whole > 0
UNION ALL
SELECT doc_id, domain, lang, source, whole + 1, n_tokens, CAST(least(n_tokens, part - start) AS BIGINT) FROM prefix WHERE start < part
"""

_SHARE_SQL = """
{b}a AS (SELECT *, CAST(sum(weight) OVER ({k}) AS BIGINT) AS w,
         CAST(coalesce(sum(cap) OVER ({k} ORDER BY cap / weight, {n} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cb,
         CAST(coalesce(sum(weight) OVER ({k} ORDER BY cap / weight, {n} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS wb FROM {s}),
{b}f AS (SELECT *, CAST(cap AS HUGEINT) * (w - wb) <= CAST(budget - cb AS HUGEINT) * weight AS filled FROM {b}a),
{b}r AS (SELECT *, CAST(budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({k}), 0) AS BIGINT) AS rest,
         CAST(coalesce(sum(CASE WHEN NOT filled THEN weight END) OVER ({k}), 0) AS BIGINT) AS rw,
         CAST(coalesce(sum(CASE WHEN NOT filled THEN weight END) OVER ({k} ORDER BY cap / weight, {n} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS BIGINT) AS cw FROM {b}f),
{b} AS (SELECT {p}, CASE WHEN filled THEN cap ELSE least((rest * cw) // nullif(rw, 0) - (rest * (cw - weight)) // nullif(rw, 0), cap) END AS own FROM {b}r),
"""


def oracle_sql() -> str:
    levels = (("b1", "n1", "", "domain", "domain"), ("b2", "n2", "PARTITION BY domain", "lang", "domain, lang"),
              ("b3", "n3", "PARTITION BY domain, lang", "source", "domain, lang, source"))
    out = ORACLE
    for b, s, k, n, p in levels:
        out = out.replace("{%s}" % b, _SHARE_SQL.format(b=b, s=s, k=k, n=n, p=p).strip())
    return out
