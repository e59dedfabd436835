"""URL filters: a Bloom filter cascade over the corpus's own keys.

DataFrame expressions only.  A listed key is a host and the start of a path.
The first filter encodes the listed keys; the second those keys of the corpus
that pass it without being listed; the third the listed keys that pass the
second, and so on until a filter lets nothing through that it should not.  As
the corpus's keys are all known, the cascade answers without error for each of
them.  It travels as one array, so no page is joined with anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Bits for each key of a filter, and hashes that set them.
BITS, HASHES = 10, 7
#: Bytes of a cascade that travel with the tasks; beyond it keys are joined.
MOST_BYTES = 32 << 20
#: Shapes of listed keys (labels of the host, length of the path) that are
#: written out as expressions; beyond it keys are joined.
MOST_SHAPES = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query: host and start of the path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    h = F.xxhash64(key, F.lit(level))
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    return [(low + high * F.lit(j)) % F.lit(bits) for j in range(HASHES)]


def _filter(keys: DataFrame, n: int, level: int) -> tuple[DataFrame, int]:
    """One row with the words of a filter of ``keys``, and its bits."""
    words = -(-max(n, 1) * BITS // 64)
    set_bits = keys.select(F.explode(F.array(*_positions(F.col("key"), level, words * 64))).alias("b")).select(
        F.expr("b div 64").alias("i"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("w")
    )
    blank = keys.sparkSession.range(words).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
    rows = set_bits.unionByName(blank).groupBy("i").agg(F.bit_or("w").alias("w"))
    in_order = F.array_sort(F.collect_list(F.struct("i", "w")))
    return materialize(rows.agg(F.transform(in_order, lambda x: x.w).alias("words")), "urls-filter"), words * 64


def _passes(key: Column, words: Column, level: int, bits: int, start: int = 0) -> Column:
    """Whether all bits of a key are set in the filter that begins at ``start`` (in words)."""
    tests = [
        F.getbit(F.get(words, F.shiftright(p, 6).cast("int") + start), (p % 64).cast("int")) == 1
        for p in _positions(key, level, bits)
    ]
    return reduce(lambda a, b: a & b, tests)


class Cascade:
    """Exact membership in ``listed`` for the keys of ``universe`` (each a
    table with the column ``key``; repeated and null keys do not matter)."""

    def __init__(self, listed: DataFrame, universe: DataFrame):
        inside = materialize(listed.where("key is not null").select("key").distinct(), "urls-listed")
        n = inside.count()
        parts, self.levels = [], []
        words, bits = _filter(inside, n, 1)
        passed = universe.where("key is not null").select("key", F.lit(False).alias("listed"))
        passed = passed.where(_passes(F.col("key"), words.scalar(), 1, bits))
        # what passes the first filter: the listed keys and few others, told apart by grouping
        both = materialize(
            passed.unionByName(inside.select("key", F.lit(True).alias("listed"))).groupBy("key").agg(F.max("listed").alias("listed")),
            "urls-passed",
        )
        start, level, turn = 0, 1, False
        while True:
            self.levels.append((level, bits, start))
            parts.append(words)
            start += bits // 64
            left = both.where(F.col("listed") == F.lit(turn))
            n = left.count()
            if not n:
                break
            level += 1
            words, bits = _filter(left, n, level)
            # the side just encoded stays whole, of the other what the new filter lets through
            kept = materialize(both.where((F.col("listed") == F.lit(turn)) | _passes(F.col("key"), words.scalar(), level, bits)), "urls-passed")
            discard(both)
            both, turn = kept, not turn
        spark = inside.sparkSession
        self.table = materialize(spark.range(1).select(F.concat(*[p.scalar() for p in parts]).alias("words")), "urls-cascade")
        for t in (*parts, both, inside):
            discard(t)

    def holds(self, key: Column) -> Column:
        """The first filter that a key does not pass decides."""
        words = self.table.scalar()
        found = F.lit(len(self.levels) % 2 == 1)
        for level, bits, start in reversed(self.levels):
            found = F.when(~_passes(key, words, level, bits, start), F.lit(level % 2 == 0)).otherwise(found)
        return F.when(key.isNotNull(), found).otherwise(F.lit(False))


def _key(host: Column, path: Column, labels: Column | int, size: Column | int) -> Column:
    """The last ``labels`` labels of a host and the first ``size`` characters
    of a path; null where they have fewer."""
    count = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    labels, size = (x if isinstance(x, Column) else F.lit(x) for x in (labels, size))
    tail = F.array_join(F.slice(F.split(host, "[.]"), -labels, labels), ".")
    fits = (count >= labels) & (F.length(path) >= size)
    return F.when(fits, F.concat(tail, F.substring(path, F.lit(1), size)))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """The verdict on every url: that of the longest rule that fits.

    ``rules``: host, path, verdict (allow or block).  A rule fits its host and
    all subdomains if the url's path starts with the rule's; of equally long
    rules the one with the longer host counts, of one rule with both verdicts
    block.  What no listed key fits gets ``otherwise``.  Rules without a host
    or verdict are left out; a null path is an empty one.

    Returns page_id, host, path, rule (host and path as one string, null if
    none fits), verdict.  Null urls and those without ``://`` have an empty
    host and path, which no rule fits.  Repeated pages and ids are judged row
    by row; long urls are read whole; an empty table gives no rows, and
    without rules all get ``otherwise``.  Other columns are not looked at.

    A list of up to MOST_BYTES (some 20 million keys) and MOST_SHAPES goes
    through the cascade; a longer one is joined with the distinct keys.
    """
    rules = materialize(
        rules.select(
            F.translate(F.col("host"), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
        )
        .where("host <> '' and verdict in ('allow', 'block')")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.concat("host", "path").alias("key"), "verdict",
            F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("size"), F.length("host").alias("hosts"),
        ),
        "urls-rules",
    )
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    shapes = rules.select("labels", "size").distinct().orderBy("labels", "size").limit(MOST_SHAPES + 1).collect()
    if len(shapes) > MOST_SHAPES or rules.count() * BITS > 8 * MOST_BYTES:
        return _joined(urls, rules, otherwise)
    if not shapes:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    host, path = F.col("host"), F.col("path")
    names = [f"k{i}" for i in range(len(shapes))]
    keyed = urls.select("page_id", "host", "path", *[_key(host, path, s.labels, s.size).alias(n) for s, n in zip(shapes, names)])
    universe = keyed.select(F.explode(F.array_compact(F.array(*names))).alias("key")).distinct()
    listed = Cascade(rules, universe)
    blocked = Cascade(rules.where("verdict = 'block'"), rules.where("verdict = 'allow'"))
    fits = [
        F.when(listed.holds(F.col(n)), F.struct(F.length(n).alias("n"), (F.length(n) - F.lit(s.size)).alias("h"), F.col(n).alias("key")))
        for s, n in zip(shapes, names)
    ]
    best = keyed.select("page_id", "host", "path", F.array_max(F.array(*fits))["key"].alias("rule"))
    verdict = F.when(F.col("rule").isNull(), F.lit(otherwise)).when(blocked.holds(F.col("rule")), "block").otherwise("allow")
    return best.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _joined(urls: DataFrame, rules: DataFrame, otherwise: str) -> DataFrame:
    """The same for lists that no task can hold: distinct hosts and paths are
    cut to the shapes of the rules and joined with them."""
    shapes = rules.select("labels", "size").distinct().agg(F.collect_list(F.struct("labels", "size")).alias("shapes"))
    places = urls.select("host", "path").distinct()
    cut = places.select("host", "path", F.explode(materialize(shapes, "urls-shapes").scalar()).alias("s"))
    key = _key(F.col("host"), F.col("path"), F.col("s.labels"), F.col("s.size"))
    found = (
        cut.select("host", "path", key.alias("key")).where("key is not null")
        .join(rules.select("key", "verdict", "hosts"), "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("key").alias("n"), F.col("hosts").alias("h"), "key", "verdict")).alias("best"))
    )
    return urls.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def oracle_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return f"""
WITH rules(h, p, v) AS (VALUES {rules}),
rest AS (
  SELECT row_number() OVER () AS rid, page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT rid, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (
  SELECT rid, arg_max(struct_pack(rule := h || p, v := v), length(h || p)) AS best
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (rid)
"""
