"""Result documents: swapped by session, thinned evenly; sketches of visitors."""

import json
import os

from pyspark.sql import functions as F

from floorflow.operators import results, summary

DOCS = "session_id string, floor_id string, result string, timeline string, digest string"


def test_only_written_sessions_are_swapped(spark, tmp_path):
    path = str(tmp_path / "docs")
    results.write(spark.createDataFrame([("s1", "f0", '{"a":1}', "{}", "{}"), ("s2", "f0", '{"a":2}', "{}", "{}")], DOCS), path)
    results.write(spark.createDataFrame([("s2", "f0", '{"a":3}', "{}", "{}"), ("s2", "f1", '{"a":4}', None, "{}")], DOCS), path)
    rows = spark.read.schema("value string, session_id string, floor_id string, kind string").text(path).where("kind = 'result'").collect()
    assert {(r.session_id, r.floor_id): json.loads(r.value)["a"] for r in rows} == {("s1", "f0"): 1, ("s2", "f0"): 3, ("s2", "f1"): 4}
    assert not [n for n in os.listdir(path) if n.startswith(".spark-staging")]


def test_thinning_is_even(spark):
    for n, most in ((0, 5), (3, 5), (5, 5), (12, 5), (1001, 120)):
        got = spark.range(1).select(results.thinned(F.lit(list(range(n))) if n else F.array().cast("array<int>"), most).alias("x")).first().x
        assert got == (list(range(n)) if n <= most else [int(i * n / most) for i in range(most)])


def test_lists_are_in_order_and_hold_nulls(spark):
    rows = spark.createDataFrame([("s", "f", "b", 1.0), ("s", "f", "a", None), ("s", "g", "c", 2.0)], "session_id string, floor_id string, zone string, v double")
    got = {r.floor_id: [tuple(x) for x in r.zones] for r in results.listed(rows, "zones", "zone", ["zone", "v"]).collect()}
    assert got == {"f": [("a", None), ("b", 1.0)], "g": [("c", 2.0)]}


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(60_000).selectExpr("concat('f', id % 2) AS floor_id", "id div 6000 AS w", "concat('g', id * id % 40009) AS gid")
    sketches = summary.visitor_sketches(rows, ["floor_id", "w"], "gid")
    assert sketches.count() == 20
    for by in (["floor_id"], ["w"], []):
        exact = rows.groupBy(*by).agg(F.countDistinct("gid").alias("n"))
        got = summary.visitors(sketches, by)
        both = got.join(exact, by) if by else got.crossJoin(exact)
        assert both.count() == exact.count()
        assert all(abs(r.visitors - r.n) <= 4 * summary.sketch_error() * r.n for r in both.collect())
    assert summary.visitors(sketches.limit(0), ["floor_id"]).count() == 0
