"""Rates of cameras, newest frames, the gallery's order, shared facts."""

import random
from dataclasses import replace

from pyspark.sql import functions as F

from floorflow.operators import agreement, ranking, summary, tables
from floorflow.plans.site import SITE
from floorflow.streaming import live

ROWS = "cam_id string, ts_us bigint, event_id bigint, v int"


def test_rates_end_when_a_camera_is_stale(spark):
    s = 1_000_000
    rows = [("a", k * s // 10, k, 0) for k in range(40)] + [("b", 0, 90, 0)] + [("c", s, 91, 0), ("c", s, 92, 0)] + [("d", 9 * s, 93, 0), ("d", 10 * s, 94, 0)]
    table = spark.createDataFrame(rows, ROWS)
    rate = lambda now, stale: {r.cam_id: r.fps for r in summary.latest_rates(table, "cam_id", F.lit(now), stale_us=stale).collect()}
    assert rate(10 * s, 10 * s) == {"a": 10.0, "b": 0.0, "c": 0.0, "d": 1.0}
    assert rate(10 * s, 6 * s) == {"a": 0.0, "b": 0.0, "c": 0.0, "d": 1.0}
    assert rate(2 * s, 10 * s) == {"a": 10.0, "b": 0.0, "c": 0.0}  # what comes later is not known yet
    window = {r.cam_id: (r.last_us, r.fps) for r in summary.windowed_rates(table, "cam_id", 11 * s).collect()}
    assert window == {"a": (39 * s // 10, 3.0), "b": (0, 0.0), "c": (s, 0.2), "d": (10 * s, 0.2)}


def test_newest_rows_of_a_backlog(spark):
    rows = spark.createDataFrame([("a", 1, 1, 7), ("a", 2, 5, 8), ("a", 2, 9, None), ("b", 0, 2, 1)], ROWS)
    assert {tuple(r) for r in live.newest(rows, "cam_id").collect()} == {("a", 2, 9, None, 2), ("b", 0, 2, 1, 0)}
    assert live.newest(rows.limit(0), "cam_id").count() == 0


def test_margin_follows_the_scale():
    assert SITE.margin == 10.0 and replace(SITE, m_per_px=0.05).margin == 2.0 and replace(SITE, m_per_px=None).margin == 0.0


def test_galleries_are_met_in_blocks(spark, monkeypatch):
    vectors = spark.range(60).selectExpr("id AS vec_id", "id % 7 AS pid", "id % 3 AS camid", "array(CAST(id + 1 AS FLOAT), CAST(id * id % 11 - 5 AS FLOAT), 1.5F) AS embedding")
    whole = {tuple(r) for r in ranking.rank_gallery(vectors, F.col("vec_id") % 5 == 0).collect()}
    monkeypatch.setattr(ranking, "SENT_BYTES", 300)
    assert {tuple(r) for r in ranking.rank_gallery(vectors, F.col("vec_id") % 5 == 0).collect()} == whole and len(whole) > 600
    scored = ranking.scored_gallery(vectors, F.col("vec_id") == 10).collect()
    assert all(not (r.vec_id % 7 == 3 and r.vec_id % 3 == 1) for r in scored)


def test_tables_written_together(spark):
    got = tables.written_together(a=spark.range(5), b=spark.range(3).selectExpr("id * 2 AS x"))
    assert got["a"].count() == 5 and {r.x for r in got["b"].collect()} == {0, 2, 4}
    small, large = spark.range(10), spark.range(10)
    assert "broadcast" in tables.sent(small, F.lit(8))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in tables.sent(large, F.lit(8), 79)._jdf.queryExecution().logical().toString().lower()


def test_a_random_gallery_is_drawn_once_for_all_queries(spark):
    rng = random.Random(12)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], rng.choice([*range(5), None]) if k % 9 else 7, k % 3) for k in range(90)] + [(500, [1.0] * 4, 88, 1)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, pid int, camid bigint")
    asked = F.col("vec_id") % 5 == 0
    pairs = ranking.scored_gallery(vectors, asked).join(vectors.select("vec_id", "pid"), "vec_id")
    got = agreement.random_gallery(vectors, asked, 6)
    assert tuple(got.first()) == tuple(agreement.cuhk_scores(pairs, 6).first()) and got.first().n > 60


def test_one_block_of_queries_is_multiplied_as_a_matrix(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(5)], rng.choice([0, 1, 2, None]), k % 4) for k in range(60)]
    rows += [(61, None, 1, 2), (62, [1.0, None, 1.0, 1.0, 1.0], 1, 3), (65, [1.0] * 5, None, 1), (66, [2.0] * 5, 3, None)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, pid int, camid bigint")
    got = ranking.scored_gallery(vectors, F.col("vec_id") % 5 < 2)
    assert "BroadcastNestedLoop" not in got._jdf.queryExecution().toString()
    one = {(r.q, r.vec_id): (r.hit, r.cos) for r in got.collect()}
    monkeypatch.setattr(ranking, "SENT_BYTES", 300)
    many = {(r.q, r.vec_id): (r.hit, r.cos) for r in ranking.scored_gallery(vectors, F.col("vec_id") % 5 < 2).collect()}
    assert one == many and len(one) > 1000
    assert ranking.scored_gallery(vectors, F.col("vec_id") == -1).count() == 0
    ranked = ranking.rank_gallery(vectors, F.col("vec_id") % 5 < 2).collect()
    monkeypatch.setattr(ranking, "SENT_BYTES", 1 << 20)
    assert {tuple(r) for r in ranking.first_of_gallery(vectors, F.col("vec_id") % 5 < 2, 4).collect()} == {tuple(r) for r in ranked if r["rank"] <= 4}
    first = {q: min(r["rank"] for r in ranked if r.q == q and r.hit) for q in {r.q for r in ranked if r.hit}}
    assert {r.q: r["first"] for r in ranking.first_hits(vectors, F.col("vec_id") % 5 < 2).collect()} == first
