"""Registered queries on runs, annotations, truth and dashboards, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as agr
from ..operators import ranking
from ..sources.tracks import TRACKS_SQL, from_events
from .evaluation import BOXES, MOT, RANKED, _boxes, _mot, _ranked, _read, _vectors


def _tracks(spark, d):
    return from_events(_read(spark, d, "events"))


def run_sequences(spark, d):
    b = _boxes(spark, d)
    return agr.sequences(b.where("det_id % 5 < 3 AND frame % 3 > 0"), b.where("det_id % 5 > 1 AND frame % 4 > 0"), ["cam_id", "frame"])


def track_lifetimes(spark, d):
    return agr.lifetimes(_mot(spark, d), ["seq", "id"], "frame")


def track_run_agreement(spark, d):
    """Two runs with ids and whole frames missing, one moved a little; some
    frames are empty in both."""
    m = _mot(spark, d).selectExpr("seq", "frame", "id", "x AS x1", "y AS y1", "x + w AS x2", "y + h AS y2")
    other = m.where("(id + frame) % 7 > 0 AND frame % 9 > 0").selectExpr("seq", "frame", "id", "x1 + id % 3 AS x1", "y1", "x2", "y2 - frame % 2 AS y2")
    frames = m.selectExpr("seq", "explode(array(frame, -frame)) AS frame")
    return agr.track_agreement(m.where("(id + frame) % 11 > 0"), other, ["seq", "frame"], frames)


def _moved(spark, d):
    """A detector's boxes, and those of another that misses some and has the
    others a little off, with unit vectors."""
    vectors = _read(spark, d, "embeddings").selectExpr("vec_id AS v", "embedding AS e")
    n = vectors.count()
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = vectors.select("v", F.transform("e", lambda x: x / size).alias("embedding"), F.transform("e", lambda x: -x / size).alias("back"))
    boxes = _boxes(spark, d).withColumn("v", F.col("det_id") % n).join(unit, "v")
    b = boxes.where("det_id % 7 > 0").selectExpr(
        "cam_id", "frame", "det_id", "x1 + det_id % 3 AS x1", "y1 - det_id % 2 AS y1", "x2 + det_id % 3 AS x2", "y2", "conf * 0.96875D AS conf",
        "CASE WHEN det_id % 50 = 1 THEN back ELSE embedding END AS embedding",
    )
    return boxes.where("det_id % 11 > 0"), b


def detector_agreement(spark, d):
    a, b = _moved(spark, d)
    return agr.detector_agreement(a, b, _boxes(spark, d).selectExpr("cam_id", "explode(array(frame, frame + 1000000)) AS frame"), 0.7)


def run_similarity(spark, d):
    return agr.run_similarity(*_moved(spark, d), 0.7)


def reid_cmc(spark, d):
    """Share of queries whose first hit is within each rank up to ten."""
    first = ranking.first_hits(_vectors(spark, d), F.col("vec_id") % 50 == 0)
    ranks = F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank")
    return first.select("first", ranks).groupBy("rank").agg(F.round(F.avg((F.col("first") <= F.col("rank")).cast("double")), 6).alias("cmc"))


def reid_scores_labels(spark, d):
    """Score and label pairs of a ROC curve; scores are rounded as SQL rounds
    them, by their multiple of 10^5."""
    return _ranked(spark, d).select("q", "vec_id", (F.round(F.col("cos") * 1e5) / 1e5).alias("score"), F.col("hit").cast("int").alias("label"))


def reid_random_gallery(spark, d):
    return agr.random_gallery(_vectors(spark, d), F.col("vec_id") % 50 == 0, 10)


def image_psnr(spark, d):
    p = _read(spark, d, "part").selectExpr("p_brand", "CAST(p_size AS DOUBLE) AS a", "p_retailprice % 50 AS b")
    error = p.groupBy("p_brand").agg(F.avg((F.col("a") - F.col("b")) ** 2).alias("e"))
    return error.select("p_brand", F.round(agr.psnr(F.col("e")), 6).alias("psnr"))


def unit_vectors(spark, d):
    """Vectors over their length; the length's own vector stays without one."""
    v = _read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    size = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x))
    unit = v.withColumn("s", size).select("vec_id", F.transform("e", lambda x: x / F.greatest("s", F.lit(1e-12))).alias("e"))
    return unit.select("vec_id", F.round(F.col("e")[0], 6).alias("first"), F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def track_confidence(spark, d):
    """Confidence of a track by its age and the frames it was unseen."""
    return _read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CAST(l_orderkey % 12 AS INT)").alias("age"), F.col("l_linenumber").alias("unseen")).select(
        "l_orderkey", "l_linenumber", F.round(F.when(F.col("age") < 7, F.pow(F.lit(0.9), 7 - F.col("age"))).otherwise(F.pow(F.lit(0.9), F.col("unseen") - 1)), 9).alias("confidence")
    )


def diagonal_distance(spark, d):
    """Squared distance of detections from tracks over the tracks' variances."""
    b = _boxes(spark, d).selectExpr("cam_id", "frame", "det_id", "array((x1 + x2) / 2, (y1 + y2) / 2, y2 - y1, (x2 - x1) / (y2 - y1)) AS z", "array(10D + det_id % 5, 10D, 4D, 1e-2D) AS p")
    pairs = b.alias("a").join(b.alias("b"), F.expr("a.cam_id = b.cam_id AND a.frame = b.frame AND a.det_id < b.det_id"))
    part = "aggregate(zip_with(zip_with(a.z, b.z, (x, y) -> (x - y) * (x - y)), a.p, (x, v) -> x / v), 0D, (s, x) -> s + x)"
    return pairs.select(F.col("a.det_id").alias("trk_id"), F.col("b.det_id").alias("det_id"), F.round(F.expr(part), 6).alias("d2"))


def _annotations(spark, d):
    return _read(spark, d, "events").selectExpr("concat('s', user_id % 3) AS seq", "event_id AS frame", "user_id AS id", "CAST(event_id % 5 > 0 AS INT) AS flag", "CAST(event_id % 12 + 1 AS INT) AS class")


def annotation_classes(spark, d):
    return agr.pedestrians(_annotations(spark, d)).select("seq", "frame", "id", "category")


def annotation_tracks(spark, d):
    rows = agr.pedestrians(_annotations(spark, d)).select("seq", "frame", (F.col("id") % 40).alias("id"))
    return agr.renumbered(rows, "seq", ["id", "frame"]).select("seq", "frame", "id", "track")


def annotation_boxes(spark, d):
    a = _read(spark, d, "lineitem").selectExpr(
        "l_orderkey % 50 AS image_id", "l_orderkey", "l_linenumber", "l_quantity * 20 - 100 AS bx", "l_extendedprice % 700 - 50 AS by", "l_quantity * 4 - 20 AS bw", "l_extendedprice % 90 AS bh",
        "l_quantity - 3 AS area",
    )
    images = spark.range(50).selectExpr("id AS image_id", "640D AS width", "480D AS height")
    out = agr.boxes_of(a, images)
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


def crowd_annotations(spark, d):
    """Crowd annotations from JSON lines, ignored ones marked as crowds."""
    lines = _read(spark, d, "events").selectExpr("event_id", "to_json(named_struct('ID', event_id, 'gtboxes', array(named_struct('tag', CASE WHEN event_id % 4 = 0 THEN 'mask' ELSE 'person' END, 'ignore', IF(event_id % 6 = 0, 1, 0))))) AS value")
    parsed = lines.select(F.from_json("value", "ID bigint, gtboxes array<struct<tag:string,ignore:int>>").alias("j"))
    each = parsed.select(F.col("j.ID").alias("event_id"), F.explode("j.gtboxes").alias("g"))
    return each.select("event_id", F.when((F.col("g.tag") != "person") | (F.col("g.ignore") == 1), 1).otherwise(0).alias("iscrowd"))


def mot_file_lines(spark, d):
    m = _mot(spark, d).withColumns({"id": F.col("id") - 3, "conf": F.lit(0.875), "x": F.col("x") + 0.25})
    return agr.mot_lines(m)


def coco_document(spark, d):
    """Images of each sequence as one JSON list, in frame order."""
    one = F.struct("frame", F.concat_ws("/", "seq", F.format_string("%06d.jpg", "frame")).alias("file_name"))
    return _mot(spark, d).select("seq", "frame").distinct().groupBy("seq").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(one))), 256).alias("sha"), F.count("*").alias("images"))


def foot_points(spark, d):
    """Foot points of boxes, from the size they were found at to the source's."""
    b = _boxes(spark, d).where("frame % 50 <> 7")  # frames that were skipped
    return b.select("det_id", F.expr("(x1 + x2) / 2 * (1920D / 800D)").alias("u"), F.expr("y2 * (1080D / 600D)").alias("v"))


def _agents(spark, d):
    return _mot(spark, d).selectExpr("concat(seq, ':', id) AS agent", "frame - 78800 AS frame", "x", "y", "w / 100 AS speed")


def truth_onset(spark, d):
    return agr.onset(_agents(spark, d), "agent", 0.8, 2)


def truth_crossings(spark, d):
    return agr.first_crossing(_agents(spark, d), "agent", (500.0, 200.0), (500.0, 800.0))


def truth_density(spark, d):
    """Agents in a zone by frame and the peak of all."""
    inside = "CASE WHEN x >= 2e2D AND x < 8e2D AND y >= 1e2D AND y < 9e2D THEN 1 ELSE 0 END"
    n = _agents(spark, d).groupBy("frame").agg(F.sum(F.expr(inside)).alias("n"), F.avg(F.expr(f"CASE WHEN {inside} = 1 THEN speed END")).alias("v"))
    return n.agg(F.max("n").alias("peak"), F.round(F.max("n") / F.lit(48.0), 3).alias("peak_density"), F.round(F.max("v"), 3).alias("peak_speed"))


def live_dashboard(spark, d):
    return agr.dashboard(_tracks(spark, d), 3_000_000, 5.0, 400.0, F.lit(25.0), (0.6, 0.8))


def density_units(spark, d):
    c = _read(spark, d, "customer").where("c_custkey > 0")
    col = lambda e: F.expr(f"CAST({e} AS DOUBLE)")
    value, unit = agr.area_density(F.col("c_nationkey"), col("CASE WHEN c_custkey % 3 = 0 THEN c_custkey END"), col("c_custkey % 5 * 100000"), col("c_custkey % 2 * 40"))
    return c.select("c_custkey", value.alias("density"), unit.alias("unit"))


def objects_by_speed(spark, d):
    o = _tracks(spark, d).groupBy("cam_id", "gid").agg(F.round(F.when(F.count("*") > 5, F.avg("u")), 6).alias("speed"))
    return agr.speed_order(o, "speed", "cam_id")


ROUTE = [(0.0, 0.0), (300.0, 0.0), (300.0, 400.0), (900.0, 400.0)]


def route_positions(spark, d):
    e = _read(spark, d, "events").selectExpr("event_id", "CAST(event_id * 37 % 1500 AS DOUBLE) AS s")
    return e.withColumn("p", F.expr(agr.polyline_position(ROUTE, "s"))).select("event_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


def segment_crossings(spark, d):
    e = _read(spark, d, "events").selectExpr("event_id", "CAST(event_id * 7919 % 1000 AS DOUBLE) AS x1", "CAST(event_id * 104729 % 1000 AS DOUBLE) AS y1", "CAST(event_id * 31 % 1000 AS DOUBLE) AS x2", "CAST(event_id * 17 % 1000 AS DOUBLE) AS y2")
    return e.where(agr.segments_meet(("x1", "y1"), ("x2", "y2"), (500.0, 200.0), (450.0, 800.0))).select("event_id")


def positions_between(spark, d):
    rows = _tracks(spark, d).select("gid", "ts_us", "event_id", F.col("u").alias("x"), F.col("v").alias("y"))
    span = rows.agg(F.expr("min(ts_us) div 500000 + 1").alias("a"), F.expr("max(ts_us) div 500000").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b")).alias("k")).select((F.col("k") * 500_000).alias("at_us"))
    out = agr.between_snapshots(rows, ["gid"], grid)
    return out.select("gid", "at_us", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def lite_frames(spark, d):
    """Observations as a replay sends them: rounded, with seconds."""
    return _tracks(spark, d).select("event_id", F.round(F.col("ts_us") / F.lit(1e6), 3).alias("ts"), F.round(F.col("u") + 0.26, 1).alias("x"), F.round(F.col("v") / 3, 1).alias("y"), F.round("conf", 3).alias("conf"))


_AG = f"{MOT}, ag AS (SELECT seq || ':' || CAST(id AS VARCHAR) AS agent, frame - 78800 AS frame, x, y, w / 100 AS speed FROM mt)"
_AN = "an AS (SELECT 's' || CAST(user_id % 3 AS VARCHAR) AS seq, event_id AS frame, user_id AS id, event_id % 12 + 1 AS class FROM events WHERE event_id % 5 > 0 AND event_id % 12 + 1 NOT IN (3, 4, 5, 6, 9, 10, 11))"
_DASH = f"""{TRACKS_SQL}, db0 AS (SELECT cam_id, ts_us // 1000000 AS frame, gid, max({{'t': ts_us, 'e': event_id, 'u': u, 'v': v}}) AS m FROM tracks GROUP BY ALL),
df AS (SELECT cam_id, frame, max(m.t) AS t, row_number() OVER (PARTITION BY cam_id ORDER BY frame) AS f FROM db0 GROUP BY cam_id, frame),
db1 AS (SELECT cam_id, gid, f, t, m.u AS u, m.v AS v, CASE WHEN f - lag(f) OVER (PARTITION BY cam_id, gid ORDER BY f) > 1 THEN 1 ELSE 0 END AS gap FROM db0 JOIN df USING (cam_id, frame)),
db2 AS (SELECT *, sum(gap) OVER (PARTITION BY cam_id, gid ORDER BY f ROWS UNBOUNDED PRECEDING) AS isle FROM db1),
db3 AS (SELECT *, min({{'t': t, 'u': u, 'v': v}}) OVER (PARTITION BY cam_id, gid, isle ORDER BY t RANGE BETWEEN 3000000 PRECEDING AND CURRENT ROW) AS o, min(t) OVER (PARTITION BY cam_id, gid, isle) AS since FROM db2),
db4 AS (SELECT *, sqrt((u - o.u) * (u - o.u) + (v - o.v) * (v - o.v)) AS far, (t - o.t) / 1e6 AS dt FROM db3),
db5 AS (SELECT *, CASE WHEN dt > 0 AND far >= 5 THEN far / dt ELSE 0 END AS speed FROM db4),
db6 AS (SELECT *, coalesce(abs(speed - lag(speed) OVER w) / nullif((t - lag(t) OVER w) / 1e6, 0), 0) AS accel, CASE WHEN far > 0 THEN round((u - o.u) / far * 0.6::DOUBLE + (v - o.v) / far * 0.8::DOUBLE, 3) END AS align FROM db5 WINDOW w AS (PARTITION BY cam_id, gid, isle ORDER BY f))"""
_P = "CASE WHEN s <= 300 THEN {0} WHEN s <= 700 THEN {1} WHEN s <= 1300 THEN {2} ELSE {3} END"

#: Two detectors' boxes and the pairs of one id, which overlap most.
_MOVED = """ra AS (SELECT * FROM boxes WHERE det_id % 11 <> 0),
rb AS (SELECT cam_id, frame, det_id, x1 + det_id % 3 AS x1, y1 - det_id % 2 AS y1, x2 + det_id % 3 AS x2, y2, conf * 0.96875e0 AS conf FROM boxes WHERE det_id % 7 <> 0),
pq AS (SELECT ra.cam_id, ra.frame, ra.det_id, greatest(0, least(ra.x2, rb.x2) - greatest(ra.x1, rb.x1)) * greatest(0, least(ra.y2, rb.y2) - greatest(ra.y1, rb.y1)) AS inter,
  (ra.x2 - ra.x1) * (ra.y2 - ra.y1) AS one, (rb.x2 - rb.x1) * (rb.y2 - rb.y1) AS two, greatest(abs(ra.x1 - rb.x1), abs(ra.y1 - rb.y1), abs(ra.x2 - rb.x2), abs(ra.y2 - rb.y2)) AS off,
  abs(ra.conf - rb.conf) AS dc FROM ra JOIN rb USING (cam_id, frame, det_id)),
pr AS (SELECT *, inter / (one + two - inter) AS o FROM pq WHERE inter / (one + two - inter) > 0.7e0)"""

ORACLE = {
    "run_sequences": f"WITH {BOXES}, o AS (SELECT DISTINCT cam_id, frame FROM boxes WHERE det_id % 5 < 3 AND frame % 3 > 0), t AS (SELECT DISTINCT cam_id, frame FROM boxes WHERE det_id % 5 > 1 AND frame % 4 > 0) SELECT (SELECT count(*) FROM (FROM o INTERSECT FROM t)) AS shared, (SELECT count(*) FROM (FROM o EXCEPT FROM t)) AS first_only, (SELECT count(*) FROM (FROM t EXCEPT FROM o)) AS second_only",
    "track_lifetimes": f"WITH {MOT}, l AS (SELECT max(frame) - min(frame) + 1 AS n FROM mt GROUP BY seq, id) SELECT count(*) AS tracks, round(avg(n), 6) AS mean, round(median(n), 6) AS median, max(n) AS longest FROM l",
    "track_run_agreement": f"""WITH {MOT},
a AS (SELECT seq, frame, id, x, y, x + w AS p, y + h AS q FROM mt WHERE (id + frame) % 11 <> 0),
b AS (SELECT seq, frame, id, x + id % 3 AS x, y, x + w AS p, y + h - frame % 2 AS q FROM mt WHERE (id + frame) % 7 <> 0 AND frame % 9 <> 0),
fr AS (SELECT DISTINCT seq, frame FROM mt UNION SELECT seq, -frame FROM mt),
sz AS (SELECT seq, frame, (SELECT count(*) FROM a WHERE a.seq = fr.seq AND a.frame = fr.frame) AS n, (SELECT count(*) FROM b WHERE b.seq = fr.seq AND b.frame = fr.frame) AS m FROM fr),
cm AS (SELECT a.seq, a.frame, count(*) AS c, max(greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.p - b.p), abs(a.q - b.q))) AS off FROM a JOIN b USING (seq, frame, id) GROUP BY a.seq, a.frame),
al AS (SELECT *, abs(n - m) AS more, CASE WHEN n = 0 AND m = 0 THEN 1 WHEN n > 0 AND m > 0 THEN coalesce(c, 0) / (n + m - coalesce(c, 0)) END AS rate FROM sz LEFT JOIN cm USING (seq, frame)),
r AS (SELECT round(avg(rate), 6) AS id_rate, round(max(off), 6) AS coord_max, round(avg(off), 6) AS coord_mean, max(more) AS count_max, round(avg(more), 6) AS count_mean FROM al)
SELECT *, CASE WHEN id_rate >= 0.99 AND coord_max < 2 THEN 'identical' WHEN id_rate >= 0.95 AND coord_max < 5 THEN 'negligible' WHEN id_rate >= 0.9 THEN 'minor' ELSE 'significant' END AS verdict FROM r""",
    "detector_agreement": f"""WITH {BOXES}, {_MOVED},
al AS (SELECT DISTINCT cam_id, frame FROM boxes UNION SELECT cam_id, frame + 1000000 FROM boxes),
sz AS (SELECT *, (SELECT count(*) FROM ra WHERE ra.cam_id = al.cam_id AND ra.frame = al.frame) AS n, (SELECT count(*) FROM rb WHERE rb.cam_id = al.cam_id AND rb.frame = al.frame) AS m,
  (SELECT count(*) FROM pr WHERE pr.cam_id = al.cam_id AND pr.frame = al.frame) AS c FROM al)
SELECT (SELECT round(max(off), 6) FROM pr) AS coord_max, (SELECT round(avg(off), 6) FROM pr) AS coord_mean, (SELECT round(avg(dc), 6) FROM pr) AS conf_mean, round(avg(abs(n - m)), 6) AS count_mean,
  max(abs(n - m)) AS count_max, round(avg(CASE WHEN n = 0 AND m = 0 THEN 1 WHEN n > 0 AND m > 0 THEN c / greatest(n, m) END), 6) AS match_rate FROM sz""",
    "run_similarity": f"""WITH {BOXES}, {_MOVED},
vn AS (SELECT vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS sq, (SELECT count(*) FROM embeddings) AS total FROM embeddings),
sh AS (SELECT cam_id, frame FROM ra INTERSECT SELECT cam_id, frame FROM rb),
sz AS (SELECT *, (SELECT count(*) FROM ra WHERE ra.cam_id = sh.cam_id AND ra.frame = sh.frame) AS n, (SELECT count(*) FROM rb WHERE rb.cam_id = sh.cam_id AND rb.frame = sh.frame) AS m,
  (SELECT count(*) FROM pr WHERE pr.cam_id = sh.cam_id AND pr.frame = sh.frame) AS c FROM sh),
pc AS (SELECT pr.*, CASE WHEN sq > 0 THEN CASE WHEN det_id % 50 = 1 THEN -1e0 ELSE 1e0 END END AS cos FROM pr JOIN vn ON vec_id = det_id % total),
ps AS (SELECT count(*) AS matched, round(avg(o), 6) AS iou_mean, round(quantile_cont(o, 0.05), 6) AS iou_p5, round(min(o), 6) AS iou_min, round(avg(dc), 6) AS conf_mean, round(max(dc), 6) AS conf_max,
  count(cos) AS embedded, round(avg(cos), 6) AS cos_mean, round(quantile_cont(cos, 0.05), 6) AS cos_p5, round(quantile_cont(cos, 0.01), 6) AS cos_p1, round(min(cos), 6) AS cos_min FROM pc),
ss AS (SELECT count(*) AS frames, CAST(sum(n) AS BIGINT) AS n_a, CAST(sum(m) AS BIGINT) AS n_b, round(avg(c / greatest(n, m)), 6) AS frame_rate FROM sz)
SELECT ss.*, ps.*, round(2 * matched / (n_a + n_b), 6) AS dice, 2 * matched / (n_a + n_b) > 0.95 AND iou_mean > 0.9 AS detections_pass, cos_mean > 0.98 AS embeddings_pass FROM ss, ps""",
    "reid_cmc": f"WITH {RANKED}, f AS (SELECT q, min(rank) AS first FROM rk WHERE hit GROUP BY q) SELECT CAST(r AS INTEGER) AS rank, round(avg(CASE WHEN first <= r THEN 1e0 ELSE 0e0 END), 6) AS cmc FROM f, range(1, 11) AS t(r) GROUP BY r",
    "reid_scores_labels": f"WITH {RANKED} SELECT q, vec_id, round(cos, 5) AS score, CAST(hit AS INTEGER) AS label FROM rk",
    "reid_random_gallery": f"WITH {RANKED}, tr AS (SELECT t, q, label AS pid, vec_id, hit, cos, row_number() OVER (PARTITION BY t, q, label ORDER BY md5('0:' || CAST(t AS VARCHAR) || ':' || CAST(vec_id AS VARCHAR)), vec_id) AS nth FROM rk JOIN embeddings USING (vec_id), range(10) AS z(t)), pk AS (SELECT * FROM tr WHERE nth = 1), tp AS (SELECT t, q, max(cos) AS top FROM pk WHERE hit GROUP BY ALL), rn AS (SELECT tp.t, tp.q, count(pk.cos) + 1 AS rank FROM tp LEFT JOIN pk ON pk.t = tp.t AND pk.q = tp.q AND NOT pk.hit AND pk.cos > top GROUP BY tp.t, tp.q) SELECT "
    + ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1e0 ELSE 0e0 END), 6) AS cmc{k}" for k in (1, 5, 10)) + ", count(*) AS n FROM rn",
    "image_psnr": "SELECT p_brand, round(10 * log10(65025 / avg((p_size - p_retailprice % 50) * (p_size - p_retailprice % 50))), 6) AS psnr FROM part GROUP BY p_brand",
    "unit_vectors": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), n AS (SELECT *, sqrt(list_dot_product(e, e)) AS s FROM v) SELECT vec_id, round(e[1] / s, 6) AS first, round(list_sum([x / s FOR x IN e]), 6) AS total FROM n",
    "track_confidence": "SELECT l_orderkey, l_linenumber, round(pow(0.9::DOUBLE, CASE WHEN l_orderkey % 12 < 7 THEN 7 - l_orderkey % 12 ELSE l_linenumber - 1 END), 9) AS confidence FROM lineitem",
    "diagonal_distance": f"WITH {BOXES} SELECT a.det_id AS trk_id, b.det_id AS det_id, round(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) / (10 + a.det_id % 5) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2) / 10 + pow(a.y2 - a.y1 - (b.y2 - b.y1), 2) / 4 + pow((a.x2 - a.x1) / (a.y2 - a.y1) - (b.x2 - b.x1) / (b.y2 - b.y1), 2) / 0.01::DOUBLE, 6) AS d2 FROM boxes a JOIN boxes b ON a.cam_id = b.cam_id AND a.frame = b.frame AND a.det_id < b.det_id",
    "annotation_classes": f"WITH {_AN} SELECT seq, frame, id, CAST(CASE WHEN class IN (2, 7, 8, 12) THEN -1 ELSE 1 END AS INTEGER) AS category FROM an",
    "annotation_tracks": f"WITH {_AN} SELECT seq, frame, id % 40 AS id, dense_rank() OVER (PARTITION BY seq ORDER BY id % 40) AS track FROM an",
    "annotation_boxes": "WITH b AS (SELECT l_orderkey, l_linenumber, greatest(0, l_quantity * 20 - 100) AS x1, greatest(0, l_extendedprice % 700 - 50) AS y1, greatest(0, l_quantity * 4 - 21) AS w, greatest(0, l_extendedprice % 90 - 1) AS h FROM lineitem WHERE l_quantity > 3), c AS (SELECT l_orderkey, l_linenumber, x1, y1, least(639, x1 + w) AS x2, least(479, y1 + h) AS y2 FROM b) SELECT l_orderkey, l_linenumber, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM c WHERE x2 >= x1 AND y2 >= y1",
    "crowd_annotations": "SELECT event_id, CAST(event_id % 4 = 0 OR event_id % 6 = 0 AS INTEGER) AS iscrowd FROM events",
    "mot_file_lines": f"WITH {MOT} SELECT seq, frame, id - 3 AS id, CAST(frame AS VARCHAR) || ',' || CAST(id - 3 AS VARCHAR) || ',' || printf('%.1f', round(x + 0.25, 1)) || ',' || printf('%.1f', y) || ',' || printf('%.1f', w) || ',' || printf('%.1f', h) || ',0.88,-1,-1,-1' AS line FROM mt WHERE id >= 3",
    "coco_document": f"WITH {MOT}, fr AS (SELECT DISTINCT seq, frame FROM mt) SELECT seq, sha256('[' || string_agg('{{\"frame\":' || CAST(frame AS VARCHAR) || ',\"file_name\":\"' || seq || '/' || printf('%06d', frame) || '.jpg\"}}', ',' ORDER BY frame) || ']') AS sha, count(*) AS images FROM fr GROUP BY seq",
    "foot_points": f"WITH {BOXES} SELECT det_id, (x1 + x2) / 2 * (1920e0 / 800e0) AS u, y2 * (1080e0 / 600e0) AS v FROM boxes WHERE frame % 50 <> 7",
    "truth_onset": f"WITH {_AG}, fs AS (SELECT a.agent, a.frame FROM ag a JOIN ag b ON a.agent = b.agent AND b.frame = a.frame + 1 WHERE a.speed >= 0.8 AND b.speed >= 0.8) SELECT agent, min(frame) AS onset FROM fs GROUP BY agent",
    "truth_crossings": f"WITH {_AG}, sd AS (SELECT *, lag(x) OVER (PARTITION BY agent ORDER BY frame) AS px FROM ag) SELECT agent, min(frame) AS frame FROM sd WHERE (px - 500) * (x - 500) < 0 AND y BETWEEN 140 AND 860 GROUP BY agent",
    "truth_density": f"WITH {_AG}, zz AS (SELECT frame, count(*) FILTER (WHERE x >= 200 AND x < 800 AND y >= 100 AND y < 900) AS n, avg(speed) FILTER (WHERE x >= 200 AND x < 800 AND y >= 100 AND y < 900) AS v FROM ag GROUP BY frame) SELECT max(n) AS peak, round(max(n) / 48, 3) AS peak_density, round(max(v), 3) AS peak_speed FROM zz",
    "live_dashboard": f"WITH {_DASH}, dd AS (SELECT cam_id, count(*) AS n, round(avg(speed), 1) AS avg_speed, round(max(speed), 1) AS max_speed, round(avg(accel), 2) AS accel, count(*) FILTER (WHERE speed > 400) AS moving, round(avg((t - since) / 1e6), 1) AS avg_dwell, round(max((t - since) / 1e6), 1) AS max_dwell, round(avg(align) FILTER (WHERE speed > 400), 3) AS avg_align FROM db6 WHERE f = (SELECT max(f) FROM df WHERE df.cam_id = db6.cam_id) GROUP BY cam_id) SELECT dd.*, (SELECT count(DISTINCT gid) FROM tracks WHERE tracks.cam_id = dd.cam_id) AS cumulative, n - moving AS stationary, round(100 * moving / n, 0) AS moving_ratio, round(n / 25, 3) AS density, CASE WHEN round(n / 25, 3) < 0.4 THEN 'Low' WHEN round(n / 25, 3) < 1 THEN 'Normal' ELSE 'High' END AS level FROM dd",
    "density_units": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN round(c_nationkey / c_custkey, 3) WHEN c_custkey % 5 > 0 AND c_custkey % 2 > 0 THEN round(c_nationkey / (c_custkey % 5 * 100000 / 1600), 3) WHEN c_custkey % 5 > 0 THEN round(c_nationkey / (c_custkey % 5 * 0.1::DOUBLE), 2) ELSE 0 END AS density, CASE WHEN c_custkey % 3 = 0 OR (c_custkey % 5 > 0 AND c_custkey % 2 > 0) THEN '/m2' WHEN c_custkey % 5 > 0 THEN '/Mpx' ELSE '-' END AS unit FROM customer WHERE c_custkey > 0",
    "objects_by_speed": f"WITH {TRACKS_SQL}, o AS (SELECT cam_id, gid, round(CASE WHEN count(*) > 5 THEN avg(u) END, 6) AS speed FROM tracks GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY cam_id ORDER BY speed DESC NULLS LAST, gid) AS place FROM o",
    "route_positions": f"WITH e AS (SELECT event_id, CAST(event_id * 37 % 1500 AS DOUBLE) AS s FROM events) SELECT event_id, {_P.format('s', '300e0', 's - 400', '900e0')} AS x, {_P.format('0e0', 's - 300', '400e0', '400e0')} AS y FROM e",
    "segment_crossings": "WITH e AS (SELECT event_id, event_id * 7919 % 1000 AS px, event_id * 104729 % 1000 AS py, event_id * 31 % 1000 AS qx, event_id * 17 % 1000 AS qy FROM events), m AS (SELECT *, (px - 500) * 600 + (py - 200) * 50 AS s1, (qx - 500) * 600 + (qy - 200) * 50 AS s2, (qx - px) * (200 - py) - (qy - py) * (500 - px) AS s3, (qx - px) * (800 - py) - (qy - py) * (450 - px) AS s4 FROM e) SELECT event_id FROM m WHERE sign(s1) * sign(s2) < 0 AND sign(s3) * sign(s4) < 0",
    "positions_between": f"WITH {TRACKS_SQL}, n AS (SELECT gid, ts_us, u, v, lead(ts_us) OVER w AS t1, lead(u) OVER w AS u1, lead(v) OVER w AS v1 FROM tracks WINDOW w AS (PARTITION BY gid ORDER BY ts_us, event_id)), g AS (SELECT unnest(range((SELECT min(ts_us) FROM tracks) // 500000 + 1, (SELECT max(ts_us) FROM tracks) // 500000 + 1)) * 500000 AS at_us) SELECT gid, at_us, round(u + (at_us - ts_us) / (t1 - ts_us) * (u1 - u), 6) AS x, round(v + (at_us - ts_us) / (t1 - ts_us) * (v1 - v), 6) AS y FROM n JOIN g ON at_us >= ts_us AND at_us < t1",
    "lite_frames": f"WITH {TRACKS_SQL} SELECT event_id, round(ts_us / 1e6, 3) AS ts, round(u + 0.26::DOUBLE, 1) AS x, round(v / 3, 1) AS y, round(conf, 3) AS conf FROM tracks",
}

QUERIES = {
    f.__name__: f
    for f in (
        run_sequences, track_lifetimes, track_run_agreement, detector_agreement, run_similarity, reid_cmc, reid_scores_labels, reid_random_gallery, image_psnr, unit_vectors,
        track_confidence, diagonal_distance, annotation_classes, annotation_tracks, annotation_boxes, crowd_annotations, mot_file_lines,
        coco_document, foot_points, truth_onset, truth_crossings, truth_density, live_dashboard, density_units, objects_by_speed,
        route_positions, segment_crossings, positions_between, lite_frames,
    )
}
