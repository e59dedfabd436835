"""Registered queries on boxes, re-identification vectors and track streams,
and the same in SQL.

``embeddings`` gives the re-identification vectors; boxes and frames are integer
functions of ``events`` ids.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.window import Window

from ..functions.geometry import iou, num
from ..operators import assignment, ranking, summary
from ..sources.tracks import TRACKS_SQL, from_events


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tracks(spark, d):
    return from_events(_read(spark, d, "events"))


# ---- queries -------------------------------------------------------------


def _boxes(spark, d):
    e = _read(spark, d, "events")
    return e.selectExpr(
        "event_id div 48 AS frame", "event_id AS det_id", "concat('cam', event_id % 4) AS cam_id",
        "CAST((event_id * 7919) % 800 AS DOUBLE) AS x1", "CAST((event_id * 104729) % 800 AS DOUBLE) AS y1",
        "CAST((event_id * 7919) % 800 + 100 + (event_id * 31) % 150 AS DOUBLE) AS x2",
        "CAST((event_id * 104729) % 800 + 150 + (event_id * 17) % 200 AS DOUBLE) AS y2",
        "value / (value + 25e0) AS conf",
    )


def box_similarity(spark, d):
    return ranking.box_pairs(_boxes(spark, d))


def mahalanobis_softmax(spark, d):
    p = _boxes(spark, d).selectExpr("cam_id", "frame", "det_id % 3 AS trk_id", "det_id", "(x1 + y1) / 4e1 AS d2")
    return ranking.distance_softmax(p)


def best_detection_match(spark, d):
    b = _boxes(spark, d)
    return ranking.best_detection(b.where("det_id % 3 = 0"), b.where("det_id % 3 <> 0"), 0.1)


def _vectors(spark, d):
    return _read(spark, d, "embeddings").select(
        "vec_id", F.col("label").alias("pid"), (F.col("vec_id") % 4).alias("camid"), "embedding"
    )


def _ranked(spark, d):
    return ranking.rank_gallery(_vectors(spark, d), F.col("vec_id") % 50 == 0)


def embedding_cosine_topk(spark, d):
    first = ranking.first_of_gallery(_vectors(spark, d), F.col("vec_id") % 50 == 0, 5)
    return first.select("q", "vec_id", "rank", F.round("cos", 6).alias("cos"))


def reid_queries(spark, d):
    return ranking.reid_scores(_ranked(spark, d))


def reid_map(spark, d):
    return ranking.reid_scores(_ranked(spark, d)).agg(
        F.round(F.avg("ap"), 6).alias("map"), F.round(F.avg("inp"), 6).alias("minp"),
        *(F.round(F.avg((F.col("first_rank") <= k).cast("double")), 6).alias(f"cmc{k}") for k in (1, 5, 10)),
    )


def reid_roc_pairs(spark, d):
    return _ranked(spark, d).groupBy(F.floor((F.col("cos") + 1) * 10).cast("int").alias("bin")).agg(
        F.sum(F.col("hit").cast("long")).alias("same"), F.sum((~F.col("hit")).cast("long")).alias("other")
    )


def _mot(spark, d):
    t = _read(spark, d, "events").selectExpr(
        "concat('s', user_id % 2) AS seq", "user_id AS id",
        "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 21600000000 AS frame", "event_id",
    )
    return t.groupBy("seq", "id", "frame").agg(F.min("event_id").alias("e")).selectExpr(
        "seq", "id", "frame", "CAST((e * 7919) % 1000 AS DOUBLE) AS x", "CAST((e * 104729) % 1000 AS DOUBLE) AS y",
        "CAST(50 + (e * 31) % 150 AS DOUBLE) AS w", "CAST(80 + (e * 17) % 200 AS DOUBLE) AS h",
    )


def track_gap_interp(spark, d):
    return ranking.fill_gaps(_mot(spark, d), 5, 20)


def coco_half_split(spark, d):
    m = _mot(spark, d)
    ends = m.groupBy("seq").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"))
    half = m.join(F.broadcast(ends), "seq").withColumn("mid", F.expr("f0 + (f1 - f0 + 1) div 2"))
    return half.selectExpr(
        "seq", "id", "CASE WHEN frame < mid THEN 'train' ELSE 'val' END AS part", "CASE WHEN frame < mid THEN frame - f0 ELSE frame - mid END AS frame"
    )


def id_jaccard(spark, d):
    b = _boxes(spark, d)
    sets = b.groupBy("frame").agg(
        F.collect_set(F.expr("CASE WHEN conf > 5e-1 THEN det_id END")).alias("a"),
        F.collect_set(F.expr("CASE WHEN conf < 8e-1 THEN det_id END")).alias("b"),
    )
    both = F.size(F.array_intersect("a", "b"))
    any_ = F.size(F.array_union("a", "b"))
    return sets.select("frame", both.alias("both"), any_.alias("either"), F.round(both / F.nullif(any_, F.lit(0)), 6).alias("jaccard"))


def dice_match_rate(spark, d):
    """Pairs of two detectors that are each other's best, as a Dice rate."""
    b = _boxes(spark, d)
    p = b.where("det_id % 3 = 0").alias("a").join(b.where("det_id % 3 <> 0").alias("b"), F.expr("a.cam_id = b.cam_id AND a.frame = b.frame"))
    near = p.select(F.col("a.det_id").alias("i"), F.col("b.det_id").alias("j"), F.expr(iou("a", "b")).alias("o")).where("o > 1e-1")
    first = lambda one, two: F.row_number().over(Window.partitionBy(one).orderBy(F.desc("o"), two))
    mutual = near.withColumns({"p": first("i", "j"), "q": first("j", "i")}).where("p = 1 AND q = 1")
    found = mutual.agg(
        F.count("*").alias("matched"), F.round(F.avg("o"), 6).alias("iou_mean"), F.round(F.percentile("o", F.lit(0.05)), 6).alias("iou_p5")
    )
    return found.join(F.broadcast(b.agg(F.count("*").alias("n")))).withColumn("dice", F.round(2 * F.col("matched") / F.col("n"), 6))


def rate_window_fps(spark, d):
    return summary.frame_rate(_tracks(spark, d), "cam_id").select("event_id", "fps")


def latest_fps(spark, d):
    """Rates of cameras as told at a moment by when some had stopped."""
    t = _tracks(spark, d).withColumn("cam_id", F.concat(F.lit("c"), (F.col("event_id") % 997).cast("string")))
    span = F.col("b") - F.expr("(b - a) div 4")
    ends = t.agg(F.min("ts_us").alias("a"), F.max("ts_us").alias("b"))
    return summary.latest_rates(t.join(F.broadcast(ends)), "cam_id", span, stale_us=300_000)


def track_linear_interp(spark, d):
    """Every gap under 20 frames filled on the line, however short the track."""
    return ranking.fill_gaps(_mot(spark, d), 0, 20)


def drop_oldest_counts(spark, d):
    return summary.dropped_oldest(_tracks(spark, d), "cam_id", 64, F.expr("ts_us div 1000000"))


def ingest_window_stats(spark, d):
    t = _tracks(spark, d)
    return t.groupBy("cam_id", F.expr("ts_us div 5000000").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("conf"))


def lap_assignment(spark, d):
    b = _boxes(spark, d)
    return assignment.match_frames(b.where("det_id % 3 = 0"), b.where("det_id % 3 <> 0"), 0.05)


def nms(spark, d):
    return assignment.suppress(_boxes(spark, d), 0.2, 0.1).select("cam_id", "frame", "det_id")


def greedy_agreement(spark, d):
    """How well two detectors agree: counts, matches and differences."""
    b = _boxes(spark, d)
    one, two = b.where("det_id % 3 = 0"), b.where("det_id % 3 <> 0")
    pairs = assignment.greedy_matches(one, two, 0.1)
    return pairs.groupBy("cam_id").agg(F.count("*").alias("matched"), F.round(F.avg("iou"), 6).alias("iou"))


def tracker_run(spark, d):
    return assignment.track(_boxes(spark, d))


# ---- the same in SQL -----------------------------------------------------

BOXES = """boxes AS (SELECT 'cam' || CAST(event_id % 4 AS VARCHAR) AS cam_id, event_id // 48 AS frame, event_id AS det_id, CAST((event_id * 7919) % 800 AS DOUBLE) AS x1, CAST((event_id * 104729) % 800 AS DOUBLE) AS y1,
  CAST((event_id * 7919) % 800 + 100 + (event_id * 31) % 150 AS DOUBLE) AS x2, CAST((event_id * 104729) % 800 + 150 + (event_id * 17) % 200 AS DOUBLE) AS y2, value / (value + 25e0) AS conf FROM events)"""
_DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_COS = f"{_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')}))"
RANKED = f"""rk0 AS (SELECT a.vec_id AS q, b.vec_id, a.label = b.label AS hit, round({_COS}, 9) AS cos FROM embeddings a JOIN embeddings b
  ON a.vec_id % 50 = 0 AND NOT (a.label = b.label AND a.vec_id % 4 = b.vec_id % 4)),
rk AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cos DESC, vec_id) AS rank FROM rk0),
rs AS (SELECT q, min(rank) AS first_rank, round(avg(nth / rank), 9) AS ap, round(count(*) / max(rank), 9) AS inp
  FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank) AS nth FROM rk WHERE hit) GROUP BY q)"""
MOT = """mt0 AS (SELECT 's' || CAST(user_id % 2 AS VARCHAR) AS seq, user_id AS id, epoch_us(ts) // 21600000000 AS frame, min(event_id) AS e FROM events GROUP BY ALL),
mt AS (SELECT seq, id, frame, CAST((e * 7919) % 1000 AS DOUBLE) AS x, CAST((e * 104729) % 1000 AS DOUBLE) AS y, CAST(50 + (e * 31) % 150 AS DOUBLE) AS w, CAST(80 + (e * 17) % 200 AS DOUBLE) AS h FROM mt0)"""
_LINE = ", ".join(f"round(p.{c} + (f - p.frame) * ({c} - p.{c}) / (frame - p.frame), 6) AS {c}" for c in "xywh")


def _span(a1, a2, b1, b2):
    """What two intervals share: their lengths less the length of both together."""
    return f"greatest(0, ({a2}) - ({a1}) + ({b2}) - ({b1}) - (greatest({a2}, {b2}) - least({a1}, {b1})))"


_ONE_TWO = f"""ov0 AS (SELECT cam_id, frame, a.det_id AS i, b.det_id AS j, b.conf, {_span('a.x1', 'a.x2', 'b.x1', 'b.x2')} * {_span('a.y1', 'a.y2', 'b.y1', 'b.y2')} AS shared,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS areas FROM boxes a JOIN boxes b USING (cam_id, frame) WHERE a.det_id % 3 = 0 AND b.det_id % 3 > 0),
ov AS (SELECT i, j, conf, shared / (areas - shared) AS o FROM ov0)"""
ORACLE = {
    "box_similarity": f"""WITH {BOXES},
g0 AS (SELECT a.frame AS frame, a.det_id AS a_id, b.det_id AS b_id, 1 - b.conf AS doubt, a.x2 - a.x1 AS wa, a.y2 - a.y1 AS ha, b.x2 - b.x1 AS wb, b.y2 - b.y1 AS hb,
  a.x1 AS ax, a.x2 AS aw, a.y1 AS ay, a.y2 AS az, b.x1 AS bx, b.x2 AS bw, b.y1 AS bq, b.y2 AS bz FROM boxes a JOIN boxes b USING (cam_id, frame) WHERE a.det_id < b.det_id),
g1 AS (SELECT *, wa * doubt / 4 AS sa, ha * doubt / 4 AS ta, wb * doubt / 2 AS sb, hb * doubt / 2 AS tb FROM g0),
g2 AS (SELECT *, {_span('ax', 'aw', 'bx', 'bw')} * {_span('ay', 'az', 'bq', 'bz')} AS shared,
  {_span('ax - sa', 'aw + sa', 'bx - sb', 'bw + sb')} * {_span('ay - ta', 'az + ta', 'bq - tb', 'bz + tb')} AS softly, (wa + 2 * sa) * (ha + 2 * ta) + (wb + 2 * sb) * (hb + 2 * tb) AS areas FROM g1)
SELECT frame, a_id, b_id, round(shared / (wa * ha + wb * hb - shared), 9) AS iou, round(softly / (areas - softly), 9) AS soft,
  round(exp(0 - (greatest(wa, wb) - least(wa, wb) + greatest(ha, hb) - least(ha, hb)) / greatest(wa, wb)), 9) AS shape1,
  round(exp(least(wa, wb) / greatest(wa, wb) - 1 + least(ha, hb) / greatest(ha, hb) - 1), 9) AS shape2 FROM g2""",
    "mahalanobis_softmax": f"WITH {BOXES}, mp AS (SELECT cam_id, frame, det_id % 3 AS trk_id, det_id, (x1 + y1) / 4e1 AS d2 FROM boxes) SELECT cam_id, frame, trk_id, det_id, round(CASE WHEN d2 > 13.2767e0 THEN 0e0 ELSE exp(13.2767e0 - least(d2, 13.2767e0)) / sum(exp(13.2767e0 - least(d2, 13.2767e0))) OVER (PARTITION BY cam_id, frame, trk_id) END, 9) AS similarity FROM mp",
    "best_detection_match": f"""WITH {BOXES}, {_ONE_TWO}
SELECT cam_id, frame, t.det_id AS trk_id, round(coalesce(p.conf, 0), 9) AS score
FROM (SELECT * FROM boxes WHERE det_id % 3 = 0) t LEFT JOIN (SELECT i, arg_max(conf, {{'o': o, 'k': 0 - j}}) AS conf FROM ov WHERE o >= 0.1e0 GROUP BY i) p ON p.i = t.det_id""",
    "embedding_cosine_topk": f"WITH {RANKED} SELECT q, vec_id, CAST(rank AS INTEGER) AS rank, round(cos, 6) AS cos FROM rk WHERE rank <= 5",
    "reid_queries": f"WITH {RANKED} SELECT q, CAST(first_rank AS INTEGER) AS first_rank, ap, inp FROM rs",
    "reid_map": f"WITH {RANKED} SELECT round(avg(ap), 6) AS map, round(avg(inp), 6) AS minp, " + ", ".join(f"round(avg(CASE WHEN first_rank <= {k} THEN 1e0 ELSE 0e0 END), 6) AS cmc{k}" for k in (1, 5, 10)) + " FROM rs",
    "reid_roc_pairs": f"WITH {RANKED} SELECT CAST(floor((cos + 1) * 10) AS INTEGER) AS bin, count(*) FILTER (WHERE hit) AS same, count(*) FILTER (WHERE NOT hit) AS other FROM rk GROUP BY 1",
    "track_gap_interp": f"WITH {MOT}, mg AS (SELECT *, count(*) OVER (PARTITION BY seq, id) AS n, lag({{'frame': frame, 'x': x, 'y': y, 'w': w, 'h': h}}) OVER (PARTITION BY seq, id ORDER BY frame) AS p FROM mt), mf AS (SELECT *, unnest(range(p.frame + 1, frame)) AS f FROM mg WHERE n > 5 AND frame - p.frame > 1 AND frame - p.frame < 20) SELECT seq, frame, id, x, y, w, h, false AS made FROM mt UNION ALL SELECT seq, f, id, {_LINE}, true FROM mf",
    "track_linear_interp": f"WITH {MOT}, mg AS (SELECT *, count(*) OVER (PARTITION BY seq, id) AS n, lag({{'frame': frame, 'x': x, 'y': y, 'w': w, 'h': h}}) OVER (PARTITION BY seq, id ORDER BY frame) AS p FROM mt), mf AS (SELECT *, unnest(range(p.frame + 1, frame)) AS f FROM mg WHERE frame - p.frame > 1 AND frame - p.frame < 20) SELECT seq, frame, id, x, y, w, h, false AS made FROM mt UNION ALL SELECT seq, f, id, {_LINE}, true FROM mf",
    "latest_fps": f"""WITH {TRACKS_SQL}, en AS (SELECT max(ts_us) - (max(ts_us) - min(ts_us)) // 4 AS now FROM tracks),
lr AS (SELECT event_id % 997 AS c, ts_us, now, row_number() OVER (PARTITION BY event_id % 997 ORDER BY ts_us DESC, event_id DESC) AS back FROM tracks, en WHERE ts_us <= now)
SELECT 'c' || c AS cam_id, round(CASE WHEN max(now) - max(ts_us) <= 300000 AND max(ts_us) > min(ts_us) THEN (count(*) - 1) / ((max(ts_us) - min(ts_us)) / 1e6) ELSE 0 END, 6) AS fps FROM lr WHERE back <= 25 GROUP BY c""",
    "coco_half_split": f"WITH {MOT}, hs AS (SELECT *, min(frame) OVER (PARTITION BY seq) AS f0, max(frame) OVER (PARTITION BY seq) AS f1 FROM mt), hm AS (SELECT *, f0 + (f1 - f0 + 1) // 2 AS mid FROM hs) SELECT seq, id, CASE WHEN frame < mid THEN 'train' ELSE 'val' END AS part, CASE WHEN frame < mid THEN frame - f0 ELSE frame - mid END AS frame FROM hm",
    "id_jaccard": f"WITH {BOXES} SELECT frame, CAST(count(*) FILTER (WHERE conf > 5e-1 AND conf < 8e-1) AS INTEGER) AS both, CAST(count(*) FILTER (WHERE conf > 5e-1 OR conf < 8e-1) AS INTEGER) AS either, round(count(*) FILTER (WHERE conf > 5e-1 AND conf < 8e-1) / nullif(count(*) FILTER (WHERE conf > 5e-1 OR conf < 8e-1), 0), 6) AS jaccard FROM boxes GROUP BY frame",
    "dice_match_rate": f"""WITH {BOXES}, {_ONE_TWO},
rk AS (SELECT o, row_number() OVER (PARTITION BY i ORDER BY o DESC, j) AS p, row_number() OVER (PARTITION BY j ORDER BY o DESC, i) AS q FROM ov WHERE o > 0.1e0)
SELECT count(*) AS matched, round(avg(o), 6) AS iou_mean, round(quantile_cont(o, 0.05), 6) AS iou_p5, (SELECT count(*) FROM boxes) AS n, round(2 * count(*) / (SELECT count(*) FROM boxes), 6) AS dice FROM rk WHERE p = 1 AND q = 1""",
    "rate_window_fps": f"WITH {TRACKS_SQL}, fp AS (SELECT event_id, count(*) OVER w AS n, (ts_us - min(ts_us) OVER w) / 1e6 AS span FROM tracks WINDOW w AS (PARTITION BY cam_id ORDER BY ts_us, event_id ROWS 24 PRECEDING)) SELECT event_id, round(CASE WHEN span > 0 THEN (n - 1) / span ELSE 0e0 END, 6) AS fps FROM fp",
    "drop_oldest_counts": f"WITH {TRACKS_SQL} SELECT cam_id, ts_us // 1000000 AS batch, count(*) AS n, greatest(count(*) - 64, 0) AS dropped FROM tracks GROUP BY 1, 2",
    "ingest_window_stats": f"WITH {TRACKS_SQL} SELECT cam_id, ts_us // 5000000 AS w, count(*) AS n, round(avg(conf), 6) AS conf FROM tracks GROUP BY 1, 2",
}

QUERIES = {
    f.__name__: f
    for f in (
        box_similarity, mahalanobis_softmax, best_detection_match, embedding_cosine_topk, reid_queries, reid_map, reid_roc_pairs,
        track_gap_interp, coco_half_split, id_jaccard, dice_match_rate, rate_window_fps, latest_fps, track_linear_interp, drop_oldest_counts, ingest_window_stats,
        lap_assignment, nms, greedy_agreement, tracker_run,
    )
}
