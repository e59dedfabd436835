"""Registered queries on result documents and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results, session, summary
from ..operators.observations import KEY
from ..sources.tracks import TRACKS_SQL, from_events
from ..streaming import live
from . import crowd
from .site import SITE

S = SITE
_PERSON = "array<struct<gid: string, route: int, duration: double, max_deviation: double, epfi: double>>"
_RESULT = f"totals struct<cbs_total: double, epfi_avg: double, sei: double, persons: bigint>, elapsed_sec double, bottlenecks array<struct<zone: string, cbs: double, risk: string>>, persons {_PERSON}, exits array<struct<exit_id: string, n_out: bigint>>"


def _written(spark, d):
    """Documents of all sessions, written and read back as text."""
    facts = crowd._facts(spark, d)
    counts = session.with_density(session.tick_counts(facts["states"], facts["grid"], S, S.bottlenecks), S)
    path = live.fresh_folder(spark)
    results.write(results.documents(results.results(facts, S), results.timelines(counts), 5), path)
    return spark.read.schema("value string, session_id string, floor_id string, kind string").text(path)


def result_documents(spark, d):
    """Each session's numbers as its document tells them."""
    r = _written(spark, d).where("kind = 'result'").select(*KEY, F.from_json("value", _RESULT).alias("r"))
    return r.select(
        *KEY, "r.elapsed_sec", "r.totals.cbs_total", "r.totals.epfi_avg", "r.totals.sei", F.size("r.persons").cast("bigint").alias("persons"),
        F.array_join(F.transform("r.bottlenecks", lambda b: F.concat_ws(":", b.zone, b.risk)), ",").alias("risks"),
        F.aggregate("r.exits", F.lit(0).cast("bigint"), lambda s, x: s + x.n_out).alias("passed"),
    )


def timeline_documents(spark, d):
    """Samples of the timelines, with a map of densities."""
    t = _written(spark, d).where("kind = 'timeline'").select(*KEY, F.explode(F.from_json("value", "timeline array<struct<k: bigint, people: bigint, density: map<string,double>>>")["timeline"]).alias("t"))
    return t.select(*KEY, "t.k", "t.people", F.explode("t.density").alias("zone", "rho"))


def digest_documents(spark, d):
    kind = f"verdict string, worst_bottleneck struct<cbs: double, zone: string>, worst_persons {_PERSON}, timeline array<struct<k: bigint>>"
    g = _written(spark, d).where("kind = 'digest'").select(*KEY, F.from_json("value", kind).alias("g"))
    return g.select(
        *KEY, "g.verdict", F.col("g.worst_bottleneck.cbs").alias("worst_cbs"), F.array_join("g.worst_persons.gid", ",").alias("worst"),
        F.array_join(F.transform("g.timeline.k", lambda k: k.cast("string")), ",").alias("points"),
    )


def live_summaries(spark, d):
    facts = crowd._facts(spark, d)
    counts = session.with_density(session.tick_counts(facts["states"], facts["grid"], S, S.bottlenecks), S)
    return results.live_summary(facts, counts, S)


def visitor_estimates(spark, d):
    """Different objects of each floor, counted, and whether their sketches by
    second, merged, come within four standard errors."""
    t = from_events(spark.read.parquet(f"{d}/events.parquet"))
    sketches = summary.visitor_sketches(t.withColumn("w", F.expr("ts_us div 1000000")), ["floor_id", "w"], "gid")
    exact = t.groupBy("floor_id").agg(F.countDistinct("gid").alias("n"))
    near = F.abs(F.col("visitors") - F.col("n")) <= 4 * summary.sketch_error() * F.col("n")
    return summary.visitors(sketches, ["floor_id"]).join(exact, "floor_id").select("floor_id", "n", near.alias("near"))


QUERIES = {f.__name__: f for f in (result_documents, timeline_documents, digest_documents, live_summaries, visitor_estimates)}
_SAME = "q.session_id = fa.session_id AND q.floor_id = fa.floor_id"
ORACLE = {
    "visitor_estimates": f"WITH {TRACKS_SQL} SELECT floor_id, count(DISTINCT gid) AS n, true AS near FROM tracks GROUP BY floor_id",
    "result_documents": f"""WITH {crowd.FACTS} SELECT session_id, floor_id, (t1 - t0) / 1e6 AS elapsed_sec, cbs_total, epfi_avg, sei, CAST(persons AS BIGINT) AS persons, CAST(passed AS BIGINT) AS passed,
  (SELECT string_agg(zone || ':' || risk, ',' ORDER BY zone) FROM cb q WHERE {_SAME}) AS risks FROM fa""",
    "timeline_documents": f"WITH {crowd.COUNTS} SELECT session_id, floor_id, k, CAST(sum(n) OVER (PARTITION BY session_id, floor_id, k) AS BIGINT) AS people, zone, round(rho, 4) AS rho FROM held",
    "digest_documents": f"""WITH {crowd.FACTS}, wp AS (SELECT *, row_number() OVER (PARTITION BY session_id, floor_id ORDER BY epfi, gid) AS place FROM ep WHERE epfi IS NOT NULL),
tl AS (SELECT session_id, floor_id, k, row_number() OVER (PARTITION BY session_id, floor_id ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY session_id, floor_id) AS n FROM tick)
SELECT session_id, floor_id, CASE WHEN dropped_ratio >= 0.30 OR tracks < 10 THEN 'insufficient' WHEN dropped_ratio >= 0.15 OR (t1 - t0) / 1e6 < 30 THEN 'caution' ELSE 'ok' END AS verdict,
  (SELECT max(cbs) FROM cb q WHERE {_SAME}) AS worst_cbs, coalesce((SELECT string_agg(gid, ',' ORDER BY place) FROM wp q WHERE place <= 8 AND {_SAME}), '') AS worst,
  (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM tl q WHERE {_SAME} AND (n <= 5 OR i IN (0, n // 5, 2 * n // 5, 3 * n // 5, 4 * n // 5))) AS points FROM fa JOIN qu USING (session_id, floor_id)""",
    "live_summaries": f"""WITH {crowd.FACTS}, lk AS (SELECT *, max(k) OVER (PARTITION BY session_id, floor_id) AS top FROM held),
ls AS (SELECT session_id, floor_id, max(k) AS k, CAST(sum(n) AS BIGINT) AS people, round(max(rho), 4) AS densest FROM lk WHERE k = top GROUP BY ALL)
SELECT session_id, floor_id, round((t1 - t0) / 1e6, 1) AS elapsed_sec, sei, round(cbs_total, 2) AS cbs_total, epfi_avg, zones_started, zones_total, k, people, densest FROM fa LEFT JOIN ls USING (session_id, floor_id)""",
}
