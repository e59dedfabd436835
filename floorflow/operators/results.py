"""Result documents of sessions: nested JSON, a document a session and floor.

Documents are built from keyed facts: each list of a document is one array of
structs, gathered by session and floor, so the parts of one document meet and
nothing else does.  Series may be long; they are written as documents of their
own, beside the result, and thinned for the digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.site import Site
from .digest import _floors
from .observations import KEY


def listed(rows: DataFrame, name: str, order: str, fields: list[str]) -> DataFrame:
    """KEY and ``name``: an array of structs of ``fields`` in ``order`` (one of them)."""
    first = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(*fields)), first).alias(name))


def results(facts: dict[str, DataFrame], site: Site) -> DataFrame:
    """KEY and result, a struct: totals, bottlenecks, zones, exits and persons."""
    totals = _floors(facts, site).join(facts["quality"].drop("warnings"), KEY, "left")
    head = totals.select(
        *KEY, "t0", "t1", F.struct("epfi_avg", "cbs_total", "sei", "zones_started", "zones_total", "persons", "passed").alias("totals"),
        F.struct("points", "dropped", "dropped_ratio", "tracks", F.split("cameras", ",").alias("cameras")).alias("quality"),
    )
    parts = (
        listed(facts["bottlenecks"], "bottlenecks", "zone", ["zone", "cbs", "over_sec", "peak", "risk"]),
        listed(facts["zones"], "zones", "zone", ["zone", "idr", "delay_sec", "participants", "status"]),
        listed(facts["exits"], "exits", "exit_id", ["exit_id", "n_in", "n_out"]),
        listed(facts["persons"], "persons", "gid", ["gid", "route", "duration", "max_deviation", "epfi"]),
    )
    for part in parts:
        head = head.join(part, KEY, "left")
    names = ["bottlenecks", "zones", "exits", "persons"]
    body = F.struct(
        F.col("session_id"), "floor_id", F.col("t0").alias("alarm_us"), ((F.col("t1") - F.col("t0")) / F.lit(1e6)).alias("elapsed_sec"), "totals", "quality", *names
    )
    return head.select(*KEY, body.alias("result"))


def timelines(counts: DataFrame) -> DataFrame:
    """KEY and timeline: an array of samples (k, people, density: a map of each
    bottleneck to its density)."""
    each = counts.groupBy(*KEY, "k").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("zone", F.round("rho", 4).alias("rho"))))).alias("density"), F.sum("n").alias("people"))
    return listed(each, "timeline", "k", ["k", "people", "density"])


def thinned(items: Column, most: int) -> Column:
    """At most ``most`` items of an array, evenly from the first on."""
    n = F.size(items)
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (i * n / most).cast("int"))
    return F.when(n <= most, items).otherwise(F.transform(places, lambda i: F.get(items, i)))


def documents(results_: DataFrame, timelines_: DataFrame, points: int = 120) -> DataFrame:
    """KEY, result (JSON), timeline (JSON) and digest (JSON: totals, verdict,
    the worst bottleneck and persons, and the timeline thinned)."""
    both = results_.withColumnRenamed("result", "told").join(timelines_.withColumnRenamed("timeline", "samples"), KEY, "left")
    r = F.col("told")
    worst = F.slice(F.array_sort(F.filter(r.persons, lambda p: p.epfi.isNotNull()), lambda a, b: F.when(a.epfi < b.epfi, -1).when(a.epfi > b.epfi, 1).when(a.gid < b.gid, -1).otherwise(1)), 1, 8)
    top = F.array_max(F.transform(r.bottlenecks, lambda b: F.struct(b.cbs.alias("cbs"), b.zone.alias("zone"))))
    verdict = (
        F.when((r.quality.dropped_ratio >= 0.30) | (r.quality.tracks < 10), "insufficient")
        .when((r.quality.dropped_ratio >= 0.15) | (r.elapsed_sec < 30), "caution")
        .otherwise("ok")
    )
    digest = F.struct(
        r.totals.alias("totals"), verdict.alias("verdict"), top.alias("worst_bottleneck"), worst.alias("worst_persons"), thinned(F.col("samples"), points).alias("timeline")
    )
    return both.select(*KEY, F.to_json("told").alias("result"), F.to_json(F.struct(F.col("samples").alias("timeline"))).alias("timeline"), F.to_json(digest).alias("digest"))


def write(docs: DataFrame, path: str) -> None:
    """A folder of JSON lines for each session and floor.  Only folders of
    these sessions are replaced; each is swapped when all rows are written."""
    rows = docs.select(*KEY, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("result", "timeline", "digest")])).alias("d"))
    text = rows.select(*KEY, "d.kind", "d.value")
    text.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEY, "kind").text(path)


def live_summary(facts: dict[str, DataFrame], counts: DataFrame, site: Site) -> DataFrame:
    """What a running session shows: elapsed seconds, SEI, CBS so far, mean
    EPFI, zones started of all, and the people and densities of its last
    sample, one row for each session and floor."""
    last = counts.withColumn("top", F.max("k").over(Window.partitionBy(*KEY))).where("k = top")
    now = last.groupBy(*KEY).agg(F.max("k").alias("k"), F.sum("n").alias("people"), F.round(F.max("rho"), 4).alias("densest"))
    floors = _floors(facts, site).select(*KEY, F.round((F.col("t1") - F.col("t0")) / F.lit(1e6), 1).alias("elapsed_sec"), "sei", F.round("cbs_total", 2).alias("cbs_total"), "epfi_avg", "zones_started", "zones_total")
    return floors.join(now, KEY, "left")
