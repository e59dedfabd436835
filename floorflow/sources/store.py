"""The configuration store: sites, cameras and floors as JSON documents.

A store is a folder of versions, each a table (site_id, kind, name, body) that
is complete when Spark has marked its write as done.  Readers take the newest
complete version, so a change is seen whole or not at all, and a writer that
dies leaves the former one in force.  Sessions lie beside the versions and no
change of the configuration touches them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BODY = "site_id string, kind string, name string, body string"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a tree of files, ``<site>/site.json``,
    ``<site>/cameras/<id>.json`` and alike, in the order of their names.  Files
    that hold no JSON object, and sites without a site.json, are left out."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
    root = "/" + re.sub(r"^[a-z0-9]+:", "", path).strip("/")
    tail = F.regexp_extract(F.url_decode(F.input_file_name()), rf"^(?:[a-z0-9]+:)?/*{re.escape(root[1:])}/(.+)\.json$", 1)
    parts = F.split(tail, "/")
    kind = F.when(F.element_at(parts, -1) == "site", "site").when(F.size(parts) == 3, F.regexp_replace(parts[1], "s$", "")).otherwise("other")
    found = whole.select(parts[0].alias("site_id"), kind.alias("kind"), F.element_at(parts, -1).alias("name"), F.col("value").alias("body"))
    valid = found.where(F.get_json_object("body", "$").startswith("{"))
    sites = valid.where("kind = 'site'").select("site_id").distinct()
    return valid.join(sites, "site_id", "left_semi").orderBy("site_id", "kind", "name")


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Complete versions, oldest first."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    found = [s.getPath() for s in files.listStatus(where)]
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def load(spark: SparkSession, root: str) -> DataFrame:
    """The documents in force."""
    done = _versions(spark, root)
    return spark.read.schema(BODY).parquet(f"{root}/versions/{done[-1]}") if done else spark.createDataFrame([], BODY)


def replaced(now: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """``now`` without what shares ``key`` with ``rows``, and ``rows``."""
    return now.join(rows.select(*key).distinct(), list(key), "left_anti").select(*[f.split()[0] for f in BODY.split(", ")]).unionByName(rows)


def commit(rows: DataFrame, root: str) -> int:
    """Put ``rows`` in force as the next version, whose number comes back.  An
    unfinished folder of that number is written anew.  One writer at a time."""
    spark = rows.sparkSession
    done = _versions(spark, root)
    number = (done[-1] if done else 0) + 1
    path = f"{root}/versions/{number}"
    rows.select("site_id", "kind", "name", "body").write.mode("overwrite").parquet(path)
    return number


def bootstrap(spark: SparkSession, root: str, seed: DataFrame) -> list[str]:
    """Take sites from the seed that the store does not have, and say which;
    sites that it has stay as they are."""
    now = load(spark, root)
    known = now.where("kind = 'site'").select("site_id")
    fresh = seed.join(seed.where("kind = 'site'").select("site_id").distinct(), "site_id", "left_semi").join(known, "site_id", "left_anti")
    names = sorted(r.site_id for r in fresh.where("kind = 'site'").select("site_id").distinct().collect())
    if names:
        commit(now.unionByName(fresh.select(*now.columns)), root)
    return names


def reset(spark: SparkSession, root: str, seed: DataFrame, site_id: str) -> bool:
    """Bring a site back to the seed exactly: documents that the seed does not
    have go.  Without the site in the seed nothing happens."""
    rows = seed.where(F.col("site_id") == site_id)
    if rows.where("kind = 'site'").isEmpty():
        return False
    now = load(spark, root)
    commit(replaced(now, rows.select(*now.columns), "site_id"), root)
    return True


def save(spark: SparkSession, root: str, rows: DataFrame) -> int:
    """Save documents; a site's ``version`` is one more than before (1 for a
    new one)."""
    now = load(spark, root)
    before = now.where("kind = 'site'").select("site_id", F.get_json_object("body", "$.version").cast("bigint").alias("v"))
    number = F.coalesce(F.col("v"), F.lit(0)) + 1
    # other fields keep their text
    raw = F.from_json("body", "map<string,variant>")
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    fields = F.transform(F.map_entries(F.map_filter(raw, lambda k, v: k != "version")), lambda e: F.concat(quoted(e.key), F.lit(":"), F.to_json(e.value)))
    body = F.concat(F.lit("{"), F.concat_ws(",", fields, F.concat(F.lit('"version":'), number.cast("string"))), F.lit("}"))
    out = rows.join(before, "site_id", "left").select("site_id", "kind", "name", F.when(F.col("kind") == "site", body).otherwise(F.col("body")).alias("body"))
    return commit(replaced(now, out, "site_id", "kind", "name"), root)
