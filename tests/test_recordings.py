"""Recordings and dumps: rows come back, names prune, failed writes leave nothing."""

import os
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from floorflow.sources import recordings as rec

ROWS = [(f"s{k % 3}", k // 6, k / 10, f"c{k % 2}", k, k + 0.5, -1.0, 0.25) for k in range(2600)]


@pytest.fixture()
def sessions(spark):
    return spark.createDataFrame([ROWS[5], *reversed(ROWS), (None, *ROWS[0][1:])], rec.TRACKS)


def test_sessions_round_trip(spark, sessions, tmp_path):
    path = f"file://{tmp_path}/rec"
    rec.write_sessions(sessions, path)
    assert sorted(os.listdir(tmp_path / "rec")) == ["s0.db", "s1.db", "s2.db"]
    back = rec.read_sessions(spark, path, rows=100)
    assert sorted(map(tuple, back.collect())) == sorted([*ROWS, ROWS[5]]) and back.rdd.getNumPartitions() == 27
    with sqlite3.connect(tmp_path / "rec" / "s2.db") as con:
        assert [r[0] for r in con.execute("SELECT call_seq FROM tracks")] == sorted(r[1] for r in [*ROWS, ROWS[5]] if r[0] == "s2")
        calls = len({r[1] for r in ROWS if r[0] == "s2"})
        assert dict(con.execute("SELECT key, value FROM meta")) == {"call_count": str(calls), "track_row_count": str(1 + sum(r[0] == "s2" for r in ROWS))}
    rec.write_sessions(sessions.where("session_id = 's1' AND call_seq < 3"), path)  # one session is replaced, the others stay
    assert {r.session_id: r["count"] for r in rec.read_sessions(spark, path).groupBy("session_id").count().collect()} == {"s0": 867, "s1": 6, "s2": 867}
    rec.write_sessions(sessions.where("session_id = 's2'"), path, "overwrite")
    assert os.listdir(tmp_path / "rec") == ["s2.db"]


def test_names_decide_which_files_are_opened(spark, sessions, tmp_path):
    path = str(tmp_path)
    rec.write_sessions(sessions, path)
    (tmp_path / "s0.db").write_bytes(b"no recording")  # would fail if it were opened
    for asked in ("session_id = 's1'", "session_id in ('s1', 's9')", "session_id > 's0' and session_id < 's2'"):
        assert {r.session_id for r in rec.read_sessions(spark, path).where(asked).select("session_id").distinct().collect()} == {"s1"}
    assert rec.read_sessions(spark, path).where("session_id = 's7'").count() == 0
    assert rec.read_sessions(spark, path).where("session_id = 's2' and local_id < 10").count() == 4


def test_a_failed_write_leaves_nothing(spark, sessions, tmp_path):
    path = tmp_path / "rec"
    rec.write_sessions(sessions.where("session_id = 's0'"), str(path))
    before = (path / "s0.db").read_bytes()
    broken = sessions.withColumn("u", F.when(F.col("local_id") == 2500, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("u") + 1))
    with pytest.raises(Exception, match="broken"):
        rec.write_sessions(broken, str(path))
    assert os.listdir(path) == ["s0.db"] and (path / "s0.db").read_bytes() == before


def test_frames_round_trip(spark, tmp_path):
    rng = np.random.default_rng(3)
    arrays = {(seq, name): rng.normal(size=shape) for seq in range(150) for name, shape in (("pred", (seq % 4, 5)), ("size", ()))}
    rows = [(seq, name, list(a.shape), a.ravel().tolist()) for (seq, name), a in arrays.items()]
    rec.write_frames(spark.createDataFrame(rows, rec.FRAMES), str(tmp_path))
    assert len(os.listdir(tmp_path)) == 150
    back = rec.read_frames(spark, str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(rows) and back.rdd.getNumPartitions() == 3
    with np.load(tmp_path / "frame_000000007.npz") as held:
        assert (held["pred"] == arrays[7, "pred"]).all() and held["size"].shape == ()
    (tmp_path / "frame_000000100.npz").write_bytes(b"torn")
    assert back.where("seq < 100 and seq >= 98").select("seq").distinct().count() == 2
    assert {r.seq for r in back.where("seq = 7 and name = 'pred'").collect()} == {7}


def test_other_stores_are_refused(spark, sessions):
    with pytest.raises(ValueError, match="mounted"):
        rec.mounted("s3a://bucket/rec")
    assert rec.mounted("file:///a/b") == "/a/b" == rec.mounted("/a/b")
