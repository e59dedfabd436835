"""Recorded sessions and frame dumps as Spark data sources.

``session_db``: a SQLite file a session, tables ``tracks`` (call_seq, ts,
cam_id, local_id, u, v, conf) and ``meta`` (key, JSON value).  ``frame_dump``: an
npz file a frame.  Files are in a folder that driver and executors mount.  Reads
are split by file, files by their names are left out where a filter asks for
others, and long recordings are split by row.  Tasks write beside the final
names; the driver renames what all tasks finished and removes the rest, so a
reader sees whole files and a failed write leaves none.
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
    WriterCommitMessage,
)

TRACKS = "session_id string, call_seq bigint, ts double, cam_id string, local_id bigint, u double, v double, conf double"
FRAMES = "seq bigint, name string, shape array<int>, data array<double>"
FIELDS = ("call_seq", "ts", "cam_id", "local_id", "u", "v", "conf")
#: Rows of a recording, and files of a dump, that one task reads.
ROWS, FILES = 500_000, 64
#: Rows that a recorder holds before it writes them.
BUFFER = 500


def mounted(path: str) -> str:
    """The local name of a folder; other stores cannot hold these files."""
    if re.match(r"^[a-z0-9]+:", path) and not path.startswith("file:"):
        raise ValueError(f"recordings and dumps need a mounted folder, not {path}")
    return re.sub(r"^file:/+", "/", path)


@dataclass
class Part(InputPartition):
    files: list
    low: int = 0
    high: int = 0


@dataclass
class Done(WriterCommitMessage):
    files: list  # (temporary name, final name)


def _keeps(filters: list[Filter], column: str, value) -> bool:
    tests = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
             LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
    return all(tests[type(f)](value, f.value) for f in filters if f.attribute == (column,) and f.value is not None)


class _Reader(DataSourceReader):
    column = ""

    def __init__(self, options):
        self.path, self.filters = mounted(options["path"]), []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In)
        for f in filters:
            if isinstance(f, known) and f.attribute == (self.column,) and (type(f) is not In or all(v is not None for v in f.value)):
                self.filters.append(f)  # a name decides it, so rows need not be asked again
            else:
                yield f

    def named(self, pattern: str) -> list[tuple]:
        """(value, file) of files that match, in the order of their names."""
        found = ((re.fullmatch(pattern, n), n) for n in sorted(os.listdir(self.path)))
        named = [(self.value(m[1]), os.path.join(self.path, n)) for m, n in found if m]
        return [(v, n) for v, n in named if _keeps(self.filters, self.column, v)]

    @staticmethod
    def value(text: str):
        return text


class SessionReader(_Reader):
    column = "session_id"

    def __init__(self, options):
        super().__init__(options)
        self.rows = int(options.get("rows", ROWS))

    def partitions(self):
        parts = []
        for session, name in self.named(r"(.+)\.db"):
            with sqlite3.connect(f"file:{name}?mode=ro", uri=True) as con:
                last = con.execute("SELECT max(rowid) FROM tracks").fetchone()[0] or 0
            con.close()
            parts += [Part([(session, name)], low, low + self.rows) for low in range(0, last, self.rows)]
        return parts or [Part([])]

    def read(self, part: Part):
        for session, name in part.files:
            con = sqlite3.connect(f"file:{name}?mode=ro", uri=True)
            try:
                asked = f"SELECT {', '.join(FIELDS)} FROM tracks WHERE rowid > ? AND rowid <= ? ORDER BY rowid"
                for row in con.execute(asked, (part.low, part.high)):
                    yield (session, *row)
            finally:
                con.close()


class FrameReader(_Reader):
    column = "seq"

    @staticmethod
    def value(text: str):
        return int(text)

    def partitions(self):
        named = self.named(r"frame_([0-9]+)\.npz")
        return [Part(named[k : k + FILES]) for k in range(0, len(named), FILES)] or [Part([])]

    def read(self, part: Part):
        for seq, name in part.files:
            with np.load(name, allow_pickle=False) as arrays:
                for key in sorted(arrays.files):
                    a = arrays[key]
                    yield (seq, key, [int(n) for n in a.shape], a.astype(float).ravel().tolist())


class _Writer(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = mounted(options["path"]), overwrite, uuid.uuid4().hex

    def target(self, name: str) -> tuple[str, str]:
        os.makedirs(self.path, exist_ok=True)
        return os.path.join(self.path, f".{self.job}-{uuid.uuid4().hex}.tmp"), os.path.join(self.path, name)

    def commit(self, messages) -> None:
        files = [pair for m in messages if m for pair in m.files]
        names = [final for _, final in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several tasks wrote the same file: rows of one file must lie in one partition")
        if self.overwrite and os.path.isdir(self.path):
            for name in os.listdir(self.path):
                if not name.startswith(".") and os.path.join(self.path, name) not in names:
                    os.remove(os.path.join(self.path, name))
        for temporary, final in files:
            os.replace(temporary, final)
        self.abort(messages)  # what attempts that failed have left

    def abort(self, messages) -> None:
        if os.path.isdir(self.path):
            for name in os.listdir(self.path):
                if name.startswith(f".{self.job}-"):
                    os.remove(os.path.join(self.path, name))


class SessionWriter(_Writer):
    """Rows of a session must come together, in the order of their calls."""

    def write(self, rows) -> Done:
        files, con, now, buffer, count, calls = [], None, None, [], 0, 0

        def flush():
            con.executemany("INSERT INTO tracks VALUES (?, ?, ?, ?, ?, ?, ?)", buffer)
            con.commit()
            buffer.clear()

        def finish():
            flush()
            con.executemany("INSERT INTO meta VALUES (?, ?)", [("call_count", json.dumps(calls)), ("track_row_count", json.dumps(count))])
            con.execute("CREATE INDEX idx_tracks_seq ON tracks(call_seq)")
            con.commit()
            con.close()

        last = None
        for row in rows:
            if row["session_id"] != now:
                if con:
                    finish()
                now, last, count, calls = row["session_id"], None, 0, 0
                files.append(self.target(f"{now}.db"))
                con = sqlite3.connect(files[-1][0])
                con.execute("CREATE TABLE tracks (call_seq INTEGER, ts REAL, cam_id TEXT, local_id INTEGER, u REAL, v REAL, conf REAL)")
                con.execute("CREATE TABLE meta (key TEXT PRIMARY KEY, value TEXT)")
            calls, last = calls + (row["call_seq"] != last), row["call_seq"]
            count += 1
            buffer.append(tuple(row[f] for f in FIELDS))
            if len(buffer) >= BUFFER:
                flush()
        if con:
            finish()
        return Done(files)


class FrameWriter(_Writer):
    """Arrays of a frame must come together."""

    def write(self, rows) -> Done:
        files, now, arrays = [], None, {}

        def finish():
            files.append(self.target(f"frame_{now:09d}.npz"))
            with open(files[-1][0], "wb") as f:
                np.savez(f, **arrays)
            arrays.clear()

        for row in rows:
            if row["seq"] != now:
                if arrays:
                    finish()
                now = row["seq"]
            arrays[row["name"]] = np.array(row["data"], float).reshape(row["shape"])
        if arrays:
            finish()
        return Done(files)


class SessionDb(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_db"

    def schema(self) -> str:
        return TRACKS

    def reader(self, schema):
        return SessionReader(self.options)

    def writer(self, schema, overwrite: bool):
        return SessionWriter(self.options, overwrite)


class FrameDump(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_dump"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema):
        return FrameReader(self.options)

    def writer(self, schema, overwrite: bool):
        return FrameWriter(self.options, overwrite)


def _known(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(SessionDb)
    spark.dataSource.register(FrameDump)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def read_sessions(spark: SparkSession, path: str, rows: int = ROWS) -> DataFrame:
    """The rows of all recordings in a folder; call_seq orders a session."""
    return _known(spark).read.format("session_db").option("path", path).option("rows", rows).load()


def write_sessions(tracks: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each session of ``tracks`` (as TRACKS), which is a task's
    work as the format has one writer a file; rows go through a buffer.  Rows
    without a session are no recording."""
    _known(tracks.sparkSession)
    named = [f.split()[0] for f in TRACKS.split(", ")]
    rows = tracks.where("session_id IS NOT NULL").select(*named).repartition("session_id").sortWithinPartitions("session_id", "call_seq", "local_id")
    rows.write.format("session_db").mode(mode).save(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return _known(spark).read.format("frame_dump").option("path", path).load()


def write_frames(frames: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each seq of ``frames`` (as FRAMES)."""
    _known(frames.sparkSession)
    rows = frames.where("seq IS NOT NULL").select("seq", "name", "shape", "data").repartition("seq").sortWithinPartitions("seq", "name")
    rows.write.format("frame_dump").mode(mode).save(path)
