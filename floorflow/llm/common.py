"""Helpers shared by the training-data operators.

Words are maximal runs of characters other than space and ``\\x09-\\x0D``,
which is what ``bytes.split()`` gives; lower-casing touches A-Z only, which is
what ``bytes.lower()`` does.  Texts therefore travel to Python tasks as binary.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: Bytes up to which a small side is broadcast; beyond it, Spark shuffles.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that a Python task handles at once.
CHUNK_BYTES = 4 << 20
#: Rows of texts in an Arrow batch, held by the JVM and the Python task alike.
BATCH_ROWS = 1000
#: The setting by which a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN: dict[str, str] = {}
#: Where the tables that materialize returned are.
_WRITTEN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).
    Where it is unset, a local session gets a folder of its own; a cluster has
    none that all can read, which is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        found = _OWN["dir"]
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    sizes are known to the planner, and a lost executor loses nothing.  The
    shuffle files of the write, which nothing reads again, go at its end.
    Columns named as ``folders`` divide the table, so that reads for one of
    their values leave the rest alone."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/floorflow/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.partitionBy(*folders).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, which nothing reads any
    more; other tables are left alone."""
    path = _WRITTEN.pop(df, None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send fewer rows at once to Python tasks than Spark's 10,000, as whole
    texts are long; a session that has another number set keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def _width(name: str, kind: DataType) -> Column:
    """Bytes of one value, roughly as a row holds it."""
    if isinstance(kind, (StringType, BinaryType)):
        return 16 + F.coalesce(F.octet_length(name), F.lit(0))
    if isinstance(kind, ArrayType):
        fields = len(kind.elementType.fields) if isinstance(kind.elementType, StructType) else 1
        return 24 + 8 * (fields + (fields > 1)) * F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0))
    return F.lit(8 * len(kind.fields) + 16 if isinstance(kind, StructType) else 8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a materialized table for broadcast if its measured bytes allow it;
    leave the join to Spark otherwise."""
    each = sum((_width(f.name, f.dataType) for f in df.schema.fields), F.lit(16))
    held = df.agg(F.sum(each).alias("bytes")).first()
    return F.broadcast(df) if (held.bytes or 0) <= most else df


def draw(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """At most ``n`` rows of a materialized table, those with the least hash of
    ``key``; rows with one key count once.  Only some 2 n rows, those below a
    bound on the hash, are sorted, whatever the table's size."""
    h = F.xxhash64(*key)
    below = (h / F.lit(2.0**64) + 0.5) * rows.count() < 2 * n + 1000
    return rows.where(below).dropDuplicates(list(key)).orderBy(h, *key).limit(n)


def label_of(labels: DataFrame) -> DataFrame:
    """doc_id and quality (0 or 1), a row for each id; of several labels of
    one id the lower counts, other values and null ids do not."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as make it differ
    from all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of an id written as text, modulo ``mod`` (null ids: of '')."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def binary_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).cast("binary")


class WordHash(dict):
    """word -> 8 bytes of a 64-bit hash; a bounded cache."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        value = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        if len(self) < self.limit:
            self[word] = value
        return value


WORD_HASH = WordHash()

#: Caches of Python workers, emptied when a task ends.
CACHES: list[dict] = [WORD_HASH]


def release() -> None:
    """Give memory that a Python task no longer uses back to the system."""
    for cache in CACHES:
        cache.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def released(run):
    """A task function that ends by giving its memory back: Spark keeps Python
    workers, which would else hold it through all later stages."""

    def task(batches):
        yield from run(batches)
        release()

    return task


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(WORD_HASH.__getitem__, words)), "<u8")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the splitmix constants are fixed values)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(seed: int, n: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(base + np.uint64(seed)) | np.uint64(1)


def chunks(batches, column: str = "text", size: int | None = None):
    """Slices of record batches that hold about ``size`` (or CHUNK_BYTES)
    bytes of ``column``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(
            pa.compute.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0)
        )
        group = np.cumsum(sizes) // (size or CHUNK_BYTES)
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            if stop > start:
                yield batch.slice(start, stop - start)


def as_list(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def as_numpy(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
