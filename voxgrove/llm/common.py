"""Shared plumbing: tables, scratch tables, bounded Arrow batches, word splitting, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch handed to Python, so that a batch of long texts stays small.
BATCH_ROWS = 1000

#: Java and DuckDB form of the contracts' word pattern: everything but these six separators.
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this subpackage to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    name = f"{tempfile.mkdtemp(prefix='voxgrove-')}/voxgrove_llm.zip"
    with zipfile.ZipFile(name, "w") as z:
        z.writestr("voxgrove/__init__.py", "")
        for f in sorted(here.glob("*.py")):
            z.write(f, f"voxgrove/llm/{f.name}")
    sc.addPyFile(name)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a plain local master may fall back to a temporary folder; on a cluster a
    missing setting is an error, since executors would not see each other's files.
    """
    ship(spark)
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="voxgrove-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch
        pass


#: Scratch tables of this process that are not known to be deleted, in order of making.
_MADE: list[str] = []


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Cut lineage with a table in the shared folder; after a loss of executors it is reread.

    The folder stays until ``release``, or ``cleanup`` of the session's folder: a lazy
    result may still read it.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/voxgrove-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def free(spark: SparkSession) -> None:
    """Have the files of ended shuffles deleted now: Spark drops them when the driver's collector finds
    that nothing refers to them, which may be long after."""
    spark._jvm.System.gc()


def made() -> int:
    """A mark for ``release_since``."""
    return len(_MADE)


def release_since(spark: SparkSession, mark: int, keep: DataFrame) -> None:
    """Delete the scratch tables made since the mark, but for ``keep``, which is a table itself."""
    for path in _MADE[mark:]:
        if path != keep._scratch:
            delete(spark, path)
    _MADE[mark:] = [keep._scratch]


def cleanup(spark: SparkSession) -> None:
    """Delete all scratch tables of this session; call it when its results are written."""
    delete(spark, f"{scratch_dir(spark)}/voxgrove-{spark.sparkContext.applicationId}")


def release(df: DataFrame) -> None:
    """Delete the folder of a scratch table that nothing reads any more."""
    if hasattr(df, "_scratch"):
        delete(df.sparkSession, df._scratch)


#: doc_id of rows that have none, in keys and in the order of rows: before all others.
NO_ID = -(1 << 63)


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns ``d`` and ``row``, never null, that tell rows apart: the doc_id, and a hash of the
    text. Only rows that agree in both have the same key."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64(F.col(text).cast("string")).alias("row")]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow by ``BATCH_ROWS`` rows. Spark bounds the bytes of a batch; no setting is changed."""
    ship(df.sparkSession)

    def run(batches):
        yield from fn(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, max(1, b.num_rows), BATCH_ROWS))
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give freed memory back, as workers live on after their task; where the platform can't, nothing."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def lean() -> None:
    """Have arrays of over a megabyte given back as soon as they are freed, whatever the heap's state."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    if option:
        option(-3, 1 << 20)  # M_MMAP_THRESHOLD


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once per row, whatever the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased UTF-8 words; bytes.split() separates at exactly \\x20 and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def spread(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that buckets taken from it are even."""
    h = h.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pack(a: np.ndarray) -> bytes:
    """Integers as zstd of their byte planes: high planes of small numbers cost nothing."""
    a = np.ascontiguousarray(a, dtype="<i8")
    return len(a).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = zstandard.ZstdDecompressor().decompress(b[8:], max_output_size=max(1, 8 * n))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<i8").ravel()


def components(pairs: DataFrame, name: str, rounds: int = 100) -> DataFrame:
    """(id, component_id) of every id in ``pairs(a, b)``: the smallest id reachable.

    Alternating large-star and small-star rounds; each is a group minimum joined back
    on its key, so no neighbour list is ever gathered. The minima are scratch tables, so
    that both sides of the join have exchanges of their own and a hot hub's rows can be
    split. Each round is a scratch table. Null or equal ends are ignored. Rounds that run out
    raise an error.
    """
    spark = pairs.sparkSession
    sums = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
    e = saved(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    old = sums(e)
    for turn in range(rounds + 1):
        if not old[0]:
            break
        if turn == rounds:
            raise RuntimeError(f"components of {name} are not complete after {rounds} rounds")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), name)
        large = both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = saved(large, name)
        release(low)
        low = saved(large.groupBy("a").agg(F.min("b").alias("m")), name)
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = saved(small.distinct(), name)
        now = sums(new)
        for x in (large, low, e):
            release(x)
        e = new
        if now == old:
            break
        old = now
    roots = e.select(F.col("b").alias("id")).distinct()
    out = e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots.select("id", F.col("id").alias("component_id")))
    return out
