"""What the corpus operators share: reading tables, cutting lineage, partition counts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as a Java, RE2 and Python character class.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read whole through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in spark.checkpoint.dir. Only where that is unset, as in
    tests on one machine, a temporary folder is made and set for the session.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="trackloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


@cache
def libc() -> ctypes.CDLL | None:
    """The C library if it is glibc, told to hand freed arrays back to the system instead of keeping them for later."""
    try:
        lib = ctypes.CDLL(None)
        lib.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: larger blocks are mapped, so freeing them returns them
        lib.malloc_trim(0)
    except (AttributeError, OSError):
        return None
    return lib


def release() -> None:
    """Give memory that this Python worker has freed back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if lib := libc():
        lib.malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, which bounds what a Python worker holds at a time."""
    libc()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        release()


@contextmanager
def _removing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of a query as soon as it ends: what is written needs them no more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written to the shared folder, to cut lineage and to be read more than once.

    The folder goes when its tables are dropped or, with those that the result still reads, when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write df and read it back: later uses neither recompute it nor depend on lost executors."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with _removing_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # for drop()
        if self.n == 1:
            fs, p = self._file(self.root)
            fs.deleteOnExit(p)
        self.spark._jvm.System.gc()  # lets Spark drop the broadcasts of what has been written
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        path = getattr(df, "_scratch_path", None)
        if path:
            fs, p = self._file(path)
            fs.delete(p, True)

    def _file(self, path: str):
        """The file system of a path, and the path for it."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p


def parts(spark: SparkSession, df: DataFrame, per: int = 1) -> int:
    """Partitions for a stage over df: those it is read in, or the session's shuffle count if greater."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions() * per)


#: A key with more than this part of all rows is joined by broadcast; there are fewer than so many such keys.
COMMON = 1000


def join_spread(rows: DataFrame, one: DataFrame, on: list[str], common: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with one(on, …), a row per key, without gathering the rows of the keys in ``common`` in one task.

    common(on): the keys that more than one row in COMMON has, so there are at most COMMON of them.
    """
    few = F.broadcast(common)
    often = rows.join(few, on, "left_semi").join(F.broadcast(one.join(few, on, "left_semi")), on, how)
    return often.unionByName(rows.join(few, on, "left_anti").join(one, on, how))


def let(value: Column, body) -> Column:
    """body(value), with value computed once per row although the lambda uses it many times."""
    return F.transform(F.array(value), body)[0]


def packed_up(df: DataFrame, *named: str) -> DataFrame:
    """All columns of df as one struct ``_in``, beside those that an operator needs: no name of theirs can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_in"), *[F.col(f"`{c}`") for c in named])


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns that packed_up() put away, those in ``new`` replaced."""
    return df.select(*[new.get(c, F.col("_in")[c]).alias(c) for c in columns])


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns of these names (in any case), which an operator is about to add."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
