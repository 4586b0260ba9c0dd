"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session; where that is unset and there is one machine, as
    in tests, a new folder of this process. A cluster without the setting is an error, for its executors share no other."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="specloom-checkpoint-"))
    return _own_dir[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends there, so a lost executor costs no recomputation.

    The files stay until the cluster clears its checkpoint folder.
    """
    path = os.path.join(shared_dir(df.sparkSession), f"specloom-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than this share of a table's rows is hot, so there are fewer hot keys than HOT_SHARES, whatever the table; a key
#: of at most LEAST_HOT rows never is.
HOT_SHARES, LEAST_HOT = 10_000, 100


def hot_keys(big: DataFrame, keys: list[str]) -> DataFrame | None:
    """The hot keys of `big`, with the parts that their rows are to be dealt into; None without one. `big` is counted by key in
    the tasks first, so a hot key is no burden here."""
    counts = big.groupBy(*keys).count()
    total, most = counts.agg(F.sum("count"), F.max("count")).first()
    least = max(LEAST_HOT, (total or 0) // HOT_SHARES)
    if (most or 0) <= least:
        return None
    return cut(counts.filter(F.col("count") > least).withColumn("hot_parts", F.ceil(F.col("count") / least).cast("int")).drop("count"), "hot")


def deal(big: DataFrame, hot: DataFrame | None, keys: list[str], spread: Column) -> DataFrame:
    """`big` with a column `salt`: the part of its hot key that a row is in by the hash `spread`; 0 for all other keys."""
    if hot is None:
        return big.withColumn("salt", F.lit(0))
    part = F.when(F.col("hot_parts").isNull(), 0).otherwise(F.pmod(spread, F.col("hot_parts"))).cast("int")
    return big.join(F.broadcast(hot), keys, "left").withColumn("salt", part).drop("hot_parts")


def repeat(small: DataFrame, hot: DataFrame | None, keys: list[str]) -> DataFrame:
    """`small` with a column `salt`, a row of a hot key once for each of its parts."""
    if hot is None:
        return small.withColumn("salt", F.lit(0))
    parts = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("hot_parts"), F.lit(1)) - 1))
    return small.join(F.broadcast(hot), keys, "left").withColumn("salt", parts).drop("hot_parts")


def split_hot(big: DataFrame, small: DataFrame, keys: list[str], spread: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables with a column `salt`, for a join on `keys` and `salt` that deals the rows of a hot key to many tasks. Null
    keys join with nothing, and are where a left join leaves them."""
    hot = hot_keys(big, keys)
    return deal(big, hot, keys, spread), repeat(small, hot, keys)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python 2 MB at a time: a batch is held several times over, in the JVM and in Python, by each task.

    A session that has set the size itself keeps it.
    """
    if spark.conf.get(BATCH) in ("67108864b", "64m", "64MB", "67108864"):
        spark.conf.set(BATCH, "2m")


_owner = ""
_caches: list[dict] = []


def cache() -> dict:
    """A dictionary that a worker keeps from task to task, until a task of another operator begins."""
    _caches.append({})
    return _caches[-1]


def task(owner: str) -> Callable[[Batches], Batches]:
    """Marks what a worker does with its batches as a task of an operator: the caches of others are emptied before it, and
    freed memory goes back to the system after it, so that workers that outlive a stage don't add up."""

    def mark(run: Batches) -> Batches:
        def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin(owner)
            yield from run(batches)
            release()

        return tidy

    return mark


def begin(owner: str) -> None:
    global _owner
    if _owner != owner:
        _owner = owner
        for kept in _caches:
            kept.clear()
        release()


def release() -> None:
    """Give freed memory back to the system: an idle worker's counts against its executor as well."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps what it has
        ctypes.CDLL(None).malloc_trim(0)



def doc_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text of `docs` (null text: empty), with the columns named in `more`; other columns are left behind."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)
