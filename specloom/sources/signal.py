"""Signals: tables of channel (ch), sample index (t, dense from 0) and value (x)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.config import Dataset, InvalidConfigError

SCHEMA = "ch int, t long, x double"
#: Samples that a task reads from a file at once.
SLICE = 1 << 20


def from_columns(table: DataFrame, index: str, channels: list) -> DataFrame:
    """A signal of a table that has a dense sample index: one channel for each column expression."""
    values = F.array(*(F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in channels))
    rows = table.select(F.col(index).cast("long").alias("t"), F.posexplode(values).alias("ch", "x"))
    return rows.select(F.col("ch").cast("int").alias("ch"), "t", "x")


def from_arrays(spark: SparkSession, arrays: list) -> DataFrame:
    """A signal of one-dimensional arrays in memory, one for each channel."""
    parts = [np.asarray(a, dtype=float).ravel() for a in arrays]
    ch = np.repeat(np.arange(len(parts), dtype=np.int32), [len(a) for a in parts])
    t = np.concatenate([np.arange(len(a), dtype=np.int64) for a in parts])
    return spark.createDataFrame(pa.table({"ch": ch, "t": t, "x": np.concatenate(parts)}), SCHEMA)


def from_npz(spark: SparkSession, path: str, names: list[str], limit: int | None = None) -> DataFrame:
    """A signal of arrays of an npz file on the driver; big signals belong into parquet."""
    with np.load(path, allow_pickle=False) as file:
        return from_arrays(spark, [file[name][:limit] for name in names])


def _hdf5():
    try:
        import h5py
    except ImportError as missing:
        raise InvalidConfigError("reading HDF5 needs h5py; parquet needs nothing more") from missing
    return h5py


def from_hdf5(spark: SparkSession, sources: list[Dataset]) -> tuple[DataFrame, float | None]:
    """A signal of HDF5 datasets, one for each channel, and the sampling interval that they state; needs h5py, which is optional.

    The driver reads lengths and the attribute dt alone; samples are read by tasks, SLICE at a time, so the files have to
    be where executors find them. dt is a dataset's attribute, else what its description says; None where neither does.
    Different intervals are an error.
    """
    h5py, slices, stated = _hdf5(), [], set()
    for ch, source in enumerate(sources):
        with h5py.File(source.path, "r") as file:
            found = (file[source.group] if source.group else file)[source.dataset]
            n, dt = int(np.prod(found.shape)), found.attrs.get("dt", source.dt)
            if len(found.shape) != 1 and n != max(found.shape, default=0):
                raise InvalidConfigError(f"dataset {source.dataset} has more than one dimension")
        if dt is not None:
            stated.add(float(dt))
        slices += [(ch, source.path, source.group, source.dataset, k, min(n, k + SLICE)) for k in range(0, n, SLICE)]
    if len(stated) > 1:
        raise InvalidConfigError(f"the datasets have different sampling intervals: {sorted(stated)}")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h5py = _hdf5()
        for batch in batches:
            for row in batch.to_pylist():
                with h5py.File(row["path"], "r") as file:
                    found = (file[row["group"]] if row["group"] else file)[row["dataset"]]
                    at = slice(row["begin"], row["end"])
                    x = found[at] if len(found.shape) < 2 else found[tuple(at if n > 1 else 0 for n in found.shape)]
                columns = [np.full(row["end"] - row["begin"], row["ch"], np.int32), np.arange(row["begin"], row["end"]), np.asarray(x, float).ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["ch", "t", "x"])

    table = spark.createDataFrame(slices, "ch int, path string, group string, dataset string, begin long, end long")
    signal = table.repartition(max(1, len(slices)), "ch", "begin").mapInArrow(read, SCHEMA)
    return signal, next(iter(stated), None)


def events_signal(spark: SparkSession, sf_dir: str, channels: tuple[int, ...] = (0, 1)) -> DataFrame:
    """The events table as a signal: channel 0 is value, 1 the number in props, 2 user_id; t is event_id."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    columns = [F.col("value"), F.regexp_extract("props", "[0-9]+", 0), F.col("user_id")]
    return from_columns(events, "event_id", columns[: max(channels) + 1]).filter(F.col("ch").isin(list(channels)))


def select_channels(signal: DataFrame, selected: list[int] | None) -> DataFrame:
    return signal if selected is None else signal.filter(F.col("ch").isin(list(selected)))


def scan(signal: DataFrame) -> DataFrame:
    """For each channel its samples, first and last index and sum."""
    return signal.groupBy("ch").agg(
        F.count("*").alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.sum("x").alias("x_sum")
    )


def checked_length(signal: DataFrame) -> tuple[list[int], int]:
    """The channels and their common number of samples. Raises unless every channel has each index from 0 once, and a number there."""
    by_channel = signal.groupBy("ch").agg(
        F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high"), F.count(F.when(F.col("x").isNotNull(), 1)).alias("filled")
    )
    rows = sorted(by_channel.collect())
    if not rows:
        raise InvalidConfigError("the signal has no samples")
    if len({r["n"] for r in rows}) > 1:
        raise InvalidConfigError("all channels must have the same number of samples")
    for r in rows:
        if r["low"] != 0 or r["high"] != r["n"] - 1 or r["filled"] != r["n"]:
            raise InvalidConfigError(f"channel {r['ch']} must have the indices 0 to n-1 once each, without nulls")
    return [r["ch"] for r in rows], rows[0]["n"]


def write_table(frame: DataFrame, path: str, dt: float | None = None) -> None:
    """Write a signal or a spectrum as parquet, in place of what is there; dt goes along as a column."""
    (frame if dt is None else frame.withColumn("dt", F.lit(dt))).write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
