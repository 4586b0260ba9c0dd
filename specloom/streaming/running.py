"""Spectra of a signal that is still arriving.

Single spectra only ever enter results as sums over error batches, so a finished batch need not be looked at again: samples
are kept until their batch is complete, its sums are appended to a table, and the spectrum is the mean over that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specloom.config import CrossConfig, SpectrumConfig
from specloom.operators.kernel import kernel_batches
from specloom.operators.spectra import finish
from specloom.plans.geometry import Geometry, geometry
from specloom.sources.signal import SCHEMA


def _whole_batches(g: Geometry, samples: int) -> int:
    """Error batches whose chunks all lie within the first `samples` samples."""
    frames = samples // g.chunk_points
    chunks = 2 * frames - (0 if frames * g.chunk_points + g.h <= samples else 1)
    return max(0, chunks) // g.config.m_var


class RunningSpectrum:
    """A spectrum in a folder: samples of batches that aren't complete under open/, sums of complete batches under batches/, and
    under progress/ how many batches each micro-batch left complete.

    Samples may come in any order within and between micro-batches, and repeatedly (the least value of an index counts); a
    batch is used once every channel has all indices up to its end. A micro-batch reads what the one before left open, not the
    samples of finished batches. All state is in the folder, which belongs to one checkpoint: a restarted process goes on where
    the last one stopped, and a repeated micro-batch replaces its own files by the same ones.
    """

    def __init__(self, spark: SparkSession, folder: str, config: SpectrumConfig, channels: list[int], cross: CrossConfig | None = None):
        self.spark, self.folder, self.channels, self.g = spark, folder, channels, geometry(config)
        cross = cross or CrossConfig()
        self.auto, self.orders, self.cross = cross.auto_corr, config.orders(), cross.keys(channels)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def _before(self, epoch: int | None = None) -> tuple[int | None, int]:
        """The last micro-batch before `epoch`, and the batches that were complete after it."""
        if not self._exists("progress"):
            return None, 0
        rows = self.spark.read.schema("epoch long, done long").parquet(f"{self.folder}/progress")
        rows = rows if epoch is None else rows.filter(F.col("epoch") < epoch)
        row = rows.orderBy(F.desc("epoch")).first()
        return (row["epoch"], row["done"]) if row else (None, 0)

    @property
    def done(self) -> int:
        """The batches that are complete."""
        return self._before()[1]

    def _begin(self, done: int) -> int:
        """The first sample that batches from number `done` on need."""
        return done * self.g.config.m_var // 2 * self.g.chunk_points

    def add(self, rows: DataFrame, epoch: int) -> None:
        """Take the samples of a micro-batch, and finish the batches that they complete."""
        g, (last, done) = self.g, self._before(epoch)
        begin, points = self._begin(done), g.chunk_points
        rows = rows.select(F.col("ch").cast("int").alias("ch"), F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x"))
        if last is not None:
            rows = rows.union(self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/open/epoch={last}"))
        fresh = rows.filter(F.col("ch").isin(self.channels) & (F.col("t") >= begin) & F.col("x").isNotNull())
        fresh.groupBy("ch", "t").agg(F.min("x").alias("x")).write.mode("overwrite").parquet(f"{self.folder}/gathered")
        signal = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/gathered")

        # Frames that all channels have whole, in a row from the first that is needed, and half a window beyond them.
        first = begin // points
        frame = F.floor(F.col("t") / points)
        counts = signal.groupBy("ch", frame.alias("frame")).agg(F.count("*").alias("n"), F.count(F.when(F.col("t") % points < g.h, 1)).alias("head"))
        whole = counts.groupBy("frame").agg(F.sum(F.when(F.col("n") == points, 1).otherwise(0)).alias("full"), F.sum(F.when(F.col("head") == g.h, 1).otherwise(0)).alias("begun"))
        of = {r["frame"]: r for r in whole.collect()}  # as many as a micro-batch and open batches have frames
        frames = 0
        while (r := of.get(first + frames)) and r["full"] == len(self.channels):
            frames += 1
        begun = (r := of.get(first + frames)) is not None and r["begun"] == len(self.channels)
        n = (first + frames) * points + (g.h if begun else 0)
        now = max(done, _whole_batches(g, n))
        if now > done:
            sums = kernel_batches(signal.filter(F.col("t") < n), g, n, self.orders, self.cross, self.auto)
            sums.filter((F.col("batch") >= done) & (F.col("batch") < now)).write.mode("overwrite").parquet(f"{self.folder}/batches/from={done}")
        signal.filter(F.col("t") >= self._begin(now)).write.mode("overwrite").parquet(f"{self.folder}/open/epoch={epoch}")
        progress = self.spark.createDataFrame([(epoch, now)], "epoch long, done long")
        progress.write.mode("overwrite").parquet(f"{self.folder}/progress/of={epoch}")
        if last is not None:  # a micro-batch is repeated only until the next begins
            for old in range(max(0, last - 8), last):
                path, files = self._path(f"open/epoch={old}")
                files.delete(path, True)

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Start a streaming query that adds each micro-batch of `stream` (ch, t, x)."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).start()

    def spectrum(self) -> DataFrame:
        """The spectrum of all complete batches so far."""
        batches = self.spark.read.parquet(f"{self.folder}/batches")
        return finish(batches.filter(F.col("from") < self.done).drop("from"), self.g)
