"""Spectra of orders 1 to 4 of a signal, with errors, as one DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.config import CrossConfig, InvalidConfigError, SpectrumConfig
from specloom.operators.kernel import kernel_batches
from specloom.plans import relational
from specloom.plans.geometry import Geometry, geometry
from specloom.sources.signal import checked_length, select_channels

def relational_batches(signal: DataFrame, g: Geometry, n: int, orders: list[int], cross: list[tuple[int, ...]], channels: list[int], auto: bool) -> DataFrame:
    """Batch sums by SQL: every step is a join or an aggregation that Catalyst plans."""
    tables = relational.base(g, n, "SELECT ch, t, x FROM {signal}")
    spectra = relational.wanted(orders, cross, channels, auto)
    return signal.sparkSession.sql(relational.with_tables(tables, relational.batches_sql(g, spectra)), signal=signal)


def finish(batches: DataFrame, g: Geometry) -> DataFrame:
    """Means over chunks, and errors from the full batches: the root of the mean variance of a batch's mean, halved since
    interlaced chunks share samples; null without a full batch."""
    m_var = g.config.m_var
    error = lambda c: F.when(F.count(c) > 0, F.sqrt(F.greatest(F.avg(c), F.lit(0.0)) / m_var) / 2)
    rows = batches.groupBy("key", "ord", "i", "j").agg(
        (F.sum("sum_re") / F.sum("n")).alias("re"),
        (F.sum("sum_im") / F.sum("n")).alias("im"),
        error("var_re").alias("err_re"),
        error("var_im").alias("err_im"),
        F.sum("n").alias("n_chunks"),
        F.count("var_re").alias("n_batches"),
    )
    step = F.lit(g.n * g.config.dt)
    return rows.select(
        F.when(F.col("key").contains(","), "cross").otherwise("auto").alias("kind"),
        F.split("key", ",").cast("array<int>").alias("key"),
        "ord", "i", "j", (F.col("i") / step).alias("f_i"), (F.col("j") / step).alias("f_j"),
        "re", "im", "err_re", "err_im", "n_chunks", "n_batches",
    )


def spectra(signal: DataFrame, config: SpectrumConfig, cross: CrossConfig | None = None, selected: list[int] | None = None) -> DataFrame:
    """The spectra of `signal` (ch, t, x): kind, key, ord, i, j, f_i, f_j, re, im, err_re, err_im, n_chunks, n_batches.

    Order 1 has i = 0, order 2 a row for each bin i, order 3 rows i and columns j, order 4 bins i and j. All listed channels
    must have equal length, selected or not. Nothing else than that length reaches the driver.
    """
    cross = cross or CrossConfig()
    channels, n = checked_length(signal)
    wanted = channels if selected is None else list(dict.fromkeys(selected))
    if not set(wanted) <= set(channels):
        raise InvalidConfigError(f"selected channels {wanted} aren't all among {channels}")
    orders, keys = config.orders() if cross.auto_corr else [], cross.keys(wanted)
    g = geometry(config).fitted(n, orders, keys)
    g.check(n, orders, keys)
    if not orders and not keys:
        raise InvalidConfigError("no spectrum is asked for")
    own = select_channels(signal, wanted)
    if config.method == "relational":
        return finish(relational_batches(own, g, n, orders, keys, wanted, cross.auto_corr), g)
    return finish(kernel_batches(own, g, n, orders, keys, cross.auto_corr), g)
