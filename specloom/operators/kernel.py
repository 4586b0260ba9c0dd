"""Batch sums of single spectra by an FFT kernel in Arrow groups: one group for each error batch of chunks, and for each channel
where no cross spectra are asked for.

A batch is all that the mean over chunks and the error need together, so a group leaves as one row for each bin, whatever
the number of chunks. A sample belongs to the batches of its frame and of its shifted frame, one or two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.plans.geometry import Geometry

#: Numbers of a block of rows of order 3, 16 MB.
BLOCK = 1 << 20
BATCHES = "key string, ord int, i int, j int, batch long, n long, sum_re double, sum_im double, var_re double, var_im double"


def second(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The unbiased second cumulant over the first axis of a and conj b."""
    m, b = len(a), b.conj()
    return m / (m - 1) * ((a * b).mean(0) - a.mean(0) * b.mean(0))


def third(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The unbiased third cumulant of a (m, columns), b (m, rows) and c (m, rows, columns), as rows by columns."""
    m = len(a)
    a, b = a[:, None, :], b[:, :, None]
    ab, ac, bc = a * b, a * c, b * c
    ma, mb, mc = a.mean(0), b.mean(0), c.mean(0)
    central = (ab * c).mean(0) - ab.mean(0) * mc - ac.mean(0) * mb - bc.mean(0) * ma + 2 * ma * mb * mc
    return m**2 / ((m - 1) * (m - 2)) * central


def fourth(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The unbiased fourth cumulant of a, conj b at the row's bin and c, conj d at the column's."""
    m = len(a)
    x, y, z, w = (v - v.mean(0) for v in (a, b.conj(), c, d.conj()))
    p, q = x * y, z * w
    pairs = np.outer(p.mean(0), q.mean(0)) + (x.T @ z) * (y.T @ w) / m**2 + (x.T @ w) * (y.T @ z) / m**2
    return m**2 / ((m - 1) * (m - 2) * (m - 3)) * ((m + 1) * (p.T @ q) / m - (m - 1) * pairs)


def transform(x: np.ndarray, g: Geometry) -> np.ndarray:
    """Coefficients (windows, transform bins) of windows (windows, N)."""
    tapered = x * g.weights
    return (np.fft.fftshift(np.fft.fft(tapered), axes=-1) if g.full else np.fft.rfft(tapered)) * g.config.dt


def at(coefficients: np.ndarray, bins: np.ndarray, g: Geometry) -> np.ndarray:
    """Coefficients at signed bins; of a real signal, those at -k are the conjugates of those at k."""
    if g.full:
        return coefficients[:, bins + g.n // 2]
    found = coefficients[:, np.abs(bins)]
    return np.where(bins < 0, found.conj(), found)


def single_spectra(found: dict[int, np.ndarray], g: Geometry, orders: list[int], cross: list[tuple[int, ...]], auto: bool) -> Iterator[tuple]:
    """(key, order, spectrum) of one chunk for all keys; found: channel to coefficients."""
    band, rows, columns = np.array(g.bins, int), np.array(g.rows3, int), np.array(g.columns3, int)

    def of(order: int, key: tuple[int, ...]) -> np.ndarray:
        a = [found[c] for c in key]
        if order == 1:
            value = at(a[0], np.array([0]), g).mean(0)
        elif order == 2:
            value = second(at(a[0], band, g), at(a[1], band, g))
        elif order == 3:
            step = max(1, BLOCK // (g.m * max(1, len(columns))))
            first = at(a[0], columns, g)
            parts = [third(first, at(a[1], r, g), at(a[2], r[:, None] + columns, g).conj()) for r in (rows[k : k + step] for k in range(0, len(rows), step))]
            value = np.concatenate(parts) if parts else np.empty((0, len(columns)), complex)
        else:
            value = fourth(*(at(x, band, g) for x in a))
        return value.conj() / g.norm(order)

    if auto:
        for channel in found:
            for order in orders:
                yield str(channel), order, of(order, (channel,) * order)
    for key in cross:
        yield ",".join(map(str, key)), len(key), of(len(key), key)


def kernel_batches(signal: DataFrame, g: Geometry, n: int, orders: list[int], cross: list[tuple[int, ...]], auto: bool) -> DataFrame:
    """Sums and variances of the single spectra of each batch."""
    points, h, m_var = g.chunk_points, g.h, g.config.m_var
    chunks = 2 * (n // points) - (0 if (n // points) * points + h <= n else 1)
    chunks = chunks if g.config.break_after is None else min(chunks, g.config.break_after)

    def batch_of(chunk) -> object:
        return F.when((chunk >= 0) & (chunk < chunks), F.floor(chunk / m_var))

    t = F.col("t")
    frame = lambda x: F.floor(x / points)
    batches = F.array_distinct(F.array_compact(F.array(batch_of(2 * frame(t)), F.when(t >= h, batch_of(2 * frame(t - h) + 1)))))
    rows = signal.select(F.explode(batches).alias("batch"), "ch", "t", "x")
    i2 = np.array(g.bins, int)
    axes = {
        1: (np.zeros(1, int), np.full(1, -1)),
        2: (i2, np.full(len(i2), -1)),
        3: tuple(x.ravel() for x in np.meshgrid(g.rows3, g.columns3, indexing="ij")),
        4: tuple(x.ravel() for x in np.meshgrid(i2, i2, indexing="ij")),
    }

    def kernel(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        first = batch * m_var
        begin = (first // 2) * points
        ch, t, x = (table.column(c).to_numpy() for c in ("ch", "t", "x"))
        values = {}
        for c in np.unique(ch):
            own = ch == c
            line = np.full(int(t[own].max()) - begin + 1, np.nan)
            line[t[own] - begin] = x[own]
            values[int(c)] = line
        spectra: dict[tuple[str, int], list[np.ndarray]] = {}
        for chunk in range(first, min(first + m_var, chunks)):
            start = (chunk // 2) * points + (chunk % 2) * h - begin
            found = {c: transform(line[start : start + points].reshape(g.m, g.n), g) for c, line in values.items()}
            for key, order, value in single_spectra(found, g, orders, cross, auto):
                spectra.setdefault((key, order), []).append(value.ravel())
        parts = []
        for (key, order), found in spectra.items():
            s = np.array(found)
            count, (i, j) = len(s), axes[order]
            whole = count == m_var
            variance = [v.var(0, ddof=1) if whole else np.full(s.shape[1], np.nan) for v in (s.real, s.imag)]
            size = s.shape[1]
            columns = [pa.array([key] * size), pa.array(np.full(size, order, np.int32)), pa.array(i.astype(np.int32))]
            columns += [pa.array(j.astype(np.int32), mask=np.full(size, order < 3)), pa.array(np.full(size, batch)), pa.array(np.full(size, count))]
            columns += [pa.array(v) for v in (s.real.sum(0), s.imag.sum(0))] + [pa.array(v, mask=np.full(size, not whole)) for v in variance]
            parts.append(pa.Table.from_arrays(columns, [c.split()[0] for c in BATCHES.split(", ")]))
        return pa.concat_tables(parts)

    return rows.groupBy("batch", *([] if cross else ["ch"])).applyInArrow(kernel, BATCHES)
