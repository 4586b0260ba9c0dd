import numpy as np
import pytest

from specloom.config import CrossConfig, InvalidConfigError, SpectrumConfig, ViewConfig
from specloom.functions.taper import taper
from specloom.plans.geometry import geometry


@pytest.mark.parametrize(
    "settings",
    [
        dict(dt=1), dict(dt=0.0), dict(dt=-1.0), dict(f_unit="mHz"), dict(s3_calc="1"), dict(f_min="0"), dict(f_max="1"), dict(f_min=0.4, f_max=0.3),
        dict(spectrum_size=0), dict(spectrum_size=1), dict(spectrum_size=2.0), dict(m=0), dict(m_var=1), dict(break_after=0), dict(order_in="some"),
        dict(order_in=[5]), dict(order_in=[]), dict(method="gpu"),
    ],
)
def test_rejected_settings(settings):
    with pytest.raises(InvalidConfigError):
        SpectrumConfig(**dict(dt=1.0) | settings)


def test_rejected_cross_and_view_settings():
    for settings in (dict(cross_corr_2=[(0, 1, 2)]), dict(cross_corr_3=[(0, "1", 2)]), dict(cross_corr_4=[[0, 1, 2, 3]]), dict(auto_corr=1)):
        with pytest.raises(InvalidConfigError):
            CrossConfig(**settings)
    for settings in (
        dict(f_min=1, f_max=1), dict(display_orders=[5]), dict(significance=0), dict(arcsinh_scale=(1, 0.1)), dict(arcsinh_scale=(True, -1)),
        dict(plot_format=["abs"]), dict(insignif_transparency=2),
    ):
        with pytest.raises(InvalidConfigError):
            ViewConfig(**dict(f_min=0, f_max=1) | settings)
    with pytest.raises(InvalidConfigError):
        CrossConfig(cross_corr_2=[(0, 2)]).keys([0, 1])
    assert CrossConfig(cross_corr_2=[(0, 1), (0, 1)]).keys([0, 1]) == [(0, 1)]


def test_orders():
    wanted = [1, 3]
    assert SpectrumConfig(1.0, order_in=wanted, f_min=-0.5).orders() == [1] and wanted == [1, 3]
    assert SpectrumConfig(1.0).orders() == [1, 2, 3, 4]


def test_taper_values():
    w = taper(8, 1.0)
    assert np.allclose(w[:4], [0.0367494, 0.16504361, 0.37920758, 0.57237374]) and np.allclose(w, w[::-1])
    assert np.isclose(0.25 * np.sum(taper(15, 0.25) ** 2), 1) and (taper(15, 0.25) > 0).all()


def test_geometry():
    g = geometry(SpectrumConfig(1.0, spectrum_size=9))
    assert (g.n, g.bins, g.rows3, g.columns3) == (16, tuple(range(9)), [0, 1, 2, 3], [0, 1, 2, 3])
    assert geometry(SpectrumConfig(1.0, spectrum_size=9, s3_calc="1/2")).columns3 == [-3, -2, -1, 0, 1, 2, 3]
    g = geometry(SpectrumConfig(1.0, f_min=-0.5, f_max=0.5, spectrum_size=17))
    assert (g.n, g.bins) == (16, tuple(range(-8, 8)))
    assert len(geometry(SpectrumConfig(0.001, f_min=-5, f_max=5, spectrum_size=1000)).bins) == 999
    assert geometry(SpectrumConfig(0.001, f_max=5, spectrum_size=1000)).n == 199_800


def test_feasibility():
    g = geometry(SpectrumConfig(1.0, spectrum_size=9))
    g.check(1000, [1, 2, 3, 4], [])
    for samples, orders in ((160, [2]), (168, [2]), (300, [2])):
        with pytest.raises(InvalidConfigError):
            g.check(samples, orders, [])
    with pytest.raises(InvalidConfigError):
        geometry(SpectrumConfig(1.0, spectrum_size=9, m=3)).check(1000, [4], [])
    with pytest.raises(InvalidConfigError):
        geometry(SpectrumConfig(1.0, spectrum_size=9, f_min=0.1)).check(10_000, [3], [])
    with pytest.raises(InvalidConfigError):
        geometry(SpectrumConfig(1.0, spectrum_size=9, f_min=0.1)).check(10_000, [], [(0, 1, 1)])


def test_no_cap_by_default():
    """All chunks of a long signal are counted unless break_after says otherwise."""
    from specloom.plans.relational import base
    from specloom.queries import CONFIG

    g = geometry(SpectrumConfig(**CONFIG))
    assert g.config.break_after is None and base(g, 123, "SELECT 1")["framed"].endswith("<= 123")
    assert base(geometry(SpectrumConfig(**CONFIG, break_after=7)), 123, "SELECT 1")["framed"].endswith("< 7")


def test_late_samples_are_used(spark):
    """Batches beyond the millionth chunk reach the kernel."""
    from pyspark.sql import functions as F

    from specloom.operators.kernel import kernel_batches

    g = geometry(SpectrumConfig(1.0, spectrum_size=9))
    begin = 85_000_000 // g.chunk_points * g.chunk_points
    n = begin + 11 * g.chunk_points
    late = spark.range(begin, n).select(F.lit(0).alias("ch"), F.col("id").alias("t"), F.rand(1).alias("x"))
    wanted = 2 * begin // g.chunk_points // g.config.m_var + 1
    sums = kernel_batches(late.filter(F.col("t") >= (wanted * g.config.m_var // 2) * g.chunk_points), g, n, [2], [], True).filter(F.col("batch") == wanted)
    assert sums.count() == len(g.bins)


def test_shorter_chunks_for_short_signals(spark):
    """With fit_m a signal too short for m windows a chunk has shorter chunks, and a warning; without it is rejected."""
    from specloom.operators.spectra import spectra
    from specloom.sources.signal import from_arrays

    signal = from_arrays(spark, [np.arange(200.0) % 7])
    with pytest.raises(InvalidConfigError):
        spectra(signal, SpectrumConfig(1.0, spectrum_size=9))
    with pytest.warns(UserWarning, match="windows"):
        rows = spectra(signal, SpectrumConfig(1.0, spectrum_size=9, order_in=[2], fit_m=True))
    shorter = spectra(signal, SpectrumConfig(1.0, spectrum_size=9, order_in=[2], m=5))
    assert rows.sort("i").collect() == shorter.sort("i").collect()
    g = geometry(SpectrumConfig(1.0, spectrum_size=9, fit_m=True))
    assert g.fitted(10_000, [4], []).m == 10 and g.fitted(100, [4], []).m == 10  # 100 samples are too few for any
