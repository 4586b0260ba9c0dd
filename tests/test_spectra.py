import numpy as np
import pytest

from specloom.config import CrossConfig, InvalidConfigError, SpectrumConfig, ViewConfig
from specloom.functions.taper import taper
from specloom.operators import views
from specloom.operators.spectra import spectra
from specloom.sources.signal import checked_length, from_arrays, from_npz, read_table, scan, select_channels, write_table

RNG = np.random.default_rng(5)
X = [RNG.exponential(size=1000), RNG.normal(size=1000).cumsum() * 0.1 + 0.3]
CROSS = dict(cross_corr_2=[(0, 1), (1, 0)], cross_corr_3=[(0, 1, 1)], cross_corr_4=[(0, 1, 0, 1), (0, 0, 1, 1)])


def by_key(rows):
    return {(tuple(r["key"]), r["ord"], r["i"], r["j"]): r for r in rows.collect()}


def plain(arrays, key, n=16, m=10, m_var=10, half=False):
    """Spectrum and error of one key, by loops over chunks, windows, rows and columns."""
    w, order, k = taper(n, 1.0), len(key), np.arange(n // 2 + 1)
    found = []
    for start in sorted([i * n * m + s for i in range(len(arrays[0]) // (n * m)) for s in (0, n // 2)]):
        if start + n * m > len(arrays[0]):
            continue
        a = [np.array([[np.sum(w * arrays[c][start + v * n :][:n] * np.exp(-2j * np.pi * q * np.arange(n) / n)) for q in k] for v in range(m)]) for c in key]
        mean = lambda x: sum(x) / m
        if order == 1:
            s = np.array([mean(a[0][:, 0])]) / np.sum(w)
        elif order == 2:
            s = np.array([m / (m - 1) * (mean(a[0][:, q] * a[1][:, q].conj()) - mean(a[0][:, q]) * mean(a[1][:, q]).conj()) for q in k]) / np.sum(w**2)
        elif order == 3:
            rows = range(len(k) // 2)
            columns = range(1 - len(rows), len(rows)) if half else rows
            at = lambda x, q: x[:, q] if q >= 0 else x[:, -q].conj()
            s = np.empty((len(rows), len(columns)), complex)
            for i in rows:
                for c, j in enumerate(columns):
                    x, y, z = at(a[0], j), at(a[1], i), at(a[2], i + j).conj()
                    s[i, c] = m**2 / ((m - 1) * (m - 2)) * mean((x - mean(x)) * (y - mean(y)) * (z - mean(z)))
            s = s / np.sum(w**3)
        else:
            b = [x - x.mean(0) for x in a]
            s = np.empty((len(k), len(k)), complex)
            for i in k:
                for j in k:
                    x, y, z, v = b[0][:, i], b[1][:, i].conj(), b[2][:, j], b[3][:, j].conj()
                    pairs = mean(x * y) * mean(z * v) + mean(x * z) * mean(y * v) + mean(x * v) * mean(y * z)
                    s[i, j] = m**2 / ((m - 1) * (m - 2) * (m - 3)) * ((m + 1) * mean(x * y * z * v) - (m - 1) * pairs)
            s = s / np.sum(w**4)
        found.append(s.conj())
    found = np.array(found)
    full = found[: len(found) // m_var * m_var].reshape(-1, m_var, *found.shape[1:])
    error = [np.sqrt((p.var(1, ddof=1) / m_var).mean(0)) / 2 for p in (full.real, full.imag)]
    return found.mean(0), error[0], error[1], len(found)


@pytest.fixture(scope="module", params=["relational", "kernel"])
def result(spark, request):
    config = SpectrumConfig(1.0, spectrum_size=9, method=request.param)
    return by_key(spectra(from_arrays(spark, X), config, CrossConfig(**CROSS)))


@pytest.mark.parametrize("key", [(0,), (1,), (0, 0), (0, 1), (1, 0), (0, 0, 0), (0, 1, 1), (1, 1, 1, 1), (0, 1, 0, 1), (0, 0, 1, 1)])
def test_against_loops(result, key):
    s, err_re, err_im, chunks = plain(X, key)
    name, order = ((key[0],) if len(set(key)) == 1 else key), len(key)
    rows = {(i, j): r for (k, n, i, j), r in result.items() if k == name and n == order}
    assert len(rows) == s.size
    for (i, j), r in rows.items():
        at = i if j is None else (i, j)
        assert np.isclose(r["re"] + 1j * r["im"], s[at], rtol=1e-9, atol=1e-9)
        assert np.isclose(r["err_re"], err_re[at], atol=1e-9) and np.isclose(r["err_im"], err_im[at], atol=1e-9)
        assert r["n_chunks"] == chunks and r["n_batches"] == chunks // 10


@pytest.mark.parametrize("method", ["relational", "kernel"])
def test_half_plane_holds_the_quarter(spark, method):
    config = dict(dt=1.0, spectrum_size=9, method=method, order_in=[3])
    cross = CrossConfig(auto_corr=False, cross_corr_3=[(0, 1, 0)])
    signal = from_arrays(spark, X)
    half = by_key(spectra(signal, SpectrumConfig(**config, s3_calc="1/2"), cross))
    quarter = by_key(spectra(signal, SpectrumConfig(**config), cross))
    s = plain(X, (0, 1, 0), half=True)[0]
    assert len(half) == 28 and len(quarter) == 16
    assert all(np.isclose(quarter[k]["re"], half[k]["re"]) and np.isclose(quarter[k]["im"], half[k]["im"]) for k in quarter)
    assert all(np.isclose(r["re"] + 1j * r["im"], s[i, j + 3]) for (_, _, i, j), r in half.items())


@pytest.mark.parametrize("method", ["relational", "kernel"])
def test_signed_frequencies(spark, method):
    config = SpectrumConfig(1.0, f_min=-0.5, f_max=0.5, spectrum_size=17, method=method)
    got = by_key(spectra(from_arrays(spark, X), config, CrossConfig(cross_corr_2=[(0, 1)])))
    assert {k[1] for k in got} == {1, 2, 4}
    one = by_key(spectra(from_arrays(spark, X), SpectrumConfig(1.0, spectrum_size=9), CrossConfig(cross_corr_2=[(0, 1)])))
    for k in range(1, 8):  # real signals: conjugates at the other side
        a, b, c = got[(0, 1), 2, k, None], got[(0, 1), 2, -k, None], one[(0, 1), 2, k, None]
        assert np.isclose(a["re"], b["re"]) and np.isclose(a["im"], -b["im"]) and np.isclose(a["im"], c["im"])


def test_odd_window_and_methods_agree(spark):
    for settings in (dict(spectrum_size=6, f_max=0.45), dict(spectrum_size=8, f_max=0.3, break_after=7)):
        a, b = (by_key(spectra(from_arrays(spark, X), SpectrumConfig(1.0, method=m, **settings))) for m in ("relational", "kernel"))
        assert a.keys() == b.keys()
        assert all(np.isclose(a[k][c], b[k][c], rtol=1e-8, atol=1e-9) for k in a for c in ("re", "im", "n_chunks"))
        assert max(r["n_chunks"] for r in a.values()) <= settings.get("break_after", 100)


def test_known_signals(spark):
    n = 4000
    noise = RNG.normal(size=n)
    signal = from_arrays(spark, [np.full(n, 2.5), noise, 3 * noise + 7, RNG.exponential(size=n)])
    got = by_key(spectra(signal, SpectrumConfig(1.0, spectrum_size=9)))
    assert np.isclose(got[(0,), 1, 0, None]["re"], 2.5)
    assert all(abs(r["re"]) < 1e-9 and abs(r["im"]) < 1e-9 for (k, n, _, _), r in got.items() if k == (0,) and n > 1)
    for order in (2, 3, 4):
        a, b = ([r["re"] for (k, n, _, _), r in sorted(got.items(), key=str) if k == (c,) and n == order] for c in (1, 2))
        assert np.allclose(np.array(a) * 3**order, b, rtol=1e-7, atol=1e-7)
    level = np.mean([got[(1,), 2, k, None]["re"] for k in range(2, 8)])
    assert 0.8 < level < 1.2  # white noise of variance 1
    assert got[(3,), 3, 1, 1]["re"] > 3 * got[(3,), 3, 1, 1]["err_re"]  # exponential noise is skew


def test_delay_has_a_linear_phase(spark):
    x = RNG.normal(size=4002)
    got = by_key(spectra(from_arrays(spark, [x[2:], x[:-2]]), SpectrumConfig(1.0, spectrum_size=17, order_in=[2]), CrossConfig(cross_corr_2=[(0, 1), (1, 0)])))
    for k in range(1, 12):
        a, b = got[(0, 1), 2, k, None], got[(1, 0), 2, k, None]
        assert np.isclose(a["re"], b["re"]) and np.isclose(a["im"], -b["im"])
        phase = np.angle((a["re"] + 1j * a["im"]) * np.exp(2j * np.pi * k / 32 * 2))
        assert abs(phase) < 0.4


def test_errors_and_rejections(spark):
    signal = from_arrays(spark, [x[:500] for x in X])
    got = spectra(signal, SpectrumConfig(1.0, spectrum_size=9, order_in=[1, 2])).collect()
    assert all(r["err_re"] is None and r["n_batches"] == 0 and r["n_chunks"] == 6 for r in got)
    with pytest.raises(InvalidConfigError):
        spectra(signal, SpectrumConfig(1.0, spectrum_size=9), CrossConfig(cross_corr_2=[(0, 1)]), selected=[0])
    with pytest.raises(InvalidConfigError):
        spectra(signal, SpectrumConfig(1.0, spectrum_size=9), selected=[4])
    with pytest.raises(InvalidConfigError):
        spectra(signal, SpectrumConfig(1.0, spectrum_size=9), CrossConfig(auto_corr=False))
    with pytest.raises(InvalidConfigError):
        checked_length(from_arrays(spark, [X[0], X[1][:-1]]))
    with pytest.raises(InvalidConfigError):
        checked_length(from_arrays(spark, [X[0]]).filter("t <> 5"))
    with pytest.raises(InvalidConfigError):
        checked_length(from_arrays(spark, [X[0]]).filter("t < 0"))
    only = spectra(signal, SpectrumConfig(1.0, spectrum_size=9, order_in=[1]), selected=[1]).collect()
    assert [r["key"] for r in only] == [[1]]


def test_sources(spark, tmp_path):
    np.savez(tmp_path / "x.npz", x=X[0], m=X[1])
    signal = from_npz(spark, str(tmp_path / "x.npz"), ["x", "m"], limit=700)
    assert checked_length(signal) == ([0, 1], 700)
    write_table(signal, str(tmp_path / "signal"), dt=0.5)
    back = read_table(spark, str(tmp_path / "signal"))
    assert back.select("dt").distinct().collect()[0][0] == 0.5
    assert sorted(map(tuple, scan(back).collect())) == sorted(map(tuple, scan(signal).collect()))
    assert select_channels(signal, [1]).select("ch").distinct().count() == 1


def test_views(spark):
    config = SpectrumConfig(1.0, spectrum_size=9)
    rows = spectra(from_arrays(spark, X), config)
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    assert views.s1_table(rows).count() == 2
    for r in views.bounds(views.of_order(rows, 2, [(0,)]), 2).collect():
        assert np.isclose(r["upper_re"], r["re"] + r["q"] * r["err_re"]) and np.isclose(r["lower_im"], r["im"] - r["q"] * r["err_im"])
    for r in views.mask(views.of_order(rows, 3), 2).collect():
        assert r["masked_re"] == (abs(r["re"]) < 2 * r["err_re"]) and r["masked_im"] == (abs(r["im"]) < 2 * r["err_im"])
    flat, scaled = by_key(views.of_order(rows, 3)), by_key(views.arcsinh(views.of_order(rows, 3), 0.02))
    peak = {c: max(np.hypot(r["re"], r["im"]) for k, r in flat.items() if k[0] == (c,)) for c in (0, 1)}
    for k, r in scaled.items():
        s = 1 / (0.02 * peak[k[0][0]])
        z = np.arcsinh(s * (flat[k]["re"] + 1j * flat[k]["im"])) / s
        assert np.isclose(r["re"], z.real) and np.isclose(r["im"], z.imag)
    view = ViewConfig(0.1, 0.3, arcsinh_scale=(True, 0.1))
    shown = views.display(rows, view)
    assert shown.keys() == {"s1", "s2", "s3", "s4"}
    assert {round(r["f_i"], 4) for r in shown["s2"].collect()} == {0.125, 0.1875, 0.25}
    assert all(0.05 <= r["f_j"] <= 0.15 for r in shown["s3"].collect())
    assert views.first_frame(from_arrays(spark, X), config).count() == 32
    assert views.time_unit("kHz") == "ms" and views.unit_labels(spark).count() == 5
    assert views.map_limits(rows).count() == 4
