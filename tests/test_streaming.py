import numpy as np

from specloom.config import CrossConfig, SpectrumConfig
from specloom.operators.spectra import spectra
from specloom.sources.signal import from_arrays
from specloom.streaming.running import RunningSpectrum


def test_running_equals_whole(spark, tmp_path):
    """After all samples have streamed in, the spectrum is that of the whole signal's complete batches."""
    rng = np.random.default_rng(8)
    whole = from_arrays(spark, [rng.normal(size=1700), rng.exponential(size=1700)])
    config, cross = SpectrumConfig(1.0, spectrum_size=9, m_var=4), CrossConfig(cross_corr_2=[(0, 1)])
    running = RunningSpectrum(spark, str(tmp_path / "run"), config, [0, 1], cross)
    (tmp_path / "in").mkdir()
    for k, (low, high) in enumerate([(0, 500), (500, 900), (900, 1700)]):
        whole.filter(f"t >= {low} AND t < {high}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema("ch int, t long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = running.follow(stream, str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert running.done == 5  # 20 chunks of 1700 samples
    key = lambda r: (tuple(r["key"]), r["ord"], r["i"], r["j"])
    expected = {key(r): r for r in spectra(whole, config, cross).collect()}
    got = {key(r): r for r in running.spectrum().collect()}
    assert got.keys() == expected.keys()
    for k, r in got.items():
        assert r["n_chunks"] == 20 and all(np.isclose(r[c], expected[k][c]) for c in ("re", "im", "err_re", "err_im"))


def test_restart_and_repeats(spark, tmp_path):
    """A process that starts anew in the folder goes on; a micro-batch that comes twice, late samples and repeats change nothing."""
    rng = np.random.default_rng(9)
    whole = from_arrays(spark, [rng.normal(size=9000), rng.exponential(size=9000)])
    config = SpectrumConfig(1.0, spectrum_size=9, m_var=4, order_in=[1, 2])
    parts = ["t < 700 AND NOT (ch = 1 AND t BETWEEN 300 AND 320)", "t BETWEEN 650 AND 4000 OR (ch = 1 AND t BETWEEN 300 AND 320)", "t BETWEEN 3000 AND 8000", "t >= 7900"]
    folder = str(tmp_path / "run")
    seen = []
    for epoch, part in enumerate(parts):
        running = RunningSpectrum(spark, folder, config, [0, 1])
        running.add(whole.filter(part), epoch)
        RunningSpectrum(spark, folder, config, [0, 1]).add(whole.filter(part), epoch)  # died before its micro-batch was committed
        seen.append(running.done)
    assert seen[0] == 0 and seen == sorted(seen) and seen[-1] == 28  # 112 chunks of 9000 samples, the last one shifted by half a window
    rows = RunningSpectrum(spark, folder, config, [0, 1]).spectrum().collect()
    expected = {(tuple(r["key"]), r["ord"], r["i"]): r for r in spectra(whole, config).collect()}
    assert len(rows) == len(expected)
    for r in rows:
        e = expected[tuple(r["key"]), r["ord"], r["i"]]
        assert r["n_chunks"] == e["n_chunks"] == 112 and np.isclose(r["re"], e["re"]) and np.isclose(r["err_re"], e["err_re"])
    open_ = spark.read.parquet(f"{folder}/open/epoch=3")
    assert open_.agg({"t": "min"}).first()[0] >= 8000  # samples of finished batches aren't kept
