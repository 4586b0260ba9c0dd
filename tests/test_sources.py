import numpy as np
import pytest

from specloom.config import Dataset, InvalidConfigError
from specloom.sources import signal as S

#: Stands for the optional library: files are npz archives, a group is a prefix of names, and "name@dt" an attribute.
LIBRARY = """
import numpy as np

class Data:
    def __init__(self, values, attrs):
        self.values, self.attrs, self.shape = values, attrs, values.shape

    def __getitem__(self, at):
        return self.values[at]

class File:
    def __init__(self, path, mode, prefix=""):
        self.path, self.prefix = path, prefix
        self.found = np.load(path)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.found.close()

    def __getitem__(self, name):
        name = self.prefix + name
        if name not in self.found:
            return File(self.path, "r", name + "/")
        return Data(self.found[name], {"dt": float(self.found[name + "@dt"])} if name + "@dt" in self.found else {})
"""


@pytest.fixture
def files(spark, tmp_path, monkeypatch):
    (tmp_path / "h5py.py").write_text(LIBRARY)
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    path = str(tmp_path / "data.npz")
    np.savez(path, **{"g/x": np.arange(10.0), "g/x@dt": 0.5, "y": np.arange(10.0) * 2, "z": np.arange(10.0)[:, None], "z@dt": 0.25, "w": np.ones((3, 4))})
    return path


def test_datasets_of_files(spark, files, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 3)
    signal, dt = S.from_hdf5(spark, [Dataset(files, "x", "g"), Dataset(files, "y", dt=0.5)])
    assert dt == 0.5 and sorted(map(tuple, signal.collect())) == [(c, t, float(t * (1 + c))) for c in (0, 1) for t in range(10)]
    assert S.checked_length(signal) == ([0, 1], 10) and signal.schema.simpleString() == "struct<ch:int,t:bigint,x:double>"
    signal, dt = S.from_hdf5(spark, [Dataset(files, "z")])
    assert dt == 0.25 and signal.count() == 10
    assert S.from_hdf5(spark, [Dataset(files, "y")])[1] is None
    for sources in ([Dataset(files, "x", "g"), Dataset(files, "z")], [Dataset(files, "w")]):
        with pytest.raises(InvalidConfigError):
            S.from_hdf5(spark, sources)


def test_descriptions():
    for wrong in (dict(path=""), dict(dataset=3), dict(group=1), dict(dt=0.0), dict(dt=1)):
        with pytest.raises(InvalidConfigError):
            Dataset(**dict(path="p", dataset="d") | wrong)


def test_without_the_library(spark, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "h5py", None)
    with pytest.raises(InvalidConfigError):
        S.from_hdf5(spark, [Dataset("p", "d")])
