"""The registered queries of the spectral engine and their SQL.

The signal is the events table: channel 0 is value, channel 1 the number in props, both over 100 so that fourth powers stay
near 1 and six decimals are the same in every engine. dt is 1 and a window has 16 points.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.config import CrossConfig, InvalidConfigError, SpectrumConfig, ViewConfig
from specloom.operators import views
from specloom.operators.spectra import spectra
from specloom.plans import relational as R
from specloom.plans.geometry import Geometry, geometry
from specloom.sources.signal import events_signal, read_table, scan, write_table

CONFIG = dict(dt=1.0, spectrum_size=9)
FULL = dict(dt=1.0, f_min=-0.5, f_max=0.5, spectrum_size=17)
WIDE = dict(dt=1.0, spectrum_size=33, method="kernel")
HALF = CONFIG | dict(s3_calc="1/2")
CROSS2 = [(0, 1), (1, 0)]
SIGNAL = (
    "SELECT 0 AS ch, event_id AS t, value / 100e0 AS x FROM events UNION ALL "
    "SELECT 1 AS ch, event_id AS t, CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / 100e0 AS x FROM events"
)
#: The number of samples, as SQL that any scale factor answers.
SAMPLES = "(SELECT count(*) FROM events)"
#: Chunks that the check SQL counts at most: its text is kept as it was. The engine has no such cap.
SQL_CHUNKS = 1_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_signal(spark, sf_dir).withColumn("x", F.col("x") / 100)


def rounded(*names: str) -> list[str]:
    """Doubles at six decimals, without a negative zero."""
    return [f"round({c}, 6) + 0e0 AS {c}" for c in names]


def rounded_sql(*names: str) -> str:
    return ", ".join(rounded(*names))


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE_SQL[name] = sql


def _spectrum(settings: dict, cross: dict, spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spectra(signal(spark, sf_dir), SpectrumConfig(**settings), CrossConfig(**cross))
    return rows.withColumn("key_str", F.array_join("key", ","))


def _tables(settings: dict) -> tuple[Geometry, dict[str, str]]:
    g = geometry(SpectrumConfig(**dict(break_after=SQL_CHUNKS) | settings))
    return g, R.base(g, SAMPLES, SIGNAL)


def _sql(settings: dict, cross: dict, body: str) -> str:
    """`body` over s, the finished spectra."""
    config, wanted = SpectrumConfig(**settings), CrossConfig(**cross)
    keys = R.wanted(config.orders() if wanted.auto_corr else [], wanted.keys([0, 1]), [0, 1], wanted.auto_corr)
    g, tables = _tables(settings)
    batches = R.batches_sql(g, keys)
    error = lambda x: f"CASE WHEN count({x}) > 0 THEN sqrt(greatest(avg({x}), 0e0) / {config.m_var}) / 2 END"
    tables["s"] = (
        f"SELECT key AS key_str, ord, i, j, i / {R.number(g.n * config.dt)} AS f_i, j / {R.number(g.n * config.dt)} AS f_j, "
        f"sum(sum_re) / sum(n) AS re, sum(sum_im) / sum(n) AS im, {error('var_re')} AS err_re, {error('var_im')} AS err_im, "
        f"CAST(sum(n) AS BIGINT) AS n_chunks, CAST(count(var_re) AS BIGINT) AS n_batches FROM ({batches}) b GROUP BY key, ord, i, j"
    )
    return R.with_tables(tables, body)


def add_spectrum(name: str, settings: dict, cross: dict | None = None, errors: bool = False) -> None:
    """A query of finished spectra: values, or errors. One-dimensional orders have no j; beside others theirs is -1."""
    cross = cross or {}
    orders = {*SpectrumConfig(**settings).orders()} if cross.get("auto_corr", True) else set()
    orders |= {int(k[-1]) for k in cross if k.startswith("cross")}
    second = not orders <= {1, 2}
    columns = ["err_re", "err_im"] if errors else ["f_i", "re", "im"]
    chosen = ["key_str", "ord", "i", *rounded(*columns), "n_batches" if errors else "n_chunks", *["coalesce(j, -1) AS j"] * second]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _spectrum(settings, cross, spark, sf_dir).selectExpr(*chosen)

    add(name, run, _sql(settings, cross, f"SELECT {', '.join(chosen)} FROM s"))


def only(order: int, settings: dict) -> dict:
    return settings | dict(order_in=[order])


for _n in (1, 2, 3, 4):
    add_spectrum(f"s{_n}_err", only(_n, CONFIG), errors=True)
    if _n != 3:
        add_spectrum(f"s{_n}_auto", only(_n, CONFIG))
        add_spectrum(f"s{_n}_full", only(_n, FULL))
    add_spectrum(f"s{_n}_kernel", only(_n, WIDE))
    add_spectrum(f"s{_n}_relational", only(_n, CONFIG) | dict(method="relational"))
add_spectrum("s3_auto_quarter", only(3, CONFIG))
add_spectrum("s3_auto_half", only(3, HALF))
for _name, _settings, _keys in (
    ("s2_cross", CONFIG, dict(cross_corr_2=CROSS2)),
    ("s3_cross_quarter", CONFIG, dict(cross_corr_3=[(0, 1, 1)])),
    ("s3_cross_half", HALF, dict(cross_corr_3=[(0, 1, 1)])),
    ("s4_cross", CONFIG, dict(cross_corr_4=[(0, 1, 0, 1), (0, 0, 1, 1)])),
    ("s2_cross_kernel", WIDE, dict(cross_corr_2=CROSS2)),
    ("s4_cross_full", FULL, dict(cross_corr_4=[(0, 1, 1, 0)])),
):
    add_spectrum(_name, _settings, dict(auto_corr=False) | _keys)
add_spectrum("s2_cross_err", CONFIG, dict(auto_corr=False, cross_corr_2=CROSS2), errors=True)
add_spectrum("spectrum_union", CONFIG, dict(cross_corr_2=[(0, 1)], cross_corr_4=[(0, 1, 0, 1)]))
add_spectrum("s2_break_after", only(2, CONFIG) | dict(break_after=7))


def _relational(name: str, settings: dict, body: str) -> None:
    """A query of an intermediate table: the same text in Spark and for the check."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        n = events.count()
        g = geometry(SpectrumConfig(**settings))
        tables = R.base(g, n, "SELECT ch, t, x FROM {signal}")
        return spark.sql(R.with_tables(tables, body), signal=signal(spark, sf_dir))

    add(name, run, R.with_tables(_tables(settings)[1], body))


_relational("window_assign", CONFIG, "SELECT ch, fr, s, wi, count(*) AS n FROM framed GROUP BY ch, fr, s, wi")
_relational("chunk_count", CONFIG, "SELECT ch, count(DISTINCT fr * 1000 + s) AS n_chunks FROM framed GROUP BY ch")
# The same from the number of samples alone: a chunk of 160 points begins at each 160th sample and 8 after it, if it ends in time.
_CHUNKS = (
    "WITH c AS (SELECT ch, fr, s FROM (VALUES (0), (1)) AS a(ch), (VALUES (0), (8)) AS b(s), "
    "(SELECT CAST(range AS BIGINT) AS fr FROM range((SELECT count(*) // 160 FROM events))) f WHERE fr * 160 + s + 160 <= (SELECT count(*) FROM events)) "
)
ORACLE_SQL["window_assign"] = _CHUNKS + "SELECT ch, fr, s, wi, CAST(16 AS BIGINT) AS n FROM c, (SELECT CAST(range AS BIGINT) AS wi FROM range(10)) w"
ORACLE_SQL["chunk_count"] = _CHUNKS + "SELECT ch, count(*) AS n_chunks FROM c GROUP BY ch"
for _name, _settings, _table in (("dft_coeffs", CONFIG, "aw"), ("dft_coeffs_full", FULL, "aw"), ("dft_mirror", CONFIG, "awm")):
    _relational(_name, _settings, f"SELECT ch, fr, s, wi, k, {rounded_sql('re', 'im')} FROM {_table}")


def add_literal(name: str, columns: str, rows: Callable[[], list[tuple]]) -> None:
    """A table that follows from the settings alone."""
    names = [c.split()[0] for c in columns.split(", ")]
    text = ", ".join("(" + ", ".join(R.number(v) if isinstance(v, float) else str(v) for v in row) + ")" for row in rows())
    add(name, lambda spark, _: spark.createDataFrame(rows(), columns), f"SELECT * FROM (VALUES {text}) AS v({', '.join(names)})")


def _axis(settings: dict, bins: Callable[[Geometry], list[int]]) -> Callable[[], list[tuple]]:
    g = geometry(SpectrumConfig(**settings))
    return lambda: [(k, g.frequency(k)) for k in bins(g)]


add_literal("freq_axis", "k int, f double", _axis(CONFIG, lambda g: list(g.bins)))
add_literal("freq_axis_full", "k int, f double", _axis(FULL, lambda g: list(g.bins)))
add_literal("freq_axis_s3", "k int, f double", _axis(HALF, lambda g: g.columns3))

# The taper's formula in SQL: x from 0 to 16 in 15 steps, bells at x and a length of 17 away, scaled to a power of 1.
_bell = lambda x: f"exp(-power(({x} - 8e0) / (2e0 * 17e0 * 0.14e0), 2))"
add(
    "taper_table",
    lambda spark, _: spark.createDataFrame([(p, float(w)) for p, w in enumerate(geometry(SpectrumConfig(**CONFIG)).weights)], "p int, w double").selectExpr("p", *rounded("w")),
    f"WITH grid AS (SELECT CAST(range AS INT) AS p, range * 16e0 / 15e0 AS x FROM range(16)), bells AS (SELECT p, {_bell('x')} - {_bell('(-0.5e0)')} * "
    f"({_bell('(x + 17e0)')} + {_bell('(x - 17e0)')}) / ({_bell('16.5e0')} + {_bell('(-17.5e0)')}) AS v FROM grid) "
    "SELECT p, round(v / sqrt((SELECT sum(v * v) FROM bells)), 6) + 0e0 AS w FROM bells",
)
add(
    "signal_scan",
    lambda spark, sf_dir: scan(signal(spark, sf_dir)).selectExpr("ch", "n", "t_min", "t_max", *rounded("x_sum")),
    f"SELECT ch, count(*) AS n, min(t) AS t_min, max(t) AS t_max, round(sum(x), 6) + 0e0 AS x_sum FROM ({SIGNAL}) s GROUP BY ch",
)
add(
    "first_frame",
    lambda spark, sf_dir: views.first_frame(signal(spark, sf_dir), SpectrumConfig(**CONFIG)).selectExpr("ch", "t", "time", *rounded("x")),
    f"SELECT ch, t, t * 1e0 AS time, round(x, 6) + 0e0 AS x FROM ({SIGNAL}) s WHERE t < 16",
)
add(
    "unit_labels",
    lambda spark, _: views.unit_labels(spark),
    "SELECT * FROM (VALUES ('Hz', 's'), ('kHz', 'ms'), ('MHz', 'us'), ('GHz', 'ns'), ('THz', 'ps')) AS v(f_unit, t_unit)",
)


def add_view(name: str, settings: dict, make: Callable[[DataFrame], DataFrame], columns: list, body: str, cross: dict | None = None) -> None:
    """A query of a view of finished spectra; `body` may begin with its own tables."""
    cross = cross or {}
    sql = _sql(settings, cross, body)
    add(name, lambda spark, sf_dir: make(_spectrum(settings, cross, spark, sf_dir)).selectExpr(*columns), sql)


add_view(
    "s1_table", only(1, CONFIG), views.s1_table, ["dataset_index", *rounded("s1", "error_s1")],
    "SELECT CAST(key_str AS INT) AS dataset_index, round(re, 6) + 0e0 AS s1, round(err_re, 6) + 0e0 AS error_s1 FROM s WHERE err_re IS NOT NULL",
)
add_view(
    "s2_bounds", only(2, CONFIG), lambda s: views.bounds(s, 3), ["key_str", "i", "q", *rounded("upper_re", "lower_re", "upper_im", "lower_im")],
    "SELECT key_str, i, q, round(re + q * err_re, 6) + 0e0 AS upper_re, round(re - q * err_re, 6) + 0e0 AS lower_re, "
    "round(im + q * err_im, 6) + 0e0 AS upper_im, round(im - q * err_im, 6) + 0e0 AS lower_im FROM s CROSS JOIN (VALUES (1), (2), (3)) AS v(q)",
)
for _n in (3, 4):
    add_view(
        f"s{_n}_mask", only(_n, CONFIG), lambda s: views.mask(s, 1), ["key_str", "i", "j", "masked_re AS masked"],
        "SELECT key_str, i, j, CASE WHEN abs(re) < err_re THEN 1 ELSE 0 END AS masked FROM s",
    )
add_view(
    "map_limits", CONFIG, lambda s: views.map_limits(s).withColumn("key_str", F.array_join("key", ",")), ["key_str", "ord", *rounded("limit_re")],
    "SELECT key_str, ord, round(max(abs(re)), 6) + 0e0 AS limit_re FROM s WHERE ord IN (3, 4) GROUP BY key_str, ord",
)
add_view(
    "s2_arcsinh", only(2, CONFIG), lambda s: views.arcsinh(s, 0.02), ["key_str", "i", *rounded("re")],
    "SELECT key_str, i, round(sign(re) * ln(abs(re * k) + sqrt(re * k * re * k + 1e0)) / k, 6) + 0e0 AS re FROM "
    "(SELECT s.*, 1e0 / (max(sqrt(re * re + im * im)) OVER (PARTITION BY key_str) * 0.02e0) AS k FROM s) u",
)


# The complex arcsinh: of z = scale * (re, im), sign * ln |w| and sign * arg w for w = z + sqrt(z^2 + 1), taken at re >= 0.
add_view(
    "s2_cross_arcsinh", only(2, CONFIG), lambda s: views.arcsinh(s, 0.02), ["key_str", "i", *rounded("re", "im")],
    "WITH k AS (SELECT s.*, 1e0 / (max(sqrt(re * re + im * im)) OVER (PARTITION BY key_str) * 0.02e0) AS k FROM s), "
    "z AS (SELECT *, CASE WHEN re < 0 THEN -1e0 ELSE 1e0 END AS sg FROM k), a AS (SELECT *, re * k * sg AS x, im * k * sg AS y FROM z), "
    "q AS (SELECT *, x * x - y * y + 1e0 AS u, 2e0 * x * y AS v FROM a), "
    "w AS (SELECT *, x + sqrt(greatest((sqrt(u * u + v * v) + u) / 2e0, 0e0)) AS wr, "
    "y + sqrt(greatest((sqrt(u * u + v * v) - u) / 2e0, 0e0)) * CASE WHEN v < 0 THEN -1e0 ELSE 1e0 END AS wi FROM q) "
    "SELECT key_str, i, round(sg * ln(sqrt(wr * wr + wi * wi)) / k, 6) + 0e0 AS re, round(sg * atan2(wi, wr) / k, 6) + 0e0 AS im FROM w",
    dict(auto_corr=False, cross_corr_2=CROSS2),
)
add_view(
    "s2_display", only(2, CONFIG), lambda s: views.display(s, ViewConfig(0.1, 0.4, [2], significance=2))["s2"], ["key_str", "i", "q", *rounded("re", "upper_re", "lower_im")],
    "SELECT key_str, i, q, round(re, 6) + 0e0 AS re, round(re + q * err_re, 6) + 0e0 AS upper_re, round(im - q * err_im, 6) + 0e0 AS lower_im "
    "FROM s CROSS JOIN (VALUES (1), (2)) AS v(q) WHERE err_re IS NOT NULL AND i / 16e0 BETWEEN 0.1e0 AND 0.4e0",
)
for _n, _limit, _settings in ((3, 0.4, HALF), (4, 0.3, FULL)):
    _low = -_limit if _n == 4 else -0.2
    _half = 2 if _n == 3 else 1
    add_view(
        f"s{_n}_display", only(_n, _settings), lambda s, n=_n, low=_low, high=_limit: views.display(s, ViewConfig(low, high, [n]))[f"s{n}"], ["key_str", "i", "j", *rounded("re", "im"), "masked_re AS masked"],
        f"SELECT key_str, i, j, round(re, 6) + 0e0 AS re, round(im, 6) + 0e0 AS im, CASE WHEN abs(re) < err_re THEN 1 ELSE 0 END AS masked FROM s "
        f"WHERE j / 16e0 BETWEEN {R.number(_low / _half)} AND {R.number(_limit / _half)} AND i / 16e0 BETWEEN {R.number(0 if _n == 3 else _low)} AND {R.number(_limit / _half)}",
    )
# Where an imaginary part is 0 but for rounding, so is its error, and which is larger says nothing.
add_view(
    "s4_mask_im", only(4, CONFIG), lambda s: views.mask(s, 1).filter("err_im > 1e-6"), ["key_str", "i", "j", "masked_im AS masked"],
    "SELECT key_str, i, j, CASE WHEN abs(im) < err_im THEN 1 ELSE 0 END AS masked FROM s WHERE err_im > 1e-6",
    dict(auto_corr=False, cross_corr_4=[(0, 1, 0, 1)]),
)
add_view(
    "map_limits_im", only(4, CONFIG), lambda s: views.map_limits(s).withColumn("key_str", F.array_join("key", ",")), ["key_str", "ord", *rounded("limit_re", "limit_im")],
    "SELECT key_str, ord, round(max(abs(re)), 6) + 0e0 AS limit_re, round(max(abs(im)), 6) + 0e0 AS limit_im FROM s GROUP BY key_str, ord",
    dict(auto_corr=False, cross_corr_4=[(0, 1, 0, 1)]),
)
add_view(
    "order_fetch", CONFIG, lambda s: views.of_order(s, 2, [(0, 1), (1,)]), ["key_str", "i", *rounded("re")],
    "SELECT key_str, i, round(re, 6) + 0e0 AS re FROM s WHERE ord = 2 AND key_str IN ('0,1', '1')",
    dict(cross_corr_2=CROSS2),
)
# Signed frequencies have no order 3: which orders are left, and of how many bins.
add_view(
    "orders_signed", FULL, lambda s: s.groupBy("ord").agg(F.count("*").alias("n_rows")), ["ord", "n_rows"],
    "SELECT ord, n_rows FROM (VALUES (1, CAST(2 AS BIGINT)), (2, 32), (4, 512)) AS v(ord, n_rows) WHERE EXISTS (SELECT 1 FROM s)",
)


def rejected_keys(spark: SparkSession, _: str) -> DataFrame:
    """Which cross keys name a channel that isn't selected, and are rejected."""

    def rejected(key: tuple[int, ...]) -> bool:
        try:
            CrossConfig(**{f"cross_corr_{len(key)}": [key]}).keys([0, 1])
        except InvalidConfigError:
            return True
        return False

    keys = [(0, 1), (0, 2), (1, 1, 0), (2, 1, 0), (0, 1, 0, 1), (0, 1, 0, 3)]
    return spark.createDataFrame([(",".join(map(str, k)), rejected(k)) for k in keys], "key_str string, rejected boolean")


add(
    "cross_key_check", rejected_keys,
    "SELECT key_str, list_max(CAST(string_split(key_str, ',') AS INT[])) > 1 AS rejected FROM (VALUES ('0,1'), ('0,2'), ('1,1,0'), ('2,1,0'), ('0,1,0,1'), ('0,1,0,3')) AS v(key_str)",
)


def save_load_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spectrum written as parquet and read again."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:  # executors of a cluster don't share a temporary folder
        if not spark.sparkContext.master.startswith("local["):
            raise InvalidConfigError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="specloom-")
    path = f"{folder}/specloom-spectrum-{uuid.uuid4().hex}"
    write_table(_spectrum(only(2, CONFIG), {}, spark, sf_dir), path)
    return read_table(spark, path).selectExpr("key_str", "i", *rounded("re"))


add("save_load_roundtrip", save_load_roundtrip, _sql(only(2, CONFIG), {}, "SELECT key_str, i, round(re, 6) + 0e0 AS re FROM s"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of both channels and their cross spectra, with errors."""
    return _spectrum(CONFIG, dict(cross_corr_2=CROSS2, cross_corr_4=[(0, 1, 0, 1)]), spark, sf_dir)
