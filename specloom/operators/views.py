"""What is shown of a spectrum, as DataFrames: tables, bounds, masks, scaled maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.config import TIME_UNITS, InvalidConfigError, SpectrumConfig, ViewConfig
from specloom.plans.geometry import geometry


def of_order(spectrum: DataFrame, order: int, keys: list[tuple[int, ...]] | None = None) -> DataFrame:
    """The rows of one order and, if given, of some keys; no rows where there is nothing."""
    rows = spectrum.filter(F.col("ord") == order)
    if keys is None:
        return rows
    wanted = F.lit(False)
    for key in keys:
        wanted = wanted | (F.col("key") == F.array(*map(F.lit, key)))
    return rows.filter(wanted)


def s1_table(spectrum: DataFrame) -> DataFrame:
    """The first order by channel, where an error is known."""
    rows = of_order(spectrum, 1).filter(F.col("err_re").isNotNull())
    return rows.select(F.col("key")[0].alias("dataset_index"), F.col("re").alias("s1"), F.col("err_re").alias("error_s1"))


def bounds(spectrum: DataFrame, significance: int) -> DataFrame:
    """For q = 1 to significance the values plus and less q errors, of both components."""
    if significance < 1:
        raise InvalidConfigError("significance must be a positive integer")
    q = F.explode(F.sequence(F.lit(1), F.lit(significance))).alias("q")
    rows = spectrum.select("*", q)
    return rows.select(
        *spectrum.columns,
        "q",
        *((F.col(c) + sign * F.col("q") * F.col(f"err_{c}")).alias(f"{name}_{c}") for c in ("re", "im") for name, sign in (("upper", 1), ("lower", -1))),
    )


def mask(spectrum: DataFrame, significance: int) -> DataFrame:
    """masked_re and masked_im: 1 where a component is within `significance` errors of 0, else 0."""
    return spectrum.withColumns(
        {f"masked_{c}": F.when(F.abs(F.col(c)) < significance * F.col(f"err_{c}"), 1).otherwise(0) for c in ("re", "im")}
    )


def complex_asinh(re: Column, im: Column) -> tuple[Column, Column]:
    """asinh z = ln(z + sqrt(z^2 + 1)), by the odd symmetry with a real part of 0 or more, where nothing cancels."""
    sign = F.when(re < 0, -1.0).otherwise(1.0)
    a, b = re * sign, im * sign
    u, v = a * a - b * b + 1, 2 * a * b
    size = F.hypot(u, v)
    root_re = F.sqrt(F.greatest(F.lit(0.0), (size + u) / 2))
    root_im = F.sqrt(F.greatest(F.lit(0.0), (size - u) / 2)) * F.when(v < 0, -1.0).otherwise(1.0)
    x, y = a + root_re, b + root_im
    return sign * F.log(F.hypot(x, y)), sign * F.atan2(y, x)


def arcsinh(spectrum: DataFrame, alpha: float, componentwise: bool = False) -> DataFrame:
    """Values and errors on an arcsinh scale whose linear part ends at alpha times a key's largest absolute value.

    By default of the complex numbers, which mixes their components; componentwise keeps these apart.
    """
    if alpha <= 0:
        raise InvalidConfigError("alpha must be above 0")
    peak = spectrum.groupBy("key", "ord").agg(F.max(F.hypot("re", "im")).alias("peak"))
    scale = F.when(F.col("peak") > 0, 1 / (F.col("peak") * alpha)).otherwise(F.lit(1.0))
    rows = spectrum.join(peak, ["key", "ord"]).withColumn("scale", scale)
    new = {}
    for re, im in (("re", "im"), ("err_re", "err_im")):
        x, y = F.col("scale") * F.col(re), F.col("scale") * F.col(im)
        a, b = (F.asinh(x), F.asinh(y)) if componentwise else complex_asinh(x, y)
        new |= {re: a / F.col("scale"), im: b / F.col("scale")}
    return rows.withColumns(new).select(spectrum.columns)


def map_limits(spectrum: DataFrame) -> DataFrame:
    """The symmetric colour limit of each two-dimensional map: the largest absolute value of each component."""
    return spectrum.filter("ord IN (3, 4)").groupBy("key", "ord").agg(F.max(F.abs("re")).alias("limit_re"), F.max(F.abs("im")).alias("limit_im"))


def first_frame(signal: DataFrame, config: SpectrumConfig) -> DataFrame:
    """The samples of the first window with their times."""
    n = geometry(config).n
    return signal.filter(F.col("t") < n).select("ch", "t", (F.col("t") * config.dt).alias("time"), "x")


def unit_labels(spark: SparkSession) -> DataFrame:
    """The time unit of each frequency unit."""
    return spark.createDataFrame(sorted(TIME_UNITS.items()), "f_unit string, t_unit string")


def time_unit(f_unit: str) -> str:
    if f_unit not in TIME_UNITS:
        raise InvalidConfigError(f"f_unit must be one of {', '.join(TIME_UNITS)}")
    return TIME_UNITS[f_unit]


def _scaled(spectrum: DataFrame, view: ViewConfig) -> DataFrame:
    on, alpha = view.arcsinh_scale
    return arcsinh(spectrum, alpha) if on else spectrum


def s2_view(spectrum: DataFrame, view: ViewConfig) -> DataFrame:
    """Order 2 within the frequency limits, scaled if asked, with its bounds; rows without an error aren't shown."""
    rows = _scaled(of_order(spectrum, 2).filter(F.col("err_re").isNotNull()), view)
    return bounds(rows.filter(F.col("f_i").between(view.f_min, view.f_max)), view.significance)


def map_view(spectrum: DataFrame, order: int, view: ViewConfig) -> DataFrame:
    """Order 3 or 4 within the limits, halved for order 3, with its mask. Rows are f_i, columns f_j."""
    if order not in (3, 4):
        raise InvalidConfigError("maps are of order 3 or 4")
    half = 2 if order == 3 else 1
    low, high = view.f_min / half, view.f_max / half
    rows = _scaled(of_order(spectrum, order), view)
    rows = rows.filter(F.col("f_j").between(low, high) & F.col("f_i").between(max(low, 0) if order == 3 else low, high))
    return mask(rows, view.significance)


def display(spectrum: DataFrame, view: ViewConfig) -> dict[str, DataFrame]:
    """All views that the settings ask for, by name; none is run."""
    made = {1: ("s1", lambda: s1_table(spectrum)), 2: ("s2", lambda: s2_view(spectrum, view))}
    made |= {n: (f"s{n}", lambda n=n: map_view(spectrum, n, view)) for n in (3, 4)}
    return {made[n][0]: made[n][1]() for n in view.display_orders}
