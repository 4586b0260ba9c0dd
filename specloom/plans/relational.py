"""Single spectra as SQL text that Spark and other engines run alike: window arithmetic, a transform by a join with a table of
twiddles, and cumulants as averages over joins.

Complex values are pairs of expressions. Means are named in one select and combined in the next.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from specloom.functions.taper import SIGMA
from specloom.plans.geometry import Geometry


@dataclass(frozen=True)
class Complex:
    re: str
    im: str

    def __mul__(self, other: Complex) -> Complex:
        return Complex(f"({self.re} * {other.re} - {self.im} * {other.im})", f"({self.re} * {other.im} + {self.im} * {other.re})")

    def __add__(self, other: Complex) -> Complex:
        return Complex(f"({self.re} + {other.re})", f"({self.im} + {other.im})")

    def __sub__(self, other: Complex) -> Complex:
        return Complex(f"({self.re} - {other.re})", f"({self.im} - {other.im})")

    def scaled(self, factor: float) -> Complex:
        return Complex(f"({number(factor)} * {self.re})", f"({number(factor)} * {self.im})")

    @property
    def conj(self) -> Complex:
        return Complex(self.re, f"(-({self.im}))")


def column(name: str, table: str = "") -> Complex:
    dot = f"{table}." if table else ""
    return Complex(f"{dot}{name}re", f"{dot}{name}im")


def number(x: float) -> str:
    """A double literal in any dialect."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def means(values: dict[str, Complex]) -> str:
    return ", ".join(f"avg({v.re}) AS {name}re, avg({v.im}) AS {name}im" for name, v in values.items())


def twiddles_sql(g: Geometry) -> str:
    """(p, k, c, d): the taper's weight at p times cos and -sin for bin k, times dt, so that the sums of x c and x d are a
    coefficient. All rows come from one range, so the text is as long for any window."""
    n, bins, dt = g.n, g.transform_bins, g.config.dt
    width = number(2 * (n + 1) * SIGMA)
    bell = lambda x: f"exp(-(({x} - {number(n / 2)}) / {width}) * (({x} - {number(n / 2)}) / {width}))"
    plain = lambda x: np.exp(-(((x - n / 2) / (2 * (n + 1) * SIGMA)) ** 2))
    edge = float(plain(-0.5) / (plain(n + 0.5) + plain(-n - 1.5)))
    grid = f"(p * {number(n)} / {number(max(n - 1, 1))})"
    raw = f"{bell(grid)} - {number(edge)} * ({bell(f'({grid} + {number(n + 1)})')} + {bell(f'({grid} - {number(n + 1)})')})"
    line = np.linspace(0, n, n)
    power = np.sum((plain(line) - edge * (plain(line + n + 1) + plain(line - n - 1))) ** 2)
    scale, turn = number(dt / np.sqrt(power * dt)), number(2 * np.pi / n)
    return (
        f"SELECT p, k, {scale} * w * cos({turn} * ((p * k) % {n})) AS c, -{scale} * w * sin({turn} * ((p * k) % {n})) AS d FROM (SELECT p, k, {raw} AS w FROM "
        f"(SELECT CAST(floor(id / {len(bins)}) AS BIGINT) AS p, id % {len(bins)} + ({bins[0]}) AS k FROM range({n * len(bins)}) AS r(id)) u) v"
    )


def base(g: Geometry, n: int, signal: str) -> dict[str, str]:
    """The common tables: signal, framed samples, twiddles and coefficients aw; awm also has the bins below 0."""
    points = g.chunk_points
    chunk = f"(2 * floor((t - s) / {points}) + CASE WHEN s > 0 THEN 1 ELSE 0 END)"
    cap = "" if g.config.break_after is None else f" AND {chunk} < {g.config.break_after}"
    tables = {
        "signal": signal,
        "shifted": f"SELECT ch, t, x, 0 AS s FROM signal UNION ALL SELECT ch, t, x, {g.h} AS s FROM signal WHERE t >= {g.h}",
        "framed": f"SELECT ch, s, CAST(floor((t - s) / {points}) AS BIGINT) AS fr, CAST(floor(((t - s) % {points}) / {g.n}) AS BIGINT) AS wi, "
        f"CAST((t - s) % {g.n} AS INT) AS p, x FROM shifted WHERE floor((t - s) / {points}) * {points} + {points} + s <= {n}{cap}",
        "tw": twiddles_sql(g),
        "aw": "SELECT ch, fr, s, wi, k, sum(x * c) AS re, sum(x * d) AS im FROM framed JOIN tw ON framed.p = tw.p GROUP BY ch, fr, s, wi, k",
    }
    if not g.full:
        tables["awm"] = "SELECT ch, fr, s, wi, k, re, im FROM aw UNION ALL SELECT ch, fr, s, wi, -k AS k, re, -im AS im FROM aw WHERE k > 0"
    return tables


def order1(g: Geometry, key: tuple[int, ...]) -> str:
    value = Complex("avg(re)", "avg(im)").conj.scaled(1 / g.norm(1))
    return f"SELECT fr, s, 0 AS i, CAST(NULL AS INT) AS j, {value.re} AS re, {value.im} AS im FROM aw WHERE ch = {key[0]} AND k = 0 GROUP BY fr, s"


def order2(g: Geometry, key: tuple[int, ...]) -> str:
    low, high = g.bins[0], g.bins[-1]
    re, im = "covar_samp(a.re, b.re) + covar_samp(a.im, b.im)", "covar_samp(a.im, b.re) - covar_samp(a.re, b.im)"
    value = Complex(f"({re})", f"({im})").conj.scaled(1 / g.norm(2))
    return (
        f"SELECT a.fr, a.s, a.k AS i, CAST(NULL AS INT) AS j, {value.re} AS re, {value.im} AS im FROM aw a JOIN aw b "
        f"ON a.fr = b.fr AND a.s = b.s AND a.wi = b.wi AND a.k = b.k WHERE a.ch = {key[0]} AND b.ch = {key[1]} AND a.k BETWEEN {low} AND {high} GROUP BY a.fr, a.s, a.k"
    )


def order3(g: Geometry, key: tuple[int, ...]) -> str:
    m, rows, columns = g.m, g.rows3, g.columns3
    a, b, c = column("", "a"), column("", "b"), column("", "c").conj
    inner = (
        f"SELECT a.fr, a.s, b.k AS i, a.k AS j, {means({'abc': a * b * c, 'ab': a * b, 'ac': a * c, 'bc': b * c, 'a': a, 'b': b, 'c': c})} "
        f"FROM awm a JOIN awm b ON a.fr = b.fr AND a.s = b.s AND a.wi = b.wi JOIN awm c ON a.fr = c.fr AND a.s = c.s AND a.wi = c.wi AND c.k = a.k + b.k "
        f"WHERE a.ch = {key[0]} AND b.ch = {key[1]} AND c.ch = {key[2]} AND b.k BETWEEN {rows[0]} AND {rows[-1]} AND a.k BETWEEN {columns[0]} AND {columns[-1]} "
        f"GROUP BY a.fr, a.s, b.k, a.k"
    )
    ma, mb, mc = column("a"), column("b"), column("c")
    central = column("abc") - column("ab") * mc - column("ac") * mb - column("bc") * ma + (ma * mb * mc).scaled(2)
    value = central.scaled(m**2 / ((m - 1) * (m - 2))).conj.scaled(1 / g.norm(3))
    return f"SELECT fr, s, i, j, {value.re} AS re, {value.im} AS im FROM ({inner}) u"


def order4(g: Geometry, key: tuple[int, ...]) -> str:
    m, low, high = g.m, g.bins[0], g.bins[-1]
    centred = (
        "SELECT ch, fr, s, wi, k, re - avg(re) OVER (PARTITION BY ch, fr, s, k) AS re, im - avg(im) OVER (PARTITION BY ch, fr, s, k) AS im "
        f"FROM aw WHERE k BETWEEN {low} AND {high} AND ch IN ({', '.join(map(str, sorted(set(key))))})"
    )
    pair = lambda one, two: (
        "SELECT e.fr, e.s, e.wi, e.k, e.re AS ure, e.im AS uim, f.re AS vre, -f.im AS vim "
        f"FROM centred e JOIN centred f ON e.fr = f.fr AND e.s = f.s AND e.wi = f.wi AND e.k = f.k WHERE e.ch = {one} AND f.ch = {two}"
    )
    x, y, z, w = column("u", "p"), column("v", "p"), column("u", "q"), column("v", "q")
    values = {"xyzw": x * y * (z * w), "xy": x * y, "zw": z * w, "xz": x * z, "yw": y * w, "xw": x * w, "yz": y * z}
    inner = (
        f"SELECT p.fr, p.s, p.k AS i, q.k AS j, {means(values)} FROM ({pair(key[0], key[1])}) p JOIN ({pair(key[2], key[3])}) q "
        "ON p.fr = q.fr AND p.s = q.s AND p.wi = q.wi GROUP BY p.fr, p.s, p.k, q.k"
    )
    pairs = column("xy") * column("zw") + column("xz") * column("yw") + column("xw") * column("yz")
    central = column("xyzw").scaled(m + 1) - pairs.scaled(m - 1)
    value = central.scaled(m**2 / ((m - 1) * (m - 2) * (m - 3))).conj.scaled(1 / g.norm(4))
    return f"WITH centred AS ({centred}) SELECT fr, s, i, j, {value.re} AS re, {value.im} AS im FROM ({inner}) u"


ORDERS = {1: order1, 2: order2, 3: order3, 4: order4}


def with_tables(tables: dict[str, str], body: str) -> str:
    """`body`, which may begin with tables of its own, over `tables`."""
    return "WITH " + ", ".join(f"{name} AS ({text})" for name, text in tables.items()) + (f", {body[5:]}" if body.startswith("WITH ") else f" {body}")


def wanted(orders: list[int], cross: list[tuple[int, ...]], channels: list[int], auto: bool) -> list[tuple[str, int, tuple[int, ...]]]:
    """(printed key, order, channels) of all spectra."""
    found = [(str(c), n, (c,) * n) for c in channels for n in orders] if auto else []
    return found + [(",".join(map(str, key)), len(key), key) for key in cross]


def batches_sql(g: Geometry, spectra: list[tuple[str, int, tuple[int, ...]]]) -> str:
    """Sums and variances of the single spectra of each error batch, for all keys, over the tables of base()."""
    m_var, one = g.config.m_var, []
    for name, order, key in spectra:
        one.append(
            f"SELECT '{name}' AS key, {order} AS ord, CAST(i AS INT) AS i, CAST(j AS INT) AS j, "
            f"CAST(floor((2 * fr + CASE WHEN s > 0 THEN 1 ELSE 0 END) / {m_var}) AS BIGINT) AS batch, re, im FROM ({ORDERS[order](g, key)}) t"
        )
    full = lambda x: f"CASE WHEN count(*) = {m_var} THEN var_samp({x}) END"
    return (
        f"SELECT key, ord, i, j, batch, count(*) AS n, sum(re) AS sum_re, sum(im) AS sum_im, {full('re')} AS var_re, {full('im')} AS var_im "
        f"FROM ({' UNION ALL '.join(one)}) single GROUP BY key, ord, i, j, batch"
    )


def spectrum_sql(g: Geometry, n: int, signal: str, spectra: list[tuple[str, int, tuple[int, ...]]]) -> str:
    """The finished spectra: key, ord, i, j, re, im, err_re, err_im, n_chunks, n_batches."""
    m_var = g.config.m_var
    error = lambda x: f"sqrt(CASE WHEN avg({x}) > 0 THEN avg({x}) ELSE 0e0 END / {m_var}) / 2"
    body = (
        f"SELECT key, ord, i, j, sum(sum_re) / sum(n) AS re, sum(sum_im) / sum(n) AS im, CASE WHEN count(var_re) > 0 THEN {error('var_re')} END AS err_re, "
        f"CASE WHEN count(var_re) > 0 THEN {error('var_im')} END AS err_im, CAST(sum(n) AS BIGINT) AS n_chunks, CAST(count(var_re) AS BIGINT) AS n_batches "
        f"FROM ({batches_sql(g, spectra)}) b GROUP BY key, ord, i, j"
    )
    return with_tables(base(g, n, signal), body)
