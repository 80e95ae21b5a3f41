"""Math, angles, arrays, maps and dates as column expressions (F family)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(x: Column | str, low: float, high: float) -> Column:
    """x brought into ``low`` .. ``high``; null stays null."""
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), F.lit(low)), F.lit(high)))


def fisher_z_mean(r: Column | str) -> Column:
    """Aggregate: tanh of the mean of atanh(r), r clipped to ±0.999999."""
    return F.tanh(F.avg(F.atanh(clip(r, -0.999999, 0.999999))))


def fisher_z_bounds(r: Column | str, n: Column | str, z: float = 1.959963984540054) -> list[Column]:
    """``low``, ``high``: confidence bounds of a correlation of ``n`` pairs; null for n <= 3."""
    mid = F.atanh(clip(r, -0.999999, 0.999999))
    half = F.when(_c(n) > 3, F.lit(z) / F.sqrt(_c(n) - 3))
    return [F.tanh(mid - half).alias("low"), F.tanh(mid + half).alias("high")]


def angle_difference(a: Column | str, b: Column | str) -> Column:
    """a - b in degrees, brought to -180 .. 180."""
    return F.pmod(_c(a) - _c(b) + 180.0, F.lit(360.0)) - 180.0


def angle_between(u: Column | str, v: Column | str) -> Column:
    """Angle of two arrays in degrees; null if a norm is 0."""
    return F.degrees(F.acos(clip(cosine(u, v), -1.0, 1.0)))


def dot(u: Column | str, v: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(u), _c(v), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(u: Column | str, v: Column | str) -> Column:
    """Cosine of two arrays; null if a norm is 0 or the lengths differ."""
    n = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when((n > 0) & (F.size(_c(u)) == F.size(_c(v))), dot(u, v) / n)


def distance2(u: Column | str, v: Column | str) -> Column:
    """Squared Euclidean distance of two arrays."""
    return F.aggregate(F.zip_with(_c(u), _c(v), lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def spectrum(values: Column | str) -> list[Column]:
    """Of an array of positive numbers: ``log_sum``, ``geometric_mean``, ``softness`` (sum of 1/x); null if one isn't positive."""
    v = _c(values)
    fine = (F.size(v) > 0) & F.forall(v, lambda x: x > 0)
    logs = F.when(fine, F.aggregate(v, F.lit(0.0), lambda s, x: s + F.ln(x.cast("double"))))
    soft = F.when(fine, F.aggregate(v, F.lit(0.0), lambda s, x: s + 1 / x.cast("double")))
    return [logs.alias("log_sum"), F.exp(logs / F.size(v)).alias("geometric_mean"), soft.alias("softness")]


def log_slope(values: Column | str) -> Column:
    """Slope of ln(value) over ln(rank from 1) of an array of positive numbers; null under two entries."""
    v = _c(values)
    n = F.size(v).cast("double")
    pairs = F.transform(v, lambda x, i: F.struct(F.ln((i + 1).cast("double")).alias("x"), F.ln(x.cast("double")).alias("y")))
    sums = F.aggregate(
        pairs, F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "xx", "xy")]),
        lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["xy"] + p["x"] * p["y"]).alias("xy")),
    )
    return F.when((n >= 2) & F.forall(v, lambda x: x > 0), F.try_divide(n * sums["xy"] - sums["x"] * sums["y"], n * sums["xx"] - sums["x"] * sums["x"]))


def masked(values: Column | str, mask: Column | str) -> Column:
    """Entries whose mask entry is true."""
    return F.transform(F.filter(F.arrays_zip(_c(values).alias("v"), _c(mask).alias("m")), lambda s: s["m"]), lambda s: s["v"])


def take(values: Column | str, places: Column | str) -> Column:
    """Entries at the given places (from 0), null where there is none."""
    return F.transform(_c(places), lambda i: F.get(_c(values), i))


def padded(values: Column | str, width: int) -> list[Column]:
    """``padded``: the array with zeros up to ``width``; ``mask``: which entries are real.

    An array that is too long, or has a null, NaN or infinite entry, or only zeros fails the query.
    """
    v = _c(values).cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0) & (F.size(v) <= width)
    checked = F.when(fine, v).otherwise(F.raise_error(F.lit("array too long, not finite or all zero")).cast("array<double>"))
    rest = F.lit(width) - F.size(v)
    return [
        F.when(v.isNotNull(), F.concat(checked, F.array_repeat(F.lit(0.0), rest))).alias("padded"),
        F.when(v.isNotNull(), F.concat(F.array_repeat(F.lit(True), F.size(v)), F.array_repeat(F.lit(False), rest))).alias("mask"),
    ]


def lookup(key: Column | str, table: dict[str, float], default: float | None = None) -> Column:
    """Value of a small fixed table; ``default`` for keys it lacks."""
    pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(pairs, _c(key)), F.lit(default).cast("double"))


def min_max(table: dict[str, float]) -> dict[str, float]:
    """The table scaled to 0 .. 1; a constant table becomes 0."""
    low, high = min(table.values()), max(table.values())
    return {k: (v - low) / (high - low) if high > low else 0.0 for k, v in table.items()}


def property_sum(seq: Column | str, table: dict[str, float]) -> Column:
    """Sum of a per-letter table over a sequence; letters outside count 0."""
    pairs = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
    return F.aggregate(F.split(_c(seq), ""), F.lit(0.0), lambda s, ch: s + F.coalesce(F.try_element_at(pairs, ch), F.lit(0.0)))


def month(at: Column | str) -> Column:
    """``yyyy-MM`` of a time."""
    return F.date_format(_c(at), "yyyy-MM")


def stamp(at: Column | str) -> Column:
    """ISO text of a time to the second, in the session's zone."""
    return F.date_format(_c(at), "yyyy-MM-dd'T'HH:mm:ss")
