"""Parsing and formatting of job parameters, names, years and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE, FALSE = ("true", "1", "yes", "y", "on"), ("false", "0", "no", "n", "off")
FIRST_YEAR, LAST_YEAR = 1999, 2024
PERIODS = {"P1": (1999, 2005), "P2": (2006, 2012), "P3": (2013, 2018), "P4": (2019, 2024)}
SENSORS = {"P1": "L5/L7", "P2": "L5/L7", "P3": "L8", "P4": "L8/L9"}


def parse_bool(c: Column, default: bool = True, unknown: bool | None = None) -> Column:
    """Truthy text; NULL and blank give ``default``, other text ``unknown``
    (``default`` where not set)."""
    t = F.lower(F.trim(c.cast("string")))
    other = default if unknown is None else unknown
    return (F.when(t.isNull() | t.isin("", "nan"), F.lit(default)).when(t.isin(*TRUE), F.lit(True)).when(t.isin(*FALSE), F.lit(False)).otherwise(F.lit(other)))


def split_list(c: Column) -> Column:
    """Items between commas or semicolons, trimmed, blanks dropped; NULL: none."""
    t = F.when(c.isNull() | F.lower(F.trim(c)).isin("", "nan"), F.lit("")).otherwise(c)
    return F.filter(F.transform(F.split(t, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def satellite(c: Column) -> Column:
    """``5`` and ``L5`` are ``l5``; what is none is NULL."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.rlike("^l[0-9]+$"), t).when(t.isin("4", "5", "7", "8", "9"), F.concat(F.lit("l"), t))


def iso_date(c: Column, default: str | None = None) -> Column:
    """``dd/MM/yyyy`` or ``yyyy-MM-dd``, else ``default``."""
    return F.coalesce(F.try_to_date(c, "dd/MM/yyyy"), F.try_to_date(c, "yyyy-MM-dd"), F.lit(default).cast("date"))


def first_of(*cols: Column) -> Column:
    """The first that is neither NULL nor blank."""
    return F.coalesce(*(F.when(F.trim(c.cast("string")) != "", c) for c in cols))


def year_list(c: Column, low: int = FIRST_YEAR, high: int = LAST_YEAR, digits_only: bool = True) -> Column:
    """Sorted distinct years of a comma-joined text; what is none is skipped."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    if digits_only:
        parts = F.filter(parts, lambda x: x.rlike("^[0-9]+$"))
        years = F.transform(parts, lambda x: x.try_cast("int"))
    else:
        years = F.transform(parts, lambda x: F.floor(x.try_cast("double")).cast("int"))
    return F.array_sort(F.array_distinct(F.filter(years, lambda y: y.isNotNull() & y.between(low, high))))


def clean_text(c: Column, default: str = "") -> Column:
    t = F.trim(c.cast("string"))
    return F.when(t.isNull() | F.lower(t).isin("nan", "none", ""), F.lit(default)).otherwise(t)


def safe_int(c: Column, default: int = -9999) -> Column:
    """Through a double, toward zero; what is no number is ``default``."""
    d = c.cast("string").try_cast("double")
    return F.when(d.isNull() | F.isnan(d), F.lit(default)).otherwise(F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("int"))


def number(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(default))


def mgrs_id(c: Column) -> Column:
    """Upper case without blanks; NULL unless two digits lead five letters or more."""
    t = F.upper(F.replace(F.trim(c), F.lit(" "), F.lit("")))
    return F.when(t.rlike("^[0-9]{2}") & (F.length(t) >= 5), t)


def utm_epsg(zone: Column, latitude: Column) -> Column:
    return F.when(latitude >= 0, 32600).otherwise(32700) + zone


RASTER_NAME = r"^([0-9]{2}[A-Z]{3})_([a-z]+)_([0-9]+x[0-9]+)_C([0-9]+)_R([0-9]+)_([0-9]{4})"


def raster_name(stem: Column) -> Column:
    """struct(tile, mode, size, col, row, year) of a raster's name."""
    g = lambda i: F.regexp_extract(stem, RASTER_NAME, i)
    return F.when(stem.rlike(RASTER_NAME), F.struct(
        g(1).alias("tile"), g(2).alias("mode"), g(3).alias("size"), g(4).cast("int").alias("col"), g(5).cast("int").alias("row"), g(6).cast("int").alias("year")))


def class_of_name(stem: Column) -> Column:
    """The last group of digits."""
    return F.try_element_at(F.regexp_extract_all(stem, F.lit(r"([0-9]+)"), F.lit(1)), F.lit(-1)).cast("int")


def utm_of_path(path: Column) -> Column:
    p = F.upper(path)
    return F.when(p.contains("UTM18"), 18).when(p.contains("UTM19"), 19)


def key(*cols: Column) -> Column:
    """Parts joined by a vertical bar."""
    return F.concat_ws("|", *(c.cast("string") for c in cols))


def rect_id(tile: Column, mode: Column, size: Column, col: Column, row: Column) -> Column:
    return F.format_string("%s_%s_%s_C%03d_R%03d", tile, mode, size, col, row)


def datetime_slug(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("/"), F.lit("_")), F.lit("-"), F.lit(""))


def period_of(year: Column) -> Column:
    out = None
    for p, (a, b) in PERIODS.items():
        out = (F if out is None else out).when(year.between(a, b), p)
    return out


def sensor_of(period: Column) -> Column:
    out = None
    for p, s in SENSORS.items():
        out = (F if out is None else out).when(period == p, s)
    return out


def extent_target(tier: Column) -> Column:
    return F.when(tier == 0, 100.0).when(tier == 1, 85.0).when(tier == 2, 90.0).when(tier == 3, 95.0).otherwise(90.0)


def label_id(corr: Column, class_id: Column) -> Column:
    return F.when(F.coalesce(corr, F.lit(-9999)) > 0, corr).otherwise(F.coalesce(class_id, F.lit(-9999)))


def stored_to_physical(c: Column) -> Column:
    """Stored indices carry an offset of one and a scale of ten thousand."""
    return c / 10000 - 1


def safe_pct(num: Column, den: Column) -> Column:
    return F.when(den > 0, F.try_divide(num, den) * 100).otherwise(0.0)


def modal_cap(zone: Column) -> Column:
    return F.when(zone == 18, 14).when(zone == 19, 32).otherwise(22)


def satellite_of_year(year: Column) -> Column:
    return F.when(year <= 1999, "l5").when(year <= 2002, "l7").when(year == 2003, "l5").when(year <= 2012, "l7").when(year <= 2022, "l8").otherwise("l9")


def sensors_allowed(year: Column) -> Column:
    base = F.when(year <= 1998, F.array(F.lit("l4"), F.lit("l5"))).when(year <= 2012, F.array(F.lit("l5"))).when(year <= 2020, F.array(F.lit("l8"))).otherwise(F.array(F.lit("l8"), F.lit("l9")))
    return F.when((year >= 1984) & (year < 2017), F.array_append(base, F.lit("l7"))).otherwise(base)


def nearest_year(target: int, years: Column) -> Column:
    """The year of the list nearest to ``target``, the earlier of two; NULL if none."""
    return F.array_min(F.transform(years, lambda y: F.struct(F.abs(y - target).alias("d"), y.alias("y"))))["y"]


def compact_years(years: Column, max_n: int | None = None) -> Column:
    """Sorted distinct years, thinned to ``max_n`` that spread evenly (rounding
    half to even) and keep the first and last."""
    ys = F.array_sort(F.array_distinct(F.filter(years, lambda y: y.isNotNull() & y.between(FIRST_YEAR, LAST_YEAR))))
    if max_n is None:
        return ys
    if max_n <= 2:
        return F.slice(ys, 1, max_n)
    n = F.size(ys)
    at = F.transform(F.sequence(F.lit(0), F.lit(max_n - 1)), lambda i: F.bround(i * (n - 1) / F.lit(max_n - 1)).cast("int"))
    # steps of one or more keep all places apart, so no refill is needed
    return F.when(n > max_n, F.transform(F.array_distinct(at), lambda i: F.get(ys, i))).otherwise(ys)


def char_sum(c: Column) -> Column:
    """Sum of the code points of a text."""
    return F.aggregate(F.split(c, ""), F.lit(0), lambda s, x: s + F.when(x == "", 0).otherwise(F.ascii(x)))
