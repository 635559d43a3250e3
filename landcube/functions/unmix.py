"""Linear spectral unmixing as column arithmetic.

Fractions are the least-squares solution, a constant matrix times the bands: six
multiply-adds each. Input scale is 0 to 10000. Results are clamped and truncated
to bytes, as the stored bands are.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
#: Endmember spectra by band (fixed values), shared by all sensors.
ENDMEMBERS = {
    "gv": (119.0, 475.0, 169.0, 6250.0, 2399.0, 675.0),
    "npv": (1514.0, 1597.0, 1421.0, 3053.0, 7707.0, 1975.0),
    "soil": (1799.0, 2479.0, 3158.0, 5437.0, 7707.0, 6646.0),
    "cloud": (4031.0, 8714.0, 7900.0, 8989.0, 7002.0, 6607.0),
}
#: The three-endmember model (fixed values).
SMALL = {
    "subs_small": (1780.0, 3370.0, 4580.0, 5590.0, 6830.0, 6450.0),
    "veg_small": (300.0, 600.0, 310.0, 6690.0, 2400.0, 960.0),
    "dark_small": (190.0, 100.0, 50.0, 70.0, 30.0, 20.0),
}


@functools.lru_cache(maxsize=None)
def _solve(rows: tuple) -> tuple:
    return tuple(map(tuple, np.linalg.pinv(np.array(rows).T).tolist()))


def weights(model: dict) -> dict[str, tuple[float, ...]]:
    """Fraction name to its six band weights."""
    return dict(zip(model, _solve(tuple(model.values()))))


def byte(c: Column) -> Column:
    """Clamped to 0..255 and truncated; NULL stays."""
    return F.when(c.isNotNull(), F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0)))).cast("int")


def fractions(df: DataFrame, model: dict = ENDMEMBERS) -> DataFrame:
    out = df
    for name, w in weights(model).items():
        total = sum((F.col(b) * F.lit(x) for b, x in zip(BANDS[1:], w[1:])), F.col(BANDS[0]) * F.lit(w[0]))
        out = out.withColumn(name, byte(F.greatest(total, F.lit(0.0) * total) * 100))
    if model is ENDMEMBERS:
        out = out.withColumn("shade", byte(F.abs(F.col("gv") + F.col("npv") + F.col("soil") - 100).cast("double")))
    return out


def nd_byte(a: Column, b: Column) -> Column:
    return byte(F.try_divide(a - b, a + b) * 100 + 100)


def fraction_indices(df: DataFrame) -> DataFrame:
    """gvs, ndfi, sefi, wefi and fns from the fractions."""
    gv, npv, soil, shade = (F.col(c).cast("double") for c in ("gv", "npv", "soil", "shade"))
    total = gv + npv + soil
    gvs = byte(F.try_divide(100 * gv, total))
    return df.withColumns({
        "gvs": gvs,
        "ndfi": nd_byte(gvs.cast("double"), npv + soil),
        "sefi": nd_byte(F.try_divide(100 * (gv + npv), total), soil),
        "wefi": nd_byte(gv + npv, soil + shade),
        "fns": nd_byte(gv + shade, soil),
    })
