"""Spectral indices as column expressions.

Inputs are reflectances (0 to 1 unless an index says otherwise); normalised
differences are stored with an offset of one. A zero denominator masks (NULL), as
does a NULL band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nd(a: Column, b: Column) -> Column:
    """Normalised difference."""
    return F.try_divide(a - b, a + b)


def ndvi(nir, red):
    return nd(nir, red) + 1


def ndbi(swir1, nir):
    return nd(swir1, nir) + 1


def ndmi(nir, swir1):
    return nd(nir, swir1) + 1


def ndsi(green, swir1):
    return nd(green, swir1) + 1


def mbi(swir1, swir2, nir):
    return F.try_divide(swir1 - swir2 - nir, swir1 + swir2 + nir + 1e-6) + 0.5


def ui(swir2, nir):
    return nd(swir2, nir) + 1


def bu(nir, red, swir1):
    """Built-up: the offsets of both indices cancel."""
    return ndbi(swir1, nir) - ndvi(nir, red)


def ebbi(nir_dn, swir1_dn, tir_dn):
    return F.try_divide(swir1_dn - nir_dn, 10 * F.sqrt(swir1_dn + tir_dn))


def ndwi(nir, swir1):
    """The pipeline's water index, equal to ``ndmi``."""
    return nd(nir, swir1) + 1


def ndwi_green(green, nir):
    """The other published form, kept apart."""
    return nd(green, nir) + 1


def mndwi(green, swir1):
    return nd(green, swir1) + 1


def savi(nir, red):
    return F.try_divide(1.5 * (nir - red), 0.5 + nir + red) + 1


def pri(blue, green):
    return nd(blue, green) + 1


def cai(swir1, swir2):
    return F.try_divide(swir2, swir1) + 1


def evi(blue, red, nir):
    return F.try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1) + 1


def evi2(nir, red):
    return F.try_divide(2.5 * (nir - red), nir + 2.4 * red + 1) + 1


def hallcover(red, nir, swir2):
    return F.exp(-0.017 * red - 0.007 * nir - 0.079 * swir2 + 5.22)


def hallheigth(red, nir, swir1):
    return F.exp(-0.039 * red - 0.011 * nir - 0.026 * swir1 + 4.13)


def gcvi(nir, green):
    return F.try_divide(nir, green)


#: Index name to (function, its band arguments).
INDICES = {
    "cai": (cai, ("swir1", "swir2")),
    "evi2": (evi2, ("nir", "red")),
    "gcvi": (gcvi, ("nir", "green")),
    "hallcover": (hallcover, ("red", "nir", "swir2")),
    "hallheigth": (hallheigth, ("red", "nir", "swir1")),
    "ndvi": (ndvi, ("nir", "red")),
    "ndwi": (ndwi, ("nir", "swir1")),
    "pri": (pri, ("blue", "green")),
    "savi": (savi, ("nir", "red")),
    "ndbi": (ndbi, ("swir1", "nir")),
    "ndmi": (ndmi, ("nir", "swir1")),
    "ndsi": (ndsi, ("green", "swir1")),
    "mbi": (mbi, ("swir1", "swir2", "nir")),
    "ui": (ui, ("swir2", "nir")),
    "bu": (bu, ("nir", "red", "swir1")),
    "ebbi": (ebbi, ("nir", "swir1", "tir")),
    "ndwi_green": (ndwi_green, ("green", "nir")),
    "mndwi": (mndwi, ("green", "swir1")),
    "evi": (evi, ("blue", "red", "nir")),
}
#: What the full mosaic adds, in this order, and the reduced one.
FULL = ("cai", "evi2", "gcvi", "hallcover", "hallheigth", "ndvi", "ndwi", "pri", "savi", "ndbi", "ndmi", "ndsi", "mbi")
REDUCED = ("ndvi", "ndwi")


def with_indices(df: DataFrame, names=FULL) -> DataFrame:
    """``df`` with the named indices of its band columns, in one projection."""
    return df.withColumns({n: INDICES[n][0](*map(F.col, INDICES[n][1])) for n in names})
