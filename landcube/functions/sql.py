"""The engine's functions for SQL: names that ``register`` adds to a session.

Bodies are SQL, so that Catalyst inlines them as it does the column expressions; a test
holds each against its expression. Bands are reflectances, as in ``indices``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name to (bands, body).
INDICES = {
    "ndvi": ("nir red", "try_divide(nir - red, nir + red) + 1"),
    "ndbi": ("swir1 nir", "try_divide(swir1 - nir, swir1 + nir) + 1"),
    "ndmi": ("nir swir1", "try_divide(nir - swir1, nir + swir1) + 1"),
    "ndsi": ("green swir1", "try_divide(green - swir1, green + swir1) + 1"),
    "mbi": ("swir1 swir2 nir", "try_divide(swir1 - swir2 - nir, swir1 + swir2 + nir + 1e-6D) + 0.5D"),
    "ui": ("swir2 nir", "try_divide(swir2 - nir, swir2 + nir) + 1"),
    "bu": ("nir red swir1", "(try_divide(swir1 - nir, swir1 + nir) + 1) - (try_divide(nir - red, nir + red) + 1)"),
    "ebbi": ("nir swir1 tir", "try_divide(swir1 - nir, 10 * sqrt(swir1 + tir))"),
    "ndwi": ("nir swir1", "try_divide(nir - swir1, nir + swir1) + 1"),
    "ndwi_green": ("green nir", "try_divide(green - nir, green + nir) + 1"),
    "mndwi": ("green swir1", "try_divide(green - swir1, green + swir1) + 1"),
    "savi": ("nir red", "try_divide(1.5D * (nir - red), 0.5D + nir + red) + 1"),
    "pri": ("blue green", "try_divide(blue - green, blue + green) + 1"),
    "cai": ("swir1 swir2", "try_divide(swir2, swir1) + 1"),
    "evi": ("blue red nir", "try_divide(2.5D * (nir - red), nir + 6 * red - 7.5D * blue + 1) + 1"),
    "evi2": ("nir red", "try_divide(2.5D * (nir - red), nir + 2.4D * red + 1) + 1"),
    "hallcover": ("red nir swir2", "exp(-0.017D * red - 0.007D * nir - 0.079D * swir2 + 5.22D)"),
    "hallheigth": ("red nir swir1", "exp(-0.039D * red - 0.011D * nir - 0.026D * swir1 + 4.13D)"),
    "gcvi": ("nir green", "try_divide(nir, green)"),
}
#: Other scalar functions: name to (arguments, type, body).
SCALARS = {
    "sr_scale": ("dn double", "double", "(dn * 2.75e-5D - 0.2D) * 10000"),
    "reflectance": ("dn double", "double", "least(greatest(dn * 2.75e-5D - 0.2D, 0.0D), 1.0D)"),
    "qa_clear": ("qa int, cloud_bit int, shadow_bit int", "boolean", "((qa >> cloud_bit) & 1) = 0 and ((qa >> shadow_bit) & 1) = 0"),
    "period": ("year int", "string", "case when year between 1999 and 2005 then 'P1' when year between 2006 and 2012 then 'P2' when year between 2013 and 2018 then 'P3' when year between 2019 and 2024 then 'P4' end"),
    "safe_pct": ("part double, total double", "double", "coalesce(try_divide(part, total) * 100, 0.0D)"),
}
#: Table functions, to be used with LATERAL: name to (arguments, columns, body).
TABLES = {
    # squares of ``size`` from a tile's upper left corner that lie in it by ``inside``
    "rectangles": (
        "x0 double, y0 double, x1 double, y1 double, size double, inside double", "col int, row int, rx0 double, ry0 double, rx1 double, ry1 double",
        """select cast(i % ceil((x1 - x0) / size) as int), cast(floor(i / ceil((x1 - x0) / size)) as int), x0 + i % ceil((x1 - x0) / size) * size, y1 - floor(i / ceil((x1 - x0) / size)) * size - size,
           x0 + i % ceil((x1 - x0) / size) * size + size, y1 - floor(i / ceil((x1 - x0) / size)) * size
           from explode(sequence(0L, ceil((x1 - x0) / size) * ceil((y1 - y0) / size) - 1)) as t(i)
           where (least(x0 + i % ceil((x1 - x0) / size) * size + size, x1) - (x0 + i % ceil((x1 - x0) / size) * size))
               * (y1 - floor(i / ceil((x1 - x0) / size)) * size - greatest(y1 - floor(i / ceil((x1 - x0) / size)) * size - size, y0)) >= inside * size * size"""),
}


def register(spark: SparkSession, prefix: str = "lc_") -> list[str]:
    """Create all functions for the session, each under ``prefix``; their names."""
    made = []
    for name, (bands, body) in INDICES.items():
        made.append((name, ", ".join(f"{b} double" for b in bands.split()), "returns double", body))
    made += [(name, args, f"returns {kind}", body) for name, (args, kind, body) in SCALARS.items()]
    made += [(name, args, f"returns table ({columns})", body) for name, (args, columns, body) in TABLES.items()]
    for name, args, returns, body in made:
        spark.sql(f"create or replace temporary function {prefix}{name}({args}) {returns} return {body}")
    return [prefix + name for name, *_ in made]
