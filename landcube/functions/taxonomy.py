"""Class taxonomies, ecoregion names and other fixed values of the legend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL1 = {1: "Formacion_boscosa", 2: "Form_natural_no_boscosa", 3: "Agropecuaria_silvicultura", 4: "Area_sin_vegetacion", 5: "Cuerpo_de_agua", 6: "No_observado"}
#: Second-level code to name (fixed values); codes ending in .0 repeat their first level.
LEVEL2 = {
    "1.1": "Bosque", "2.1": "Humedal", "2.2": "Pastizal", "2.3": "Estepa", "2.4": "Matorral", "3.1": "Pastura", "3.2": "Agricultura", "3.3": "Silvicultura",
    "4.1": "Arena_playa_duna", "4.2": "Salar", "4.3": "Afloramiento_rocoso", "4.4": "Zonas_urbanas", "4.5": "Mineria", "4.6": "Areas_fotovoltaicas",
    "4.7": "Otra_sin_vegetacion", "5.1": "Rio_lago_oceano", "5.2": "Glaciar",
}
#: Class id to third-level code, and its name where the code does not end in .0 (fixed values).
CODES = {
    1: "1.0.0", 3: "1.1.0", 59: "1.1.1", 60: "1.1.2", 67: "1.1.3", 10: "2.0.0", 11: "2.1.0", 73: "2.1.1", 74: "2.1.2", 12: "2.2.0", 63: "2.3.0",
    66: "2.4.0", 14: "3.0.0", 15: "3.1.0", 18: "3.2.0", 19: "3.2.1", 36: "3.2.2", 9: "3.3.0", 79: "3.3.1", 80: "3.3.2", 22: "4.0.0", 23: "4.1.0",
    61: "4.2.0", 29: "4.3.0", 24: "4.4.0", 30: "4.5.0", 75: "4.6.0", 25: "4.7.0", 26: "5.0.0", 33: "5.1.0", 34: "5.2.0", 27: "6.0.0",
}
LEVEL3 = {
    "1.1.1": "Bosque_primario", "1.1.2": "Bosque_secundario", "1.1.3": "Bosque_achaparrado", "2.1.1": "Turberas", "2.1.2": "Otros_humedales",
    "3.2.1": "Cultivos_temporales", "3.2.2": "Cultivos_perennes", "3.3.1": "Coniferas", "3.3.2": "Latifoliadas",
}
TRANSVERSAL = frozenset({11, 73, 74, 18, 19, 36, 9, 79, 80, 24, 30, 75, 34})
CRITICAL = frozenset({67, 23, 61, 33})
GENERAL_EXCLUDED = TRANSVERSAL | {14}
PROXY, PROXY_PCT = (10, 22), 25.0
NONE = "sin_nombre"
#: Smallest patch kept by the sieve, in pixels (fixed values).
MMU_PIXELS = dict.fromkeys((11, 33, 34, 23, 67, 61, 24), 2)
MMU_DEFAULT = 6
ECOREGIONS = {
    1: "E1_Puna_seca_andina", 2: "E2_Desierto_Atacama", 3: "E3_Matorral_norte_1", 4: "E4_Estepa_andina", 5: "E5_Matorral_norte_2", 6: "E6_Andes_norte",
    7: "E7_Andes_central", 8: "E8_Matorral_sur", 9: "E9_Costa_Norte", 10: "E10_Andes_Sur", 11: "E11_Costa_Sur_1", 12: "E12_Costa_Sur_2",
    13: "E13_Andes_Sur_Costa", 14: "E14_Estepa_patagonica", 15: "E15_Bosque_subpolar", 16: "E16_Isla_de_Pascua", 17: "E17_Juan_Fernandez",
}


def names(class_id: int) -> tuple[str, str, str, str, str, str]:
    """n1 code and name, n2 code and name, n3 code and name."""
    code = CODES[class_id]
    n1, n2, _ = code.split(".")
    first = LEVEL1[int(n1)]
    second = LEVEL2.get(f"{n1}.{n2}", first)
    return n1, first, f"{n1}.{n2}", second, code, LEVEL3.get(code, second)


SCHEMA = "class_id int, n1_cd string, n1_nm string, n2_cd string, n2_nm string, n3_cd string, n3_nm string, es_transversal boolean, es_critica_n3 boolean"


def rows(extra_glacier: bool = False) -> list[tuple]:
    """The samples' legend; the labels' legend has a second glacier id."""
    out = [(k, *names(k), k in TRANSVERSAL, k in CRITICAL) for k in CODES]
    if extra_glacier:
        out.append((35, *names(34), True, False))
    return out


def table(spark: SparkSession, extra_glacier: bool = False) -> DataFrame:
    return spark.createDataFrame(rows(extra_glacier), SCHEMA)


def annotate(df: DataFrame, id_col: str, prefix: str = "", extra_glacier: bool = False) -> DataFrame:
    """``df`` with the taxonomy of ``id_col``; the legend has a few dozen rows, so
    it is broadcast. Unknown ids are ``sin_nombre``."""
    tax = table(df.sparkSession, extra_glacier)
    fill = {"n1_cd": "", "n2_cd": "", "n3_cd": "", "n1_nm": NONE, "n2_nm": NONE, "n3_nm": NONE, "es_transversal": False, "es_critica_n3": False}
    tax = tax.select(F.col("class_id").alias("_k"), *(F.col(c).alias(f"_{c}") for c in fill))
    out = df.join(F.broadcast(tax), F.col(id_col) == F.col("_k"), "left")
    return out.withColumns({prefix + c: F.coalesce(F.col(f"_{c}"), F.lit(v)) for c, v in fill.items()}).drop("_k", *(f"_{c}" for c in fill))


def transversal_modal(mode_id: Column, transversal_pct: Column | None = None) -> Column:
    """Whether the general model leaves a rectangle of this modal class out."""
    out = F.coalesce(mode_id, F.lit(-9999)).isin(*sorted(GENERAL_EXCLUDED))
    if transversal_pct is not None:
        out = out | (F.coalesce(mode_id, F.lit(-9999)).isin(*PROXY) & (F.coalesce(transversal_pct, F.lit(0.0)) >= PROXY_PCT))
    return out


def ecoregion_label(eco_id: Column, name: Column) -> Column:
    """Canonical name; names that are land-cover labels by mistake are repaired."""
    clean = F.when(F.lower(F.trim(name)).isin("nan", "none"), "").otherwise(F.coalesce(F.trim(name), F.lit("")))
    wrong = {*LEVEL1.values(), "Bosque", "Humedal", "Pastizal", "Pastura", "Silvicultura", "Estepa", "Matorral", NONE, ""}
    known = F.create_map(*(F.lit(x) for kv in ECOREGIONS.items() for x in kv))
    canonical = F.coalesce(F.try_element_at(known, eco_id), F.concat(F.lit("E"), eco_id.cast("string"), F.lit("_desconocida")))
    own = clean.startswith("E") & clean.contains("_") & ~clean.isin(*sorted(wrong))
    return F.when(eco_id.isNull(), F.when(clean == "", NONE).otherwise(clean)).otherwise(F.when(own, clean).otherwise(canonical))


def ecoregion_order(label: Column) -> Column:
    n = F.regexp_extract(label, r"^E(\d+)_", 1)
    return F.when(n != "", n.cast("int")).otherwise(999)


def mmu_pixels(class_id: Column) -> Column:
    return F.when(class_id.isin(*MMU_PIXELS), 2).otherwise(MMU_DEFAULT)


def class_label(class_id: Column, name: Column) -> Column:
    return F.format_string("ID %d - %s", class_id, name)
