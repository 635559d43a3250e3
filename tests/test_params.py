from landcube.functions import scalars as S
from landcube.operators import params as P
from pyspark.sql import functions as F

PARAM = "YEAR string, GRID_NAME string, SATELLITE string, `BLACK LIST` string, USETILEMASK string"


def test_satellite(spark):
    df = spark.createDataFrame([("L5",), ("5",), (" l8 ",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(S.satellite(F.col("s"))).collect()] == ["l5", "l5", "l8", None, None]


def test_split_list(spark):
    df = spark.createDataFrame([("A,B; C",), (None,), ("nan",), (" ; ",)], "s string")
    assert [r[0] for r in df.select(S.split_list(F.col("s"))).collect()] == [["A", "B", "C"], [], [], []]


def test_normalize_one_row(spark):
    df = spark.createDataFrame([("2020", " SE-19-V-D ", "L5", None, "True"), (None, "A", "5", None, None), ("2020", "B", "zz", None, None)], PARAM)
    rows = P.normalize(df).collect()
    assert len(rows) == 1 and rows[0].grid_name == "SE-19-V-D" and rows[0].black_list == [] and rows[0].cloud_cover == 80
    assert (rows[0].t0_s, rows[0].t1_s, rows[0].use_tile_mask) == ("2020-01-01", "2020-12-31", True)
    assert P.skipped(df).count() == 1


def _jobs(spark, rows):
    return spark.createDataFrame([("CHILE", g, 2020, "l8", bl) for g, bl in rows], "country string, grid_name string, year int, satellite string, black_list array<string>")


def _xw(spark, rows):
    return spark.createDataFrame(rows, "cim_name string, mgrs_tile string, overlap_frac_of_cim string")


def test_expand_to_two_tiles(spark):
    out = P.expand(_jobs(spark, [("CIM-1", ["S"])]), _xw(spark, [("CIM-1", "18GXN", "0.8"), ("CIM-1", "18GXM", "0.2"), ("CIM-1", "T2", "0.001")]), 0.01).collect()
    assert {(r.grid_name, r.cim_name, tuple(r.black_list)) for r in out} == {("18GXN", "CIM-1", ("S",)), ("18GXM", "CIM-1", ("S",))}


def test_expand_merges_black_lists(spark):
    out = P.expand(_jobs(spark, [("A", ["SCENE_A"]), ("B", ["SCENE_B"]), ("C", [])]), _xw(spark, [("A", "18GXN", "1"), ("B", "18GXN", "1")])).collect()
    assert len(out) == 1 and out[0].black_list == ["SCENE_A", "SCENE_B"] and out[0].cim_name == "A,B"
    assert [r[0] for r in P.unmatched(_jobs(spark, [("A", []), ("C", [])]), _xw(spark, [("A", "T", "1")])).collect()] == ["C"]


def test_compact_years_keeps_ends(spark):
    df = spark.range(1).select(S.compact_years(F.sequence(F.lit(1999), F.lit(2024)), 9).alias("y"))
    ys = df.first().y
    assert len(ys) == 9 and ys[0] == 1999 and ys[-1] == 2024


def test_bool_variants(spark):
    df = spark.createDataFrame([("maybe",), (None,), ("off",)], "s string")
    assert [r[0] for r in df.select(S.parse_bool(F.col("s"), False, unknown=True)).collect()] == [True, False, False]
