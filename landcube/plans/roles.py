"""The driver's tables in the roles of observations, series, scenes and boxes.

Each role is a SQL text that Spark and DuckDB read alike, so that a query and its
twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OBS = """select l_suppkey as tile, l_partkey as px, l_orderkey as scene, l_linenumber as qa, cast(l_shipdate as date) as acq,
 year(l_shipdate) as yr, l_discount * 20000.7 + 50 as blue, l_tax * 30000.3 + 80 as green, l_quantity * 100.3 as red, l_extendedprice / 10.7 as nir,
 l_quantity * 60.1 + l_discount * 9000 as swir1, l_tax * 25000.9 + l_quantity * 20 as swir2, l_quantity + 200.3 as tir from lineitem"""

#: 15 years of classes of pixels in rectangles, one row each.
LULC = """select cast(l_suppkey % 10 as int) as rect, cast(l_partkey % 97 as int) as px, y as year,
 min(case when l_quantity < 20 then 59 when l_quantity < 30 then 66 when l_quantity < 34 then 12 when l_quantity < 38 then 3 when l_quantity < 42 then 25 when l_quantity < 46 then 33 else 27 end) as class_id,
 min(cast(l_suppkey % 5 as int)) as eco_id, min(-33.0 - (l_partkey % 97) / 100.0D) as lat
 from (select *, 1999 + cast((l_orderkey + l_linenumber) % 26 as int) as y from lineitem) group by l_suppkey % 10, l_partkey % 97, y"""

SERIES = "select user_id as rect, event_type as cls, value, year(ts) as yr, dayofyear(ts) as year, event_id from events"

RECTS = """select concat('R', cast(s_suppkey as varchar(20))) as grid_id, cast(s_suppkey as int) as k, cast(s_nationkey as int) as nk, s_acctbal as bal,
 (s_suppkey * 37 % 100) * 10.0D as x0, (s_suppkey * 61 % 100) * 10.0D as y0, (s_suppkey * 37 % 100) * 10.0D + 35 as x1, (s_suppkey * 61 % 100) * 10.0D + 25 as y1 from supplier"""

#: Characterised rectangles from customers.
CANDS = """select concat('G', cast(c_custkey as varchar(20))) as grid_id, cast(c_custkey as int) as k, cast(c_nationkey % 17 as int) as eco_dom_id,
 concat('E', cast(c_nationkey % 17 as varchar(20)), '_x') as eco_dom_name, concat('T', cast(c_custkey % 7 as varchar(20))) as mgrs_dom,
 cast(c_custkey * 7 % 61 as double) + 40 as valid_area_pct, cast(c_custkey * 11 % 71 as double) + 30 as eco_dom_pct, cast(c_custkey % 15 as double) as noobs_pct,
 cast(c_custkey * 13 % 60 as double) as transition_pct, cast(c_custkey * 17 % 70 as double) + 30 as lulc_mode_pct, cast(c_custkey * 19 % 80 as double) + 20 as lulc_last_pct,
 case c_custkey % 6 when 0 then 25 when 1 then 33 when 2 then 59 when 3 then 67 when 4 then 23 else 12 end as lulc_mode_id,
 case c_custkey % 5 when 0 then 25 when 1 then 59 when 2 then 61 when 3 then 66 else 12 end as lulc_last_id,
 cast(c_custkey * 3 % 27 as int) as max_stab_run, cast(c_custkey * 23 % 101 as double) as stable_yr_pct, cast(c_custkey * 29 % 200 as double) / 100 as shannon_idx,
 cast(1 + c_custkey % 9 as int) as n_mode_classes, cast(c_custkey * 31 % 40 as double) as critical_pct, cast(c_custkey * 37 % 50 as double) as conf_risk_pct,
 cast(c_custkey % 12 as double) as north_forest_pct, cast(c_custkey % 10 as double) as achaparrado_pct, cast(c_custkey % 33 as double) as rare_presence_pct,
 case when c_custkey % 11 = 0 then 'Salar' when c_custkey % 13 = 0 then 'Arena_playa_duna' when c_custkey % 17 = 0 then 'Bosque_primario' else '' end as target_rare_class,
 case c_custkey % 3 when 0 then 'mixto' else 'puro' end as grid_mode,
 case c_custkey % 3 when 0 then 'anual' when 1 then 'estable' else 'transicion' end as dim_temporal,
 case c_custkey % 2 when 0 then 'homogenea' else 'simple_media' end as dim_espacial,
 concat(case c_custkey % 3 when 0 then 'anual' when 1 then 'estable' else 'transicion' end, '_', case c_custkey % 2 when 0 then 'homogenea' else 'simple_media' end) as sample_type,
 case c_custkey % 2 when 0 then 'UTM18' else 'UTM19' end as utm, case when c_custkey % 20 < 14 then 'train' when c_custkey % 20 < 17 then 'val' else 'test' end as split,
 cast(c_custkey % 4 as int) as review_tier, case when c_custkey % 9 = 0 then 'auto_sin_revision' else 'manual' end as review_desc,
 case when c_custkey % 7 = 0 then '' when c_custkey % 5 = 0 then '2001, 1999,x,2013' else concat(cast(1999 + c_custkey % 26 as varchar(20)), ',2024') end as stable_years,
 case when c_custkey % 4 = 0 then cast(1999 + c_custkey % 26 as int) else -9999 end as ref_year, cast(c_custkey % 7 as int) as n_stb_P1, cast(c_custkey * 3 % 8 as int) as n_stb_P2,
 cast(c_custkey * 5 % 7 as int) as n_stb_P3, cast(c_custkey * 2 % 7 as int) as n_stb_P4, cast(c_custkey % 101 as double) as stb_p_P1, cast(c_custkey * 3 % 101 as double) as stb_p_P2,
 cast(c_custkey * 5 % 101 as double) as stb_p_P3, cast(c_custkey * 7 % 101 as double) as stb_p_P4, cast(c_custkey * 2 % 101 as double) as md_pct_P1, cast(c_custkey * 4 % 101 as double) as md_pct_P2,
 cast(c_custkey * 6 % 101 as double) as md_pct_P3, cast(c_custkey * 8 % 101 as double) as md_pct_P4, case c_custkey % 3 when 0 then 67 when 1 then 23 else 61 end as md_id_P1,
 case c_custkey % 4 when 0 then 67 when 1 then 33 else 61 end as md_id_P2, case c_custkey % 5 when 0 then 67 when 1 then 23 else 33 end as md_id_P3, case c_custkey % 7 when 0 then 67 when 1 then 23 else 61 end as md_id_P4,
 cast(c_custkey % 9 as int) as col, cast(c_custkey / 9 as int) % 11 as row, concat('M', cast(c_custkey % 5 as varchar(20))) as mgrs from customer"""

#: Label polygons from orders.
POLYS = """select concat('R', cast(o_custkey % 40 as varchar(20))) as grid_id, cast(1999 + o_custkey % 3 as int) as rev_year, case o_orderpriority when '1-URGENT' then 59 when '2-HIGH' then 66 when '3-MEDIUM' then 12 when '4-NOT SPECIFIED' then 25 else 33 end as class_id,
 cast(o_orderkey as int) as patch_id, cast(floor(o_totalprice / 100) as double) / 100 as area_ha, case when o_orderkey % 3 = 0 then 'aprobado' when o_orderkey % 7 = 0 then 'rechazado' else '' end as poly_qa,
 case when o_orderkey % 10 = 0 then 33 else -9999 end as corr_id, case o_custkey % 40 % 4 when 0 then 'aprobado' when 1 then 'parcial' when 2 then 'pendiente' else 'rechazado' end as rect_qa, case when o_orderkey % 501 = 0 then 'val' else 'train' end as split, cast(o_custkey % 40 % 4 as int) as rev_tier from orders"""

SCENES = """select cast(o_orderkey as varchar(20)) as scene_id, cast(o_orderdate as date) as acq, case when o_orderkey % 50 = 0 then null else cast(floor(o_totalprice / 1000) as double) end as cloud_cover,
 cast(o_custkey % 30 as int) as wrs_path, cast(o_custkey % 9 as int) as wrs_row, case o_orderkey % 3 when 0 then 'l7' when 1 then 'l8' else 'l9' end as platform,
 (o_custkey % 100) * 1.0D as x0, (o_custkey % 90) * 1.0D as y0, (o_custkey % 100) * 1.0D + 5 as x1, (o_custkey % 90) * 1.0D + 5 as y1 from orders"""

#: A class grid of 100 columns in tiles by brand.
GRID = """select p_brand as tile, cast(k / 20 as int) as row, cast(k % 20 as int) as col, p_size as elev, case when p_size < 15 then 59 when p_size < 30 then 66 when p_size < 45 then 33 else 0 end as value
 from (select *, row_number() over (partition by p_brand order by p_partkey) - 1 as k from part)"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str) -> str:
    """The role's text for DuckDB, whose ``/`` of integers is not whole and whose
    literals have no D."""
    return sql.replace("10.0D", "10.0::double").replace("1.0D", "1.0::double").replace("100.0D", "100.0::double").replace("cast(k / 20 as int)", "cast(k // 20 as int)").replace("cast(c_custkey / 9 as int)", "cast(c_custkey // 9 as int)")


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A role over the parquet tables of ``sf_dir``, without registering views."""
    import re

    names = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    text = sql.replace("cast(k / 20 as int)", "cast(floor(k / 20) as int)").replace("cast(c_custkey / 9 as int)", "cast(floor(c_custkey / 9) as int)")
    for t in names:
        text = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", text)
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})
