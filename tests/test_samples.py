from landcube.operators import characterize as C
from landcube.operators import labels as B
from landcube.operators import review as V
from landcube.operators import select as L
from pyspark.sql import functions as F


def test_longest_run_first_of_equals(spark):
    rows = [(1, y, y in (2000, 2001, 2005, 2006)) for y in range(1999, 2010)] + [(2, 1999, False)]
    out = {r.rect: (r.run, r.run_start, r.run_end) for r in C.longest_run(spark.createDataFrame(rows, "rect int, year int, stable boolean")).collect()}
    assert out == {1: (2, 2000, 2001), 2: (0, -9999, -9999)}


def test_mode_ties_take_the_lowest(spark):
    df = spark.createDataFrame([(1, 1, c, 1, 0.0) for c in (66, 59, 66, 59)], "rect int, px int, class_id int, eco_id int, lat double")
    assert C.pixel_modes(df, ["rect", "px"]).first().mode_id == 59


def test_split_holds_clusters_together(spark):
    rows = [(f"g{i}", "T", i % 12 * 2 if i % 3 else i % 12 * 2 - 1, i // 12, "", "a", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "grid_id string, mgrs string, col int, row int, target_rare_class string, sample_type string, eco_dom_id int")
    out = L.split(df)
    assert out.count() == 60 and out.groupBy("cluster").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert L.split_leaks(out).first().leak_pairs == 0


PLAN = "grid_id string, dim_temporal string, sample_type string, stable_years string, ref_year int, review_tier int, target_rare_class string, target_rare_class_id int, " + ", ".join(
    f"md_id_{p} int, md_nm_{p} string, stb_yrs_{p} string" for p in ("P1", "P2", "P3", "P4"))


def test_review_plan_rules(spark):
    row = lambda i, d, st="", ref=-9999, ids=(1, 1, 1, 1), rare="": (i, d, d + "_compleja", st, ref, 2, rare, -9999, *(x for k in ids for x in (k, rare if k == 9 else "", "")))
    df = spark.createDataFrame([
        row("a", "anual", ref=2010), row("b", "estable", "2000,2012,2020"), row("c", "transicion", ids=(1, 2, 2, 2)), row("d", "transicion", ",".join(str(y) for y in range(1999, 2025) if y != 2010)),
        row("e", "transicion"), row("f", "anual", ref=2010, ids=(1, 9, 1, 1), rare="X")], PLAN)
    out = {r.grid_id: r for r in V.plan(df).collect()}
    assert out["a"].review_years == "2010" and out["a"].review_priority == 2
    assert out["b"].review_years == "2000,2012,2020"
    assert (out["c"].review_years, out["c"].review_rule, out["c"].review_priority) == ("2004,2005,2006,2007", "transicion_cambio_modal_entre_periodos", 1)
    assert out["d"].review_years == "2009,2010,2011" and out["e"].review_years == "1999,2005,2012,2018,2024"
    assert out["f"].review_years == "2006,2010,2012" and out["f"].review_notes == "incluye_anios_clase_rara" and out["f"].review_priority == 1


def test_merge_edits_and_area(spark):
    rows = [("R", 2000, 59, 1, 3.0, "", -9999), ("R", 2000, 66, 2, 1.0, "", -9999), ("S", 2000, 59, 1, 1.0, "aprobado", -9999)]
    df = B.init_qa(spark.createDataFrame(rows, "grid_id string, rev_year int, class_id int, patch_id int, area_ha double, poly_qa string, corr_id int").withColumn("split", F.lit("train")).withColumn("rev_tier", F.lit(2)))
    edits = spark.createDataFrame([("R|2000|59|1", "aprobado", 33)], "poly_uid string, poly_qa string, corr_id int")
    rects = spark.createDataFrame([("S|2000", "rechazado")], "rect_key string, rect_qa string")
    out = {r.poly_uid: r for r in B.merge_edits(df, edits, rects).collect()}
    assert out["R|2000|59|1"].lbl_id == 33 and out["R|2000|66|2"].cov_rect == 75.0 and out["S|2000|59|1"].poly_qa == "rechazado" and out["S|2000|59|1"].cov_rect == 0.0
    assert B.violations(B.merge_edits(df, edits, rects)).count() == 0


def test_scores_add_their_terms_from_left_to_right(spark):
    """To the last bit, so that orders by score do not depend on how a sum is nested."""
    import math
    import random

    rnd = random.Random(5)
    whole = ["valid_area_pct", "eco_dom_pct", "stable_yr_pct", "lulc_mode_pct", "lulc_last_pct", "transition_pct", "critical_pct", "conf_risk_pct", *(f"{a}_{p}" for p in L.LENGTH for a in ("stb_p", "md_pct"))]
    rows = [tuple(float(rnd.randrange(101)) for _ in whole) + (rnd.randrange(200) / 100, rnd.randrange(27), rnd.randrange(1, 9), *(rnd.randrange(7) for _ in L.LENGTH)) for _ in range(300)]
    names = [*whole, "shannon_idx", "max_stab_run", "n_mode_classes", *(f"n_stb_{p}" for p in L.LENGTH)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n in whole or n == 'shannon_idx' else 'int'}" for n in names))
    for r in L.scores(df).collect():
        v, e = r.valid_area_pct / 100 * 2, r.eco_dom_pct / 100
        few, norm = min(max(r.n_mode_classes, 2), 4) / 4.0, min(max(r.shannon_idx / math.log(19), 0.0), 1.0)
        assert r.sc_e_h == r.max_stab_run / 26.0 * 5 + r.stable_yr_pct / 100 * 4 + r.lulc_mode_pct / 100 * 3 + (1 - norm) * 2 + v + e
        assert r.sc_e_s == r.max_stab_run / 26.0 * 4 + r.stable_yr_pct / 100 * 3 + r.lulc_mode_pct / 100 * 3 + few * 2 + v + e
        assert r.sc_a_h == max([0.0] + [r[f"n_stb_{p}"] / n * 5 + r[f"stb_p_{p}"] / 100 * 4 + r[f"md_pct_{p}"] / 100 * 3 + v + e for p, n in L.LENGTH.items() if r[f"n_stb_{p}"] >= 1])
        assert r.sc_t_h == r.transition_pct / 100 * 5 + max(r.lulc_mode_pct, r.lulc_last_pct) / 100 * 4 + r.critical_pct / 100 * 2 + v + e
        assert r.sc_t_s == r.transition_pct / 100 * 5 + few * 3 + r.conf_risk_pct / 100 * 3 + r.critical_pct / 100 * 2 + v + e


def test_clusters_and_leaks_join_cells_and_not_rows(spark):
    from landcube.operators.spatial import neighbour_cells

    cells = [("A", 0, 0), ("A", 1, 1), ("A", 3, 3), ("B", 0, 0), ("B", 5, 0), ("B", 6, 0), ("A", -1, 0)]
    rows = [(f"g{i:02d}", *cells[i * i % 7], (None, "train", "val", "test")[i % 4]) for i in range(60)]
    df = spark.createDataFrame(rows, "grid_id string, mgrs string, col int, row int, split string")
    near = lambda a, b: a[1] == b[1] and a[2:4] != b[2:4] and max(abs(a[2] - b[2]), abs(a[3] - b[3])) <= 1 and min(*a[2:4], *b[2:4]) >= 0
    pairs = [(a, b) for a in rows for b in rows if near(a, b)]
    leaks = sum(a[4] is not None and b[4] is not None and a[4] != b[4] for a, b in pairs)
    assert tuple(L.split_leaks(df).first()) == (len(pairs), leaks // 2)
    found = {r[0]: r[0] for r in rows}
    for _ in rows:
        for a, b in pairs:
            found[b[0]] = min(found[a[0]], found[b[0]])
    assert {r.grid_id: r.cluster for r in L.clusters(df).collect()} == found
    # 300,000 rows in two cells: 45,000 million pairs of rows, two of cells
    many = spark.range(300_000).selectExpr("concat('g', id) as grid_id", "'A' as mgrs", "cast(id % 2 as int) as col", "0 as row", "if(id % 3 = 0, 'train', 'val') as split")
    assert neighbour_cells(many)[1].count() == 2
    assert tuple(L.split_leaks(many).first()) == (2 * 150_000**2, 50_000 * 100_000 * 2)
    assert L.clusters(many).where("cluster = 'g0'").count() == 300_000
