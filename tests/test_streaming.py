from landcube.streaming import composite


def test_yearly_composite(spark, tmp_path):
    """Calendar years, leap years included; a late observation still counts."""
    times = [("2020-01-05 00:00:00", 1.0), ("2020-12-31 23:00:00", 3.0), ("2019-12-25 00:00:00", 8.0), ("2021-01-01 00:00:00", 5.0), ("2020-02-29 00:00:00", 2.0)]
    src = spark.createDataFrame([("t", 1, t, v) for t, v in times], "tile string, px int, acq string, nir double").selectExpr("tile", "px", "cast(acq as timestamp) acq", "nir")
    for i, (t, _) in enumerate(times):
        src.where(f"acq = '{t}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = composite.yearly(composite.read(spark, str(tmp_path / "in"), src.schema, per_trigger=1), ["tile", "px"], ["nir"])
    q = out.writeStream.format("memory").queryName("yearly").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {(r.year, r.n, r.nir_mean) for r in spark.table("yearly").collect()} == {(2019, 1, 8.0), (2020, 3, 2.0), (2021, 1, 5.0)}
