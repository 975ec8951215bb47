from weftline.streaming.slices import running_slices


def test_runs_go_on_over_micro_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("g", i, k) for i, k in enumerate("aab")], "g string, i int, k string").coalesce(1).write.parquet(f"{source}/0")
    spark.createDataFrame([("g", 3 + i, k) for i, k in enumerate("bba")] + [("h", 0, None)], "g string, i int, k string").coalesce(1).write.parquet(f"{source}/1")
    stream = spark.readStream.schema("g string, i int, k string").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    query = running_slices(stream, "g", "k", "i", row_limit=2).writeStream.format("memory").queryName("sliced").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = {(r.grp, r.ord): (r.run_no, r.slice_no) for r in spark.table("sliced").collect()}
    assert found[("h", 0)] == (0, 0)
    runs = [found[("g", i)] for i in range(6)]
    if runs[0] == (0, 0):  # files are taken in the order of their times, which may be equal
        assert runs == [(0, 0), (0, 0), (1, 0), (1, 0), (1, 1), (2, 0)]
