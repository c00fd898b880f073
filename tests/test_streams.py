from datetime import datetime, timedelta

from docmill.streaming import jobs as J

T0 = datetime(2026, 8, 1, 12)


def rows(*events):
    return [(i, job, event, T0 + timedelta(seconds=i)) for i, (job, event) in enumerate(events)]


def test_state_is_kept_across_batches(spark, tmp_path):
    # processing-time timers want batches without data for ever, which an availableNow run would wait for
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = "id long, job_id string, event string, created_at timestamp"
    folder, ck = str(tmp_path / "in"), str(tmp_path / "ck")
    first = rows(("a", "received"), ("a", "started"), ("b", "received"), ("a", "succeeded"), ("a", "started"))
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(folder)
    seen = {}

    def keep(batch, _):
        seen.update({r["job_id"]: (r["status"], r["attempts"]) for r in batch.collect()})

    def run():
        stream = J.track_jobs(J.read_table_stream(spark, folder, spark.read.schema(schema).parquet(folder).schema))
        stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    run()
    assert seen["a"] == ("SUCCEEDED", 1) and seen["b"] == ("QUEUED", 0)
    seen.clear()
    run()  # a restart adds nothing
    assert seen == {}
    spark.createDataFrame([(9, "b", "started", T0), (10, "b", "retry_scheduled", T0), (11, "b", "started", T0)], schema).coalesce(1).write.mode("append").parquet(folder)
    run()
    assert seen == {"b": ("PROCESSING", 2)}


def test_timeline_on_a_table(spark):
    df = spark.createDataFrame(rows(("a", "x"), ("a", "x"), ("b", "y")), "id long, job_id string, event string, created_at timestamp")
    assert {(r["event"], r["n"]) for r in J.event_timeline(df).collect()} == {("x", 2), ("y", 1)}


def test_files_of_a_stream_become_jobs_once(spark, tmp_path):
    from pyspark.sql import functions as F

    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, sha256 string, original_filename string, kind string, queue string"
    spark.createDataFrame([("u1", "aa", "x", "text", "light"), ("u1", "aa", "x", "text", "light"), ("u2", "bb", "y", "pdf", "heavy")], schema).coalesce(1).write.parquet(folder)
    done = spark.createDataFrame([("d", "SUCCEEDED", None, T0, "aa", 512)], "id string, status string, cached_from_job_id string, finished_at timestamp, sha256 string, n int").select("id", "status", "cached_from_job_id", "finished_at", "sha256", F.struct("n").alias("options"))
    for _ in range(2):  # a restart adds nothing
        J.intake_jobs(spark.readStream.schema(schema).parquet(folder), F.struct(F.lit(512).alias("n")), lambda: done, lambda: F.lit(T0).cast("timestamp"), out, str(tmp_path / "ck")).awaitTermination()
    jobs = spark.read.parquet(f"{out}/jobs").collect()
    assert sorted((r["document_id"], r["status"], r["cached_from_job_id"]) for r in jobs) == [("u1", "SUCCEEDED", "d"), ("u2", "QUEUED", None)]
    assert spark.read.parquet(f"{out}/job_events").count() == 4
