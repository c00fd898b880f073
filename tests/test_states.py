"""Changes of job state are guarded and can be made again; the façade refuses what a state doesn't allow."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docmill import schemas
from docmill.engine import Engine, Refused, UnknownJob
from docmill.operators import analytics, transitions
from docmill.operators.current import current_jobs

T0 = datetime(2026, 8, 1, 12)


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [("q", "QUEUED", 0, None), ("p", "PROCESSING", 1, "w1"), ("d", "SUCCEEDED", 1, "w1"), ("f", "FAILED", 3, "w2"), ("r", "RETRYING", 3, None)]
    made = spark.createDataFrame(rows, "id string, status string, attempts int, worker_id string")
    full = schemas.conformed(made.withColumn("max_attempts", F.lit(3)).withColumn("started_at", F.lit(T0)).withColumn("created_at", F.lit(T0)).withColumn("loaded_at", F.lit(T0)), "jobs")
    return full.cache()


def at(minutes=1):
    return F.lit(datetime(2026, 8, 1, 12, minutes)).cast("timestamp")


def later(jobs, made):
    """The current rows once a change is appended."""
    both = jobs.unionByName(made.jobs)
    return current_jobs(both, *[c for c in both.columns if c not in ("id", "loaded_at")])


def test_one_worker_wins_a_job_and_a_claim_made_again_changes_nothing(spark, jobs):
    asked = spark.createDataFrame([(j, w) for j in "qpdfr" for w in ("b", "a")], "job_id string, worker_id string")
    made = transitions.claim(jobs, asked, at())
    assert [(r["id"], r["worker_id"], r["attempts"], r["status"]) for r in made.jobs.collect()] == [("q", "a", 1, "PROCESSING")]
    assert [(r["job_id"], r["event"]) for r in made.events.collect()] == [("q", "started")]
    assert transitions.claim(later(jobs, made), asked, at(2)).jobs.count() == 0
    assert {r["id"] for r in transitions.claim(jobs, asked, at()).events.select("id").collect()} == {r["id"] for r in made.events.select("id").collect()}


def test_results_of_a_lost_worker_are_dropped(spark, jobs):
    asked = spark.createDataFrame([("p", "w9", 1), ("d", "w1", 1)], "job_id string, worker_id string, n int").select("job_id", "worker_id", *[F.col("n").alias(c) for c in ("page_count", "char_count", "word_count", "token_count", "chunk_count")], F.array().cast("array<string>").alias("warnings"))
    assert transitions.succeed(jobs, asked, at()).jobs.count() == 0
    own = transitions.succeed(jobs, asked.withColumn("worker_id", F.lit("w1")), at())
    assert [r["id"] for r in own.jobs.collect()] == ["p"] and own.jobs.first()["progress"] == 100.0
    beats = spark.createDataFrame([("p", "w1"), ("p", "w9"), ("d", "w1"), ("zz", "w")], "job_id string, worker_id string")
    assert {(r["job_id"], r["worker_id"]) for r in transitions.replies(jobs, beats).filter("not lost").collect()} == {("p", "w1")}


def test_failures_wait_or_end(spark, jobs):
    asked = spark.createDataFrame([("p", "w1", "INTERNAL_ERROR", "m")], "job_id string, worker_id string, error_code string, message string")
    once = transitions.fail(jobs, asked, at()).jobs.first()
    assert (once["status"], (once["next_retry_at"] - once["loaded_at"]).seconds) == ("RETRYING", 10)
    assert transitions.fail(jobs, asked, F.lit(datetime(2026, 8, 1, 12, 15)).cast("timestamp")).jobs.first()["error_code"] == "TIMEOUT"
    assert transitions.fail(jobs, asked.withColumn("error_code", F.lit("CORRUPTED_FILE")), at()).jobs.first()["status"] == "FAILED"


def test_intake_made_twice_gives_the_same_rows(spark, jobs):
    files = spark.createDataFrame([("u1", "aa", "x.txt", "text", "light"), ("u2", "bb", "y.txt", "text", "light")], "id string, sha256 string, original_filename string, kind string, queue string")
    finished = jobs.filter("id = 'd'").withColumn("sha256", F.lit("aa"))
    options = F.lit(None).cast(jobs.schema["options"].dataType)
    one, hits, events = transitions.intake(files, options, finished, at())
    two, _, _ = transitions.intake(files, options, finished, at())
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and [r["hit_id"] for r in hits.collect()] == ["d"]
    assert sorted(r["event"] for r in events.collect()) == ["cache_hit", "dispatched", "received", "received"]


def test_facade_cancels_retries_and_appends(spark, jobs, tmp_path):
    base = str(tmp_path)
    jobs.write.parquet(f"{base}/jobs.parquet")
    spark.createDataFrame([], schemas.schema_of("job_events")).write.parquet(f"{base}/job_events.parquet")
    engine = Engine(spark, base)
    with pytest.raises(Refused, match="JOB_NOT_ACTIVE"):
        engine.cancel("d", T0)
    with pytest.raises(Refused, match="JOB_NOT_RETRYABLE"):
        engine.retry("q", T0)
    with pytest.raises(UnknownJob):
        engine.cancel("nobody", T0)
    engine.commit(engine.cancel("q", datetime(2026, 8, 1, 13)))
    engine.commit(engine.retry("f", datetime(2026, 8, 1, 13)))
    now = {r["id"]: r["status"] for r in engine.current().collect()}
    assert now == {"q": "CANCELLED", "p": "PROCESSING", "d": "SUCCEEDED", "f": "QUEUED", "r": "RETRYING"}
    assert {r["event"] for r in engine.events("f").collect()} == {"manual_retry"}


def test_result_and_original(spark, small):
    engine = Engine(spark, small)
    done = engine.jobs(status="SUCCEEDED", limit=50).filter("cached_from_job_id is null").join(engine.table("chunks").select("job_id").distinct(), F.col("id") == F.col("job_id")).first()["id"]
    row = engine.result(done, chunks=True).first()
    assert row["error"] is None and row["text"] and row["markdown"] and row["pages"] and row["chunks"]
    bare = engine.result(done, text=False)
    assert "text" not in bare.columns and "chunks" not in bare.columns and bare.first()["pages"]
    failed = engine.jobs(status="FAILED", limit=1).first()["id"]
    assert engine.result(failed).first()["error"] == "JOB_FAILED"
    assert engine.original(done).first()["key"].startswith("sha256/") and engine.chunks(done, "jsonl").first()["line"].startswith('{"job_id":')


def test_schemas(spark, small):
    for name in schemas.TABLES:
        assert schemas.differences(spark.read.parquet(f"{small}/{name}.parquet"), name) == [], name
    old = spark.createDataFrame([("a", "7")], "id string, attempts string")
    new = schemas.conformed(old, "jobs")
    assert schemas.differences(new, "jobs") == [] and new.first()["attempts"] == 7 and new.first()["status"] is None


def test_exact_quantiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    values = [("a", float(x)) for x in rng.lognormal(2, 3, 700)] + [("b", float(x)) for x in rng.integers(-5, 6, 301)] + [(None, -1.5), (None, 2.0), ("c", 4.0), ("c", None), ("d", None)]
    df = spark.createDataFrame(values, "k string, x double").repartition(7)
    found = {r["k"]: r for r in analytics.exact_quantiles(df, ["k"], "x", {"p0": 0.0, "p50": 0.5, "p95": 0.95, "near": 0.95}, nearest=("near",)).collect()}
    for k in ("a", "b", None, "c"):
        own = np.sort([x for n, x in values if n == k and x is not None])
        for name, q in (("p0", 0.0), ("p50", 0.5), ("p95", 0.95)):
            assert np.isclose(found[k][name], np.quantile(own, q)), (k, name)
        assert found[k]["near"] == own[round(0.95 * (len(own) - 1))]
    assert "d" not in found


def test_ranks_and_peaks_in_parts(spark):
    import random

    r = random.Random(2)
    rows = [(r.choice("ab"), r.randint(0, 50)) for _ in range(300)]
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "k string, t int, i int")
    for row in analytics.ranks_in_parts(df, "k", "t", F.floor(F.col("t") / 7)).collect():
        assert row["earlier"] == sum(k == row["k"] and t < row["t"] for k, t in rows)
    spans = [(k, t * 1_000_000, None if r.random() < 0.1 else (t + r.randint(0, 20)) * 1_000_000) for k, t in rows]
    peaks = {x["k"]: x["peak"] for x in analytics.peak_depth(spark.createDataFrame(spans, "k string, a long, b long"), "k", "a", "b", width=5).collect()}
    for k in "ab":
        assert peaks[k] == max(sum(o == k and a <= t * 1_000_000 and (b is None or b > t * 1_000_000) for o, a, b in spans) for t in range(80))
