"""Operational questions about documents, jobs and job events. ``now`` and ``since`` are arguments, never the clock."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Job states and the events that count as reliability events (fixed values).
STATUSES = ("QUEUED", "PROCESSING", "RETRYING", "SUCCEEDED", "FAILED", "CANCELLED")
ACTIVE = ("QUEUED", "PROCESSING", "RETRYING")
RELIABILITY = ("worker_lost", "message_missing", "retry_scheduled", "dispatch_failed", "manual_retry", "cancelled")
LINKS = "/v1/jobs/"  # where a job's resources are found (fixed value)
FIRST_RUN = "status = 'SUCCEEDED' and cached_from_job_id is null"


def seconds(later: Column | str, earlier: Column | str) -> Column:
    """Difference of two timestamps in seconds, with microseconds."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (later, earlier))
    return (F.unix_micros(a) - F.unix_micros(b)) / 1e6


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of both sides in which null equals null; the keys come out once."""
    other = right.select(*[F.col(k).alias(f"{k}_other_") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{k}_other_")) for k in keys])
    return left.join(other, on, how).drop(*[f"{k}_other_" for k in keys])


BINS = 64  # bins a doubling of the value, in exact quantiles


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], nearest: tuple[str, ...] = ()) -> DataFrame:
    """(keys..., one column a name of ``at``): interpolated quantiles, or for the names in ``nearest`` the value at the
    rounded rank (half to even). Null values are left out.

    Exact, yet no task sorts a group: values are counted in bins by magnitude, the bins that hold the wanted ranks are
    chosen from their running counts, and only the distinct values of those bins are ranked.
    """
    x = F.col(value).cast("double")
    size = F.log2(1 + F.abs(x) * 1e6) * BINS
    clean = df.filter(x.isNotNull()).select(*keys, x.alias("x_"), F.when(x < 0, -F.ceil(size)).otherwise(F.floor(size)).cast("int").alias("bin_"))
    counts = clean.groupBy(*keys, "bin_").agg(F.count("*").alias("n_"))
    whole = Window.partitionBy(*keys)
    before = F.sum("n_").over(whole.orderBy("bin_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")
    placed = counts.select(*keys, "bin_", "n_", before.alias("before_"), F.sum("n_").over(whole).alias("all_"))
    want = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q"), F.lit(name in nearest).alias("round")) for name, q in at.items()])
    wanted = placed.withColumn("w_", F.explode(want)).withColumn("pos_", F.col("w_.q") * (F.col("all_") - 1))
    low = F.when(F.col("w_.round"), F.bround("pos_")).otherwise(F.floor("pos_")).cast("long")
    high = F.when(F.col("w_.round"), F.bround("pos_")).otherwise(F.ceil("pos_")).cast("long")
    ranks = wanted.select(*keys, "bin_", "before_", "n_", F.col("w_.name").alias("name_"), (F.col("pos_") - F.floor("pos_")).alias("part_"), F.explode(F.array_distinct(F.array(low, high))).alias("rank_"), low.alias("low_"), high.alias("high_"))
    ranks = ranks.filter((F.col("rank_") >= F.col("before_")) & (F.col("rank_") < F.col("before_") + F.col("n_")))
    chosen = ranks.select(*keys, "bin_", "before_").distinct()
    values = join_null_safe(clean, chosen, [*keys, "bin_"]).groupBy(*keys, "bin_", "before_", "x_").agg(F.count("*").alias("m_"))
    upto = F.sum("m_").over(Window.partitionBy(*keys, "bin_").orderBy("x_").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before_")
    values = values.select(*keys, "bin_", "x_", (upto - F.col("m_")).alias("from_"), upto.alias("to_"))
    found = join_null_safe(ranks, values, [*keys, "bin_"]).filter("rank_ >= from_ and rank_ < to_")
    both = found.groupBy(*keys, "name_").agg(F.max(F.when(F.col("rank_") == F.col("low_"), F.col("x_"))).alias("a_"), F.max(F.when(F.col("rank_") == F.col("high_"), F.col("x_"))).alias("b_"), F.max("part_").alias("part_"))
    read = both.withColumn("v_", F.when(F.col("a_") == F.col("b_"), F.col("a_")).otherwise(F.col("a_") + (F.col("b_") - F.col("a_")) * F.col("part_")))
    return read.groupBy(*keys).agg(*[F.max(F.when(F.col("name_") == name, F.col("v_"))).alias(name) for name in at])


def ranks_in_parts(df: DataFrame, key: str, order: str, part: Column) -> DataFrame:
    """``df`` with ``earlier``: how many rows of the same key come strictly before by ``order``.

    ``part`` is a coarser value of the same order. Rows are ranked inside a key's parts and the parts' counts are added
    up, so no task sorts a whole key.
    """
    cut = df.withColumn("part_", part)
    inside = F.rank().over(Window.partitionBy(key, "part_").orderBy(order)) - 1
    sums = cut.groupBy(key, "part_").agg(F.count("*").alias("n_"))
    offset = F.sum("n_").over(Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_")
    ranked = join_null_safe(cut.withColumn("inside_", inside), sums.select(key, "part_", offset.alias("offset_")), [key, "part_"])
    return ranked.withColumn("earlier", (F.col("inside_") + F.col("offset_")).cast("long")).drop("part_", "inside_", "offset_")


def peak_depth(jobs: DataFrame, key: str, begin: str, end: str, width: int = 3600) -> DataFrame:
    """(``key``, peak): the most jobs of a key that waited at one time, from begin (epoch microseconds) to end; a null end
    waits on. A sweep over the ends of the intervals: sums inside parts of ``width`` seconds on top of the parts before."""
    ends = F.array(F.struct(F.col(begin).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))
    steps = jobs.filter(F.col(begin).isNotNull()).select(key, F.inline(ends)).filter("t is not null")
    steps = steps.groupBy(key, "t").agg(F.sum("d").alias("d")).withColumn("part", F.floor(F.col("t") / (width * 1_000_000)))
    sums = steps.groupBy(key, "part").agg(F.sum("d").alias("s"))
    base = sums.select(key, "part", (F.sum("s").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("s")).alias("base"))
    inside = steps.withColumn("run", F.sum("d").over(Window.partitionBy(key, "part").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    depth = join_null_safe(inside, base, [key, "part"]).withColumn("depth", F.col("run") + F.col("base"))
    return depth.groupBy(key).agg(F.max("depth").cast("long").alias("peak"))


def list_jobs(jobs: DataFrame, uploads: DataFrame, status: str | None = None, kind: str | None = None, client: str | None = None, name: str | None = None) -> DataFrame:
    """Jobs with their file; filters apply only where given. ``%`` and ``_`` in ``name`` keep their meaning."""
    for column, value in (("status", status), ("client_reference", client)):
        jobs = jobs.filter(F.col(column) == value) if value else jobs
    files = uploads.select(F.col("id").alias("document_id"), "original_filename", "kind").distinct()
    files = files.filter(F.col("kind") == kind) if kind else files
    files = files.filter(F.col("original_filename").ilike(f"%{name}%")) if name else files
    return jobs.join(files, "document_id")


def newest_page(listing: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1 to 200 and offset at least 0")
    return listing.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)


def status_histogram(jobs: DataFrame) -> DataFrame:
    """(status, n) over all states, zero where none."""
    states = jobs.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return F.broadcast(states).join(jobs.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def window_summary(jobs: DataFrame, since: Column) -> DataFrame:
    """One row of filtered counts, averages, quantiles and sums of the jobs created since."""
    timed = jobs.filter(F.col("created_at") >= since).withColumn("wait", seconds("started_at", "created_at")).withColumn("took", seconds("finished_at", "started_at"))
    done = "status = 'SUCCEEDED'"
    counts = timed.agg(
        F.count("*").alias("created"), F.count_if(F.expr(done)).alias("succeeded"), F.count_if(F.expr("status = 'FAILED'")).alias("failed"), F.count("cached_from_job_id").alias("cache_hits"),
        F.avg(F.when(F.col("cached_from_job_id").isNull(), F.col("wait"))).alias("avg_wait"),
        *[F.coalesce(F.sum(F.when(F.expr(done), F.col(c))), F.lit(0)).cast("long").alias(c.replace("_count", "s")) for c in ("page_count", "char_count", "token_count", "chunk_count")],
        F.count_if(F.size("warnings") > 0).alias("with_warnings"),
    )
    times = exact_quantiles(timed.filter(FIRST_RUN).select(F.lit(1).alias("all"), "took"), ["all"], "took", {"p50_duration": 0.5, "p95_duration": 0.95})
    return counts.withColumn("all", F.lit(1)).join(times, "all", "left").drop("all")  # one row each


def by_kind(jobs: DataFrame, uploads: DataFrame, since: Column) -> DataFrame:
    kinds = uploads.groupBy(F.col("id").alias("document_id")).agg(F.max("kind").alias("kind"))
    timed = jobs.filter(F.col("created_at") >= since).withColumn("took_us", F.unix_micros("finished_at") - F.unix_micros("started_at")).join(kinds, "document_id")
    return timed.groupBy("kind").agg(
        F.count("*").alias("jobs"), F.count_if(F.expr("status = 'SUCCEEDED'")).alias("succeeded"), F.count_if(F.expr("status = 'FAILED'")).alias("failed"), (F.sum(F.when(F.expr(FIRST_RUN), F.col("took_us"))) / F.count(F.when(F.expr(FIRST_RUN), F.col("took_us"))) / 1e6).alias("avg_duration_s"), F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("pages"),
    )


def bucket_seconds(window_minutes: int) -> int:
    return 60 if window_minutes <= 120 else 300 if window_minutes <= 720 else 3600


def timeline(jobs: DataFrame, since: int, now: int, width: int) -> DataFrame:
    """(t, succeeded, failed) per bucket of ``width`` seconds by finishing time, zero-filled from ``since`` to ``now``
    (epoch seconds)."""
    at = F.floor(F.unix_micros("finished_at") / (width * 1_000_000)) * width
    counts = jobs.filter(F.unix_micros("finished_at") >= since * 1_000_000).groupBy(at.cast("long").alias("t")).agg(F.count_if(F.expr("status = 'SUCCEEDED'")).alias("succeeded"), F.count_if(F.expr("status = 'FAILED'")).alias("failed"))
    every = jobs.sparkSession.range(since // width * width, now + 1, width).withColumnRenamed("id", "t")
    return every.join(counts, "t", "left").na.fill(0, ["succeeded", "failed"])


def histogram(df: DataFrame, column: str, alias: str) -> DataFrame:
    return df.groupBy(F.col(column).alias(alias)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), alias)


def queue_position(jobs: DataFrame) -> DataFrame:
    """(id, queue, position): how many queued jobs of the queue were created earlier. One ranking instead of a count per
    job, in parts of an hour."""
    waiting = jobs.filter("status = 'QUEUED'").select("id", "queue", "created_at")
    ranked = ranks_in_parts(waiting, "queue", "created_at", F.floor(F.unix_micros("created_at") / 3_600_000_000))
    return ranked.select("id", "queue", F.col("earlier").alias("position"))


def newest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The row of each key with the latest ``at`` (nulls last), of equal ones the least ``tie``: a partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    late = F.coalesce(-F.unix_micros(at), F.lit((1 << 63) - 1))
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(late.alias("a"), F.col(tie).alias("b"))).alias("row_"))
    return best.select(*keys, "row_.*")


def cache_hits(jobs: DataFrame, uploads: DataFrame) -> DataFrame:
    """(id, hit_id): for each job the newest other job that succeeded by itself on the same bytes with equal options.

    Options are compared as structs (null-safe), not as text. The lookup side is reduced to one job a key first.
    """
    bytes_ = uploads.groupBy(F.col("id").alias("document_id")).agg(F.max("sha256").alias("sha256"))
    keyed = jobs.join(bytes_, "document_id").select("id", "status", "cached_from_job_id", "finished_at", "sha256", "options")
    source = newest(keyed.filter(FIRST_RUN), ["sha256", "options"], "finished_at", "id").select("sha256", "options", F.col("id").alias("hit_id"))
    same = (keyed["sha256"] == source["sha256"]) & keyed["options"].eqNullSafe(source["options"])
    return keyed.join(source, same).filter("id <> hit_id").select("id", "hit_id")


def active_jobs(jobs: DataFrame, limit: int = 25) -> DataFrame:
    """Running jobs first, then the oldest."""
    first = F.when(F.col("status") == "PROCESSING", 0).otherwise(1)
    return jobs.filter(F.col("status").isin(*ACTIVE)).orderBy(first, "created_at", "id").limit(limit)


def recent_failures(jobs: DataFrame, limit: int = 8) -> DataFrame:
    return jobs.filter("status = 'FAILED'").orderBy(F.desc_nulls_first("finished_at"), "id").limit(limit)


def job_listing(jobs: DataFrame) -> DataFrame:
    """A job as the listing shows it: derived flags, rounded durations, typed error."""
    return jobs.select(
        "id", "status", F.col("status").isin("SUCCEEDED", "FAILED", "CANCELLED").alias("is_terminal"), F.round(seconds("finished_at", "started_at"), 2).alias("took_s"), F.round(seconds("started_at", "created_at"), 2).alias("wait_s"), F.col("language.code").alias("language_code"), F.col("language.confidence").alias("language_confidence"),
        result_error(F.col("status")).alias("result_error"), *[F.concat(F.lit(LINKS), "id", F.lit(tail)).alias(f"{name}_link") for name, tail in (("self", ""), ("result", "/result"), ("chunks", "/chunks"), ("document", "/document"))], (F.size(F.coalesce("warnings", F.array())) > 0).alias("has_warnings"),
    )


def result_error(status: Column) -> Column:
    """Why a job has no result; null where it has one."""
    return F.when(status == "SUCCEEDED", None).when(status == "FAILED", "JOB_FAILED").when(status == "CANCELLED", "JOB_CANCELLED").otherwise("JOB_NOT_FINISHED")


def shaped_result(results: DataFrame, text: bool = True, pages: bool = True, chunks: bool = True) -> DataFrame:
    """Results without what wasn't asked for; pages lose their text with ``text``."""
    drop = [c for c, keep in (("text", text), ("markdown", text), ("pages", pages), ("chunks", chunks)) if not keep and c in results.columns]
    out = results.drop(*drop)
    if not text and pages and "pages" in out.columns:
        fields = {f.name for f in out.schema["pages"].dataType.elementType.fields} & {"text", "markdown"}
        out = out.withColumn("pages", F.transform("pages", lambda p: p.dropFields(*sorted(fields)))) if fields else out
    return out


def new_warnings(old: Column, new: Column) -> Column:
    """Old warnings and those of the new ones that aren't among them, in order."""
    return F.concat(F.coalesce(old, F.array().cast("array<string>")), F.filter(F.coalesce(new, F.array().cast("array<string>")), lambda w: ~F.array_contains(F.coalesce(old, F.array().cast("array<string>")), w)))


def queue_summary(jobs: DataFrame) -> DataFrame:
    """(queue, n, wait_p50, wait_p95, wait_max, took_mean, peak_depth) of finished jobs that ran themselves."""
    timed = jobs.filter(FIRST_RUN).select("queue", seconds("started_at", "created_at").alias("wait"), seconds("finished_at", "started_at").alias("took"), F.unix_micros("created_at").alias("a"), F.unix_micros("started_at").alias("b"))
    sums = timed.groupBy("queue").agg(F.count("*").alias("n"), F.max("wait").alias("wait_max"), F.avg("took").alias("took_mean"))
    waits = exact_quantiles(timed, ["queue"], "wait", {"wait_p50": 0.5, "wait_p95": 0.95})
    peaks = peak_depth(timed.filter("b is null or b >= a"), "queue", "a", "b")
    return join_null_safe(join_null_safe(sums, waits, ["queue"], "left"), peaks, ["queue"], "left").select("queue", "n", "wait_p50", "wait_p95", "wait_max", "took_mean", F.col("peak").alias("peak_depth"))


def queue_depths(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status = 'QUEUED'").groupBy("queue").agg(F.count("*").alias("depth"))


def macro_average(df: DataFrame, group: list[str], category: str, value: str, without: str | None = None) -> DataFrame:
    """Mean of the categories' means per group; categories whose name starts with ``without`` don't count."""
    df = df.filter(~F.coalesce(F.col(category).startswith(without), F.lit(False))) if without else df
    inner = df.groupBy(*group, category).agg(F.avg(value).alias("m"))
    return inner.groupBy(*group).agg(F.avg("m").alias("macro"), F.count("*").alias("categories"))


def category_means(records: DataFrame, group: list[str], times: str, pages: str, *values: str) -> DataFrame:
    """(group..., samples, pages, time_mean, time_p95, a mean of each value): page times are pooled over all records of a
    group, not averaged by record."""
    sums = records.groupBy(*group).agg(F.count("*").alias("samples"), F.sum(pages).alias("pages"), *[F.avg(v).alias(v) for v in values])
    flat = records.select(*group, F.explode(times).alias("t_"))
    means = flat.groupBy(*group).agg(F.avg("t_").alias("time_mean"))
    high = exact_quantiles(flat, group, "t_", {"time_p95": 0.95})
    return join_null_safe(join_null_safe(sums, means, group, "left"), high, group, "left")


def candidate_summary(records: DataFrame, group: list[str], category: str, value: str, seconds_a_page: str, pages: str, real: str) -> DataFrame:
    """Per candidate: macro average and page-weighted seconds of the synthetic records, mean, minimum and page-weighted
    seconds of those whose category is ``real``."""
    is_real = F.col(category) == real
    weighted = lambda on: F.try_divide(F.sum(F.when(on, F.col(seconds_a_page) * F.col(pages))), F.sum(F.when(on, F.col(pages))))
    sums = records.groupBy(*group).agg(weighted(~is_real).alias("s_weighted"), F.avg(F.when(is_real, F.col(value))).alias("real_mean"), F.min(F.when(is_real, F.col(value))).alias("real_min"), weighted(is_real).alias("real_s_weighted"))
    return join_null_safe(sums, macro_average(records.filter(~is_real), group, category, value), group, "left")


def outcome(jobs: DataFrame) -> DataFrame:
    """(succeeded, failed, in_flight, success_rate) over all jobs, one row; the rate is null where none has ended."""
    ended = jobs.agg(F.count_if(F.col("status") == "SUCCEEDED").alias("succeeded"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status").isin(*ACTIVE)).alias("in_flight"))
    return ended.withColumn("success_rate", F.try_divide(F.col("succeeded"), F.col("succeeded") + F.col("failed")))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def stored_once(uploads: DataFrame) -> DataFrame:
    """Content-addressed storage: one row per content, with how often and under how many ids it came."""
    return uploads.filter("sha256 is not null").groupBy("sha256").agg(F.min("id").alias("first_id"), F.countDistinct("id").alias("ids"), F.count("*").alias("copies"))
