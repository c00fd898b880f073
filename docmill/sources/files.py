"""Reading files from and writing results to storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from docmill.functions import text as T
from docmill.session import cut_lineage

MOST_BYTES = 50 * 1024 * 1024


def scan_files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, glob: str | None = None) -> DataFrame:
    """Files of a folder with their content hash. The size limit is a filter on file metadata, so larger files are
    never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).filter(F.col("length") <= most_bytes).withColumn("sha256", F.sha2("content", 256))


def too_large(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, error_code) of the files the scan leaves out; content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") > most_bytes).select("path", "length", F.lit("FILE_TOO_LARGE").alias("error_code"))


def distinct_contents(files: DataFrame) -> DataFrame:
    """One row per content: hashes are compared before any expensive reader runs, content stays out of the shuffle."""
    first = files.groupBy("sha256").agg(F.min("path").alias("path"))
    return files.join(first, ["sha256", "path"], "left_semi")


def missing_files(keys: DataFrame, files: DataFrame) -> DataFrame:
    """Keys without a stored file."""
    return keys.join(files.select(F.col("path").alias("key")), "key", "left_anti")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of samples, one row each."""
    return spark.read.option("multiLine", "true").json(path)


def write_by_content(df: DataFrame, path: str) -> None:
    """Content-addressed dataset: a content is stored once, in whatever run it comes, partitioned by the first two digits
    of its hash. Only the hashes of what is stored are read."""
    new = df.dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        held = spark.read.schema(T_.StructType([f for f in new.schema.fields])).parquet(path).select("sha256", F.col("prefix").cast("string").alias("prefix"))
        new = cut_lineage(new.join(held, ["prefix", "sha256"], "left_anti"))
    new.write.mode("append").partitionBy("prefix").parquet(path)


def write_chunks(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Line-delimited JSON, ``job_id`` first."""
    chunks.select("job_id", *[c for c in chunks.columns if c != "job_id"]).write.mode(mode).option("ignoreNullFields", "false").json(path)


def result_json(*columns: str) -> Column:
    """A result as JSON with its nulls; characters beyond ASCII stay."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def write_texts(df: DataFrame, text: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(text).alias("value")).write.mode(mode).text(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def markdown_report(df: DataFrame, order: str) -> DataFrame:
    """(report): a small table as one Markdown table, in the order of a column."""
    rows = df.orderBy(order).select(*[F.col(c).cast("string") for c in df.columns])
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[T.escape_cell(F.col(c)) for c in df.columns]), F.lit(" |"))
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    numbered = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return rows.agg(F.concat(F.lit(head), F.array_join(numbered, "\n")).alias("report"))


def append_events(events: DataFrame, path: str) -> None:
    """Append-only audit log."""
    events.write.mode("append").parquet(path)


def object_key(sha256: Column, filename: Column) -> Column:
    return T.document_key(sha256, T.extension(filename))
