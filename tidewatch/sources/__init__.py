"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import keep_first
from tidewatch.sources import schemas

#: chunk_<worker>_<first day>_<last day>_part<n>.csv.gz
CHUNK_NAME = r"chunk_(\d+)_(\d{8})_(\d{8})_part(\d+)\.csv(?:\.gz)?$"


def chunk_columns(name: Column) -> list[Column]:
    """worker, first_day, last_day, part of a chunk file's name; null for other names."""
    part = lambda i: F.when(F.regexp_extract(name, CHUNK_NAME, i) != "", F.regexp_extract(name, CHUNK_NAME, i))
    return [part(1).cast("int").alias("worker"), F.to_date(part(2), "yyyyMMdd").alias("first_day"), F.to_date(part(3), "yyyyMMdd").alias("last_day"), part(4).cast("int").alias("part")]


def read_csv(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """CSV files, gzipped or not, with a header and a declared schema."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(list(paths))


def read_fills(spark: SparkSession, *paths: str) -> DataFrame:
    return read_csv(spark, schemas.FILLS, *paths)


def read_chunks(spark: SparkSession, schema: str, folder: str) -> DataFrame:
    """All chunk files of a folder, with worker, first_day, last_day, part, size and path. A gz file is one task: rewrite it once as Parquet."""
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("pathGlobFilter", "chunk_*_part*.csv*").csv(folder)
    name = F.col("_metadata.file_name")
    return rows.select(*rows.columns, *chunk_columns(name), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_path").alias("path"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or a glob of paths leads to any file, in any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else schemas.empty(spark, schema)


def read_activity(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """One table of those paths and globs that there are."""
    there = [p for p in paths if exists(spark, p)]
    return read_csv(spark, schema, *there) if there else schemas.empty(spark, schema)


def merge_markets(main: DataFrame, missing: DataFrame) -> DataFrame:
    """Both tables of markets, one row an id: the main table's first, then the earliest created."""
    both = main.withColumn("prio", F.lit(0)).unionByName(missing.withColumn("prio", F.lit(1)))
    return keep_first(both, ["id"], F.col("prio"), F.col("createdAt").asc_nulls_last(), F.col("question").asc_nulls_last()).drop("prio")


def string_list(text: Column) -> Column:
    """An array of strings from its JSON text."""
    return F.from_json(text, "array<string>")


def flatten_markets(raw: DataFrame) -> DataFrame:
    """The markets table from rows of a `json` column, a market each; a record without an id is skipped.

    `outcomes` and `clobTokenIds` are arrays, or texts that hold arrays; get_json_object gives the same text for both.
    """
    field = lambda path: F.get_json_object("json", f"$.{path}")
    outcomes, tokens = string_list(field("outcomes")), string_list(field("clobTokenIds"))
    flag = lambda path: F.coalesce(field(path).cast("string") == "true", F.lit(False))
    rows = raw.select(
        field("createdAt").alias("createdAt"), field("id").alias("id"), F.coalesce(F.nullif(field("question"), F.lit("")), field("title"), F.lit("")).alias("question"),
        F.coalesce(F.get(outcomes, 0), F.lit("")).alias("answer1"), F.coalesce(F.get(outcomes, 1), F.lit("")).alias("answer2"),
        (flag("negRiskAugmented") | flag("negRiskOther")).cast("string").alias("neg_risk"), field("slug").alias("market_slug"),
        F.coalesce(F.get(tokens, 0), F.lit("")).alias("token1"), F.coalesce(F.get(tokens, 1), F.lit("")).alias("token2"),
        field("conditionId").alias("condition_id"), field("volume").try_cast("double").alias("volume"), field("events[0].ticker").alias("ticker"), field("closedTime").alias("closedTime"),
    )
    return rows.where("id is not null")


def flatten_fills(raw: DataFrame) -> DataFrame:
    """Fills as text columns from rows of a `json` column; what a record lacks is an empty text."""
    names = [c.split()[0] for c in schemas.FILLS.split(", ")]
    return raw.select(*(F.coalesce(F.get_json_object("json", f"$.{n}"), F.lit("")).alias(n) for n in names))


def write_table(df: DataFrame, path: str, *clustered: str) -> None:
    """Parquet, replacing what is there; sorted within files by `clustered`, so that a slice skips row groups."""
    (df.sortWithinPartitions(*clustered) if clustered else df).write.mode("overwrite").parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """A catalog table bucketed and sorted by a key: joins and slices on it need no exchange."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)


def write_chunks(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Gzipped CSV parts with quoted text."""
    df.write.mode("overwrite").option("compression", "gzip").option("header", True).option("escape", '"').option("maxRecordsPerFile", rows_per_file).csv(path)


def land_chunks(df: DataFrame, path: str, *order: str) -> None:
    """Gzipped CSV files named chunk_<worker>_<first day>_<last day>_part<n>.csv.gz, one for each worker and part.

    df has worker, part, first_day and last_day beside the rows, which are in the given order within a file. Files are renamed one by one, so
    there are to be as many as a folder is listed for, not as many as rows.
    """
    spark = df.sparkSession
    name = F.format_string("chunk_%s_%s_%s_part%s", F.col("worker").cast("string"), F.date_format("first_day", "yyyyMMdd"), F.date_format("last_day", "yyyyMMdd"), F.col("part").cast("string"))
    rows = df.withColumn("chunk", name).drop("worker", "part", "first_day", "last_day")
    rows.repartition("chunk").sortWithinPartitions("chunk", *order).write.mode("overwrite").partitionBy("chunk").option("compression", "gzip").option("header", True).option("escape", '"').csv(f"{path}/unnamed")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in files.globStatus(hadoop(f"{path}/unnamed/chunk=*")):
        part = files.globStatus(hadoop(f"{folder.getPath()}/part-*"))[0].getPath()
        files.rename(part, hadoop(f"{path}/{folder.getPath().getName().removeprefix('chunk=')}.csv.gz"))
    files.delete(hadoop(f"{path}/unnamed"), True)
