"""Streams on disk: Parquet (or ORC) by day, hour and partition keys; compaction and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import TIME, time_range
from ..functions.sql_functions import MAX_TOKEN, MIN_TOKEN
from ..operators import relational as R


def write(df: DataFrame, path: str, keys: list[str] | None = None, bloom: list[str] | None = None, format: str = "parquet", mode: str = "append", level: str = "hourly") -> None:
    """Appends rows under p_date=/p_hour=/key=… directories. A task writes few partitions, as rows
    are dealt by their hour; a bloom filter is kept for the columns in bloom."""
    at = F.timestamp_micros(F.col(TIME))
    df = df.withColumn("p_date", F.to_date(at))
    parts = ["p_date", *(["p_hour"] if level == "hourly" else []), *(keys or [])]
    if level == "hourly":
        df = df.withColumn("p_hour", F.hour(at))
    out = df.repartition(*parts, F.pmod(F.xxhash64(TIME), F.lit(8))).sortWithinPartitions(*parts, F.col(TIME).desc()).write.mode(mode).format(format).partitionBy(*parts)
    for c in bloom or ():
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.save(path)


def read(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, format: str = "parquet", schema=None) -> DataFrame:
    """Rows of a time range, with the columns of all the stream's versions; only the partitions
    that the range touches are read."""
    reader = spark.read.format(format).option("mergeSchema", "true")
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return time_range(df, start, end).drop("p_date", "p_hour")


def compact(spark: SparkSession, source: str, target: str, day: str, files: int = 1, stream_type: str = "logs") -> None:
    """Writes one day of a stream anew as few sorted files; metadata streams of distinct values are
    merged on the way. The source stays, to be dropped by the caller once readers are done."""
    df = spark.read.option("mergeSchema", "true").parquet(source).where(F.col("p_date") == day)
    if stream_type == "metadata":
        df = R.merge_distinct(df.drop("p_date", "p_hour")).withColumn("p_date", F.lit(day).cast("date"))
    else:
        df = df.drop("p_hour")
    df.repartitionByRange(files, F.col(TIME).desc()).sortWithinPartitions("p_date", F.col(TIME).desc()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("p_date").parquet(target)


def retain(spark: SparkSession, path: str, oldest: str) -> list[str]:
    """Deletes the partitions of days before oldest (YYYY-MM-DD) and returns their names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(root) if fs.exists(root) else []:
        name = s.getPath().getName()
        if name.startswith("p_date=") and name.removeprefix("p_date=") < oldest:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


def token_index(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    """An inverted index as a table: each token with the rows that hold it, one row per pair."""
    words = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+")
    tokens = F.filter(words, lambda t: F.length(t).between(MIN_TOKEN, MAX_TOKEN))
    return df.select(F.explode(F.array_distinct(tokens)).alias("token"), *key)


def search_index(df: DataFrame, index: DataFrame, token: str, key: list[str]) -> DataFrame:
    """The rows of df that hold a token, through the index."""
    return df.join(index.where(F.col("token") == token.lower()).select(*key), key, "left_semi")


def geo_lookup(df: DataFrame, ranges: DataFrame, ip: str) -> DataFrame:
    """Adds the fields of a table of IPv4 ranges (first, last as numbers, disjoint) to rows with an
    address. Ranges are cut at /16 blocks, so that the join is on equal blocks, with a range check
    among the few ranges of a block."""
    parts = F.split(F.col(ip), r"\.")
    number = sum((parts[i].try_cast("long") * (256 ** (3 - i)) for i in range(4)), F.lit(0))
    left = df.withColumn("__ip", F.when(F.size(parts) == 4, number)).withColumn("__block", F.shiftright("__ip", 16))
    right = ranges.withColumn("__block", F.explode(F.sequence(F.shiftright("first", 16), F.shiftright("last", 16))))
    met = left.join(right, (left["__block"] == right["__block"]) & (left["__ip"] >= right["first"]) & (left["__ip"] <= right["last"]), "left")
    return met.drop("__ip", "__block", "first", "last")


def due_hours(spark: SparkSession, path: str, since: int, threshold: int) -> list[tuple[str, int, int]]:
    """Hours of data (date, hour, files) in which at least threshold files are newer than since (µs):
    what an incremental merge would take up. Lists file metadata only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "modificationTime")
    at = files.where(F.unix_micros("modificationTime") >= since).select(F.regexp_extract("path", r"p_date=([0-9-]+)", 1).alias("d"), F.regexp_extract("path", r"p_hour=([0-9]+)", 1).try_cast("int").alias("h"))
    return [tuple(r) for r in at.groupBy("d", "h").count().where(F.col("count") >= threshold).orderBy("d", "h").collect()]
