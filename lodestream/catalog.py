"""Streams: named tables of a type with an event time in microseconds, and their schemas."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIME = "_timestamp"
#: Stream types, each a prefix of its views' names.
TYPES = ("logs", "metrics", "traces", "metadata", "filelist", "enrichment_tables", "service_graph")


@dataclass
class Stream:
    name: str
    type: str = "logs"
    fts: list[str] = field(default_factory=list)
    #: enrichment tables only: rows times the width that broadcast() may take
    columns: list[str] = field(default_factory=list)

    @property
    def view(self) -> str:
        return self.name if self.type == "logs" else f"{self.type}__{self.name}"


class Catalog:
    """Registers DataFrames as streams. A stream's view has its columns in alphabetical order, as
    ``SELECT *`` shows them; logs go by their bare name, other types by "type"."name"."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.streams: dict[tuple[str, str], Stream] = {}

    def register(self, name: str, df: DataFrame, type: str = "logs", fts: list[str] | None = None) -> Stream:
        if type not in TYPES:
            raise ValueError(f"no stream type {type!r}")
        stream = Stream(name, type, list(fts or ()), sorted(df.columns))
        df.select(*[F.col(f"`{c}`") for c in stream.columns]).createOrReplaceTempView(stream.view)
        self.streams[type, name] = stream
        return stream

    def get(self, name: str, type: str = "logs") -> Stream:
        if (type, name) not in self.streams:
            raise LookupError(f"stream not found: {type}.{name}")
        return self.streams[type, name]

    def df(self, name: str, type: str = "logs") -> DataFrame:
        return self.spark.table(self.get(name, type).view)


def with_time(df: DataFrame, column: str) -> DataFrame:
    """Adds _timestamp in microseconds from a timestamp column, which is read as UTC."""
    return df.withColumn(TIME, F.unix_micros(F.col(column).cast("timestamp")))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df under a newer schema: columns cast where their type has drifted (a value that can't be
    is null), null where missing, in alphabetical order."""
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for f in sorted(schema, key=lambda f: f.name):
        if f.name not in have:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif have[f.name] == f.dataType:
            out.append(F.col(f"`{f.name}`"))
        else:
            out.append(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name))
    return df.select(*out)


def widen(*schemas: T.StructType) -> T.StructType:
    """One schema for all versions of a stream, oldest first: new fields are appended, and of two
    types of a field the latest counts."""
    found: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema:
            found[f.name] = f.dataType
    return T.StructType([T.StructField(n, t, True) for n, t in found.items()])


def union_versions(parts: list[DataFrame]) -> DataFrame:
    """Parts of a stream that were written under different schemas, as one."""
    schema = widen(*[p.schema for p in parts])
    out = conform(parts[0], schema)
    for p in parts[1:]:
        out = out.unionByName(conform(p, schema))
    return out


def time_range(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Rows with start <= _timestamp < end, in microseconds; a missing bound is open. Where the
    table is partitioned by p_date, whole partitions outside are never listed."""
    for bound, op, day in ((start, ">=", ">="), (end, "<", "<=")):
        if bound:
            df = df.where(f"{TIME} {op} {int(bound)}")
            if "p_date" in df.columns:
                df = df.where(f"p_date {day} to_date(timestamp_micros({int(bound)}))")
    return df
