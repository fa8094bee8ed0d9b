"""Relational operators that need more than a line of SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import TIME


def within(df: DataFrame, most: int) -> bool:
    """Is a table small enough to broadcast, by the size that the optimizer knows it to have? A
    table whose size it can't tell counts as large."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= most


def lookup_join(left: DataFrame, table: DataFrame, on, how: str = "left", most: int = 64 << 20) -> DataFrame:
    """Join with an enrichment table: broadcast while its size is under most bytes, else by a
    shuffle, where adaptive execution splits skewed keys."""
    return left.join(F.broadcast(table) if within(table, most) else table, on, how)


def limited_broadcast_join(left: DataFrame, right: DataFrame, keys: list[str], most_rows: int, how: str = "inner") -> DataFrame:
    """Join whose left side is first cut to most_rows rows, a fixed bound, and broadcast."""
    return right.join(F.broadcast(left.limit(most_rows)), keys, how)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int | None = None) -> DataFrame:
    """Each left row with the newest right row of its keys that is no newer than it (by _timestamp),
    at most tolerance older. Both sides are sorted once, together, per key and day; the last right
    row before a day is carried in from per-day maxima, so that a hot key is dealt out by day.
    Right rows of one key and time: the greatest counts. Right columns are nested in "right"."""
    day = 86_400_000_000
    slot = F.floor(F.col(TIME) / day).alias("__slot")
    rest = sorted(c for c in right.columns if c not in keys)
    row = F.struct(TIME, *[c for c in rest if c != TIME])
    held = right.select(*keys, slot, row.alias("__row"))
    edge = held.groupBy(*keys, "__slot").agg(F.max("__row").alias("__row"))
    before = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    # one row per key and day that either side has
    days = left.select(*keys, slot).distinct().join(edge, [*keys, "__slot"], "full").withColumn("__carried", F.max("__row").over(before)).select(*keys, "__slot", "__carried").where("__carried IS NOT NULL")
    marks = held.select(*keys, "__slot", F.col(f"__row.{TIME}").alias("__at"), F.lit(0).alias("__side"), "__row", F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__left"))
    carried = days.select(*keys, "__slot", F.lit(None).cast("long").alias("__at"), F.lit(-1).alias("__side"), F.col("__carried").alias("__row"), F.lit(None).cast(marks.schema["__left"].dataType).alias("__left"))
    asked = left.select(*keys, slot, F.col(TIME).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(marks.schema["__row"].dataType).alias("__row"), F.struct(*left.columns).alias("__left"))
    w = Window.partitionBy(*keys, "__slot").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = marks.union(carried).union(asked).withColumn("right", F.max("__row").over(w)).where("__side = 1")
    if tolerance is not None:
        found = found.withColumn("right", F.when(F.col("__at") - F.col(f"right.{TIME}") <= tolerance, F.col("right")))
    return found.select("__left.*", "right")


def range_join(left: DataFrame, right: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Left rows with the right rows whose [low, high) holds left's number: an equal join on buckets of
    width, with the bounds checked inside a bucket."""
    a = left.withColumn("__bucket", F.floor(F.col(at) / width))
    b = right.where(F.col(low) < F.col(high)).withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return a.join(b, (a["__bucket"] == b["__bucket"]) & (a[at] >= b[low]) & (a[at] < b[high])).drop("__bucket")


def deduplicate(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The first row per key: the newest, or the first by order. Equal rows of the order are told
    apart by all columns, so that the result is always the same. The newest row is an aggregate,
    which combines before the shuffle; another order needs the rows of a key in one place."""
    rest = sorted(c for c in df.columns if c not in keys)
    if not rest:
        return df.dropDuplicates(keys)
    if order is None:
        others = [c for c in rest if c != TIME]
        best = df.groupBy(*keys).agg(F.min(F.struct((-F.col(TIME)).alias("__age"), *others)).alias("__row"))
        found = {c: F.col(f"`{c}`") for c in keys} | {TIME: (-F.col("__row.__age")).alias(TIME)} | {c: F.col(f"__row.`{c}`") for c in others}
        return best.select(*[found[c] for c in df.columns])
    w = Window.partitionBy(*keys).orderBy(*order, *[F.col(c) for c in rest])
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row per key by partial aggregation: a key with a third of all rows sends a row
    per task."""
    rest = sorted(c for c in df.columns if c not in keys and c != TIME)
    best = df.groupBy(*keys).agg(F.max(F.struct(TIME, *rest)).alias("__row"))
    return best.select(*keys, f"__row.{TIME}", *[f"__row.`{c}`" for c in rest])


def match_one_join(left: DataFrame, right: DataFrame, keys: list[str], limit: int, how: str = "inner", complex_right: bool = False) -> DataFrame:
    """Joins each left row with at most one right row: the right side is first cut to its newest
    limit rows (any limit rows if it is no plain scan), then to the newest per key. Without keys
    only the limit applies."""
    right = right.limit(limit) if complex_right or TIME not in right.columns else right.orderBy(F.col(TIME).desc()).limit(limit)
    if not keys:
        return left.crossJoin(right)
    one = latest(right, keys) if TIME in right.columns else right.dropDuplicates(keys)
    clash = [c for c in one.columns if c in left.columns and c not in keys]
    for c in clash:
        one = one.withColumnRenamed(c, f"right_{c}")
    return left.join(one, keys, how)


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark keeps n rows per group and task before the shuffle."""
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def values_top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values of a column: zo_sql_key, zo_sql_num. Ties by value."""
    counts = df.groupBy(F.col(column).cast("string").alias("zo_sql_key")).agg(F.count(F.lit(1)).alias("zo_sql_num"))
    return counts.orderBy(F.desc("zo_sql_num"), F.col("zo_sql_key").asc_nulls_last()).limit(k)


def top_k_distinct(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    """The k groups with most different values."""
    return df.groupBy(group).agg(F.countDistinct(value).alias("n_distinct")).orderBy(F.desc("n_distinct"), group).limit(k)


def distinct_values(df: DataFrame, fields: list[str]) -> DataFrame:
    """Rows of the distinct-values stream: each combination of the fields with its first time and
    its count."""
    return df.groupBy(*fields).agg(F.min(TIME).alias(TIME), F.count(F.lit(1)).alias("count"))


def merge_distinct(df: DataFrame) -> DataFrame:
    """Compaction of the distinct-values stream: one row for all that differ in time and count only."""
    others = [c for c in df.columns if c not in (TIME, "count")]
    return df.groupBy(*others).agg(F.min(TIME).alias(TIME), F.sum("count").alias("count"))


def cardinality(df: DataFrame, fields: list[str], exact: bool = False) -> DataFrame:
    """One row: the number of values of each field and their product."""
    count = F.countDistinct if exact else F.approx_count_distinct
    out = df.agg(*[count(f).alias(f) for f in fields])
    product = F.lit(1).cast("long")
    for f in fields:
        product = product * F.col(f)
    return out.withColumn("product", product)


def sample_system(df: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    return df.sample(fraction=ratio, seed=seed)


def sample_stratified(df: DataFrame, ratio: float, strata: int, start: int, end: int, seed: int = 42) -> DataFrame:
    """The same share of each of ``strata`` equal spans of the time range."""
    wide = max(1, -(-(end - start) // strata))
    stratum = F.floor((F.col(TIME) - start) / wide).cast("int")
    return df.sampleBy(stratum, {i: ratio for i in range(strata)}, seed)


def partial_aggregates(df: DataFrame, keys: list[str], value: str, slice_micros: int) -> DataFrame:
    """Mergeable state of aggregates per time slice, to be kept and merged by merge_partials()."""
    at = (F.col(TIME) - F.pmod(F.col(TIME), F.lit(slice_micros))).alias("slice")
    return df.groupBy(*keys, at).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.hll_sketch_agg(value).alias("sketch"))


def merge_partials(partials: DataFrame, keys: list[str]) -> DataFrame:
    merged = partials.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*keys, "n", "total", (F.col("total") / F.col("n")).alias("mean"), "least", "most", F.hll_sketch_estimate("sketch").alias("n_distinct"))


def downsample(df: DataFrame, step_micros: int, rule: str, labels: list[str], key: str = "__hash__", value: str = "value", origin: int = 978_307_200_000_000) -> DataFrame:
    """One sample per series and step: the greatest of each label, the rule's function of the
    values (first and last by time), at the start of the step; newest first. The origin of the
    steps is 2001-01-01."""
    ordered = F.struct(TIME, value)
    functions = {
        "avg": F.avg(value), "max": F.max(value), "min": F.min(value), "sum": F.sum(value), "count": F.count(value).cast("double"),
        "first": F.min(ordered)[value], "last": F.max(ordered)[value],
    }
    if rule not in functions:
        raise ValueError(f"no downsampling rule {rule!r}")
    bucket = (F.col(TIME) - F.pmod(F.col(TIME) - origin, F.lit(step_micros))).alias(TIME)
    out = df.groupBy(key, bucket).agg(*[F.max(c).alias(c) for c in labels], functions[rule].alias(value))
    return out.orderBy(F.col(TIME).desc(), key)


def search_around(df: DataFrame, key: int, size: int, window_micros: int = 900_000_000, where: str | None = None) -> DataFrame:
    """size rows around a time, newest first: half of them older (the key included), half newer,
    all within the window."""
    near = df.where(f"{TIME} >= {key - window_micros} AND {TIME} < {key + window_micros}")
    if where:
        near = near.where(where)
    tie = [F.col(c) for c in sorted(df.columns) if c != TIME]
    older = near.where(F.col(TIME) <= key).orderBy(F.col(TIME).desc(), *tie).limit(size // 2)
    newer = near.where(F.col(TIME) > key).orderBy(F.col(TIME).asc(), *tie).limit(size // 2)
    return newer.unionByName(older).orderBy(F.col(TIME).desc(), *tie)


#: What a log pattern puts for variable parts, tried in this order.
MASKS = [
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"\b\d{1,3}(\.\d{1,3}){3}\b", "<ip>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?Z?\b", "<time>"),
    (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    (r"\d+", "<num>"),
]


def log_patterns(df: DataFrame, column: str, k: int = 100) -> DataFrame:
    """The k most frequent shapes of a text column once numbers, ids and times are masked."""
    shape = F.col(column)
    for pattern, mask in MASKS:
        shape = F.regexp_replace(shape, pattern, mask)
    return df.groupBy(shape.alias("pattern")).agg(F.count(F.lit(1)).alias("count"), F.min(column).alias("example")).orderBy(F.desc("count"), "pattern").limit(k)


def anomaly_series(df: DataFrame, wide_micros: int, function: str = "count", column: str | None = None, training_days: int = 7, where: str | None = None) -> DataFrame:
    """The series that an anomaly detector is trained on: an aggregate per time bucket, with the
    hour and, for training over a week or more, the day of the week (0 is Sunday)."""
    if where:
        df = df.where(where)
    of = F.col(column) if column else F.lit(1)
    percentile = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    value = F.percentile(of, percentile[function]) if function in percentile else {"count": F.count, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[function](of)
    start = F.timestamp_micros(F.col(TIME) - F.pmod(F.col(TIME), F.lit(wide_micros))).alias("time_bucket")
    out = df.groupBy(start).agg(value.alias("value")).withColumn("hour", F.hour("time_bucket"))
    if training_days >= 7:
        out = out.withColumn("dow", F.dayofweek("time_bucket") - 1)
    return out.orderBy("time_bucket")


def fingerprints(df: DataFrame, fields: list[str]) -> DataFrame:
    """Alerts with the fingerprint of their grouping fields."""
    return df.withColumn("fingerprint", F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields]), 256))


def deduplicate_alerts(df: DataFrame, fields: list[str], window_micros: int) -> DataFrame:
    """Alerts that are no repeat: the first of a fingerprint, and each that comes more than the
    window after the one before it."""
    w = Window.partitionBy("fingerprint").orderBy(TIME)
    marked = fingerprints(df, fields).withColumn("__before", F.lag(TIME).over(w))
    return marked.where(F.col("__before").isNull() | (F.col(TIME) - F.col("__before") > window_micros)).drop("__before")


def group_alerts(df: DataFrame, fields: list[str]) -> DataFrame:
    """Alerts batched by fingerprint, with their count and time span."""
    return fingerprints(df, fields).groupBy("fingerprint", *fields).agg(F.count(F.lit(1)).alias("alerts"), F.min(TIME).alias("first_seen"), F.max(TIME).alias("last_seen"))
