"""The registered queries over the driver's tables, and the SQL that each is held against.

A query in the engine's own dialect goes through the planner like any request. In its text, {E}
stands for the events stream, which has _timestamp; for the oracle it is a derived table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, conform, union_versions, with_time
from .operators import relational as R
from .operators import traces as TR
from .plans.planner import Planner, Request, search
from .promql import engine as PQ
from .session import configure
from .sources import ingest as IN
from .sources import storage as SG
from .streaming import pipelines as ST

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "documents")
EVENTS = "(SELECT *, epoch_us(ts) AS _timestamp FROM events)"
DAY = 86_400_000_000
#: 2024-01-10, a day inside the events' range.
START = 1_704_844_800_000_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_last: tuple[str, str, Catalog] | None = None


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The driver's tables as streams: events as a log and a metric stream, a lookup table, spans.
    The last one is kept, as reading ten tables' schemas takes longer than many a query."""
    global _last
    app = spark.sparkContext.applicationId
    if _last is None or _last[:2] != (app, sf_dir) or _last[2].spark is not spark:
        _last = (app, sf_dir, _catalog(spark, sf_dir))
    return _last[2]


def _catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    configure(spark)
    out = Catalog(spark)
    for name in TABLES:
        out.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), fts=["text"] if name == "documents" else None)
    events = with_time(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts")
    out.register("events", events, fts=["event_type", "props"])
    out.register("nation", spark.read.parquet(f"{sf_dir}/nation.parquet"), "enrichment_tables")
    shard = (F.col("user_id") % 3).cast("string").alias("shard")
    out.register("event_value", events.select("_timestamp", "event_type", shard, "value"), "metrics")
    bounds = F.array(*[F.struct(F.lit(text).alias("le"), F.lit(number).alias("top")) for text, number in (("10", 10.0), ("50", 50.0), ("100", 100.0), ("+Inf", float("inf")))])
    hour = (F.col("_timestamp") - F.pmod("_timestamp", F.lit(3_600_000_000))).alias("_timestamp")
    buckets = events.select(hour, "event_type", "value", F.explode(bounds).alias("b")).where("value <= b.top")
    out.register("event_bucket", buckets.groupBy("_timestamp", "event_type", F.col("b.le").alias("le")).agg(F.count(F.lit(1)).cast("double").alias("value")), "metrics")
    out.register("spans", spans(events), "traces")
    return out


def spans(events: DataFrame) -> DataFrame:
    """Spans made of events: four events make a trace, the later three of which are children of the
    first; the service is the event type."""
    i = F.col("event_id")
    return events.select(
        "_timestamp", (i - i % 4).cast("string").alias("trace_id"), i.cast("string").alias("span_id"),
        F.when(i % 4 == 0, "").otherwise((i - i % 4).cast("string")).alias("reference_parent_span_id"),
        F.col("event_type").alias("service_name"), F.concat(F.lit("op"), (F.col("user_id") % 5).cast("string")).alias("operation_name"),
        F.when(i % 4 == 0, F.lit("3")).when(i % 4 == 3, F.lit("3")).otherwise("2").alias("span_kind"), F.when(F.col("value") > 100, "ERROR").otherwise("OK").alias("span_status"),
        F.col("_timestamp").alias("start_time"), (F.col("_timestamp") + F.floor(F.col("value") * 1000).cast("long")).alias("end_time"),
        F.when(i % 4 == 3, F.concat(F.lit("ext"), (F.col("user_id") % 3).cast("string"))).alias("infer_service_name"),
    )


SPANS = f"""(SELECT _timestamp, CAST(event_id - event_id % 4 AS VARCHAR) AS trace_id, CAST(event_id AS VARCHAR) AS span_id,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE CAST(event_id - event_id % 4 AS VARCHAR) END AS reference_parent_span_id, event_type AS service_name,
  'op' || CAST(user_id % 5 AS VARCHAR) AS operation_name, CASE WHEN event_id % 4 IN (0, 3) THEN '3' ELSE '2' END AS span_kind,
  CASE WHEN value > 100 THEN 'ERROR' ELSE 'OK' END AS span_status, _timestamp AS start_time, _timestamp + CAST(floor(value * 1000) AS BIGINT) AS end_time,
  CASE WHEN event_id % 4 = 3 THEN 'ext' || CAST(user_id % 3 AS VARCHAR) END AS infer_service_name FROM {EVENTS})"""


def ask(name: str, text: str, oracle: str | None = None, **request) -> None:
    """Registers a query in the engine's dialect; without an oracle the same text is one."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search(spark, Planner(catalog(spark, sf_dir)), Request(text.replace("{E}", "events"), **({"size": -1} | request)))

    QUERIES[name] = run
    ORACLES[name] = (text if oracle is None else oracle).replace("{E}", EVENTS)


def does(name: str, fn: Callable[[Catalog], DataFrame], oracle: str | None = None) -> None:
    """Registers a query on the DataFrame API."""
    QUERIES[name] = lambda spark, sf_dir: fn(catalog(spark, sf_dir))
    if oracle is not None:
        ORACLES[name] = oracle.replace("{E}", EVENTS).replace("{SPANS}", SPANS)


ask(
    "flagship", "SELECT histogram(_timestamp, '1 hour') AS bucket, event_type, count(*) AS cnt FROM {E} WHERE str_match(event_type, 'err') GROUP BY bucket, event_type",
    "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS cnt FROM events WHERE contains(event_type, 'err') GROUP BY ALL",
)

# -- sources and scans ----------------------------------------------------------------------------
ask("scan_project_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3 AND l_returnflag = 'R'")
ask("scan_time_range", "SELECT event_id, event_type FROM {E}", f"SELECT event_id, event_type, _timestamp FROM {{E}} WHERE _timestamp >= {START} AND _timestamp < {START + DAY}", start=START, end=START + DAY)
ask("scan_select_star", "SELECT * FROM nation")
ask("scan_empty_relation", "SELECT event_id, value FROM {E} WHERE 1 = 0", "SELECT event_id, value, _timestamp FROM {E} WHERE 1 = 0")
ask("scan_typed_stream", 'SELECT event_type, count(*) AS n FROM "metrics"."event_value" GROUP BY event_type', "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")


def _versions(c: Catalog) -> DataFrame:
    e = c.df("events")
    old = e.where("event_id % 2 = 0").select("_timestamp", "event_id", F.col("value").cast("string").alias("value"))
    new = e.where("event_id % 2 = 1").select("_timestamp", "event_id", "event_type", "value")
    return union_versions([old, new])


does("scan_union_versions", _versions, "SELECT _timestamp, event_id, CASE WHEN event_id % 2 = 1 THEN event_type END AS event_type, value FROM {E}")
does(
    "schema_conform", lambda c: conform(c.df("events").select("event_id", "event_type", "value"), c.spark.createDataFrame([], "value bigint, event_type bigint, added string, event_id string").schema),
    "SELECT CAST(NULL AS VARCHAR) AS added, CAST(event_id AS VARCHAR) AS event_id, TRY_CAST(event_type AS BIGINT) AS event_type, CAST(trunc(value) AS BIGINT) AS value FROM events",
)
does("scan_enrichment_join", lambda c: R.lookup_join(c.df("customer"), c.df("nation", "enrichment_tables"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name"), "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
does("scan_sample_system", lambda c: R.sample_system(c.df("lineitem"), 0.5).select("l_orderkey", "l_linenumber"))
does("scan_sample_system_share", lambda c: R.sample_system(c.df("lineitem"), 0.5).agg(F.count(F.lit(1)).alias("n")).crossJoin(c.df("lineitem").agg(F.count(F.lit(1)).alias("m"))).select((F.abs(F.col("n") / F.col("m") - 0.5) < 0.1).alias("near")), "SELECT true AS near")
ask("explain_search", "EXPLAIN SELECT event_id FROM {E} WHERE value > 20", "SELECT true AS pushed")
_explain = QUERIES["explain_search"]
QUERIES["explain_search"] = lambda spark, sf_dir: _explain(spark, sf_dir).select(F.col("plan").contains("GreaterThan(value,20.0)").alias("pushed"))
does("scan_sample_stratified", lambda c: R.sample_stratified(c.df("events"), 0.5, 10, START - 9 * DAY, START + 21 * DAY).select("event_id"))
does("compact_sorted", lambda c: c.df("events").orderBy(F.col("_timestamp").desc()).select("_timestamp", "event_id"), "SELECT _timestamp, event_id FROM {E} ORDER BY _timestamp DESC")
does("distinct_values", lambda c: R.distinct_values(c.df("events"), ["event_type"]), "SELECT event_type, min(_timestamp) AS _timestamp, count(*) AS count FROM {E} GROUP BY event_type")
does("distinct_values_merge", lambda c: R.merge_distinct(R.distinct_values(c.df("events"), ["event_type", "user_id"]).drop("user_id")), "SELECT event_type, min(_timestamp) AS _timestamp, count(*) AS count FROM {E} GROUP BY event_type")
does("filelist_merge", lambda c: c.df("orders").groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("min_ts"), F.count(F.lit(1)).alias("files")).orderBy(F.desc("min_ts")), "SELECT o_orderpriority, min(o_orderkey) AS min_ts, count(*) AS files FROM orders GROUP BY o_orderpriority ORDER BY min_ts DESC")

# -- projection, filter, predicate ---------------------------------------------------------------
ask("project_alias_expr", "SELECT o_orderkey AS k, round(o_totalprice * 2, 2) AS twice, o_orderpriority || '!' AS p FROM orders")
ask("auto_timestamp", "SELECT event_type FROM {E}", "SELECT _timestamp, event_type FROM {E}")
ask("placeholder_true", "SELECT event_id FROM {E} WHERE event_type = '_o2_all_' AND value > 50", "SELECT _timestamp, event_id FROM {E} WHERE value > 50")
ask("placeholder_false", "SELECT count(*) AS n FROM {E} WHERE event_type <> '_o2_all_'", "SELECT count(*) AS n FROM events WHERE FALSE")
ask("custom_value", "SELECT count(*) AS n FROM {E} WHERE event_type = 'err::_o2_custom'", "SELECT count(*) AS n FROM events WHERE contains(event_type, 'err')")
ask("extra_filter", "SELECT event_id FROM {E} WHERE value > 10 OR value < 1", "SELECT event_id, _timestamp FROM {E} WHERE (value > 10 OR value < 1) AND event_type = 'click'", extra_filter="event_type = 'click'")
ask("between_in_like", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AND p_name LIKE '%a%'")
ask("ilike_not_null", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'build%' AND c_name IS NOT NULL")
ask("case_cast_trycast", "SELECT event_id, CAST(value AS INT) AS a, TRY_CAST(event_type AS INT) AS b, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS c FROM {E}", "SELECT _timestamp, event_id, CAST(trunc(value) AS INT) AS a, TRY_CAST(event_type AS INT) AS b, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS c FROM {E}")
ask("contains_starts_ends", "SELECT count(*) AS n FROM part WHERE p_name LIKE '%e%' AND p_type LIKE 'S%' AND p_name NOT LIKE '%zz%' AND p_type LIKE '%L'")
ask("aggregate_filter", "SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, count(*) AS n FROM {E} GROUP BY event_type")
ask("having_alias", "SELECT event_type, count(*) AS traffic FROM {E} GROUP BY event_type HAVING count(*) > 10 ORDER BY traffic DESC")
ask("having_no_group", "SELECT count(*) AS n FROM orders HAVING count(*) > 0")
ask("exists_subquery", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
ask("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
ask("in_subquery", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
ask("cte_derived", "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE n > 12) SELECT count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders FROM top")
ask("recursive_query", "WITH RECURSIVE r(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 20) SELECT CAST(sum(n) AS BIGINT) AS total FROM r")

# -- joins ------------------------------------------------------------------------------------------
ask("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 400000")
ask("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
ask("join_right", "SELECT n.n_name, count(c.c_custkey) AS customers FROM customer c RIGHT JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
ask("join_full", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a FULL JOIN region b ON a.n_nationkey = b.r_regionkey + 20")
ask("join_cross", "WITH a AS (SELECT r_regionkey FROM region) SELECT a.r_regionkey, n.n_nationkey FROM a CROSS JOIN nation n")
ask("join_anti_left_null", "SELECT c.c_custkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
ask("join_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49 AND l_partkey IS NOT NULL)")
ask("join_self_compound", "SELECT a.l_orderkey, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey WHERE a.l_linenumber < b.l_linenumber")
ask("join_theta_like", "SELECT r.r_name, n.n_name FROM region r LEFT JOIN nation n ON n.n_name LIKE CONCAT('%', CAST(r.r_regionkey AS VARCHAR), '%')")
does("join_limit_dedup", lambda c: R.match_one_join(c.df("nation").select(F.col("n_nationkey").cast("long").alias("user_id"), "n_name"), c.df("events").select("user_id", "_timestamp", "event_id"), ["user_id"], 500), "WITH r AS (SELECT user_id, _timestamp, event_id FROM {E} ORDER BY _timestamp DESC LIMIT 500), d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _timestamp DESC) AS k FROM r) SELECT CAST(n_nationkey AS BIGINT) AS user_id, n_name, _timestamp, event_id FROM nation JOIN d ON n_nationkey = user_id WHERE k = 1")
ask("join_three_way", "SELECT n.n_name, CAST(count(*) AS BIGINT) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 0) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")

def _asof(c: Catalog, **options) -> DataFrame:
    e = c.df("events").select("user_id", "_timestamp", "event_id", "event_type")
    out = R.asof_join(e.where("event_type = 'click'"), e.where("event_type = 'view'").drop("event_type"), ["user_id"], **options)
    return out.select("event_id", F.col("right.event_id").alias("before"))


_ASOF = "WITH l AS (SELECT * FROM {E} WHERE event_type = 'click'), r AS (SELECT * FROM {E} WHERE event_type = 'view') SELECT l.event_id, {x} AS before FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l._timestamp >= r._timestamp"
does("join_asof", _asof, _ASOF.replace("{x}", "r.event_id"))
does("join_asof_tolerance", lambda c: _asof(c, tolerance=DAY), _ASOF.replace("{x}", "CASE WHEN l._timestamp - r._timestamp <= 86400000000 THEN r.event_id END"))
does("join_range", lambda c: R.range_join(c.df("orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("p")), c.df("part").select("p_partkey", (F.col("p_partkey") * 1000).alias("lo"), (F.col("p_partkey") * 1000 + 700).alias("hi")), "p", "lo", "hi", 5000).select("o_orderkey", "p_partkey"), "SELECT o_orderkey, p_partkey FROM orders JOIN part ON floor(o_totalprice) >= p_partkey * 1000 AND floor(o_totalprice) < p_partkey * 1000 + 700")

# -- aggregates --------------------------------------------------------------------------------------
ask("agg_basic", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_extendedprice), 4) AS a, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
ask("agg_count_distinct", "SELECT event_type, count(distinct user_id) AS users, count(DISTINCT props) AS props FROM {E} GROUP BY event_type")
ask("agg_median", "SELECT l_returnflag, round(median(l_quantity), 4) AS m FROM lineitem GROUP BY l_returnflag")
ask("agg_percentile_cont", "SELECT event_type, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95 FROM {E} GROUP BY event_type")
ask("agg_first_last_value", "SELECT event_type, first_value(event_id ORDER BY _timestamp) AS a, last_value(event_id ORDER BY _timestamp) AS b FROM {E} GROUP BY event_type", "SELECT event_type, arg_min(event_id, _timestamp) AS a, arg_max(event_id, _timestamp) AS b FROM {E} GROUP BY event_type")
ask("agg_array_agg", "SELECT n_regionkey, array_join(array_agg(n_name ORDER BY n_nationkey), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
ask("agg_weighted_percentile", "SELECT l_returnflag, approx_percentile_cont_with_weight(l_linenumber, CAST(l_quantity AS INT), 0.5) AS p FROM lineitem GROUP BY l_returnflag", "WITH x AS (SELECT l_returnflag, l_linenumber, unnest(range(CAST(l_quantity AS INT))) FROM lineitem) SELECT l_returnflag, quantile_cont(l_linenumber, 0.5) AS p FROM x GROUP BY l_returnflag")
ask("agg_approx_distinct", "SELECT approx_distinct(user_id) AS users FROM {E}")
ORACLES.pop("agg_approx_distinct")
ask("agg_approx_distinct_error", "SELECT abs(approx_distinct(user_id) - count(DISTINCT user_id)) <= 0.1 * count(DISTINCT user_id) AS near FROM {E}", "SELECT true AS near")
ask("agg_approx_percentile_error", "SELECT event_type, approx_percentile_cont(value, 0.9) BETWEEN percentile_cont(0.88) WITHIN GROUP (ORDER BY value) AND percentile_cont(0.92) WITHIN GROUP (ORDER BY value) AS near FROM {E} GROUP BY event_type", "SELECT event_type, true AS near FROM {E} GROUP BY event_type")
ask("agg_approx_percentile", "SELECT event_type, approx_percentile_cont(value, 0.9) AS p90, approx_median(value) AS m FROM {E} GROUP BY event_type")
ORACLES.pop("agg_approx_percentile")
ask("agg_approx_topk", "SELECT approx_topk(event_type, 3) AS top FROM {E}")
ORACLES.pop("agg_approx_topk")
does("agg_topk_distinct", lambda c: R.top_k_distinct(c.df("events"), "event_type", "user_id", 3), "SELECT event_type, count(DISTINCT user_id) AS n_distinct FROM events GROUP BY event_type ORDER BY n_distinct DESC, event_type LIMIT 3")
ask("agg_stddev_variance", "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 4) AS v FROM {E} GROUP BY event_type")
ask("agg_distinct_rows", "SELECT DISTINCT event_type, user_id FROM {E}")
ask("agg_group_by_alias", "SELECT CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS level, count(*) AS n FROM {E} GROUP BY level")
ask("agg_conditional", "SELECT event_type, COUNT(CASE WHEN value > 50 THEN 1 END) AS big, MAX(CASE WHEN value < 50 THEN value ELSE 0 END) AS small FROM {E} GROUP BY event_type")
ask("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus), ())")
ask("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
ask("agg_rollup", "SELECT n_regionkey, n_name, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_name)")
ask("agg_topk_rows", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
does("agg_streaming_partials", lambda c: R.merge_partials(R.partial_aggregates(c.df("events"), ["event_type"], "user_id", DAY), ["event_type"]).select("event_type", "n", "total", "least", "most"), "SELECT event_type, count(user_id) AS n, CAST(sum(user_id) AS BIGINT) AS total, min(user_id) AS least, max(user_id) AS most FROM events GROUP BY event_type")
ask("track_total_hits", "SELECT event_id FROM {E} WHERE value > 30 ORDER BY event_id LIMIT 5", "SELECT count(*) AS zo_sql_num FROM events WHERE value > 30", track_total_hits=True)
ask("track_total_hits_distinct", "SELECT DISTINCT event_type, user_id FROM {E}", "SELECT count(*) AS zo_sql_num FROM (SELECT DISTINCT event_type, user_id FROM events)", track_total_hits=True)
does("cardinality_product", lambda c: R.cardinality(c.df("events"), ["event_type", "user_id"], exact=True), "SELECT count(DISTINCT event_type) AS event_type, count(DISTINCT user_id) AS user_id, count(DISTINCT event_type) * count(DISTINCT user_id) AS product FROM events")

# -- windows --------------------------------------------------------------------------------------
ask("window_top_n", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2")
ask("window_ratio", "SELECT n_nationkey, n_nationkey * 1.0 / SUM(n_nationkey) OVER (PARTITION BY n_regionkey) > 0.2 AS big FROM nation")
ask("window_agg_inside", "SELECT event_type, user_id, count(_timestamp) AS n, CAST(ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY count(_timestamp) DESC, user_id) AS BIGINT) AS rn FROM {E} GROUP BY event_type, user_id")
ask("window_moving_average", "SELECT event_id, round(AVG(value) OVER (ORDER BY _timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS m FROM {E}", "SELECT event_id, round(AVG(value) OVER (ORDER BY _timestamp ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS m FROM {E}")
ask("window_ranks", "SELECT n_nationkey, CAST(RANK() OVER (ORDER BY n_regionkey) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (ORDER BY n_regionkey) AS BIGINT) AS d, CAST(NTILE(4) OVER (ORDER BY n_nationkey) AS BIGINT) AS q, PERCENT_RANK() OVER (ORDER BY n_regionkey) AS p, CUME_DIST() OVER (ORDER BY n_regionkey) AS c FROM nation")
ask("window_lag_lead", "SELECT event_id, LAG(event_id, 1) OVER (PARTITION BY user_id ORDER BY _timestamp) AS a, LEAD(event_id, 1) OVER (PARTITION BY user_id ORDER BY _timestamp) AS b FROM {E}")
ask("window_nth_first_last", "SELECT n_nationkey, FIRST_VALUE(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS f, NTH_VALUE(n_name, 2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM nation")
ask("window_range_frame", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM orders")

# -- sort and limit ------------------------------------------------------------------------------
ask("implicit_order_limit", "SELECT event_id FROM {E}", "SELECT _timestamp, event_id FROM {E} ORDER BY _timestamp DESC LIMIT 20", size=20)
ask("implicit_default_limit", "SELECT event_id FROM {E}", "SELECT _timestamp, event_id FROM {E} ORDER BY _timestamp DESC LIMIT 1005", size=0)
ask("offset_from", "SELECT event_id FROM {E}", "SELECT _timestamp, event_id FROM {E} ORDER BY _timestamp DESC LIMIT 10 OFFSET 30", size=10, frm=30)
ask("order_nulls_last", "SELECT n.n_nationkey, r.r_name FROM nation n LEFT JOIN region r ON n.n_nationkey = r.r_regionkey ORDER BY r.r_name LIMIT 3")
ask("order_offset_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
does("values_top_k", lambda c: R.values_top_k(c.df("events"), "user_id", 10), "SELECT CAST(user_id AS VARCHAR) AS zo_sql_key, count(*) AS zo_sql_num FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
does("deduplicate_keep_newest", lambda c: R.deduplicate(c.df("events").select("_timestamp", "user_id", "event_id"), ["user_id"]), "SELECT _timestamp, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _timestamp DESC, event_id) AS k FROM {E}) WHERE k = 1")
does("latest_per_key", lambda c: R.latest(c.df("events").select("_timestamp", "user_id", "event_id"), ["user_id"]), "SELECT user_id, max(_timestamp) AS _timestamp, arg_max(event_id, _timestamp) AS event_id FROM {E} GROUP BY user_id")
does("top_per_group", lambda c: R.top_per_group(c.df("lineitem"), ["l_returnflag"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5).select("l_returnflag", "l_orderkey", "l_linenumber"), "SELECT l_returnflag, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k <= 5")

# -- set operations -------------------------------------------------------------------------------
ask("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region")
ask("union_all", "SELECT event_type FROM {E} WHERE value > 90 UNION ALL SELECT event_type FROM {E} WHERE value < 1")
ask("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
ask("except_multi", "SELECT c_nationkey AS a, c_mktsegment AS b FROM customer EXCEPT SELECT c_nationkey AS a, c_mktsegment AS b FROM customer WHERE c_acctbal > 9000")

# -- scalar functions ----------------------------------------------------------------------------
ask("fn_str_match", "SELECT event_id FROM {E} WHERE str_match(event_type, 'err')", "SELECT _timestamp, event_id FROM {E} WHERE contains(event_type, 'err')")
ask("fn_match_field", "SELECT count(*) AS n FROM {E} WHERE match_field(event_type, 'ick')", "SELECT count(*) AS n FROM events WHERE contains(event_type, 'ick')")
ask("fn_str_match_ignore_case", "SELECT count(*) AS n, count(CASE WHEN match_field_ignore_case(c_mktsegment, 'Build') THEN 1 END) AS m FROM customer WHERE str_match_ignore_case(c_mktsegment, 'mAchi') OR str_match_ignore_case(c_mktsegment, 'BUILD')", "SELECT count(*) AS n, count(CASE WHEN lower(c_mktsegment) LIKE '%build%' THEN 1 END) AS m FROM customer WHERE lower(c_mktsegment) LIKE '%machi%' OR lower(c_mktsegment) LIKE '%build%'")
ask("fn_match_all", "SELECT doc_id FROM documents WHERE match_all('License')", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
ask("fn_match_all_raw", "SELECT count(*) AS n FROM documents WHERE match_all_raw_ignore_case('IDIOT*')", "SELECT count(*) AS n FROM documents WHERE contains(lower(text), 'idiot')")
ask("fn_match_all_hash", "SELECT count(*) AS n FROM documents WHERE match_all_hash('apache')", "SELECT count(*) AS n FROM documents WHERE contains(lower(text), 'apache')")
ask("fn_fuzzy_match", "SELECT c_custkey FROM customer WHERE fuzzy_match(c_mktsegment, 'houshold', 1)", "SELECT c_custkey FROM customer WHERE levenshtein(lower(c_mktsegment), 'houshold') <= 1")
ask("fn_fuzzy_match_all", "SELECT count(*) AS n FROM {E} WHERE fuzzy_match_all('clik', 1)", "SELECT count(*) AS n FROM events WHERE levenshtein(event_type, 'clik') <= 1")
ask("fn_re_match", "SELECT count(*) AS n FROM {E} WHERE re_match(event_type, '^(err|cl)')", "SELECT count(*) AS n FROM events WHERE regexp_matches(event_type, '^(err|cl)')")
ask("fn_re_not_match", "SELECT count(*) AS n FROM {E} WHERE re_not_match(props, '[5-9]')", "SELECT count(*) AS n FROM events WHERE NOT regexp_matches(props, '[5-9]')")
ask("fn_re_matches", "SELECT event_id, array_join(re_matches(props, '([0-9])'), '-') AS digits FROM {E}", "SELECT _timestamp, event_id, array_to_string(regexp_extract_all(props, '[0-9]'), '-') AS digits FROM {E}")
ask("fn_arrcount", "SELECT event_id, arrcount('[' || CAST(user_id AS VARCHAR) || ',1,\"x\"]') AS a, arrcount(event_type) AS b FROM {E}", "SELECT _timestamp, event_id, CAST(3 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b FROM {E}")
ask("fn_arrindex", "SELECT event_id, arrindex('[' || CAST(user_id AS VARCHAR) || ',2,\"x\"]', 0, 1) AS a FROM {E}", "SELECT _timestamp, event_id, '[' || CAST(user_id AS VARCHAR) || ',2]' AS a FROM {E}")
ask("fn_arrjoin", "SELECT event_id, arrjoin('[' || CAST(user_id AS VARCHAR) || ',true,\"x\"]', '|') AS a FROM {E}", "SELECT _timestamp, event_id, CAST(user_id AS VARCHAR) || '|true|x' AS a FROM {E}")
ask("fn_arrsort", "SELECT event_id, arrsort('[' || CAST(user_id AS VARCHAR) || ',40,7]') AS a, arr_descending('[\"b\",\"' || event_type || '\"]') AS d FROM {E}", "SELECT _timestamp, event_id, '[' || array_to_string(list_sort([user_id, 40, 7]), ',') || ']' AS a, '[\"' || array_to_string(list_reverse_sort(['b', event_type]), '\",\"') || '\"]' AS d FROM {E}")
ask("fn_arrzip", "SELECT event_id, arrzip('[' || CAST(user_id AS VARCHAR) || ',2]', '[\"a\",\"b\",\"c\"]', '-') AS a FROM {E}", "SELECT _timestamp, event_id, '[\"' || CAST(user_id AS VARCHAR) || '-a\",\"2-b\"]' AS a FROM {E}")
ask("fn_spath", "SELECT event_id, spath(props, 'k') AS k, spath(props, 'none') AS n FROM {E}", "SELECT _timestamp, event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS n FROM {E}")
ask("fn_cast_to_arr", "SELECT event_id, array_join(cast_to_arr('[\"' || event_type || '\",\"\",3]'), ',') AS a, to_array_string(cast_to_arr('[\"' || event_type || '\"]')) AS b FROM {E}", "SELECT _timestamp, event_id, event_type || ',3' AS a, '[\"' || event_type || '\"]' AS b FROM {E}")
ask("fn_string_to_array_v2", "SELECT p_partkey, array_join(string_to_array_v2(p_type, ' -'), '/') AS a FROM part", "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(p_type, '[ -]'), lambda x: x <> ''), '/') AS a FROM part")
ask("fn_time_range", "SELECT count(*) AS n FROM {E} WHERE time_range(_timestamp, '2024-01-05T00:00:00Z', '2024-01-06T00:00:00Z')", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
ask("fn_date_format", "SELECT event_id, date_format(_timestamp, '%Y-%m-%d %H:%M', '') AS a, date_format(_timestamp, '%d/%m/%y', '+05:30') AS b FROM {E}", "SELECT _timestamp, event_id, strftime(ts, '%Y-%m-%d %H:%M') AS a, strftime(ts + INTERVAL '330 minutes', '%d/%m/%y') AS b FROM {E}")
ask("fn_cast_to_timestamp", "SELECT count(*) AS n FROM {E} WHERE _timestamp >= cast_to_timestamp('2024-01-20T00:00:00Z')", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
ask("fn_histogram", "SELECT histogram(_timestamp, '1 hour') AS bucket, event_type, count(*) AS cnt FROM {E} GROUP BY bucket, event_type", "SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, event_type, count(*) AS cnt FROM events GROUP BY ALL")
ask("fn_histogram_auto", "SELECT histogram(_timestamp) AS bucket, count(*) AS cnt FROM {E} GROUP BY bucket", f"SELECT time_bucket(INTERVAL '30 minutes', ts) AS bucket, count(*) AS cnt FROM {{E}} WHERE _timestamp >= {START} AND _timestamp < {START + DAY} GROUP BY ALL", start=START, end=START + DAY)
ask("fn_date_bin", "SELECT date_bin(INTERVAL '1 day', to_timestamp_micros(_timestamp), TIMESTAMP '2001-01-01') AS d, count(*) AS n FROM {E} GROUP BY d", "SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY d")
ask("fn_time_bucket", "SELECT time_bucket('5 minutes', to_timestamp_micros(_timestamp)) AS b, count(*) AS n FROM {E} GROUP BY b", "SELECT time_bucket(INTERVAL '5 minutes', ts) AS b, count(*) AS n FROM events GROUP BY b")
ask("fn_substr_from_zero", "SELECT event_id, substr(event_type, 0, 3) AS a, substr(event_type, 2, 2) AS b FROM {E}", "SELECT _timestamp, event_id, substr(event_type, 1, 2) AS a, substr(event_type, 2, 2) AS b FROM {E}")
ask("fn_strings", "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS l, lower(p_type) AS lo, upper(p_name) AS up, concat(p_brand, NULL, '-', p_type) AS c, trim('  x ') AS t, coalesce(NULL, p_brand) AS co, lpad(CAST(p_partkey AS VARCHAR), 5, '0') AS lp FROM part")
ask("fn_trim_chars", "SELECT p_partkey, rtrim(ltrim(p_brand, 'Brand'), '12') AS a FROM part")
ask("fn_regexp_match", "SELECT event_id, array_extract(regexp_match(props, 'k\": ([0-9]+)'), 1) AS k, array_element(regexp_match(props, 'zz([0-9])'), 1) AS z FROM {E}", "SELECT _timestamp, event_id, regexp_extract(props, 'k\": ([0-9]+)', 1) AS k, CAST(NULL AS VARCHAR) AS z FROM {E}")
ask("fn_date_part", "SELECT event_id, date_part('hour', to_timestamp_micros(_timestamp)) AS h, date_part('dow', to_timestamp_micros(_timestamp)) AS d FROM {E}", "SELECT _timestamp, event_id, CAST(date_part('hour', ts) AS INT) AS h, CAST(date_part('dow', ts) AS INT) AS d FROM {E}")
ask("fn_date_trunc", "SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY m")
ask("fn_extract_epoch", "SELECT event_id FROM {E} WHERE _timestamp < EXTRACT(EPOCH FROM TIMESTAMP '2024-01-02 00:00:00' - INTERVAL '30 MINUTE') * 1000000", "SELECT _timestamp, event_id FROM {E} WHERE ts < TIMESTAMP '2024-01-01 23:30:00'")
ask("fn_json_get", "SELECT event_id, json_get_str(props, 'k') AS a, json_get_json(props, 'k') AS b FROM {E}", "SELECT _timestamp, event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k') AS b FROM {E}")
ask("fn_unnest_group", "SELECT unnest(flatten(cast_to_arr('[\"' || event_type || '\",\"all\"]'))) AS e, count(_timestamp) AS n FROM {E} GROUP BY e", "SELECT e, count(*) AS n FROM (SELECT unnest([event_type, 'all']) AS e FROM events) GROUP BY e")
ask("fn_range_array", "SELECT n_nationkey, array_join(range(1, 4), ',') AS r, array_join(array['a', n_name], '+') AS a FROM nation", "SELECT n_nationkey, '1,2,3' AS r, 'a+' || n_name AS a FROM nation")
ask("fn_math", "SELECT p_partkey, abs(-p_size) AS a, ceil(p_retailprice) AS c, floor(p_retailprice) AS f, round(sqrt(p_size), 6) AS s, p_partkey % 7 AS m, round(power(p_size, 2), 3) AS p FROM part", "SELECT p_partkey, abs(-p_size) AS a, CAST(ceil(p_retailprice) AS BIGINT) AS c, CAST(floor(p_retailprice) AS BIGINT) AS f, round(sqrt(p_size), 6) AS s, p_partkey % 7 AS m, round(power(p_size, 2), 3) AS p FROM part")

# -- derived analytics -----------------------------------------------------------------------------
_STATS = "count(*) AS total_requests, count(*) FILTER (WHERE span_status = 'ERROR') AS errors, count(*) FILTER (WHERE span_status = 'ERROR') * 100.0::DOUBLE / count(*) AS error_rate, quantile_cont(end_time - start_time, 0.5) AS p50, quantile_cont(end_time - start_time, 0.95) AS p95, quantile_cont(end_time - start_time, 0.99) AS p99"
does("service_graph", lambda c: TR.service_graph(c.df("spans", "traces")).select("client", "server", "total_requests", "errors", F.round("error_rate", 6).alias("error_rate"), F.round("p50", 3).alias("p50")), f"WITH s AS {{SPANS}} SELECT p.service_name AS client, c.service_name AS server, count(*) AS total_requests, count(*) FILTER (WHERE c.span_status = 'ERROR') AS errors, round(count(*) FILTER (WHERE c.span_status = 'ERROR') * 100.0::DOUBLE / count(*), 6) AS error_rate, round(quantile_cont(c.end_time - c.start_time, 0.5), 3) AS p50 FROM s c LEFT JOIN s p ON c.reference_parent_span_id = p.span_id AND c.trace_id = p.trace_id AND p.span_kind IN ('1', '3') WHERE c.span_kind IN ('1', '2') AND (p.service_name <> c.service_name OR p.service_name IS NULL) GROUP BY 1, 2")
does("service_graph_external", lambda c: TR.service_graph(c.df("spans", "traces"), exclude_internal=True).select("client", "server", "total_requests", "errors"), "WITH s AS {SPANS} SELECT p.service_name AS client, c.service_name AS server, count(*) AS total_requests, count(*) FILTER (WHERE c.span_status = 'ERROR') AS errors FROM s c LEFT JOIN s p ON c.reference_parent_span_id = p.span_id AND c.trace_id = p.trace_id AND p.span_kind = '3' WHERE c.span_kind = '2' AND (p.service_name <> c.service_name OR p.service_name IS NULL) GROUP BY 1, 2")
does("inferred_edges", lambda c: TR.inferred_edges(c.df("spans", "traces")).select("client", "server", "total_requests", "errors"), "WITH s AS {SPANS} SELECT service_name AS client, infer_service_name AS server, count(*) AS total_requests, count(*) FILTER (WHERE span_status = 'ERROR') AS errors FROM s WHERE span_kind IN ('3', '4') AND infer_service_name IS NOT NULL AND infer_service_name NOT IN (SELECT service_name FROM s WHERE service_name IS NOT NULL) GROUP BY 1, 2")
does("trace_dag_nodes", lambda c: TR.trace_nodes(c.df("spans", "traces"), "40"), "WITH s AS {SPANS} SELECT span_id, nullif(reference_parent_span_id, '') AS parent_span_id, service_name, operation_name, span_status, start_time, end_time FROM s WHERE trace_id = '40'")
does("trace_dag_edges", lambda c: TR.trace_edges(c.df("spans", "traces"), "40"), "WITH s AS {SPANS} SELECT reference_parent_span_id AS \"from\", span_id AS \"to\" FROM s WHERE trace_id = '40' AND reference_parent_span_id <> ''")
does("trace_list_index", lambda c: TR.trace_list(c.df("spans", "traces"), "default"), "WITH s AS {SPANS} SELECT min(_timestamp) AS _timestamp, 'default' AS stream_name, service_name, trace_id FROM s GROUP BY service_name, trace_id")
does("traces_latest", lambda c: TR.latest_traces(c.df("spans", "traces")).select("trace_id", "spans", "errors", "duration", "root_operation"), "WITH s AS {SPANS} SELECT trace_id, count(*) AS spans, count(*) FILTER (WHERE span_status = 'ERROR') AS errors, max(end_time) - min(start_time) AS duration, arg_min(operation_name, start_time) AS root_operation FROM s GROUP BY trace_id ORDER BY min(start_time) DESC, trace_id LIMIT 25")
_KEY = START + DAY // 2
does("search_around", lambda c: R.search_around(c.df("events"), _KEY, 20, 4 * 3600_000_000).select("_timestamp", "event_id"), f"(SELECT _timestamp, event_id FROM {{E}} WHERE _timestamp > {_KEY} AND _timestamp < {_KEY + 4 * 3600_000_000} ORDER BY _timestamp LIMIT 10) UNION ALL (SELECT _timestamp, event_id FROM {{E}} WHERE _timestamp <= {_KEY} AND _timestamp >= {_KEY - 4 * 3600_000_000} ORDER BY _timestamp DESC LIMIT 10)")
does("log_patterns", lambda c: R.log_patterns(c.df("events"), "props", 10), "SELECT regexp_replace(props, '[0-9]+', '<num>', 'g') AS pattern, count(*) AS count, min(props) AS example FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
does("anomaly_series", lambda c: R.anomaly_series(c.df("events"), 3600_000_000, "p95", "value").withColumn("value", F.round("value", 6)), "SELECT time_bucket(INTERVAL '1 hour', ts) AS time_bucket, round(quantile_cont(value, 0.95), 6) AS value, CAST(date_part('hour', time_bucket(INTERVAL '1 hour', ts)) AS INT) AS hour, CAST(date_part('dow', time_bucket(INTERVAL '1 hour', ts)) AS INT) AS dow FROM events GROUP BY ALL")
does("downsample_avg", lambda c: R.downsample(c.df("events").withColumn("__hash__", F.col("event_type")), 3600_000_000, "avg", ["event_type"]).withColumn("value", F.round("value", 6)), "SELECT event_type AS __hash__, _timestamp - (_timestamp - 978307200000000) % 3600000000 AS _timestamp, event_type, round(avg(value), 6) AS value FROM {E} GROUP BY ALL")
does("downsample_last", lambda c: R.downsample(c.df("events").withColumn("__hash__", F.col("event_type")), 86_400_000_000, "last", ["event_type"]), "SELECT event_type AS __hash__, _timestamp - (_timestamp - 978307200000000) % 86400000000 AS _timestamp, event_type, arg_max(value, _timestamp) AS value FROM {E} GROUP BY 1, 2, 3")
does("alert_dedup", lambda c: R.deduplicate_alerts(c.df("events"), ["user_id", "event_type"], DAY).select("event_id"), "SELECT event_id FROM (SELECT event_id, _timestamp - lag(_timestamp) OVER (PARTITION BY user_id, event_type ORDER BY _timestamp) AS d FROM {E}) WHERE d IS NULL OR d > 86400000000")
does("alert_groups", lambda c: R.group_alerts(c.df("events"), ["event_type"]).drop("fingerprint"), "SELECT event_type, count(*) AS alerts, min(_timestamp) AS first_seen, max(_timestamp) AS last_seen FROM {E} GROUP BY event_type")

# -- ingest -------------------------------------------------------------------------------------------


def _lines(c: Catalog, **columns) -> DataFrame:
    return c.df("events").select(F.to_json(F.struct(*[x.alias(k) for k, x in columns.items()])).alias("value"))


does(
    "ingest_json", lambda c: IN.spread(IN.from_json_lines(_lines(c, _timestamp=F.col("_timestamp"), event_id=F.col("event_id"), where_=F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")), value=F.col("value")), "s")),
    "SELECT _timestamp, event_id, value, event_type AS where__type, user_id AS where__user FROM {E}",
)


def _hec(c: Catalog) -> DataFrame:
    """Each line brings its event_id in its fields, as a time can be that of several events. An event
    without props is sent as an empty object, as null is no event."""
    line = lambda event: F.to_json(F.struct(F.col("_timestamp").alias("time"), F.col("event_type").alias("index"), F.struct("event_id").alias("fields"), event.alias("event")))
    empty = F.expr("cast(map() as map<string,string>)")
    lines = c.df("events").select(F.when(F.col("props").isNull(), line(empty)).otherwise(line(F.col("props"))).alias("value"))
    return IN.spread(IN.from_hec(lines), {"log": "string", "event_id": "bigint"}).select("_timestamp", "log", "event_id")


does("ingest_hec", _hec, "SELECT _timestamp, props AS log, event_id FROM {E}")
does(
    "ingest_loki",
    lambda c: IN.spread(IN.from_loki(_lines(c, streams=F.array(F.struct(F.struct(F.col("event_type").alias("job")).alias("stream"), F.array(F.array((F.col("_timestamp") * 1000).cast("string"), F.col("props"))).alias("values"))))), {"job": "string", "log": "string"}),
    "SELECT _timestamp, event_type AS job, props AS log FROM {E}",
)
does(
    "ingest_metrics", lambda c: IN.from_metrics_json(_lines(c, __name__=F.lit("m"), kind=F.col("event_type"), _timestamp=F.col("_timestamp"), value=F.col("value"))).select("stream", "_timestamp", "value", F.col("labels")["kind"].alias("kind")),
    "SELECT 'm' AS stream, _timestamp, value, event_type AS kind FROM {E}",
)


def _otlp(c: Catalog) -> DataFrame:
    attribute = F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("event_type").alias("stringValue")).alias("value")))
    nanos = (F.col("_timestamp") * 1000).cast("string")
    span = F.struct((F.col("event_id") % 10).cast("string").alias("traceId"), F.col("event_id").cast("string").alias("spanId"), F.lit("op").alias("name"), F.lit("SPAN_KIND_SERVER").alias("kind"), nanos.alias("startTimeUnixNano"), nanos.alias("endTimeUnixNano"))
    line = F.array(F.struct(F.struct(attribute.alias("attributes")).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans")))
    return IN.from_otlp_traces(_lines(c, resourceSpans=line)).drop("attributes")


does("ingest_otlp_traces", _otlp, "SELECT _timestamp, CAST(event_id % 10 AS VARCHAR) AS trace_id, CAST(event_id AS VARCHAR) AS span_id, '' AS reference_parent_span_id, event_type AS service_name, 'op' AS operation_name, '2' AS span_kind, 'UNSET' AS span_status, _timestamp AS start_time, _timestamp AS end_time FROM {E}")


def _bulk(c: Catalog) -> DataFrame:
    """Eight request bodies, in which an action line comes before each document."""
    e = c.df("events")
    action, doc = F.to_json(F.struct(F.struct(F.col("event_type").alias("_index")).alias("index"))), F.to_json(F.struct("_timestamp", "event_id"))
    lines = e.select((F.col("event_id") % 8).alias("file"), F.posexplode(F.array(action, doc)).alias("at", "value"), "event_id")
    out = IN.from_bulk(lines.select("file", "value", (F.col("event_id") * 2 + F.col("at")).alias("n")))
    return out.select("stream", "_timestamp", F.get_json_object("record", "$.event_id").cast("long").alias("event_id"))


def _otlp_logs(c: Catalog) -> DataFrame:
    record = F.struct((F.col("_timestamp") * 1000).cast("string").alias("timeUnixNano"), F.struct(F.col("props").alias("stringValue")).alias("body"), F.col("event_type").alias("severityText"))
    line = F.array(F.struct(F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs")))
    return IN.spread(IN.from_otlp_logs(_lines(c, resourceLogs=line)), {"body": "string", "severity": "string"})


does("ingest_bulk", _bulk, "SELECT event_type AS stream, _timestamp, event_id FROM {E}")
does("ingest_otlp_logs", _otlp_logs, "SELECT _timestamp, props AS body, event_type AS severity FROM {E}")
does(
    "token_index_search", lambda c: SG.search_index(c.df("documents").select("doc_id"), SG.token_index(c.df("documents"), "text", ["doc_id"]), "License", ["doc_id"]),
    r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])license([^\p{L}\p{N}_]|$)')",
)
#: Span kind, attributes, and the name, type and system that they give.
INFERRED = [
    ("3", {"db_system": "postgresql", "db_name": "orders", "net_peer_name": "pg-primary.prod.svc"}, ("orders", "database", "postgresql")),
    ("3", {"db_system_name": "mysql", "db_namespace": "billing"}, ("billing", "database", "mysql")),
    ("3", {"db_system": "redis", "net_peer_name": "redis-master.prod:6379"}, ("redis-master.prod", "database", "redis")),
    ("3", {"db_system": "redis"}, ("redis", "database", "redis")),
    ("3", {"db_system": "mysql", "net_peer_name": "10.0.0.5:3306"}, ("mysql", "database", "mysql")),
    ("4", {"messaging_system": "kafka", "messaging_destination_name": "checkout-events"}, ("checkout-events", "queue", "kafka")),
    ("4", {"messaging_system": "rabbitmq", "messaging_destination": "task-queue"}, ("task-queue", "queue", "rabbitmq")),
    ("3", {"rpc_system": "grpc", "rpc_service": "com.foo.Bar"}, ("com.foo.Bar", "rpc", "grpc")),
    ("3", {"rpc_system": "aws-api", "rpc_service": "S3"}, ("S3", "rpc", "aws-api")),
    ("3", {"server_address": "api.stripe.com", "http_request_method": "POST"}, ("api.stripe.com", "external", "http")),
    ("3", {"http_url": "https://api.github.com/repos?page=2"}, ("api.github.com", "external", "http")),
    ("3", {"net_peer_name": "thrift.internal"}, ("thrift.internal", "external", None)),
    ("3", {"peer_service": "payments-db", "db_system": "postgresql", "db_name": "orders"}, ("payments-db", "database", "postgresql")),
    ("3", {"net_peer_name": "10.0.0.5"}, (None, None, None)),
    ("3", {"net_peer_name": "2001:db8::1"}, (None, None, None)),
    ("3", {"net_peer_name": "[::1]:6379", "http_host": "  cache.prod:80 "}, ("cache.prod", "external", None)),
    ("3", {"url_full": "http://10.0.0.5/x"}, (None, None, None)),
    ("3", {"db_system": "  ", "db_name": ""}, (None, None, None)),
    ("2", {"db_system": "redis"}, (None, None, None)),
]


def _inferred(c: Catalog) -> DataFrame:
    k = F.col("span_id").cast("long") % len(INFERRED)
    pick = lambda values: F.element_at(F.array(*[F.lit(x).cast("string") for x in values]), (k + 1).cast("int"))
    names = sorted({n for _, attributes, _ in INFERRED for n in attributes})
    spans_ = c.df("spans", "traces").drop("infer_service_name").withColumns({n: pick([a.get(n) for _, a, _ in INFERRED]) for n in names} | {"span_kind": pick([x for x, _, _ in INFERRED])})
    return TR.infer_services(spans_).select("span_id", "infer_service_name", "infer_service_type", "infer_service_system")


_quoted = lambda x: "NULL" if x is None else f"'{x}'"
does("infer_services", _inferred, f"""WITH s AS {{SPANS}}, k(i, name, type, system) AS (VALUES {', '.join(f"({i}, {', '.join(map(_quoted, found))})" for i, (_, _, found) in enumerate(INFERRED))})
SELECT span_id, name AS infer_service_name, type AS infer_service_type, system AS infer_service_system FROM s JOIN k ON CAST(span_id AS BIGINT) % {len(INFERRED)} = i""")

# -- windows over event time, as batches and as streams ----------------------------------------------
does("window_tumbling", lambda c: ST.tumbling(c.df("events"), "6 hours", ["event_type"]).withColumn("total", F.round("total", 4)), "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
does("window_sliding", lambda c: ST.sliding(c.df("events"), "12 hours", "6 hours", ["event_type"]).withColumn("total", F.round("total", 4)), "WITH x AS (SELECT time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours' AS start, event_type, value FROM events, range(2) r(k)) SELECT start, start + INTERVAL '12 hours' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY ALL")
does("window_session", lambda c: ST.sessions(c.df("events"), "30 minutes", ["event_type"]).withColumn("total", F.round("total", 4)), "WITH a AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), b AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM b GROUP BY event_type, s")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling windows again, from a stream that reads the table's file once."""
    configure(spark)
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = ST.tumbling(with_time(stream, "ts"), "6 hours", ["event_type"], late="40 days")
    q = out.writeStream.format("memory").queryName("stream_tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("stream_tumbling").withColumn("total", F.round("total", 4))


QUERIES["stream_tumbling"] = _streamed
ORACLES["stream_tumbling"] = ORACLES["window_tumbling"]


def _in_parts(c: Catalog) -> DataFrame:
    planner, text = Planner(c), "SELECT event_id FROM events WHERE value > 20"
    parts = [search(c.spark, planner, Request(text, a, b, size=-1)) for a, b in ST.partitions(START, START + DAY, DAY // 5, mini=3_600_000_000)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


does("search_in_parts", _in_parts, f"SELECT _timestamp, event_id FROM {{E}} WHERE value > 20 AND _timestamp >= {START} AND _timestamp < {START + DAY}")
does("join_limited_broadcast", lambda c: R.limited_broadcast_join(c.df("nation").withColumnRenamed("n_nationkey", "c_nationkey"), c.df("customer"), ["c_nationkey"], 1000).select("c_custkey", "n_name"), "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")

# -- PromQL ------------------------------------------------------------------------------------------
HOUR = 3_600_000_000
#: The whole range of the events, from midnight to midnight: 721 points.
FIRST, LAST = START - 9 * DAY, START + 21 * DAY
_M = "m AS (SELECT epoch_us(ts) AS ts, event_type, CAST(user_id % 3 AS VARCHAR) AS shard, value AS v FROM events)"
_G = f"g AS (SELECT unnest(range({FIRST}, {LAST + 1}, {HOUR})) AS t)"
_R = f"WITH {_M}, {_G}, r AS (SELECT event_type, shard, t, ts, v FROM m JOIN g ON ts >= t - {6 * HOUR} AND ts <= t)"
_I = f"WITH {_M}, {_G}, i AS (SELECT event_type, shard, t, arg_max(v, ts) AS v FROM m JOIN g ON ts > t - {HOUR} AND ts <= t GROUP BY ALL)"


def prom(name: str, text: str, oracle: str | None = None, labels: tuple[str, ...] = ("event_type", "shard"), **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = PQ.query_range(catalog(spark, sf_dir), text, FIRST, LAST, HOUR, **({"lookback": HOUR} | options))
        return df.select(*[F.col("labels")[x].alias(x) for x in labels], "t", F.round("v", 6).alias("v"))

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle


def _over(fn: str) -> str:
    return f"{_R} SELECT event_type, shard, t, round({fn}, 6) AS v FROM r GROUP BY event_type, shard, t"


_M6 = "event_value[6h]"
prom("prom_selector", 'event_value{event_type="error"}', f"{_I} SELECT event_type, shard, t, round(v, 6) AS v FROM i WHERE event_type = 'error'")
prom("prom_selector_regex", 'event_value{event_type=~"err.*|click",shard!="0"}', f"{_I} SELECT event_type, shard, t, round(v, 6) AS v FROM i WHERE regexp_matches(event_type, '^err.*|click$') AND shard <> '0'")
prom("prom_offset", "event_value offset 1h", f"WITH {_M}, {_G} SELECT event_type, shard, t, round(arg_max(v, ts), 6) AS v FROM m JOIN g ON ts + {HOUR} > t - {HOUR} AND ts + {HOUR} <= t GROUP BY ALL")
for _name, _sql in {"avg": "avg(v)", "sum": "sum(v)", "min": "min(v)", "max": "max(v)", "count": "CAST(count(v) AS DOUBLE)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)", "last": "arg_max(v, ts)"}.items():
    prom(f"prom_{_name}_over_time", f"{_name}_over_time({_M6})", _over(_sql))
prom("prom_quantile_over_time", f"quantile_over_time(0.9, {_M6})", _over("quantile_cont(v, 0.9)"))
_L = f"{_R}, l AS (SELECT *, lag(v) OVER w AS pv, lag(ts) OVER w AS pts FROM r WINDOW w AS (PARTITION BY event_type, shard, t ORDER BY ts)), e AS (SELECT event_type, shard, t, count(*) AS n, arg_min(v, ts) AS fv, arg_max(v, ts) AS lv, min(ts) AS ft, max(ts) AS lt, coalesce(sum(pv) FILTER (WHERE v < pv), 0) AS reset, count(*) FILTER (WHERE v < pv) AS drops, count(*) FILTER (WHERE v <> pv) AS diffs, arg_max(pv, ts) AS pv, arg_max(pts, ts) AS pts FROM l GROUP BY event_type, shard, t)"


def _rate(counter: bool, per_second: bool) -> str:
    start = "(ft - (t - 21600000000)) / 1e6::DOUBLE"
    if counter:
        start = f"CASE WHEN d > 0 AND fv >= 0 AND took * (fv / d) < {start} THEN took * (fv / d) ELSE {start} END"
    return f"""{_L}, x AS (SELECT *, lv - fv{' + reset' if counter else ''} AS d, (lt - ft) / 1e6::DOUBLE AS took, (lt - ft) / 1e6::DOUBLE / (n - 1) AS gap FROM e WHERE n > 1),
y AS (SELECT *, {start} AS a, (t - lt) / 1e6::DOUBLE AS b FROM x)
SELECT event_type, shard, t, round(d * (took + CASE WHEN a < 1.1::DOUBLE * gap THEN a ELSE gap / 2 END + CASE WHEN b < 1.1::DOUBLE * gap THEN b ELSE gap / 2 END) / took{' / 21600' if per_second else ''}, 6) AS v FROM y"""


prom("prom_rate", f"rate({_M6})", _rate(True, True))
prom("prom_increase", f"increase({_M6})", _rate(True, False))
prom("prom_delta", f"delta({_M6})", _rate(False, False))
prom("prom_irate", f"irate({_M6})", f"{_L} SELECT event_type, shard, t, round(CASE WHEN lv < pv THEN lv ELSE lv - pv END / ((lt - pts) / 1e6::DOUBLE), 6) AS v FROM e WHERE n > 1")
prom("prom_idelta", f"idelta({_M6})", f"{_L} SELECT event_type, shard, t, round(lv - pv, 6) AS v FROM e WHERE n > 1")
prom("prom_changes", f"changes({_M6})", f"{_L} SELECT event_type, shard, t, CAST(diffs AS DOUBLE) AS v FROM e")
prom("prom_resets", f"resets({_M6})", f"{_L} SELECT event_type, shard, t, CAST(drops AS DOUBLE) AS v FROM e")
prom("prom_deriv", f"deriv({_M6})", f"{_R} SELECT event_type, shard, t, round(regr_slope(v, (ts - t) / 1e6::DOUBLE), 6) AS v FROM r GROUP BY event_type, shard, t HAVING count(*) > 1")
prom("prom_predict_linear", f"predict_linear({_M6}, 3600)", f"{_R} SELECT event_type, shard, t, round(regr_slope(v, (ts - t) / 1e6::DOUBLE) * 3600 + regr_intercept(v, (ts - t) / 1e6::DOUBLE), 6) AS v FROM r GROUP BY event_type, shard, t HAVING count(*) > 1")
prom("prom_holt_winters", f"holt_winters({_M6}, 0.5, 0.5)")
prom("prom_subquery", "max_over_time(event_value[3h:1h])", f"WITH {_M}, g AS (SELECT unnest(range({FIRST - 3 * HOUR}, {LAST + 1}, {HOUR})) AS t), i AS (SELECT event_type, shard, t, arg_max(v, ts) AS v FROM m JOIN g ON ts > t - {HOUR} AND ts <= t GROUP BY ALL) SELECT event_type, shard, g.t, round(max(v), 6) AS v FROM i JOIN g ON i.t >= g.t - {3 * HOUR} AND i.t <= g.t WHERE g.t >= {FIRST} GROUP BY event_type, shard, g.t")
prom("prom_absent", 'absent(event_value{event_type="none"})', f"WITH {_G} SELECT t, CAST(1 AS DOUBLE) AS v FROM g", labels=())
prom("prom_absent_over_time", f"absent_over_time({_M6})", "SELECT NULL::VARCHAR AS event_type, NULL::VARCHAR AS shard, 0::BIGINT AS t, 0::DOUBLE AS v WHERE FALSE")
for _name, _sql in {"abs": "abs(v)", "ceil": "ceil(v)", "floor": "floor(v)", "exp": None, "sqrt": "sqrt(v)", "ln": "ln(v)", "log2": "log2(v)", "log10": "log10(v)", "round": "round(v)", "sgn": "CAST(sign(v) AS DOUBLE)"}.items():
    _arg = "event_value / 100" if _name == "exp" else "event_value"
    # by the SQL and Prometheus sgn(0) is 0, by the engine's default 1
    prom(f"prom_{_name}", f"{_name}({_arg})", f"{_I} SELECT event_type, shard, t, round({_sql or 'exp(v / 100)'}, 6) AS v FROM i", strict=_name == "sgn")
prom("prom_clamp", "clamp(event_value, 10, 40)", f"{_I} SELECT event_type, shard, t, round(least(greatest(v, 10), 40), 6) AS v FROM i")
prom("prom_clamp_min_max", "clamp_max(clamp_min(event_value, 5), 50)", f"{_I} SELECT event_type, shard, t, round(least(greatest(v, 5), 50), 6) AS v FROM i")
prom("prom_label_replace", 'label_replace(event_value, "event_type", "x$1", "event_type", "^(e.*)$")', f"{_I} SELECT CASE WHEN event_type LIKE 'e%' THEN 'x' || event_type ELSE event_type END AS event_type, shard, t, round(v, 6) AS v FROM i")
prom("prom_label_join", 'label_join(event_value, "both", "-", "event_type", "shard")', f"{_I} SELECT event_type || '-' || shard AS both, t, round(v, 6) AS v FROM i", labels=("both",))
prom("prom_time_parts", "hour(event_value * 0 + time())", f"{_I} SELECT event_type, shard, t, CAST(date_part('hour', make_timestamp(t)) AS DOUBLE) AS v FROM i")
prom("prom_day_of_week", "day_of_week(vector(time()))", f"WITH {_G} SELECT t, CAST(date_part('dow', make_timestamp(t)) AS DOUBLE) AS v FROM g", labels=())
prom("prom_timestamp", "timestamp(event_value)", f"{_I} SELECT event_type, shard, t, CAST(t // 1000000 AS DOUBLE) AS v FROM i")
prom("prom_vector_scalar", "vector(scalar(2)) * 3", f"WITH {_G} SELECT t, CAST(6 AS DOUBLE) AS v FROM g", labels=())
prom("prom_sort", "sort_desc(event_value)", f"{_I} SELECT event_type, shard, t, round(v, 6) AS v FROM i")
for _name, _sql in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "CAST(count(*) AS DOUBLE)", "group": "1::DOUBLE", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)"}.items():
    prom(f"prom_agg_{_name}", f"{_name} by (event_type) (event_value)", f"{_I} SELECT event_type, t, round({_sql}, 6) AS v FROM i GROUP BY event_type, t", labels=("event_type",))
prom("prom_agg_without", "sum without (shard) (event_value)", f"{_I} SELECT event_type, t, round(sum(v), 6) AS v FROM i GROUP BY event_type, t", labels=("event_type",))
prom("prom_agg_all", "sum(event_value)", f"{_I} SELECT t, round(sum(v), 6) AS v FROM i GROUP BY t", labels=())
prom("prom_agg_quantile", "quantile(0.5, event_value)", f"{_I} SELECT t, round(quantile_cont(v, 0.5), 6) AS v FROM i GROUP BY t", labels=())
prom("prom_topk", "topk(2, event_value)", f"{_I} SELECT event_type, shard, t, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY v DESC, event_type, shard) AS k FROM i) WHERE k <= 2")
prom("prom_bottomk", "bottomk by (event_type) (1, event_value)", f"{_I} SELECT event_type, shard, t, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY event_type, t ORDER BY v, shard) AS k FROM i) WHERE k <= 1")
prom("prom_count_values", 'count_values("val", floor(event_value / 10))', f"{_I} SELECT CAST(CAST(floor(v / 10) AS BIGINT) AS VARCHAR) AS val, t, CAST(count(*) AS DOUBLE) AS v FROM i GROUP BY 1, t", labels=("val",))
prom("prom_binary_scalar", "(event_value * 2 + 1) / 4 - 3 % 2 ^ 2", f"{_I} SELECT event_type, shard, t, round((v * 2 + 1) / 4 - 3, 6) AS v FROM i")
prom("prom_compare_filter", "event_value > 30", f"{_I} SELECT event_type, shard, t, round(v, 6) AS v FROM i WHERE v > 30")
prom("prom_compare_bool", "event_value > bool 30", f"{_I} SELECT event_type, shard, t, CAST(v > 30 AS INT)::DOUBLE AS v FROM i")
prom("prom_vector_match", "sum by (event_type) (event_value) / on (event_type) count by (event_type) (event_value)", f"{_I} SELECT event_type, t, round(avg(v), 6) AS v FROM i GROUP BY event_type, t", labels=("event_type",))
prom("prom_group_left", "event_value / on (event_type) group_left () sum by (event_type) (event_value)", f"{_I} SELECT event_type, shard, t, round(v / sum(v) OVER (PARTITION BY event_type, t), 6) AS v FROM i")
prom("prom_and", 'event_value and event_value{shard="1"}', f"{_I} SELECT event_type, shard, t, round(v, 6) AS v FROM i WHERE shard = '1'")
prom("prom_or", 'event_value{shard="1"} or event_value{shard="2"}', f"{_I} SELECT event_type, shard, t, round(v, 6) AS v FROM i WHERE shard IN ('1', '2')")
prom("prom_unless", 'event_value unless event_value{shard="1"}', f"{_I} SELECT event_type, shard, t, round(v, 6) AS v FROM i WHERE shard <> '1'")
prom("prom_unary", "-event_value", f"{_I} SELECT event_type, shard, t, round(-v, 6) AS v FROM i")
_B = f"""WITH e AS (SELECT _timestamp - _timestamp % {HOUR} AS t, event_type, value FROM {EVENTS}), tops(top) AS (VALUES (10::DOUBLE), (50::DOUBLE), (100::DOUBLE), ('inf'::DOUBLE)),
b AS (SELECT t, event_type, top, count(*) AS c FROM e, tops WHERE value <= top AND t BETWEEN {FIRST} AND {LAST} GROUP BY ALL),
r AS (SELECT *, coalesce(lag(top) OVER w, 0) AS lo, coalesce(lag(c) OVER w, 0) AS lc, max(c) OVER (PARTITION BY t, event_type) AS n, count(*) OVER (PARTITION BY t, event_type) AS k FROM b WINDOW w AS (PARTITION BY t, event_type ORDER BY top))"""


def _below(x: int) -> str:
    return f"sum(CASE WHEN lo < {x} AND {x} <= top THEN lc + CASE WHEN isinf(top) THEN 0 ELSE (c - lc) * ({x} - lo) / (top - lo) END END)"


prom("prom_histogram_fraction", "histogram_fraction(5, 60, event_bucket)", f"{_B} SELECT event_type, t, round(CASE WHEN max(k) < 2 THEN 'nan'::DOUBLE ELSE ({_below(60)} - {_below(5)}) / max(n) END, 6) AS v FROM r GROUP BY event_type, t", labels=("event_type",))
prom("prom_histogram_quantile", "histogram_quantile(0.9, event_bucket)", f"{_B}, f AS (SELECT *, row_number() OVER (PARTITION BY t, event_type ORDER BY top) AS i FROM r WHERE c >= 0.9::DOUBLE * n) SELECT event_type, t, round(CASE WHEN k < 2 THEN 'nan'::DOUBLE WHEN isinf(top) THEN lo ELSE lo + (top - lo) * (0.9::DOUBLE * n - lc) / (c - lc) END, 6) AS v FROM f WHERE i = 1", labels=("event_type",))
does("prom_series", lambda c: PQ.series(c, ['event_value{shard="1"}'], FIRST, LAST).select(F.col("labels")["event_type"].alias("event_type"), F.col("labels")["shard"].alias("shard")), f"SELECT DISTINCT event_type, '1' AS shard FROM {{E}} WHERE user_id % 3 = 1 AND _timestamp >= {FIRST} AND _timestamp <= {LAST}")
does("prom_label_values", lambda c: PQ.label_values(c, "event_type", "event_value", FIRST, LAST), f"SELECT DISTINCT event_type AS value FROM {{E}} WHERE _timestamp >= {FIRST} AND _timestamp <= {LAST}")
does("prom_instant", lambda c: PQ.query(c, "sum by (event_type) (sum_over_time(event_value[30d]))", LAST).select(F.col("labels")["event_type"].alias("event_type"), F.round("v", 6).alias("v")), f"SELECT event_type, round(sum(value), 6) AS v FROM {{E}} WHERE _timestamp >= {FIRST} AND _timestamp <= {LAST} GROUP BY event_type")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
