"""Service graphs, inferred services and trace DAGs over span tables.

A span row has _timestamp, trace_id, span_id, reference_parent_span_id, service_name,
operation_name, span_kind, span_status, start_time and end_time (times in microseconds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stats() -> list:
    took = F.col("end_time") - F.col("start_time")
    failed = F.col("span_status") == "ERROR"
    return [
        F.count(F.lit(1)).alias("total_requests"),
        F.count(F.when(failed, 1)).alias("errors"),
        (F.count(F.when(failed, 1)) * 100.0 / F.count(F.lit(1))).alias("error_rate"),
        F.percentile(took, 0.5).alias("p50"),
        F.percentile(took, 0.95).alias("p95"),
        F.percentile(took, 0.99).alias("p99"),
    ]


def service_graph(spans: DataFrame, exclude_internal: bool = False) -> DataFrame:
    """Edges between services: each server span with its parent span's service as the client, if
    that is another service, or none for a root."""
    kinds, parents = (["2"], ["3"]) if exclude_internal else (["1", "2"], ["1", "3"])
    child = spans.where(F.col("span_kind").isin(kinds)).alias("c")
    parent = spans.where(F.col("span_kind").isin(parents)).select(F.col("trace_id").alias("p_trace"), F.col("span_id").alias("p_span"), F.col("service_name").alias("client")).alias("p")
    met = child.join(parent, (F.col("c.reference_parent_span_id") == F.col("p.p_span")) & (F.col("c.trace_id") == F.col("p.p_trace")), "left")
    met = met.where((F.col("client") != F.col("service_name")) | F.col("client").isNull())
    return met.groupBy("client", F.col("service_name").alias("server")).agg(*_stats())


def inferred_edges(spans: DataFrame) -> DataFrame:
    """Edges to services that send no spans: client and producer spans that name one, unless spans
    of that name exist. The names of instrumented services can't be null."""
    named = spans.where(F.col("span_kind").isin("3", "4") & F.col("infer_service_name").isNotNull() & (F.col("infer_service_name") != ""))
    known = spans.select(F.col("service_name").alias("infer_service_name")).where("infer_service_name IS NOT NULL").distinct()
    edges = named.join(known, "infer_service_name", "left_anti")
    return edges.groupBy(F.col("service_name").alias("client"), F.col("infer_service_name").alias("server")).agg(*_stats())


#: For each kind of dependency, the attributes that name its system and itself.
DEPENDENCIES = [
    ("database", ["db.system.name", "db.system"], ["db.namespace", "db.name"]),
    ("queue", ["messaging.system"], ["messaging.destination.name", "messaging.destination"]),
    ("rpc", ["rpc.system"], ["rpc.service"]),
]
#: Attributes that hold a host, a URL, or show a request over HTTP.
HOSTS, URLS = ["server.address", "net.peer.name", "http.host"], ["url.full", "http.url"]
HTTP = ["http.request.method", "http.method", *URLS]
#: Kinds of spans that wait for what they call.
CALLS = ["3", "4", "SPAN_KIND_CLIENT", "SPAN_KIND_PRODUCER"]
_BYTE = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_ADDRESS = rf"^({_BYTE}(\.{_BYTE}){{3}}|[0-9A-Fa-f]*:[0-9A-Fa-f]*:[0-9A-Fa-f:.]*)$"


def infer_services(spans: DataFrame) -> DataFrame:
    """Adds infer_service_name, _type and _system for client and producer spans. A name is
    peer.service, else what the kind of dependency calls itself, else a host, else the system.
    Attributes are columns by their names with dots or underscores; blank ones count as absent;
    hosts lose their ports, and addresses don't name a service."""

    def attribute(name: str):
        have = [F.col(f"`{n}`").cast("string") for n in dict.fromkeys([name, name.replace(".", "_")]) if n in spans.columns]
        return F.nullif(F.regexp_replace(F.coalesce(*have, F.lit(None).cast("string")), r"^\s+|\s+$", ""), F.lit(""))

    def first(names: list[str]):
        return F.coalesce(*map(attribute, names))

    def host(name: str):
        bare = F.regexp_replace(F.regexp_replace(attribute(name), r"^\[([^\]]*)\].*$", "$1"), r"^([^:]*):[0-9]+$", "$1")
        return F.when(~bare.rlike(_ADDRESS) & (bare != ""), bare)

    url = F.lower(F.try_parse_url(first(URLS), F.lit("HOST")))
    peer = F.coalesce(*map(host, HOSTS), F.when(~url.rlike(_ADDRESS) & ~url.startswith("["), url))
    calls, declared = F.col("span_kind").cast("string").isin(CALLS), attribute("peer.service")
    kind, name = F.lit("external"), F.coalesce(declared, peer)
    system = F.when(first(HTTP).isNotNull(), "http")
    for label, systems, own in reversed(DEPENDENCIES):
        there = first(systems).isNotNull() | first(own).isNotNull()
        kind = F.when(there, label).otherwise(kind)
        name = F.when(there, F.coalesce(declared, first(own), peer, first(systems))).otherwise(name)
        system = F.when(there, first(systems)).otherwise(system)
    found = calls & name.isNotNull()
    return spans.withColumns({"infer_service_name": F.when(found, name), "infer_service_type": F.when(found, kind), "infer_service_system": F.when(found, system)})


def trace_nodes(spans: DataFrame, trace_id: str, most: int = 10_000) -> DataFrame:
    """The spans of a trace, oldest first."""
    return spans.where(F.col("trace_id") == trace_id).orderBy("start_time", "span_id").limit(most).select("span_id", F.nullif("reference_parent_span_id", F.lit("")).alias("parent_span_id"), "service_name", "operation_name", "span_status", "start_time", "end_time")


def trace_edges(spans: DataFrame, trace_id: str, most: int = 10_000) -> DataFrame:
    """Parent and child of each span whose parent is in the trace as well."""
    nodes = trace_nodes(spans, trace_id, most)
    ids = nodes.select(F.col("span_id").alias("from"))
    return nodes.select(F.col("parent_span_id").alias("from"), F.col("span_id").alias("to")).join(ids, "from", "left_semi")


def trace_list(spans: DataFrame, stream: str) -> DataFrame:
    """Rows of the trace-list index."""
    return spans.groupBy("trace_id", "service_name").agg(F.min("_timestamp").alias("_timestamp")).select("_timestamp", F.lit(stream).alias("stream_name"), "service_name", "trace_id")


def latest_traces(spans: DataFrame, size: int = 25) -> DataFrame:
    """The newest traces with their span counts, duration, errors and services."""
    out = spans.groupBy("trace_id").agg(
        F.max("_timestamp").alias("_timestamp"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count(F.lit(1)).alias("spans"),
        F.count(F.when(F.col("span_status") == "ERROR", 1)).alias("errors"), F.array_sort(F.collect_set("service_name")).alias("services"),
        F.min(F.struct("start_time", "operation_name"))["operation_name"].alias("root_operation"),
    )
    return out.withColumn("duration", F.col("end_time") - F.col("start_time")).orderBy(F.desc("start_time"), "trace_id").limit(size)
