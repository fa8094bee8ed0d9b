"""Ingest adapters: each turns lines of a wire format into one row per record.

What they return has a stream, _timestamp in microseconds and the record as flat JSON text;
spread() makes columns of the latter. Rejected input comes with a reason, in rejected().
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import TIME

DEFAULT_STREAM = "default"


@F.pandas_udf(T.StringType())
def flatten_json(texts: pd.Series) -> pd.Series:
    """Nested objects as a_b keys; arrays as JSON text; what is no object stays null."""

    def one(text: str | None) -> str | None:
        try:
            value = json.loads(text) if text else None
        except ValueError:
            return None
        if not isinstance(value, dict):
            return None
        out: dict = {}
        todo = [("", value)]
        while todo:
            prefix, node = todo.pop()
            for k, v in node.items():
                name = f"{prefix}_{k}" if prefix else str(k)
                if isinstance(v, dict):
                    todo.append((name, v))
                else:
                    out[name] = json.dumps(v, separators=(",", ":")) if isinstance(v, list) else v
        return json.dumps(out, separators=(",", ":"), ensure_ascii=False)

    return texts.map(one)


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Struct columns as one column per leaf, named by their path; arrays stay as they are."""
    while any(t.startswith("struct") for _, t in df.dtypes):
        out = []
        for f in df.schema:
            if f.dataType.typeName() == "struct":
                out += [F.col(f"`{f.name}`")[x].alias(f"{f.name}{separator}{x}") for x in f.dataType.names]
            else:
                out.append(F.col(f"`{f.name}`"))
        df = df.select(*out)
    return df


def micros(value: Column) -> Column:
    """A time as seconds, ms, µs, ns or an ISO text, in microseconds; null if it is neither."""
    number = value.try_cast("decimal(38,9)")
    size = F.abs(number)
    scaled = F.when(size < 100_000_000_000, number * 1_000_000).when(size < 100_000_000_000_000, number * 1000).when(size < 100_000_000_000_000_000, number).otherwise(number / 1000)
    return F.coalesce(scaled.cast("long"), F.unix_micros(F.try_to_timestamp(value.cast("string"))))


def _records(df: DataFrame, stream: Column, record: Column, time: Column, now: Column | None = None) -> DataFrame:
    now = F.unix_micros(F.current_timestamp()) if now is None else now
    return df.select(stream.alias("stream"), F.coalesce(micros(time), now).alias(TIME), flatten_json(record).alias("record"))


def from_json_lines(lines: DataFrame, stream: str) -> DataFrame:
    """Lines (column value) that are a JSON object or an array of objects each."""
    is_array = F.ltrim("value").startswith("[")
    many = F.when(is_array, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    one = lines.select(F.explode(many).alias("j"))
    return _records(one, F.lit(stream), F.col("j"), F.coalesce(F.get_json_object("j", f"$.{TIME}"), F.get_json_object("j", "$.@timestamp"))).where("record IS NOT NULL")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their file and their order in it."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"))


def from_bulk(lines: DataFrame, order: str = "n") -> DataFrame:
    """Elasticsearch bulk: an action line, then its document. The lines carry their number, and their
    file (a request's body is one file), without which they count as one body."""
    from pyspark.sql import Window

    before = Window.orderBy(order) if "file" not in lines.columns else Window.partitionBy("file").orderBy(order)
    paired = lines.where(F.trim("value") != "").withColumn("action", F.lag("value").over(before))
    index = F.coalesce(F.get_json_object("action", "$.index._index"), F.get_json_object("action", "$.create._index"))
    docs = paired.where(index.isNotNull() & F.get_json_object("value", "$.index._index").isNull() & F.get_json_object("value", "$.create._index").isNull())
    return _records(docs, index, F.col("value"), F.coalesce(F.get_json_object("value", f"$.{TIME}"), F.get_json_object("value", "$.@timestamp")))


def _raw(json_col: str, path: str) -> Column:
    return F.expr(f"to_json(try_variant_get(try_parse_json({json_col}), '{path}', 'variant'))")


def from_hec(lines: DataFrame) -> DataFrame:
    """Splunk HEC: a text event becomes {"log": text}, an object is kept, fields are laid over it,
    time is the record's, and a missing index means the default stream."""
    # columns of their own, as they are used more than once
    df = lines.withColumn("event", F.expr("to_json(named_struct('x', try_variant_get(try_parse_json(value), '$.event', 'variant')))")).withColumn("fields", F.get_json_object("value", "$.fields"))
    text = F.get_json_object("value", "$.event")
    raw = F.expr("substr(event, 6, length(event) - 6)")
    base = F.when(raw.startswith('"'), F.to_json(F.struct(text.alias("log")))).when(raw.startswith("{"), raw)
    own = F.when(raw.startswith('"'), F.map_filter(F.create_map(F.lit("log"), text), lambda _, v: v.isNotNull())).when(raw.startswith("{"), F.from_json(raw, "map<string,string>"))
    merged = F.to_json(F.map_concat(own, F.coalesce(F.from_json("fields", "map<string,string>"), F.expr("cast(map() as map<string,string>)"))))
    with_fields = F.when(F.col("fields").isNotNull(), merged).otherwise(base)
    stream = F.coalesce(F.get_json_object("value", "$.index"), F.lit(DEFAULT_STREAM))
    return _records(df, stream, with_fields, F.get_json_object("value", "$.time"))


def from_loki(lines: DataFrame) -> DataFrame:
    """Loki push requests as JSON: labels and structured metadata become fields of every entry;
    times are nanoseconds; the stream's name comes from its labels."""
    schema = "streams array<struct<stream:map<string,string>,values:array<array<string>>>>"
    s = lines.select(F.explode(F.from_json("value", schema)["streams"]).alias("s")).where("size(s.stream) > 0 AND size(s.values) > 0")
    e = s.select(F.col("s.stream").alias("labels"), F.explode("s.values").alias("v")).where("v[1] <> '' AND try_cast(v[0] AS BIGINT) >= 0")
    name = F.coalesce(*[F.element_at("labels", k) for k in ("stream_name", "service_name", "job", "app")], F.lit(DEFAULT_STREAM))
    empty = F.expr("cast(map() as map<string,string>)")
    meta = F.coalesce(F.from_json(F.try_element_at("v", F.lit(3)), "map<string,string>"), empty)
    record = F.to_json(F.map_concat("labels", F.map_filter(meta, lambda k, _: ~F.map_contains_key("labels", k)), F.create_map(F.lit("log"), F.col("v")[1])))
    return e.select(name.alias("stream"), F.expr("cast(v[0] AS BIGINT) DIV 1000").alias(TIME), record.alias("record"))


def rejected_loki(lines: DataFrame) -> DataFrame:
    """Why entries of push requests are refused: reason and count."""
    schema = "streams array<struct<stream:map<string,string>,values:array<array<string>>>>"
    s = lines.select(F.explode(F.from_json("value", schema)["streams"]).alias("s"))
    e = s.select("s.stream", F.explode_outer("s.values").alias("v"))
    why = F.when(F.size("stream") <= 0, "empty labels").when(F.col("v").isNull(), "empty entries").when(F.col("v")[1] == "", "empty line").when(F.expr("try_cast(v[0] AS BIGINT) IS NULL OR try_cast(v[0] AS BIGINT) < 0"), "bad timestamp")
    return e.withColumn("reason", why).where("reason IS NOT NULL").groupBy("reason").count()


def from_metrics_json(lines: DataFrame) -> DataFrame:
    """Metric samples as JSON objects: __name__ is the stream, the rest labels, value and time. An
    object without a name or value is refused."""
    many = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    one = lines.select(F.explode(many).alias("j"))
    one = one.where(F.get_json_object("j", "$.__name__").isNotNull() & F.get_json_object("j", "$.value").isNotNull())
    out = one.select(F.get_json_object("j", "$.__name__").alias("stream"), F.coalesce(micros(F.get_json_object("j", f"$.{TIME}")), F.unix_micros(F.current_timestamp())).alias(TIME), F.get_json_object("j", "$.value").cast("double").alias("value"), F.from_json("j", "map<string,string>").alias("labels"))
    labels = F.map_filter("labels", lambda k, _: ~k.isin("value", TIME, "__type__"))
    return out.withColumn("labels", labels).withColumn("__hash__", F.xxhash64(F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")))


_ATTRIBUTES = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"


def _attributes(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    value = lambda a: F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string"))
    pairs = F.transform(c, lambda a: F.struct(F.regexp_replace(a["key"], r"[^A-Za-z0-9_]", "_").alias("key"), value(a).alias("value")))
    return F.coalesce(F.map_from_entries(pairs), F.expr("cast(map() as map<string,string>)"))


def from_otlp_traces(lines: DataFrame, oldest: int | None = None) -> DataFrame:
    """OTLP trace requests as JSON: one flat row per span, attributes as a map. Spans that ended
    before oldest (µs) are refused."""
    span = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},status:struct<code:string,message:string>>"
    schema = f"resourceSpans array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<{span}>>>>>"
    r = lines.select(F.explode(F.from_json("value", schema)["resourceSpans"]).alias("r")).select("r.resource.attributes", F.explode("r.scopeSpans").alias("s"))
    s = r.select(_attributes("attributes").alias("resource"), F.explode("s.spans").alias("x"))
    start, end = F.expr("cast(x.startTimeUnixNano AS BIGINT) DIV 1000"), F.expr("cast(x.endTimeUnixNano AS BIGINT) DIV 1000")
    kinds = {"SPAN_KIND_INTERNAL": "1", "SPAN_KIND_SERVER": "2", "SPAN_KIND_CLIENT": "3", "SPAN_KIND_PRODUCER": "4", "SPAN_KIND_CONSUMER": "5"}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("x.kind")), F.col("x.kind"), F.lit("0"))
    status = F.when(F.col("x.status.code").isin("2", "STATUS_CODE_ERROR"), "ERROR").when(F.col("x.status.code").isin("1", "STATUS_CODE_OK"), "OK").otherwise("UNSET")
    out = s.select(
        start.alias(TIME), F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"), F.coalesce("x.parentSpanId", F.lit("")).alias("reference_parent_span_id"),
        F.element_at("resource", "service_name").alias("service_name"), F.col("x.name").alias("operation_name"), kind.alias("span_kind"), status.alias("span_status"),
        start.alias("start_time"), end.alias("end_time"), F.map_concat(F.map_filter("resource", lambda k, _: k != "service_name"), F.map_filter(_attributes("x.attributes"), lambda k, _: ~F.map_contains_key("resource", k))).alias("attributes"),
    )
    return out if oldest is None else out.where(F.col("end_time") >= oldest)


def from_otlp_logs(lines: DataFrame, stream: str = DEFAULT_STREAM) -> DataFrame:
    record = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityText:string,body:struct<stringValue:string>,attributes:{_ATTRIBUTES},traceId:string,spanId:string>"
    schema = f"resourceLogs array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeLogs:array<struct<logRecords:array<{record}>>>>>"
    r = lines.select(F.explode(F.from_json("value", schema)["resourceLogs"]).alias("r")).select("r.resource.attributes", F.explode("r.scopeLogs").alias("s"))
    x = r.select(_attributes("attributes").alias("resource"), F.explode("s.logRecords").alias("x"))
    extra = F.map_filter(F.create_map(F.lit("body"), F.col("x.body.stringValue"), F.lit("severity"), F.col("x.severityText"), F.lit("trace_id"), F.col("x.traceId"), F.lit("span_id"), F.col("x.spanId")), lambda _, v: v.isNotNull())
    own = F.map_filter(_attributes("x.attributes"), lambda k, _: ~F.map_contains_key(extra, k))
    all_ = F.map_concat(F.map_filter("resource", lambda k, _: ~F.map_contains_key(extra, k) & ~F.map_contains_key(own, k)), own, extra)
    return x.select(F.lit(stream).alias("stream"), F.expr("cast(coalesce(nullif(x.timeUnixNano, '0'), x.observedTimeUnixNano) AS BIGINT) DIV 1000").alias(TIME), F.to_json(all_).alias("record"))


def from_otlp_metrics(lines: DataFrame) -> DataFrame:
    """Gauges and sums of OTLP metric requests: stream, time, value, labels."""
    point = f"struct<timeUnixNano:string,asDouble:double,asInt:string,attributes:{_ATTRIBUTES}>"
    metric = f"struct<name:string,gauge:struct<dataPoints:array<{point}>>,sum:struct<dataPoints:array<{point}>>>"
    schema = f"resourceMetrics array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeMetrics:array<struct<metrics:array<{metric}>>>>>"
    r = lines.select(F.explode(F.from_json("value", schema)["resourceMetrics"]).alias("r")).select("r.resource.attributes", F.explode("r.scopeMetrics").alias("s"))
    m = r.select(_attributes("attributes").alias("resource"), F.explode("s.metrics").alias("m"))
    p = m.select("resource", F.col("m.name").alias("stream"), F.explode(F.coalesce("m.gauge.dataPoints", "m.sum.dataPoints")).alias("p"))
    own = _attributes("p.attributes")
    labels = F.map_concat(F.map_filter("resource", lambda k, _: ~F.map_contains_key(own, k)), own)
    return p.select("stream", F.expr("cast(p.timeUnixNano AS BIGINT) DIV 1000").alias(TIME), F.coalesce("p.asDouble", F.col("p.asInt").cast("double")).alias("value"), labels.alias("labels"))


#: Attributes that name a model, its provider, token counts and a tool.
GENAI = {
    "llm_model": ["gen_ai_response_model", "gen_ai_request_model", "llm_model_name", "model"],
    "llm_provider": ["gen_ai_provider_name", "gen_ai_system", "llm_system"],
    "llm_input_tokens": ["gen_ai_usage_input_tokens", "gen_ai_usage_prompt_tokens", "llm_token_count_prompt"],
    "llm_output_tokens": ["gen_ai_usage_output_tokens", "gen_ai_usage_completion_tokens", "llm_token_count_completion"],
    "llm_tool": ["gen_ai_tool_name", "tool_name"],
}


def with_genai(spans: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Adds a model call's attributes to spans with an attributes map, and its cost where a price
    table (llm_model, input_price, output_price per million tokens) is given."""
    for name, keys in GENAI.items():
        found = F.coalesce(*[F.element_at("attributes", k) for k in keys])
        spans = spans.withColumn(name, found.try_cast("long") if name.endswith("tokens") else found)
    if prices is None:
        return spans
    cost = (F.coalesce("llm_input_tokens", F.lit(0)) * F.col("input_price") + F.coalesce("llm_output_tokens", F.lit(0)) * F.col("output_price")) / 1e6
    return spans.join(prices, "llm_model", "left").withColumn("llm_cost", cost).drop("input_price", "output_price")


def fields_of(records: DataFrame, column: str = "record") -> dict[str, str]:
    """The fields that occur in flat JSON texts and their types: bigint, double, boolean, or string
    where they are mixed. The result is as wide as the stream, not as long."""
    keys = records.select(F.explode(F.json_object_keys(column)).alias("k"), F.col(column).alias("j"))
    value = F.expr("to_json(named_struct('x', variant_get(try_parse_json(j), '$', 'map<string,variant>')[k]))")
    raw = F.regexp_replace(value, r'^\{"x":|\}$', "")
    kind = F.when(raw.isin("true", "false"), "boolean").when(raw.rlike(r"^-?\d{1,18}$"), "bigint").when(raw.rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), "double").when(raw.isin("null", "{}", ""), F.lit(None)).otherwise("string")
    rows = keys.groupBy("k").agg(F.collect_set(kind).alias("kinds")).orderBy("k").collect()
    return {r["k"]: r["kinds"][0] if len(r["kinds"]) == 1 else "double" if set(r["kinds"]) == {"bigint", "double"} else "string" for r in rows}


def spread(records: DataFrame, fields: dict[str, str] | None = None, column: str = "record", most: int = 2000) -> DataFrame:
    """Columns for the fields of flat JSON texts, in alphabetical order, _timestamp among them. Fields
    beyond the first ``most`` stay together, as texts in a map column named _more."""
    fields = fields_of(records, column) if fields is None else fields
    names = sorted(k for k in fields if k != TIME)
    values = F.from_json(column, "map<string,string>")
    out = records.withColumn("__values", values)
    cols = {k: F.element_at("__values", k).try_cast(fields[k]).alias(k) for k in names[:most]} | {TIME: F.col(TIME)}
    if rest := names[most:]:
        cols["_more"] = F.map_filter("__values", lambda k, _: k.isin(rest)).alias("_more")
    return out.select(*[cols[k] for k in sorted(cols)])


def split_streams(records: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    """The records of each stream. Stream names are few; records stay distributed."""
    for r in records.select("stream").distinct().orderBy("stream").collect():
        yield r["stream"], records.where(F.col("stream") == r["stream"]).drop("stream")
