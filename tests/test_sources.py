import json

import pytest
from pyspark.sql import functions as F

from lodestream.catalog import Catalog, conform, time_range, union_versions
from lodestream.operators import traces as TR
from lodestream.queries import INFERRED
from lodestream.sources import ingest as I
from lodestream.sources import storage as ST

US = 1_000_000


def lines(spark, *values):
    return spark.createDataFrame([(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "n long, value string")


def rows(df):
    return [(r["stream"], r["_timestamp"], json.loads(r["record"])) for r in df.orderBy("_timestamp").collect()]


def test_json(spark):
    got = rows(I.from_json_lines(lines(spark, {"a": {"b": 1, "c": [1, 2]}, "_timestamp": 5 * 10**15}, [{"x": "y", "_timestamp": 6 * 10**15}], "junk"), "s"))
    assert got == [("s", 5 * 10**15, {"a_b": 1, "a_c": "[1,2]", "_timestamp": 5 * 10**15}), ("s", 6 * 10**15, {"x": "y", "_timestamp": 6 * 10**15})]


def test_bulk(spark):
    df = lines(spark, {"index": {"_index": "a"}}, {"m": 1, "_timestamp": 1700000000}, {"create": {"_index": "b"}}, {"m": 2, "@timestamp": "2023-11-14T22:13:21Z"}, "")
    assert [(s, t, r["m"]) for s, t, r in rows(I.from_bulk(df))] == [("a", 1700000000 * US, 1), ("b", 1700000001 * US, 2)]


def test_bulk_files(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.ndjson").write_text('{"index":{"_index":"%s"}}\n{"m":1,"_timestamp":1700000000}\n' % name)
    assert {s for s, _, _ in rows(I.from_bulk(I.read_lines(spark, str(tmp_path))))} == {"a", "b"}


def test_hec(spark):
    df = lines(spark, {"event": "hi", "time": 1700000000.5}, {"event": {"a": 1}, "index": "web", "time": 1700000001, "fields": {"z": "q"}}, {"event": 7, "time": 1700000002})
    got = rows(I.from_hec(df).where("record IS NOT NULL"))
    assert got[0] == ("default", 1700000000 * US + 500000, {"log": "hi"})
    assert got[1][0] == "web" and got[1][2] == {"a": "1", "z": "q"}
    assert len(got) == 2 and I.from_hec(df).count() == 3  # a number is no event


def test_loki(spark):
    good = {"streams": [{"stream": {"job": "api", "pod": "p1"}, "values": [["1700000000000000000", "hello", {"trace": "t"}], ["1700000001000000000", ""]]}, {"stream": {}, "values": [["1", "x"]]}, {"stream": {"a": "b"}, "values": []}]}
    (r,) = I.from_loki(lines(spark, good)).collect()
    assert (r["stream"], r["_timestamp"], json.loads(r["record"])) == ("api", 1700000000 * US, {"job": "api", "pod": "p1", "trace": "t", "log": "hello"})
    assert {x["reason"]: x["count"] for x in I.rejected_loki(lines(spark, good)).collect()} == {"empty line": 1, "empty labels": 1, "empty entries": 1}


def test_metrics(spark):
    got = I.from_metrics_json(lines(spark, [{"__name__": "cpu", "__type__": "gauge", "host": "h", "_timestamp": 1700000000, "value": 1.5}, {}])).collect()
    assert [(r["stream"], r["_timestamp"], r["value"], r["labels"]) for r in got] == [("cpu", 1700000000 * US, 1.5, {"__name__": "cpu", "host": "h"})]


def _attr(**kv):
    return [{"key": k, "value": {"intValue" if isinstance(v, int) else "stringValue": str(v)}} for k, v in kv.items()]


def test_otlp(spark):
    span = {"traceId": "t", "spanId": "1", "name": "GET", "kind": "SPAN_KIND_CLIENT", "startTimeUnixNano": "2000000000", "endTimeUnixNano": "3000000000", "status": {"code": "STATUS_CODE_ERROR"}, "attributes": [{"key": "gen_ai.request.model", "value": {"stringValue": "m"}}, {"key": "gen_ai.usage.input_tokens", "value": {"intValue": "10"}}]}
    req = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "web"}}]}, "scopeSpans": [{"spans": [span]}]}]}
    df = I.from_otlp_traces(lines(spark, req))
    r = df.first()
    assert (r.service_name, r.span_kind, r.span_status, r.start_time, r.end_time) == ("web", "3", "ERROR", 2 * US, 3 * US)
    assert I.from_otlp_traces(lines(spark, req), oldest=4 * US).count() == 0
    priced = I.with_genai(df, spark.createDataFrame([("m", 2.0, 4.0)], "llm_model string, input_price double, output_price double")).first()
    assert (priced.llm_model, priced.llm_input_tokens, priced.llm_cost) == ("m", 10, pytest.approx(20 / 1e6))
    logs = {"resourceLogs": [{"resource": {"attributes": _attr(host="h")}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "5000", "body": {"stringValue": "b"}, "severityText": "INFO", "attributes": _attr(k=1)}]}]}]}
    got = I.from_otlp_logs(lines(spark, logs)).first()
    assert got["_timestamp"] == 5 and json.loads(got["record"]) == {"host": "h", "k": "1", "body": "b", "severity": "INFO"}
    metrics = {"resourceMetrics": [{"resource": {"attributes": []}, "scopeMetrics": [{"metrics": [{"name": "g", "gauge": {"dataPoints": [{"timeUnixNano": "1000", "asInt": "4", "attributes": _attr(a="b")}]}}]}]}]}
    got = I.from_otlp_metrics(lines(spark, metrics)).first()
    assert (got["stream"], got["_timestamp"], got["value"], got["labels"]) == ("g", 1, 4.0, {"a": "b"})


def test_spread(spark):
    records = spark.createDataFrame([(1, '{"a":1,"b":true,"c":1}'), (2, '{"a":2,"c":"x","d":1.5}')], "_timestamp long, record string")
    df = I.spread(records)
    assert df.dtypes == [("_timestamp", "bigint"), ("a", "bigint"), ("b", "boolean"), ("c", "string"), ("d", "double")]
    assert [tuple(r) for r in df.orderBy("_timestamp").collect()] == [(1, 1, True, "1", None), (2, 2, None, "x", 1.5)]


def test_flatten_structs(spark):
    df = I.flatten(spark.sql("SELECT named_struct('b', 1, 'c', named_struct('d', 'x')) AS a, 2 AS e"))
    assert df.columns == ["a_b", "a_c_d", "e"]


def test_schema_versions(spark):
    old = spark.createDataFrame([(1, "a", "7")], "_timestamp long, f string, n string")
    new = spark.createDataFrame([(2, "b", 8, True)], "_timestamp long, f string, n long, g boolean")
    out = union_versions([old, new])
    assert out.columns == ["_timestamp", "f", "g", "n"] and dict(out.dtypes)["n"] == "bigint"
    assert [tuple(r) for r in out.orderBy("_timestamp").collect()] == [(1, "a", None, 7), (2, "b", True, 8)]
    assert conform(spark.createDataFrame([("x",)], "n string"), new.schema).first().n is None


def test_storage(spark, tmp_path):
    path, day = str(tmp_path / "s"), 86_400 * US
    ST.write(spark.range(48).select((F.col("id") * 3600 * US).alias("_timestamp"), F.col("id").alias("n"), F.lit("k").alias("host")), path, keys=["host"], bloom=["n"])
    ST.write(spark.createDataFrame([(2 * day, 99, "k", "new")], "_timestamp long, n long, host string, extra string"), path, keys=["host"])
    df = ST.read(spark, path, day, 2 * day)
    assert df.count() == 24 and "extra" in df.columns
    assert "PartitionFilters: [isnotnull(p_date" in df._jdf.queryExecution().executedPlan().toString()
    ST.compact(spark, path, str(tmp_path / "c"), "1970-01-02")
    merged = spark.read.parquet(str(tmp_path / "c"))
    assert merged.count() == 24 and len(merged.inputFiles()) == 1 and merged.first()["_timestamp"] == 47 * 3600 * US
    assert ST.retain(spark, path, "1970-01-02") == ["p_date=1970-01-01"] and ST.read(spark, path).count() == 25
    assert time_range(df, 0, 0).count() == 24


def test_token_index(spark):
    df = spark.createDataFrame([(1, "Error in disk"), (2, "all fine")], "id long, m string")
    index = ST.token_index(df, "m", ["id"])
    assert [r.id for r in ST.search_index(df, index, "ERROR", ["id"]).collect()] == [1]


def test_geo(spark):
    ranges = spark.createDataFrame([(10 * 256**3, 10 * 256**3 + 70000, "lan"), (20 * 256**3, 20 * 256**3 + 5, "x")], "first long, last long, city string")
    df = spark.createDataFrame([("10.0.1.1",), ("10.1.0.5",), ("20.0.0.9",), ("bad",), (None,)], "ip string")
    assert {r.ip: r.city for r in ST.geo_lookup(df, ranges, "ip").collect()} == {"10.0.1.1": "lan", "10.1.0.5": "lan", "20.0.0.9": None, "bad": None, None: None}


def test_inferred_services(spark):
    """With dots in the names, and without the columns that no row has."""
    for kind, attributes, want in INFERRED:
        row = {"span_kind": kind} | {"`" + k.replace("_", ".") + "`": v for k, v in attributes.items()}
        spans = spark.range(1).select(*[F.lit(v).cast("string").alias(k.strip("`")) for k, v in row.items()])
        assert tuple(TR.infer_services(spans).first())[len(row) :] == want, attributes


def test_spread_keeps_fields_beyond_the_bound(spark):
    records = spark.createDataFrame([(1, '{"a": 1, "b": "x", "c": true}'), (2, '{"c": false, "d": 4}')], "_timestamp long, record string")
    rows = I.spread(records, most=2).orderBy("_timestamp").collect()
    assert [(r.a, r.b, r._more) for r in rows] == [(1, "x", {"c": "true"}), (None, None, {"c": "false", "d": "4"})]


def test_catalog(spark):
    c = Catalog(spark)
    c.register("zz", spark.createDataFrame([(1, 2)], "b long, a long"))
    assert c.df("zz").columns == ["a", "b"]
    with pytest.raises(LookupError):
        c.df("none")
    with pytest.raises(ValueError):
        c.register("q", spark.range(1), "nope")
