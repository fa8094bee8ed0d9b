import math

import pytest
from pyspark.sql import functions as F

from lodestream.catalog import Catalog
from lodestream.promql import engine as PQ
from lodestream.promql.parser import PromqlError, parse

S = 1_000_000


@pytest.fixture(scope="module")
def cat(spark):
    c = Catalog(spark)
    counter = [(i * 60 * S, "a", float(i * 60 if i < 5 else (i - 5) * 60)) for i in range(10)]
    gauge = [(i * 60 * S, h, float(i * k)) for i in range(10) for h, k in (("x", 1), ("y", 2))]
    c.register("hits", spark.createDataFrame(counter, "_timestamp long, job string, value double"), "metrics")
    c.register("temp", spark.createDataFrame(gauge, "_timestamp long, host string, value double"), "metrics")
    bucket = [(600 * S, le, n) for le, n in (("0.1", 10.0), ("0.5", 30.0), ("1", 40.0), ("+Inf", 40.0))]
    c.register("lat_bucket", spark.createDataFrame(bucket, "_timestamp long, le string, value double"), "metrics")
    odd = [(600 * S, "n", float("nan")), (600 * S, "i", float("inf")), (600 * S, "z", 0.0), (600 * S, "m", -1.5)]
    c.register("odd", spark.createDataFrame(odd, "_timestamp long, k string, value double"), "metrics")
    return c


def at(cat, text, t=540, **options):
    rows = PQ.query(cat, text, t * S, **options).collect()
    return {tuple(sorted((k, v) for k, v in r.labels.items())): r.v for r in rows}


def one(cat, text, t=540, **options):
    (v,) = at(cat, text, t, **options).values()
    return v


def test_selectors(cat):
    assert at(cat, "temp") == {(("__name__", "temp"), ("host", "x")): 9.0, (("__name__", "temp"), ("host", "y")): 18.0}
    assert len(at(cat, 'temp{host!="x"}')) == 1
    assert len(at(cat, '{__name__="temp",host=~"x|y"}')) == 2
    assert one(cat, 'temp{host="x"} offset 2m') == 7.0
    assert one(cat, 'temp{host="x"} @ 120') == 2.0
    assert one(cat, 'sum_over_time(temp{host="x"}[2m] @ 240)') == 9.0
    assert PQ.query_range(cat, 'sum_over_time(temp{host="x"}[2m] @ end())', 0, 540 * S, 60 * S).select("v").distinct().collect()[0].v == 24.0
    assert at(cat, "temp", 10_000) == {}
    assert len(at(cat, 'temp{missing="x"}')) == 2  # a matcher on no column is skipped


def test_rate_and_increase(cat):
    # 4 steps of 60, a reset to 0, 4 steps of 60; 9 samples of gaps of 60 s, over 540 s
    assert one(cat, "increase(hits[9m])") == pytest.approx(480 * (540 / 540))
    assert one(cat, "rate(hits[9m])") == pytest.approx(480 / 540)
    assert one(cat, "resets(hits[9m])") == 1
    assert one(cat, "changes(hits[9m])") == 9
    assert one(cat, "irate(hits[9m])") == pytest.approx(1.0)
    assert one(cat, "idelta(hits[9m])") == 60
    assert one(cat, 'delta(temp{host="y"}[9m])') == pytest.approx(18.0)
    assert at(cat, "rate(hits[30s])") == {}


def test_over_time(cat):
    assert one(cat, 'avg_over_time(temp{host="x"}[2m])') == 8.0
    assert one(cat, 'sum_over_time(temp{host="x"}[2m])') == 24.0  # both ends count
    assert one(cat, 'count_over_time(temp{host="x"}[2m])') == 3
    assert one(cat, 'stddev_over_time(temp{host="x"}[2m])') == pytest.approx(math.sqrt(2 / 3))
    assert one(cat, 'quantile_over_time(0.5, temp{host="x"}[3m])') == 7.5
    assert one(cat, 'quantile_over_time(2, temp{host="x"}[3m])') == math.inf
    assert at(cat, 'last_over_time(temp{host="x"}[2m])') == {(("__name__", "temp"), ("host", "x")): 9.0}
    assert one(cat, 'deriv(temp{host="y"}[5m])') == pytest.approx(2 / 60)
    assert one(cat, 'predict_linear(temp{host="y"}[5m], 60)') == pytest.approx(20.0)
    assert one(cat, 'holt_winters(temp{host="x"}[5m], 0.5, 0.5)') == pytest.approx(9.0)
    assert one(cat, 'max_over_time(temp{host="x"}[5m:1m])') == 9.0
    assert at(cat, "absent_over_time(temp[2m])") == {}
    assert at(cat, 'absent_over_time(temp{host="q"}[2m])', strict=True) == {(): 1.0}


def test_instant_functions(cat):
    assert at(cat, 'absent(temp{host="q"})') == {(): 1.0}
    assert at(cat, "absent(temp)") == {}
    got = at(cat, "sgn(odd)", 600)
    assert got[(("k", "z"),)] == 1.0 and got[(("k", "m"),)] == -1.0 and math.isnan(got[(("k", "n"),)])
    logs = at(cat, "ln(odd)", 600)
    assert logs[(("k", "z"),)] == -math.inf and math.isnan(logs[(("k", "m"),)])
    assert at(cat, "round(odd)", 600)[(("k", "m"),)] == -2.0
    assert at(cat, "clamp(odd, -1, 1)", 600)[(("k", "i"),)] == 1.0
    assert at(cat, "clamp(odd, 1, -1)", 600) == {}
    assert one(cat, "vector(time())") == 540
    assert one(cat, "hour(vector(7200))") == 2
    assert one(cat, "day_of_week(vector(0))") == 4  # 1970-01-01 was a Thursday
    assert one(cat, "days_in_month(vector(86400 * 31))") == 28
    with pytest.raises(PromqlError):
        at(cat, "nothing_like_it(temp)")


def test_strict_sgn(cat):
    got = at(cat, "sgn(odd)", 600, strict=True)
    assert got[(("k", "z"),)] == 0.0 and got[(("k", "m"),)] == -1.0 and got[(("k", "i"),)] == 1.0 and math.isnan(got[(("k", "n"),)])


def test_histogram_quantile(cat):
    assert one(cat, "histogram_quantile(0.5, lat_bucket)", 600) == pytest.approx(0.1 + 0.4 * (20 - 10) / 20)
    assert one(cat, "histogram_quantile(0.1, lat_bucket)", 600) == pytest.approx(0.04)
    assert one(cat, "histogram_quantile(1.5, lat_bucket)", 600) == math.inf
    assert at(cat, 'histogram_quantile(0.5, lat_bucket{le!="+Inf"})', 600) == {}


def test_histogram_fraction(cat):
    assert one(cat, "histogram_fraction(0, 0.5, lat_bucket)", 600) == pytest.approx(0.75)
    assert one(cat, "histogram_fraction(0.3, 1, lat_bucket)", 600) == pytest.approx(0.5)
    assert one(cat, "histogram_fraction(2, 1, lat_bucket)", 600) == 0


def test_aggregations(cat):
    assert at(cat, "sum(temp)") == {(): 27.0}
    assert at(cat, "max by (host) (temp)")[(("host", "y"),)] == 18.0
    assert at(cat, "sum without (host) (temp)") == {(): 27.0}
    assert at(cat, "topk(1, temp)") == {(("__name__", "temp"), ("host", "y")): 18.0}
    assert at(cat, "bottomk(1, temp)") == {(("__name__", "temp"), ("host", "x")): 9.0}
    assert at(cat, "topk(0, temp)") == {}
    assert at(cat, 'count_values("v", temp)') == {(("v", "9"),): 1.0, (("v", "18"),): 1.0}
    assert one(cat, "quantile(0.5, temp)") == 13.5
    assert one(cat, "max(odd)", 600) == math.inf and one(cat, "min(odd)", 600) == -1.5
    assert one(cat, 'max(odd{k="n"})', 600) == -math.inf
    assert one(cat, "group(temp)") == 1.0
    assert one(cat, "stddev(temp)") == 4.5


def test_binary(cat):
    assert one(cat, "vector(7 % 4 + 2 ^ 3 * 2 - 6 / 4)") == 3 + 16 - 1.5
    assert one(cat, "vector(-7 % 4)") == -3
    assert one(cat, "vector(1 / 0)") == math.inf
    assert math.isnan(one(cat, "vector(0 / 0)"))
    assert one(cat, "vector(2 > bool 1)") == 1
    with pytest.raises(PromqlError):
        at(cat, "vector(2 > 1)")
    assert len(at(cat, "temp > 10")) == 1
    assert sorted(at(cat, "temp > bool 10").values()) == [0.0, 1.0]
    assert one(cat, 'temp{host="x"} / ignoring (host) temp{host="y"}') == 0.5
    assert sorted(at(cat, "temp / on () group_left () sum(temp)").values()) == pytest.approx([9 / 27, 18 / 27])
    assert len(at(cat, 'temp unless temp{host="x"}')) == 1
    assert len(at(cat, 'temp{host="x"} or temp')) == 2
    assert len(at(cat, 'temp and on (host) temp{host="x"}')) == 1


def test_labels(cat):
    assert (("host", "x"), ("new", "x!")) == next(iter(at(cat, 'label_replace(temp{host="x"} * 1, "new", "$1!", "host", "(.*)")', strict=True)))
    assert (("both", "x"), ("host", "x")) == next(iter(at(cat, 'label_join(temp{host="x"} * 1, "both", "-", "host", "__name__")')))
    assert len(next(iter(at(cat, 'label_replace(temp{host="x"} * 1, "host", "", "host", ".*")')))) == 0
    with pytest.raises(PromqlError):
        at(cat, 'label_replace(temp, "9bad", "", "host", "")')


def test_ranges_and_limits(cat):
    df = PQ.query_range(cat, 'temp{host="x"}', 0, 540 * S, 60 * S)
    assert [r.v for r in df.orderBy("t").collect()] == [float(i) for i in range(10)]
    with pytest.raises(PromqlError):
        PQ.query_range(cat, "temp", 0, 10**12, S)
    with pytest.raises(PromqlError):
        PQ.query_range(cat, "temp[5m]", 0, S, S)
    assert PQ.query(cat, 'temp{host="x"}[3m]', 540 * S).count() == 4
    assert PQ.round_step(0.4) == S and PQ.round_step(14.6) == 15 * S


def test_metadata(cat):
    assert [r.value for r in PQ.label_values(cat, "host", "temp", 0, 10**10).collect()] == ["x", "y"]
    assert PQ.series(cat, ["temp"], 0, 10**10).count() == 2


@pytest.mark.parametrize(("text", "want"), [
    ("sum  by(a)(rate(x{b='c'}[5m]))", 'sum by (a) (rate(x{b="c"}[5m]))'), ("a+b*c", "a + b * c"), ("(a+b)*c", "(a + b) * c"), ("x offset 90m", "x offset 1h30m"),
    ("topk(3,x)", "topk(3, x)"), ("-x ^ 2", "-x ^ 2"), ("a / on(x) group_left(y) b", "a / on (x) group_left (y) b"), ("x[1h:5m]", "x[1h:5m]"),
])
def test_format(text, want):
    assert PQ.format_query(text) == want
    assert PQ.format_query(want) == want


@pytest.mark.parametrize("bad", ["", "sum(", "x{a}", "x[5]", "{}", "topk(x)", "1 +", "x{a=b}", "a + bool b"])
def test_parse_errors(bad):
    with pytest.raises(PromqlError):
        parse(bad)


def test_exemplars(spark, cat):
    cat.register("req", spark.createDataFrame([(S, "a", 1.0, ["e1"]), (2 * S, "a", 1.0, ["e2"])], "_timestamp long, job string, value double, exemplars array<string>"), "metrics")
    (r,) = PQ.exemplars(cat, "sum(rate(req[5m]))", 0, 3 * S).collect()
    assert sorted(r.exemplars) == ["e1", "e2"] and r.labels["job"] == "a"


def test_one_shuffle_per_selector(cat):
    df = PQ.query_range(cat, "sum_over_time(temp[5m])", 0, 540 * S, 60 * S)
    assert df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") == 1
    assert df.select(F.col("labels")["host"]).count() == 20
