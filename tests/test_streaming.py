import pytest
from pyspark.sql import functions as F

from lodestream.api import Engine
from lodestream.catalog import Catalog
from lodestream.streaming import pipelines as S

US = 1_000_000
SCHEMA = "_timestamp long, host string, value double"


@pytest.fixture
def source(spark, tmp_path):
    def put(n, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    put(0, [(i * 60 * US, f"h{i % 2}", float(i)) for i in range(20)])
    return lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_tumbling_matches_batch(spark, source, tmp_path):
    got = {tuple(r) for r in run(S.tumbling(source(), "5 minutes", ["host"], "1 minute"), "tumbling", "complete").collect()}
    want = {tuple(r) for r in S.tumbling(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in")), "5 minutes", ["host"]).collect()}
    assert got == want and len(got) == 8


def test_sliding_and_sessions(spark, source, tmp_path):
    batch = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert S.sliding(batch, "10 minutes", "5 minutes", ["host"]).agg(F.sum("n")).first()[0] == 40
    assert S.sessions(batch, "90 seconds", ["host"]).count() == 20
    assert S.sessions(batch, "3 minutes", ["host"]).count() == 2
    assert run(S.sessions(source(), "3 minutes", ["host"], "1 minute"), "sess").count() <= 2


def test_unique(spark, source):
    assert run(S.unique_events(source(), ["host"], "1 hour"), "uniq").count() == 2


def _pipeline(**kw):
    nodes = [S.Node("in", "stream", "src"), S.Node("hot", "condition", "value >= 10"), S.Node("twice", "function", lambda df: df.withColumn("value", F.col("value") * 2)), S.Node("out", "stream", "big"), S.Node("all", "stream", "copy")]
    return S.Pipeline("p", nodes, [("in", "hot"), ("hot", "twice"), ("twice", "out"), ("in", "all")], **kw)


def test_pipeline(spark, source, tmp_path):
    seen = {}

    def sink(name, df, number):
        seen.setdefault(name, []).extend(df.collect())

    _pipeline().start(source(), sink, str(tmp_path / "cp"), once=True).awaitTermination()
    assert len(seen["copy"]) == 20 and sorted(r.value for r in seen["big"]) == [2.0 * i for i in range(10, 20)]
    _pipeline().start(source(), sink, str(tmp_path / "cp"), once=True).awaitTermination()
    assert len(seen["copy"]) == 20  # what was read once is not read again


def test_pipeline_rules():
    _pipeline().validate()
    with pytest.raises(ValueError, match="realtime"):
        S.check_realtime([_pipeline(), _pipeline()])
    S.check_realtime([_pipeline(), _pipeline(realtime=False)])
    n = [S.Node("a", "stream"), S.Node("f", "function"), S.Node("g", "function")]
    for nodes, edges in ((n, [("a", "f"), ("f", "g"), ("g", "f")]), (n[:2], [("a", "f")]), (n[:1], [("a", "x")]), ([n[0], n[0]], []), ([S.Node("a", "stream"), S.Node("b", "stream")], []), ([S.Node("a", "odd")], [])):
        with pytest.raises(ValueError):
            S.Pipeline("p", nodes, edges).validate()


def test_derived_stream():
    calls, out = [], []
    at = S.derived_stream(lambda a, b: (a, b), lambda x: out.append(x), 0, 35, 10)
    assert at == 30 and out == [(0, 10), (10, 20), (20, 30)] and not calls


def test_partitions():
    assert S.partitions(0, 100, 40) == [(60, 100), (20, 60), (0, 20)]
    assert S.partitions(0, 100, 40, descending=False) == [(0, 40), (40, 80), (80, 100)]
    assert S.partitions(3, 100, 25, interval=10) == [(70, 100), (40, 70), (10, 40), (3, 10)]
    assert S.partitions(0, 100, 40, mini=5) == [(95, 100), (55, 95), (15, 55), (0, 15)]
    assert S.partitions(0, 100, 40, whole=True) == [(0, 100)] and S.partitions(5, 5, 1) == []
    for parts in (S.partitions(7, 1003, 97, interval=20, mini=30), S.partitions(7, 1003, 97, descending=False, interval=20, mini=30)):
        flat = sorted(parts)
        assert flat[0][0] == 7 and flat[-1][1] == 1003 and all(a[1] == b[0] for a, b in zip(flat, flat[1:], strict=False))


def test_best_cached():
    assert S.best_cached([(0, 10), (5, 30), (28, 40), (90, 95)], 0, 50) == [(5, 30)]
    assert S.best_cached([(0, 10), (12, 30)], 0, 50) == [(0, 10), (12, 30)]


@pytest.fixture(scope="module")
def engine(spark):
    c = Catalog(spark)
    c.register("logs", spark.createDataFrame([(i * US, f"h{i % 3}", None if i % 2 else i) for i in range(30)], "_timestamp long, host string, n long"))
    return Engine(c, default_limit=10)


def test_search_response(engine):
    got = engine.search("SELECT host, n FROM logs")
    assert len(got["hits"]) == 10 and got["more"] and "n" not in got["hits"][0] and got["hits"][1]["n"] == 28
    assert engine.search("SELECT host FROM logs", size=3)["total"] == 3
    assert [len(x["hits"]) for x in engine.search_multi(["SELECT host FROM logs", "SELECT n FROM logs LIMIT 2"])] == [10, 2]


def test_search_stream(engine):
    parts = list(engine.search_stream("SELECT host FROM logs", 0, 30 * US, step=10 * US))
    assert [p for _, p in parts] == [33, 67, 100] and sum(len(r) for r, _ in parts) == 30
    assert sum(len(r) for r, _ in engine.search_stream("SELECT host FROM logs", 0, 30 * US, step=10 * US, size=12)) == 12
    assert len(engine.plan_partitions("SELECT host, count(*) FROM logs GROUP BY host", 0, 30 * US, 10 * US)) == 1


def test_values_around_patterns(engine):
    assert [(r.zo_sql_key, r.zo_sql_num) for r in engine.values("logs", ["host"], 2)["host"].collect()] == [("h0", 10), ("h1", 10)]
    assert [r["_timestamp"] // US for r in engine.around("logs", 10 * US, 4).collect()] == [12, 11, 10, 9]
    assert engine.patterns("logs", "host").first().pattern == "h<num>"
    assert "Physical Plan" in engine.explain("SELECT host FROM logs")


def test_functions(engine, spark):
    engine.register_function("shout", lambda s: s.upper() + "!")
    assert spark.sql("SELECT shout('a') AS x").first().x == "A!"
    assert spark.sql("SELECT shout(CAST(NULL AS STRING)) AS x").first().x == ""
    engine.register_function("mask", lambda r: r | {"host": "x"}, "row")
    engine.register_function("firsts", lambda rows: rows[:2], "result")
    assert {h["host"] for h in engine.search("SELECT host FROM logs", query_fn="mask")["hits"]} == {"x"}
    assert len(engine.search("SELECT host FROM logs", query_fn="firsts")["hits"]) == 2


def test_shapes(engine, spark):
    df = spark.createDataFrame([(2, "a", 1.0), (1, "a", 2.0), (1, "b", 3.0)], "_timestamp long, host string, value double")
    got = {r.host: [(p.t, p.v) for p in r["values"]] for r in engine.metrics_response(df).collect()}
    assert got == {"a": [(1, "2.0"), (2, "1.0")], "b": [(1, "3.0")]}
    assert engine.table_response(spark.createDataFrame([(1, "x")], "a long, b string")) == [[1, "x"]]
