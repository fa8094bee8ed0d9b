"""Every registered query against its oracle, value by value."""

import datetime
import decimal

import duckdb
import pytest

from lodestream import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, int | float | decimal.Decimal):
        return None if x != x else round(float(x), 5)
    return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(name, spark, duck, sf):
    df = Q.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in Q.ORACLES:
        return
    want = duck.execute(Q.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    a = sorted(([plain(v) for v in r] for r in want.fetchall()), key=repr)
    b = sorted(([plain(r[c]) for c in names] for r in rows), key=repr)
    assert a == b


def against_sql(name, spark, sf, tmp_path, events):
    """A query's rows and its SQL's, sorted, on other events (SQL values of ts, event_type, value, props)."""
    for t in TABLES.split():
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"{sf}/{t}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT row_number() OVER () - 1 AS event_id, CAST(ts AS TIMESTAMP) AS ts, 3::BIGINT AS user_id, event_type, CAST(value AS DOUBLE) AS value, CAST(props AS VARCHAR) AS props FROM (VALUES {events}) AS x(ts, event_type, value, props)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = con.execute(Q.ORACLES[name])
    names = [d[0] for d in want.description]
    got = Q.QUERIES[name](spark, str(tmp_path)).select(*names).collect()
    return sorted((tuple(map(plain, r)) for r in got), key=repr), sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_hec_events_of_one_time(spark, sf, tmp_path):
    props = ["'{\"k\": 1}'", "'{\"k\": 1}'", "'other'", "NULL", "''", "'null'", "'7'", "'[1]'", "'{'", "' \" \\ / é 語 😀 '", "chr(10) || chr(9) || chr(1) || chr(8232)"]
    events = [f"('2024-01-10 00:00:0{k}.000001', 'error', 1, {p})" for k in (1, 1, 2) for p in props]
    got, want = against_sql("ingest_hec", spark, sf, tmp_path, ", ".join(events))
    assert got == want and len(got) == 33


def test_sgn_of_zero(spark, sf, tmp_path):
    events = [f"('2024-01-10 0{k}:30:00', 'error', '{v}', NULL)" for k, v in enumerate(("0.0", "-0.0", "2.5", "-2.5"))]
    got, want = against_sql("prom_sgn", spark, sf, tmp_path, ", ".join(events))
    assert got == want and [r[-1] for r in got] == [0, 0, 1, -1]
