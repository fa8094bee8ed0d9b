import pytest

from lodestream.functions.patterns import interval_micros, java_pattern, re_matches

CASES = [
    ("str_match('abc', 'b')", True),
    ("str_match('abc', 'B')", False),
    ("str_match(CAST(NULL AS STRING), 'b')", None),
    ("str_match_ignore_case('ABC', 'bC')", True),
    ("str_match_ignore_case('É', 'É')", False),
    ("fuzzy_match('hello wrld', 'world', 1)", True),
    ("fuzzy_match('hello wrld', 'World', 1)", False),
    ("fuzzy_match('x', NULL, 1)", None),
    ("re_match('abc', '^b')", False),
    ("re_not_match('abc', '^b')", True),
    ("re_not_match(CAST(NULL AS STRING), '^b')", None),
    ("arrcount('[1,2]')", 2),
    ("arrcount('{\"a\":1}')", 0),
    ("arrcount('bad')", 0),
    ("arrcount(NULL)", 0),
    ("arrindex('[1,\"a\",{\"b\":2}]', 0, 1)", '[1,"a"]'),
    ("arrindex('[1,2,3]', 1, 9)", "[2,3]"),
    ("arrindex('[1]', 3, 4)", "[]"),
    ("arrjoin('[1,true,\"a\"]', ',')", "1,true,a"),
    ("arrjoin('[]', ',')", ""),
    ("arrjoin('{}', ',')", None),
    ("arrsort('[3,1,10]')", "[1,3,10]"),
    ("arrsort('[\"b\",\"a\"]')", '["a","b"]'),
    ("arrsort('[true,false]')", "[false,true]"),
    ("arrsort('[]')", None),
    ("arr_descending('[1.5,10,2]')", "[10,2,1.5]"),
    ("arrzip('[1,2,3]', '[\"a\",\"b\"]', '-')", '["1-a","2-b"]'),
    ("arrzip('[]', '[1]', '-')", None),
    ("spath('{\"a\":{\"b\":[1]}}', 'a.b')", "[1]"),
    ("spath('{\"a\":1}', 'x')", None),
    ("cast_to_arr('[\"a\",\"\",1]')", ["a", "1"]),
    ("cast_to_arr('[]')", None),
    ("to_array_string(array('a', NULL, 'b'))", '["a","b"]'),
    ("to_array_string(CAST(array() AS ARRAY<STRING>))", "[]"),
    ("string_to_array_v2('a.b-c', '.-')", ["a", "b", "c"]),
    ("string_to_array_v2('a]b^c', ']^')", ["a", "b", "c"]),
    ("string_to_array_v2('', ',')", [""]),
    ("string_to_array_v2('abc', NULL)", ["a", "b", "c"]),
    ("time_range(5, '0', '0')", True),
    ("time_range(1700000000000000, '2023-11-14T00:00:00Z', '2023-11-15T00:00:00Z')", True),
    ("time_range(1700006400000000, '0', '2023-11-15T00:00:00Z')", False),
    ("time_range(5, 'junk', '0')", None),
    ("ls_date_format(1700000000, 'yyyy-MM-dd HH:mm', '')", "2023-11-14 22:13"),
    ("ls_date_format(1700000000000000000, 'HH:mm', '+05:30')", "03:43"),
    ("cast_to_timestamp('2024-01-01T00:00:00Z')", 1704067200000000),
    ("json_get_json('{\"a\":{\"b\":1}}', 'a')", '{"b":1}'),
    ("ls_substr('apiserver', 0, 2)", "a"),
]


@pytest.mark.parametrize(("call", "want"), CASES)
def test_function(spark, call, want):
    assert spark.sql(f"SELECT {call} AS x").first().x == want


@pytest.mark.parametrize(("text", "pattern", "want"), [("a=1 b=2", r"(\w)=(\d)", ["1", "2"]), ("a=1", r"\w", None), ("zz", r"(\d)", None), ('k="v"', r'k=("[^"]*")', ["v"]), ("x y=2", r"(\w)(?:=(\d))?", ["x", "2"])])
def test_re_matches(spark, text, pattern, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.selectExpr(f"{re_matches('s', pattern)} AS x").first().x == want


def test_pushdown(spark, sf):
    """A text match reaches the Parquet scan as a filter."""
    spark.read.parquet(f"{sf}/events.parquet").createOrReplaceTempView("pushed")
    plan = spark.sql("SELECT event_id FROM pushed WHERE str_match(event_type, 'err')")._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(event_type,err)" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string>" in plan


def test_intervals():
    assert interval_micros("5 minutes") == 300_000_000
    assert interval_micros("1h") == 3_600_000_000
    assert java_pattern("%Y-%m-%dT%H:%M:%S%%") == "yyyy-MM-dd'T'HH:mm:ss%"
    for bad in ("", "soon", "5", "0 s"):
        with pytest.raises(ValueError):
            interval_micros(bad)
    with pytest.raises(ValueError):
        java_pattern("%Q")
