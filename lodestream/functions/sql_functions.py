"""The engine's scalar functions, as SQL functions that Catalyst inlines.

Each is an expression over built-in functions, so it takes part in constant folding, predicate
pushdown and code generation like anything written out by hand.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Token lengths that full-text functions see.
MIN_TOKEN, MAX_TOKEN = 2, 64
_ARRAY = "from_json(s, 'array<string>')"
#: The first character of a JSON array's first element tells the type that it is sorted by.
_FIRST = r"substr(ltrim(substr(ltrim(s), 2)), 1, 1)"
_NUMBER_ORDER = "(a, b) -> CASE WHEN try_cast(a AS DOUBLE) < try_cast(b AS DOUBLE) THEN -1 WHEN try_cast(a AS DOUBLE) > try_cast(b AS DOUBLE) THEN 1 ELSE 0 END"


def _sorted(descending: bool) -> str:
    turn = "reverse({})" if descending else "{}"
    text = turn.format(f"array_sort({_ARRAY})")
    number = turn.format(f"array_sort({_ARRAY}, {_NUMBER_ORDER})")
    return (
        f"CASE WHEN coalesce(size({_ARRAY}), 0) <= 0 THEN NULL WHEN {_FIRST} = '\"' THEN to_json({text}) "
        f"WHEN {_FIRST} IN ('t', 'f') THEN concat('[', array_join({text}, ','), ']') ELSE concat('[', array_join({number}, ','), ']') END"
    )


#: An epoch number in seconds, milliseconds, microseconds or nanoseconds, told apart by size.
_MICROS = "CASE WHEN abs(t) < 100000000000 THEN t * 1000000 WHEN abs(t) < 100000000000000 THEN t * 1000 WHEN abs(t) < 100000000000000000 THEN t ELSE t DIV 1000 END"
_BOUND = "CASE WHEN {0} = '' THEN 0 ELSE coalesce(try_cast({0} AS BIGINT), unix_micros(try_to_timestamp({0}))) END"

#: name: (parameters, type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "str_match": ("h STRING, n STRING", "BOOLEAN", "contains(h, n)"),
    "match_field": ("h STRING, n STRING", "BOOLEAN", "contains(h, n)"),
    # the needle is lowered over ASCII only, so an upper-case letter beyond it never matches
    "str_match_ignore_case": ("h STRING, n STRING", "BOOLEAN", f"contains(lower(h), translate(n, '{_UP}', '{_LOW}'))"),
    "match_field_ignore_case": ("h STRING, n STRING", "BOOLEAN", f"contains(lower(h), translate(n, '{_UP}', '{_LOW}'))"),
    "search_tokens": ("h STRING", "ARRAY<STRING>", rf"filter(split(lower(h), '[^\\p{{L}}\\p{{N}}_]+'), t -> length(t) BETWEEN {MIN_TOKEN} AND {MAX_TOKEN})"),
    "fuzzy_match": ("h STRING, n STRING, d INT", "BOOLEAN", rf"CASE WHEN h IS NULL OR n IS NULL OR d IS NULL THEN NULL ELSE exists(filter(split(lower(h), '[^\\p{{L}}\\p{{N}}_]+'), t -> length(t) BETWEEN {MIN_TOKEN} AND {MAX_TOKEN}), t -> levenshtein(t, n) <= d) END"),
    "re_match": ("h STRING, p STRING", "BOOLEAN", "h RLIKE p"),
    "re_not_match": ("h STRING, p STRING", "BOOLEAN", "NOT (h RLIKE p)"),
    "arrcount": ("s STRING", "BIGINT", "CAST(coalesce(json_array_length(s), 0) AS BIGINT)"),
    "arrindex": ("s STRING, a BIGINT, b BIGINT", "STRING", "CASE WHEN json_array_length(s) IS NULL THEN NULL WHEN a >= json_array_length(s) OR b < a THEN '[]' ELSE to_json(slice(from_json(s, 'array<variant>'), CAST(a + 1 AS INT), CAST(least(b, json_array_length(s) - 1) - a + 1 AS INT))) END"),
    "arrjoin": ("s STRING, d STRING", "STRING", f"array_join({_ARRAY}, d, 'null')"),
    "arrsort": ("s STRING", "STRING", _sorted(False)),
    "arr_descending": ("s STRING", "STRING", _sorted(True)),
    "arrzip": (
        "x STRING, y STRING, d STRING",
        "STRING",
        "CASE WHEN coalesce(json_array_length(x), 0) = 0 OR coalesce(json_array_length(y), 0) = 0 THEN NULL ELSE "
        "to_json(zip_with(slice(from_json(x, 'array<string>'), 1, least(json_array_length(x), json_array_length(y))), "
        "slice(from_json(y, 'array<string>'), 1, least(json_array_length(x), json_array_length(y))), (a, b) -> concat(coalesce(a, 'null'), d, coalesce(b, 'null')))) END",
    ),
    "spath": ("j STRING, p STRING", "STRING", "get_json_object(j, concat('$.', p))"),
    "cast_to_arr": ("s STRING", "ARRAY<STRING>", f"CASE WHEN coalesce(size({_ARRAY}), 0) <= 0 THEN NULL ELSE filter({_ARRAY}, x -> coalesce(x, 'null') <> '') END"),
    "to_array_string": ("a ARRAY<STRING>", "STRING", "to_json(filter(a, x -> x IS NOT NULL))"),
    "string_to_array_v2": ("s STRING, d STRING", "ARRAY<STRING>", r"CASE WHEN s = '' THEN array(s) WHEN d IS NULL THEN filter(split(s, ''), x -> x <> '') WHEN d = '' THEN array(s) ELSE filter(split(s, concat('[', regexp_replace(d, '([\\[\\]\\\\^&-])', '\\\\$1'), ']')), x -> x <> '') END"),
    "time_range": ("t BIGINT, a STRING, b STRING", "BOOLEAN", f"CASE WHEN {_BOUND.format('a')} IS NULL OR {_BOUND.format('b')} IS NULL THEN NULL ELSE ({_BOUND.format('a')} <= 0 OR t >= {_BOUND.format('a')}) AND ({_BOUND.format('b')} <= 0 OR t < {_BOUND.format('b')}) END"),
    "epoch_micros": ("t BIGINT", "BIGINT", _MICROS),
    # the planner turns date_format(t, strftime, zone) into this, with a Java pattern
    "ls_date_format": ("t BIGINT, f STRING, z STRING", "STRING", f"date_format(from_utc_timestamp(timestamp_micros({_MICROS}), CASE WHEN z = '' THEN 'UTC' ELSE z END), f)"),
    "cast_to_timestamp": ("x STRING", "BIGINT", "unix_micros(to_timestamp(x))"),
    # the planner turns histogram(t, interval) and date_bin(interval, t, origin) into this, in µs
    "ls_histogram": ("t BIGINT, w BIGINT", "TIMESTAMP", "timestamp_micros(t - pmod(t, w))"),
    "ls_date_bin": ("t BIGINT, w BIGINT, o BIGINT", "TIMESTAMP", "timestamp_micros(t - pmod(t - o, w))"),
    "json_get_str": ("j STRING, k STRING", "STRING", "get_json_object(j, concat('$.', k))"),
    "json_get_json": ("j STRING, k STRING", "STRING", "to_json(variant_get(try_parse_json(j), '$', 'map<string,variant>')[k])"),
    # Postgres counts from the start even where it lies before the text
    "ls_substr": ("s STRING, a INT, n INT", "STRING", "CASE WHEN a < 1 THEN substr(s, 1, greatest(n + a - 1, 0)) ELSE substr(s, a, n) END"),
}


def register(spark: SparkSession) -> None:
    known = {r.function for r in spark.sql("SHOW USER FUNCTIONS").collect()}
    for name, (parameters, kind, body) in FUNCTIONS.items():
        if name not in {k.rpartition(".")[2] for k in known}:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
