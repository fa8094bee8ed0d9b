"""From a search request to the SQL that Spark runs, and what the request implies.

The dialect that comes in is Postgres-like; rewrites work on tokens, so that whatever they don't
know stays as written. The order is: dashboard placeholders and custom values, aliases of
full-text calls, analysis, added columns, function spellings, streams bounded by the time range,
order and limit.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..catalog import TIME, Catalog
from ..functions.patterns import interval_micros, java_pattern, quoted, re_matches
from .tokens import KEYWORDS, Token, close, done, render, rewrite_calls, split, tokens

#: Caps on limit and offset, and the probe that a default limit is raised by.
MAX_LIMIT, MAX_OFFSET, PROBE = 100_000, 100_000, 5
#: What a dashboard puts for a variable without a value, and after a custom one.
PLACEHOLDER, CUSTOM = "_o2_all_", "::_o2_custom"
#: The aggregates by which a query counts as complex.
AGGREGATES = {
    "min", "max", "avg", "sum", "count", "median", "array_agg", "percentile_cont", "summary_percentile", "first_value", "last_value",
    "approx_distinct", "approx_median", "approx_percentile_cont", "approx_percentile_cont_with_weight", "approx_topk", "approx_topk_distinct",
}
#: Seconds of time range up to which histogram() without an interval takes so many seconds.
LADDER = [(900, 10), (1800, 15), (3600, 30), (21_600, 60), (86_400, 1800), (604_800, 3600), (2_592_000, 86_400)]
_TEXT_SEARCH = {"match_all", "fuzzy_match_all", "match_all_hash"}
_CLAUSES = {"WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "QUALIFY", "WINDOW"}
_AFTER_TABLE = _CLAUSES | KEYWORDS | {"LEFT", "RIGHT", "FULL", "INNER", "CROSS", "OUTER", "SEMI", "ANTI", "NATURAL", "LATERAL", "TABLESAMPLE"}
_EXPLAIN = re.compile(r"\s*EXPLAIN\s+(?P<analyze>ANALYZE\s+)?", re.I)


@dataclass
class Request:
    sql: str
    start: int = 0
    end: int = 0
    frm: int = 0
    size: int = 0
    stream_type: str = "logs"
    track_total_hits: bool = False
    quick_mode: bool = False
    histogram_interval: int = 0
    sampling_ratio: float | None = None
    extra_filter: str | None = None


@dataclass
class Plan:
    sql: str
    streams: list[str]
    complex: bool
    limit: int | None
    offset: int
    ordered: bool
    #: rows to show of those fetched (a default limit fetches a few more, to see if there are any)
    shown: int | None
    equal: dict[str, list[str]] = field(default_factory=dict)
    where: str | None = None
    interval: int | None = None


def _find(parts: list[Token], word: str, start: int = 0) -> int:
    """The first place of a keyword outside of all parentheses, or -1."""
    depth = 0
    for k in range(start, len(parts)):
        t = parts[k]
        if t.kind == "op":
            depth += (t.text in "([") - (t.text in ")]")
        if depth == 0 and t.word == word:
            return k
    return -1


def is_complex(parts: list[Token]) -> bool:
    """Joins, subqueries, grouping, DISTINCT, HAVING, set operations, CTEs, aggregates, windows."""
    words = [t.word for t in parts]
    if words.count("SELECT") > 1 or set(words) & {"GROUP", "JOIN", "HAVING", "UNION", "INTERSECT", "EXCEPT", "WITH", "OVER", "WITHIN"}:
        return True
    if len(words) > 1 and words[1] == "DISTINCT":
        return True
    if any(t.kind in ("name", "quoted") and t.value.lower() in AGGREGATES and k + 1 < len(parts) and parts[k + 1].text == "(" for k, t in enumerate(parts)):
        return True
    at = _find(parts, "FROM")
    if at < 0:
        return False
    table = parts[at + 1 : next((k for k in range(at + 1, len(parts)) if parts[k].word in _CLAUSES), len(parts))]
    return len(split(table)) > 1


def remove_placeholders(parts: list[Token], placeholder: str = PLACEHOLDER) -> list[Token]:
    """A comparison with the placeholder holds for every row, a negated one for none."""
    out = list(parts)
    k = 0
    while k < len(out):
        t = out[k]
        if t.kind == "string" and t.value in (placeholder, f"%{placeholder}%") and k >= 2:
            end, op = k + 1, k - 1
            negated = False
            if out[op].text == "," or out[op].text == "(":  # in a list or a call
                start = k
                while out[start].text != "(":
                    start -= 1
                end = close(out, start) + 1
                before = out[start - 1]
                if before.word == "IN":
                    op = start - 1
                elif before.kind == "name" and before.value.lower().startswith(("str_match", "match_field")):
                    out[start - 1 : end] = done("TRUE")
                    k = start
                    continue
                else:
                    k += 1
                    continue
            word = out[op].word
            if word not in ("=", ">=", "<=", ">", "<", "<>", "!=", "LIKE", "ILIKE", "IN"):
                k += 1
                continue
            left = op - 1
            if out[left].word == "NOT":
                negated, left = True, left - 1
            negated = negated or word in ("<>", "!=")
            if out[left].text == ")":  # a call on the left
                depth = 0
                while True:
                    depth += (out[left].text == ")") - (out[left].text == "(")
                    if depth == 0:
                        break
                    left -= 1
                if out[left - 1].kind == "name" and out[left - 1].word not in KEYWORDS:
                    left -= 1
            while left >= 2 and out[left - 1].text == ".":
                left -= 2
            out[left:end] = done("FALSE" if negated else "TRUE")
            k = left
        k += 1
    return out


def custom_values(parts: list[Token]) -> list[Token]:
    """field = 'v::custom' and field IN ('v::custom') search for v in the field."""
    out: list[Token] = []
    k = 0
    while k < len(parts):
        t, nxt = parts[k], parts[k + 1 : k + 5]
        if t.word in KEYWORDS:
            out.append(t)
            k += 1
            continue
        if t.kind in ("name", "quoted") and len(nxt) > 1 and nxt[0].text == "=" and nxt[1].kind == "string" and nxt[1].value.endswith(CUSTOM):
            value, used = nxt[1].value, 3
        elif t.kind in ("name", "quoted") and len(nxt) > 3 and nxt[0].word == "IN" and nxt[1].text == "(" and nxt[2].kind == "string" and nxt[3].text == ")" and nxt[2].value.endswith(CUSTOM):
            value, used = nxt[2].value, 5
        else:
            out.append(t)
            k += 1
            continue
        out += [Token("name", "str_match"), Token("op", "("), t, Token("op", ","), Token("string", "'" + value.removesuffix(CUSTOM).replace("'", "''") + "'"), Token("op", ")")]
        k += used
    return out


def total_hits(parts: list[Token]) -> list[Token]:
    """What counts the rows of a query: its projection becomes a count and what only orders or
    groups goes; a DISTINCT query is counted from outside."""
    count = [Token("name", "SELECT"), *done("count(*) AS zo_sql_num"), Token("name", "FROM")]
    start = next((k for k, t in enumerate(parts) if t.word == "SELECT"), 0)
    if parts[start + 1].word == "DISTINCT" or parts[0].word == "WITH" or {"UNION", "INTERSECT", "EXCEPT"} & {t.word for t in parts}:
        return [*count, Token("op", "("), *parts, Token("op", ")")]
    at = _find(parts, "FROM")
    end = min([k for w in ("GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET") if (k := _find(parts, w, at)) > 0], default=len(parts))
    return [*count, *parts[at + 1 : end]]


def equal_items(parts: list[Token]) -> dict[str, list[str]]:
    """Columns held equal to literals by conjunctions of the WHERE clause: col = lit, lit = col,
    col IN (lits). They can prune partitions."""
    at = _find(parts, "WHERE")
    if at < 0:
        return {}
    end = min([k for w in _CLAUSES - {"WHERE"} if (k := _find(parts, w, at)) > 0], default=len(parts))
    found: dict[str, list[str]] = {}

    def visit(cond: list[Token]) -> None:
        while len(cond) > 1 and cond[0].text == "(" and close(cond, 0) == len(cond) - 1:
            cond = cond[1:-1]
        if len(split(cond, "OR")) > 1:
            return
        terms = split(cond, "AND")
        if len(terms) > 1:
            for x in terms:
                visit(x)
            return
        name = [t for t in cond if t.kind in ("name", "quoted")]
        literal = [t.value for t in cond if t.kind in ("string", "number")]
        if len(cond) >= 3 and literal and cond[-1].kind in ("string", "number") and cond[-2].text == "=" and cond[-3].kind in ("name", "quoted") and len(cond) in (3, 5):
            found.setdefault(cond[-3].value, []).append(cond[-1].value)
        elif len(cond) in (3, 5) and cond[0].kind in ("string", "number") and cond[1].text == "=" and cond[-1].kind in ("name", "quoted"):
            found.setdefault(cond[-1].value, []).append(cond[0].value)
        elif len(name) >= 2 and len(cond) > 3 and cond[-1].text == ")":
            k = next((i for i, t in enumerate(cond) if t.word == "IN"), -1)
            if k > 0 and cond[k - 1].word != "NOT" and all(len(x) == 1 and x[0].kind in ("string", "number") for x in split(cond[k + 2 : -1])):
                found.setdefault(cond[k - 1].value, []).extend(literal)

    visit(parts[at + 1 : end])
    return found


def _lit(arg: list[Token]) -> str | None:
    return arg[0].value if len(arg) == 1 and arg[0].kind == "string" else None


def _call(name: str, *args: list[Token]) -> list[Token]:
    out = [Token("name", name), Token("op", "(")]
    for i, a in enumerate(args):
        out += [Token("op", ",")] * bool(i) + a
    return [*out, Token("op", ")")]


def _ordered(first: bool, args: list[list[Token]]) -> list[Token] | None:
    """first_value(x ORDER BY t) and last_value take the value at the least or greatest t."""
    if len(args) != 1 or (at := _find(args[0], "ORDER")) < 0:
        return None
    x, key = args[0][:at], args[0][at + 2 :]
    words = [t.word for t in key]
    least = first != ("DESC" in words)
    key = [t for t in key if t.word not in ("ASC", "DESC", "NULLS", "FIRST", "LAST")]
    return _call("min_by" if least else "max_by", x, key)


def _array_agg(args: list[list[Token]]) -> list[Token] | None:
    if len(args) != 1 or (at := _find(args[0], "ORDER")) < 0:
        return None
    x, key = render(args[0][:at]), args[0][at + 2 :]
    up = "false" if any(t.word == "DESC" for t in key) else "true"
    by = render([t for t in key if t.word not in ("ASC", "DESC", "NULLS", "FIRST", "LAST")])
    return done(f"transform(sort_array(collect_list(struct({by} AS a, {x} AS b)), {up}), x -> x.b)")


def _extract(args: list[list[Token]]) -> list[Token] | None:
    part = args[0]
    if len(part) > 2 and part[1].word == "FROM" and part[0].word == "EPOCH":
        return done(f"(unix_micros(CAST({render(part[2:])} AS TIMESTAMP)) / 1000000)")
    return None


def _date_part(args: list[list[Token]]) -> list[Token] | None:
    name = (_lit(args[0]) or "").lower()
    if name == "dow":
        return done(f"(dayofweek({render(args[1])}) - 1)")
    if name == "epoch":
        return done(f"(unix_micros(CAST({render(args[1])} AS TIMESTAMP)) / 1000000)")
    return None


def _interval(arg: list[Token]) -> int:
    text = next((t.value for t in arg if t.kind == "string"), None)
    if text is None:
        text = " ".join(t.text for t in arg if t.word != "INTERVAL")
    return interval_micros(text)


class Planner:
    def __init__(self, catalog: Catalog, default_limit: int = 1000, placeholder: str = PLACEHOLDER, quick_fields: int = 500, id_column: str | None = None):
        self.catalog = catalog
        self.default_limit, self.placeholder = default_limit, placeholder
        self.quick_fields, self.id_column = quick_fields, id_column

    # -- functions ---------------------------------------------------------------------------

    def _rules(self, fts: list[str], interval: int | None):
        def search(args: list[list[Token]]) -> list[Token]:
            if not fts:
                raise ValueError("match_all needs a stream with a full-text field")
            text = _lit(args[0])
            if text is None:
                raise ValueError("match_all takes a literal")
            return done("(" + " OR ".join(f"str_match_ignore_case(`{f}`, {quoted(text.rstrip('*'))})" for f in fts) + ")")

        def fuzzy(args: list[list[Token]]) -> list[Token]:
            if not fts:
                raise ValueError("fuzzy_match_all needs a stream with a full-text field")
            far = render(args[1]) if len(args) > 1 else "1"
            return done("(" + " OR ".join(f"fuzzy_match(`{f}`, {render(args[0])}, {far})" for f in fts) + ")")

        def histogram(args: list[list[Token]]) -> list[Token]:
            wide = _interval(args[1]) if len(args) > 1 else interval
            if not wide:
                raise ValueError("histogram() without an interval needs a time range")
            return _call("ls_histogram", args[0], done(str(wide)))

        def date_bin(args: list[list[Token]]) -> list[Token]:
            of = render(args[1])
            origin = f"unix_micros(CAST({render(args[2])} AS TIMESTAMP))" if len(args) > 2 else "0"
            return done(f"ls_date_bin(unix_micros(CAST({of} AS TIMESTAMP)), {_interval(args[0])}, {origin})")

        def date_format(args: list[list[Token]]) -> list[Token] | None:
            if len(args) != 3:
                return None
            return _call("ls_date_format", args[0], done(quoted(java_pattern(_lit(args[1]) or ""))), args[2])

        def matches(args: list[list[Token]]) -> list[Token]:
            return done(re_matches(render(args[0]), _lit(args[1]) or ""))

        def regexp_match(args: list[list[Token]]) -> list[Token]:
            found = re_matches(render(args[0]), _lit(args[1]) or "")
            if found.startswith("CAST(NULL"):
                found = f"CASE WHEN {render(args[0])} RLIKE {quoted(_lit(args[1]) or '')} THEN array(regexp_extract({render(args[0])}, {quoted(_lit(args[1]) or '')}, 0)) END"
            return done(found)

        def strip(name: str):
            return lambda args: done(f"{name}({render(args[1])}, {render(args[0])})") if len(args) == 2 else None

        rename = lambda name: lambda args: _call(name, *args)
        element = lambda args: done(f"try_element_at({render(args[0])}, {render(args[1])})")
        rules = {
            "match_all": search, "match_all_hash": search, "fuzzy_match_all": fuzzy, "histogram": histogram, "date_bin": date_bin,
            "time_bucket": lambda a: date_bin(a) if len(a) > 1 else None, "date_format": date_format, "re_matches": matches, "regexp_match": regexp_match,
            "array_element": element, "array_extract": element, "concat": lambda a: _call("concat_ws", done("''"), *a),
            "rtrim": strip("rtrim"), "ltrim": strip("ltrim"), "btrim": rename("trim"), "extract": _extract, "date_part": _date_part,
            "to_timestamp_micros": rename("timestamp_micros"), "to_unixtime": rename("unix_timestamp"), "flatten": lambda a: a[0], "unnest": rename("explode"),
            "range": lambda a: done("sequence({}, {} - 1)".format(*([render(x) for x in a] if len(a) > 1 else ["0", render(a[0])]))),
            "substr": lambda a: _call("ls_substr", *a) if len(a) == 3 else None,
            "approx_distinct": rename("approx_count_distinct"), "approx_median": lambda a: _call("approx_percentile", a[0], done("0.5")),
            "approx_percentile_cont": rename("approx_percentile"), "approx_percentile_cont_with_weight": lambda a: _call("percentile", a[0], a[2], a[1]),
            "summary_percentile": lambda a: _call("percentile", a[0], a[-1], a[1]) if len(a) == 3 else _call("percentile", *a),
            "approx_topk": rename("approx_top_k"), "first_value": lambda a: _ordered(True, a), "last_value": lambda a: _ordered(False, a), "array_agg": _array_agg,
            "string_agg": rename("listagg"), "strpos": rename("instr"), "starts_with": rename("startswith"), "ends_with": rename("endswith"),
        }
        return rules

    @staticmethod
    def _spellings(parts: list[Token]) -> list[Token]:
        """array[...] literals, text types, and the place of nulls in an order."""
        out: list[Token] = []
        k = 0
        while k < len(parts):
            t = parts[k]
            if t.word == "ARRAY" and k + 1 < len(parts) and parts[k + 1].text == "[":
                end = close(parts, k + 1)
                out += [Token("name", "array"), Token("op", "("), *Planner._spellings(parts[k + 2 : end]), Token("op", ")")]
                k = end + 1
            elif t.word in ("TEXT", "VARCHAR") and out and out[-1].word in ("AS", "::") and not (k + 1 < len(parts) and parts[k + 1].text == "("):
                out.append(Token("name", "STRING"))
                k += 1
            elif t.word == "ORDER" and k + 1 < len(parts) and parts[k + 1].word == "BY" and not (out and out[-1].text == "(" and len(out) > 1 and out[-2].word == "GROUP"):
                depth, end = 0, k + 2
                while end < len(parts):
                    depth += (parts[end].text in "([") - (parts[end].text in ")]") if parts[end].kind == "op" else 0
                    if depth < 0 or depth == 0 and parts[end].word in _CLAUSES | {"ROWS", "RANGE", "FETCH"}:
                        break
                    end += 1
                out += parts[k : k + 2]
                for i, item in enumerate(split(parts[k + 2 : end])):
                    out += [Token("op", ",")] * bool(i) + Planner._spellings(item)
                    if not any(x.word == "NULLS" for x in item):
                        out += [Token("name", "NULLS"), Token("name", "LAST")]
                k = end
            else:
                out.append(t)
                k += 1
        return out

    # -- streams -----------------------------------------------------------------------------

    def _tables(self, parts: list[Token], stream_type: str) -> list[tuple[int, int, str, str]]:
        """(start, end, type, name) of each stream read, by its place; names of CTEs are none."""
        ctes = self._ctes(parts) if parts[0].word == "WITH" else set()
        found = []
        k = 0
        while k < len(parts):
            if parts[k].word in ("FROM", "JOIN") and k + 1 < len(parts) and not self._in_call(parts, k):
                at = k + 1
                while at < len(parts) and parts[at].kind in ("name", "quoted", "string") and parts[at].word not in KEYWORDS:
                    end, kind, name = at + 1, stream_type, parts[at].value
                    if end + 1 < len(parts) and parts[end].text == ".":
                        kind, name, end = ("enrichment_tables" if name == "enrich" else name), parts[end + 1].value, end + 2
                    if name.lower() not in ctes:
                        found.append((at, end, kind, name))
                    at = end
                    while at < len(parts) and (parts[at].kind in ("name", "quoted") and parts[at].word not in _AFTER_TABLE or parts[at].word == "AS"):
                        at += 1
                    if parts[k].word == "FROM" and at < len(parts) and parts[at].text == ",":
                        at += 1
                    else:
                        break
            k += 1
        return found

    @staticmethod
    def _ctes(parts: list[Token]) -> set[str]:
        """Lower-case names before AS (, with or without a list of columns in between."""
        out = set()
        for k in range(1, len(parts) - 1):
            if parts[k].word == "AS" and parts[k + 1].text == "(":
                at = k - 1
                if parts[at].text == ")":
                    while at > 0 and parts[at].text != "(":
                        at -= 1
                    at -= 1
                out.add(parts[at].value.lower())
        return out

    @staticmethod
    def _in_call(parts: list[Token], at: int) -> bool:
        """Is this FROM the one of EXTRACT(x FROM y), TRIM(x FROM y) or the like?"""
        depth = 0
        for k in range(at - 1, -1, -1):
            depth += (parts[k].text == ")") - (parts[k].text == "(") if parts[k].kind == "op" else 0
            if depth < 0:
                return parts[k + 1].word not in ("SELECT", "WITH") and not any(t.word == "SELECT" for t in parts[k + 1 : at])
        return False

    # -- planning ----------------------------------------------------------------------------

    def interval(self, request: Request) -> int | None:
        """The histogram interval in microseconds: as asked, or by the length of the range."""
        if request.histogram_interval:
            return request.histogram_interval * 1_000_000
        if not (request.start and request.end):
            return None
        seconds = (request.end - request.start) / 1e6
        return next((wide for most, wide in LADDER if seconds <= most), 86_400) * 1_000_000

    def plan(self, request: Request) -> Plan:
        parts = [t for t in tokens(_EXPLAIN.sub("", request.sql, count=1)) if t.text != ";"]
        parts = custom_values(remove_placeholders(parts, self.placeholder))
        for t in parts:
            if t.kind == "name" and t.value.lower() in ("match_all_raw", "match_all_raw_ignore_case"):
                t.text = "match_all"
        if request.track_total_hits:
            parts = total_hits(parts)
        if request.extra_filter and not is_complex(parts):
            parts = self._add_filter(parts, tokens(request.extra_filter))
        hard = is_complex(parts)
        tables = self._tables(parts, request.stream_type)
        streams = [self.catalog.get(name, kind) for _, _, kind, name in tables]
        if any(t.kind == "name" and t.value.lower() in _TEXT_SEARCH for t in parts) and (len(tables) > 1 or sum(t.word == "SELECT" for t in parts) > 1):
            raise ValueError("match_all can't be used with subqueries, joins and CTEs")
        fts = streams[0].fts if len(streams) == 1 else []
        equal = equal_items(parts)
        where = self.where_text(parts) if not hard else None
        has_limit, has_order = _find(parts, "LIMIT") >= 0, _find(parts, "ORDER") >= 0
        own_limit = int(parts[_find(parts, "LIMIT") + 1].text) if has_limit and parts[_find(parts, "LIMIT") + 1].kind == "number" else None
        if own_limit is not None and own_limit > MAX_LIMIT:
            parts[_find(parts, "LIMIT") + 1] = Token("number", str(MAX_LIMIT))
        if not hard and not request.track_total_hits:
            parts = self._add_columns(parts, streams, request.quick_mode)
            tables = self._tables(parts, request.stream_type)
        parts = self._bound(parts, tables, request)
        interval = self.interval(request)
        parts = rewrite_calls(self._spellings(self._generators(parts)), self._rules(fts, interval))
        sql = render(parts)
        ordered = not hard and not has_order and len(streams) == 1 and TIME in streams[0].columns and not request.track_total_hits
        if ordered:
            at = _find(parts, "LIMIT")
            at = len(parts) if at < 0 else at
            sql = render([*parts[:at], *done(f"ORDER BY {TIME} DESC NULLS LAST"), *parts[at:]])
        limit, shown = None, None
        if request.size > 0 and not has_limit:
            limit = shown = min(request.size, MAX_LIMIT)
        elif request.size == 0 and not has_limit and not request.track_total_hits:
            limit, shown = self.default_limit + PROBE, self.default_limit
        elif request.size > 0:
            shown = min(request.size, MAX_LIMIT, own_limit if own_limit is not None else MAX_LIMIT)
        return Plan(sql, [s.name for s in streams], hard, limit, min(request.frm, MAX_OFFSET), ordered or has_order, shown, equal, where, interval)

    def where_text(self, parts: list[Token]) -> str | None:
        """The WHERE clause of a query over one table, as text."""
        at = _find(parts, "WHERE")
        if at < 0 or is_complex(parts):
            return None
        end = min([k for w in _CLAUSES - {"WHERE"} if (k := _find(parts, w, at)) > 0], default=len(parts))
        return render(parts[at + 1 : end])

    @staticmethod
    def _add_filter(parts: list[Token], extra: list[Token]) -> list[Token]:
        at = _find(parts, "WHERE")
        end = min([k for w in _CLAUSES - {"WHERE"} if (k := _find(parts, w, max(at, 0))) > 0], default=len(parts))
        left, right = Token("op", "("), Token("op", ")")
        if at < 0:
            return [*parts[:end], Token("name", "WHERE"), left, *extra, right, *parts[end:]]
        return [*parts[: at + 1], left, *parts[at + 1 : end], right, Token("name", "AND"), left, *extra, right, *parts[end:]]

    def _add_columns(self, parts: list[Token], streams: list, quick: bool) -> list[Token]:
        at = _find(parts, "FROM")
        if at < 0 or not streams or TIME not in streams[0].columns:
            return parts
        chosen = split(parts[1:at])
        names = {(c[-1].value if len(c) < 4 or c[-2].word == "AS" else "") for c in chosen}
        if any(c[-1].text == "*" for c in chosen):
            if quick and len(streams[0].columns) > self.quick_fields:
                fields = [TIME, *[c for c in streams[0].columns if c != TIME]][: self.quick_fields]
                return [parts[0], *done(", ".join(f"`{c}`" for c in fields)), *parts[at:]]
            return parts
        extra = [TIME] if TIME not in names else []
        if self.id_column and self.id_column in streams[0].columns and self.id_column not in names:
            extra.append(self.id_column)
        return [parts[0], *done("".join(f"`{c}`, " for c in extra).rstrip(", ") + ("," if extra else "")), *parts[1:]] if extra else parts

    def _bound(self, parts: list[Token], tables: list[tuple[int, int, str, str]], request: Request) -> list[Token]:
        out = list(parts)
        for at, end, kind, name in reversed(tables):
            stream = self.catalog.get(name, kind)
            named = end < len(out) and (out[end].word == "AS" or out[end].kind in ("name", "quoted") and out[end].word not in _AFTER_TABLE)
            source = f"`{stream.view}`"
            bounds = [f"{TIME} {op} {b}" for op, b in ((">=", request.start), ("<", request.end)) if b and TIME in stream.columns]
            if bounds or stream.view != name:
                source = f"(SELECT * FROM {source}{' WHERE ' + ' AND '.join(bounds) if bounds else ''})" + ("" if named else f" AS `{name}`")
            out[at:end] = done(source)
        return out

    @staticmethod
    def _generators(parts: list[Token]) -> list[Token]:
        """unnest() in a SELECT that also groups is unrolled in a subquery first: the expression
        becomes a column that its alias, and the same expression elsewhere, refer to."""
        at, grouped = _find(parts, "FROM"), _find(parts, "GROUP")
        if at < 0 or grouped < 0 or not any(t.value.lower() == "unnest" for t in parts[:at] if t.kind == "name"):
            return parts
        found: dict[str, str] = {}

        def take(args: list[list[Token]]) -> list[Token]:
            inner = args[0]
            while inner[0].value.lower() == "flatten" and close(inner, 1) == len(inner) - 1:
                inner = inner[2:-1]
            # a SQL function can't stand in a generator, so this one is written out
            written_out = inner[0].value.lower() == "cast_to_arr" and close(inner, 1) == len(inner) - 1
            key = f"from_json({render(inner[2:-1])}, 'array<string>')" if written_out else render(inner)
            found.setdefault(key, f"__each_{len(found)}")
            return [Token("name", found[key])]

        chosen = rewrite_calls(parts[:at], {"unnest": take})
        views = " ".join(f"LATERAL VIEW explode({key}) AS {name}" for key, name in found.items())
        end = min([k for w in _CLAUSES if (k := _find(parts, w, at)) > 0], default=len(parts))
        return [*chosen, *parts[at:end], *done(views), *parts[end:]]


def search(spark: SparkSession, planner: Planner, request: Request) -> DataFrame:
    """The rows of a request. A default limit's probe rows are left in; see Plan.shown. EXPLAIN gives
    one row with the plan; EXPLAIN ANALYZE runs the query first, so that it is the final plan."""
    if asked := _EXPLAIN.match(request.sql):
        df = search(spark, planner, replace(request, sql=request.sql[asked.end() :]))
        if asked["analyze"]:
            df._jdf.queryExecution().toRdd().count()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        return spark.createDataFrame([(df._jdf.queryExecution().explainString(mode),)], "plan string")
    plan = planner.plan(request)
    df = spark.sql(plan.sql)
    if request.sampling_ratio is not None:
        df = df.sample(request.sampling_ratio, seed=42)
    if plan.offset:
        df = df.offset(plan.offset)
    return df.limit(plan.limit) if plan.limit is not None else df


def sql(spark: SparkSession, catalog: Catalog, text: str, **request) -> DataFrame:
    """A query without implied limit."""
    return search(spark, Planner(catalog), Request(text, **({"size": -1} | request)))
