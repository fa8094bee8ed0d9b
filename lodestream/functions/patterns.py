"""Expressions that depend on a literal pattern, built while planning."""

from __future__ import annotations

import re

#: Strftime codes and their Java patterns.
STRFTIME = {
    "a": "EEE", "A": "EEEE", "b": "MMM", "B": "MMMM", "d": "dd", "e": "d", "F": "yyyy-MM-dd", "f": "SSSSSS", "H": "HH", "I": "hh", "j": "DDD",
    "m": "MM", "M": "mm", "p": "a", "R": "HH:mm", "s": None, "S": "ss", "T": "HH:mm:ss", "y": "yy", "Y": "yyyy", "z": "xx", "Z": "VV", "3f": "SSS", "6f": "SSSSSS",
}


def java_pattern(strftime: str) -> str:
    """The Java pattern of a strftime format; a code without one is an error."""
    out, i = [], 0
    while i < len(strftime):
        c = strftime[i]
        if c == "%":
            code = next((k for k in (strftime[i + 1 : i + 3], strftime[i + 1 : i + 2]) if k in STRFTIME or k == "%"), None)
            if code is None or code != "%" and STRFTIME[code] is None:
                raise ValueError(f"no pattern for %{strftime[i + 1 : i + 2]}")
            out.append("%" if code == "%" else STRFTIME[code])
            i += 1 + len(code)
        else:
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
            i += 1
    return "".join(out)


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def re_matches(column: str, pattern: str) -> str:
    """SQL for all matches as a list: of each match, the last group that took part from the second
    on, else the first, without one pair of double quotes around; NULL if there is none."""
    groups = re.compile(re.sub(r"\(\?<(?![=!])", "(?P<", pattern)).groups
    if groups == 0:
        return "CAST(NULL AS ARRAY<STRING>)"
    each = [f"regexp_extract_all({column}, {quoted(pattern)}, {g})" for g in range(1, groups + 1)]
    found = each[0]
    for later in each[1:]:
        found = f"zip_with({later}, {found}, (a, b) -> coalesce(nullif(a, ''), b))"
    bare = f"transform({found}, x -> CASE WHEN length(x) > 1 AND startswith(x, '\"') AND endswith(x, '\"') THEN substr(x, 2, length(x) - 2) ELSE x END)"
    return f"CASE WHEN size({found}) > 0 THEN {bare} END"


_UNITS = {"us": 1, "microsecond": 1, "ms": 1000, "millisecond": 1000, "s": 10**6, "second": 10**6, "sec": 10**6, "m": 60 * 10**6, "minute": 60 * 10**6, "min": 60 * 10**6, "h": 3600 * 10**6, "hour": 3600 * 10**6, "hr": 3600 * 10**6, "d": 86400 * 10**6, "day": 86400 * 10**6, "w": 7 * 86400 * 10**6, "week": 7 * 86400 * 10**6}


def interval_micros(text: str) -> int:
    """'5 minutes', '1h', '30 second 500 ms' in microseconds."""
    parts = re.findall(r"(\d+)\s*([a-zA-Z]+)", text)
    if not parts or re.sub(r"(\d+)\s*([a-zA-Z]+)|\s+", "", text):
        raise ValueError(f"not an interval: {text!r}")
    total = 0
    for n, unit in parts:
        name = unit if unit in _UNITS else unit.lower().rstrip("s") or unit
        if name not in _UNITS:
            raise ValueError(f"not an interval: {text!r}")
        total += int(n) * _UNITS[name]
    if total <= 0:
        raise ValueError("an interval must be positive")
    return total
