import json
import struct

import pyarrow as pa
import pytest

from lodestream.sources import wire as W


def number(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def field(k, value):
    if isinstance(value, float):
        return number(k << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, int):
        return number(k << 3) + number(value)
    value = value.encode() if isinstance(value, str) else value
    return number(k << 3 | 2) + number(len(value)) + value


def pair(k, v):
    return field(1, k) + field(2, v)


def series(labels, samples):
    return field(1, b"".join(field(1, pair(*x)) for x in labels.items()) + b"".join(field(2, field(1, float(v)) + field(2, t)) for v, t in samples))


def test_remote_write(spark):
    request = series({"__name__": "up", "job": "a"}, [(1.5, 1700000000000), (2, -5)]) + series({"job": "nameless"}, [(1, 1)])
    df = spark.createDataFrame([(bytearray(pa.compress(request, codec="snappy", asbytes=True)),), (bytearray(request),), (None,)], "content binary")
    got = [(r.stream, r["_timestamp"], r.value, r.labels) for r in W.from_remote_write(df).collect()]
    labels = {"__name__": "up", "job": "a"}
    assert got == [("up", 1700000000000000, 1.5, labels), ("up", -5000, 2.0, labels)] * 2


def entry(seconds, line, nanos=0, **meta):
    return field(2, field(1, field(1, seconds) + field(2, nanos)) + field(2, line) + b"".join(field(3, pair(*x)) for x in meta.items()))


def test_loki(spark):
    request = field(1, field(1, '{job="api", path="a\\"b"}') + entry(1700000000, "hello", 5000, trace="t") + entry(1, "") + entry(-3, "early")) + field(1, field(1, "{}") + entry(1, "x"))
    df = spark.createDataFrame([(bytearray(pa.compress(request, codec="snappy", asbytes=True)),)], "content binary")
    (r,) = W.from_loki_protobuf(df).collect()
    assert (r.stream, r["_timestamp"], json.loads(r.record)) == ("api", 1700000000000005, {"trace": "t", "job": "api", "path": 'a"b', "log": "hello"})


def test_broken_messages():
    with pytest.raises((ValueError, IndexError)):
        list(W.fields(b"\x0a\x7fabc"))
    with pytest.raises(ValueError):
        list(W.fields(b"\x0b"))
    assert W.unpack(b"plain") == b"plain"
