"""Protobuf push requests: Prometheus remote write and Loki, without generated classes.

A request is a row with its bytes in the column content (as the binaryFile source gives it), usually
compressed by Snappy. Messages are read field by field from the published definitions."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_LABEL = re.compile(r'([A-Za-z_][A-Za-z0-9_.]*)\s*=\s*"((?:[^"\\]|\\.)*)"')


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = data[at]
        out |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return out, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a message: an integer, or the bytes of what has a length or
    a fixed width."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        if at > len(data):
            raise ValueError("a message ends too early")
        yield key >> 3, value


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def unpack(data: bytes) -> bytes:
    """Undoes Snappy's block format; what isn't compressed stays."""
    try:
        size, _ = varint(data, 0)
        return pa.decompress(data, decompressed_size=size, codec="snappy", asbytes=True)
    except (pa.ArrowException, OSError, IndexError, ValueError):
        return data


def _pairs(message: bytes) -> tuple[str, str]:
    found = dict(fields(message))
    return found.get(1, b"").decode(), found.get(2, b"").decode()


def remote_write(request: bytes) -> Iterator[tuple[str, int, float, dict]]:
    """(metric, time in µs, value, labels) of every sample; series without a name are refused."""
    for n, series in fields(unpack(request)):
        if n != 1:
            continue
        parts = list(fields(series))
        labels = dict(_pairs(x) for k, x in parts if k == 1)
        name = labels.get("__name__")
        if not name:
            continue
        for k, sample in parts:
            if k == 2:
                found = dict(fields(sample))
                value = struct.unpack("<d", found[1])[0] if 1 in found else 0.0
                yield name, signed(found.get(2, 0)) * 1000, value, labels


def loki_push(request: bytes, name_labels: tuple[str, ...] = ("stream_name", "service_name", "job", "app")) -> Iterator[tuple[str, int, dict]]:
    """(stream, time in µs, record) of every entry. Streams without labels, empty lines and times
    before 1970 are refused."""
    for n, stream in fields(unpack(request)):
        if n != 1:
            continue
        parts = list(fields(stream))
        text = next((x.decode() for k, x in parts if k == 1), "")
        labels = {k: re.sub(r"\\(.)", r"\1", v) for k, v in _LABEL.findall(text)}
        if not labels:
            continue
        for k, entry in parts:
            if k != 2:
                continue
            inner = list(fields(entry))
            when = dict(fields(next((x for f, x in inner if f == 1), b"")))
            line = next((x.decode() for f, x in inner if f == 2), "")
            seconds = signed(when.get(1, 0))
            if line and seconds >= 0:
                meta = dict(_pairs(x) for f, x in inner if f == 3)
                stream_name = next((labels[x] for x in name_labels if x in labels), "default")
                yield stream_name, seconds * 1_000_000 + when.get(2, 0) // 1000, meta | labels | {"log": line}


def from_remote_write(requests: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for content in batch.column(0).to_pylist() if content for r in remote_write(content)]
            out = list(zip(*rows, strict=True)) if rows else [[]] * 4
            labels = pa.array([list(x.items()) for x in out[3]], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), labels], ["stream", "_timestamp", "value", "labels"])

    return requests.select("content").mapInArrow(run, "stream string, _timestamp long, value double, labels map<string,string>")


def from_loki_protobuf(requests: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for content in batch.column(0).to_pylist() if content for r in loki_push(content)]
            out = list(zip(*rows, strict=True)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array([json.dumps(x, ensure_ascii=False) for x in out[2]], pa.string())], ["stream", "_timestamp", "record"])

    return requests.select("content").mapInArrow(run, "stream string, _timestamp long, record string")
