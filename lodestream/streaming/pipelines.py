"""Continuous work: windows over event time, pipelines of nodes, and searches in parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import TIME

EVENT_TIME = "event_time"


def with_event_time(df: DataFrame, late: str) -> DataFrame:
    """A timestamp column from _timestamp, with a watermark that lets rows be so late."""
    return df.withColumn(EVENT_TIME, F.timestamp_micros(F.col(TIME))).withWatermark(EVENT_TIME, late)


def tumbling(df: DataFrame, wide: str, keys: list[str], late: str = "10 minutes", value: str = "value") -> DataFrame:
    """Counts and sums per window and key. The same plan runs over a table or a stream."""
    return _windowed(with_event_time(df, late), F.window(EVENT_TIME, wide), keys, value)


def sliding(df: DataFrame, wide: str, slide: str, keys: list[str], late: str = "10 minutes", value: str = "value") -> DataFrame:
    return _windowed(with_event_time(df, late), F.window(EVENT_TIME, wide, slide), keys, value)


def sessions(df: DataFrame, gap: str, keys: list[str], late: str = "10 minutes", value: str = "value") -> DataFrame:
    return _windowed(with_event_time(df, late), F.session_window(EVENT_TIME, gap), keys, value)


def _windowed(df: DataFrame, window, keys: list[str], value: str) -> DataFrame:
    out = df.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def unique_events(df: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return with_event_time(df, late).dropDuplicatesWithinWatermark(keys)


def drop_too_old(df: DataFrame, oldest: int) -> DataFrame:
    return df.where(F.col(TIME) >= oldest)


# -- pipelines of nodes ------------------------------------------------------------------------------


@dataclass
class Node:
    """kind: stream (source or target), condition (SQL predicate) or function (DataFrame to DataFrame)."""

    id: str
    kind: str
    what: object = None


@dataclass
class Pipeline:
    """A source stream whose rows flow along edges through conditions and functions to streams."""

    name: str
    nodes: list[Node]
    edges: list[tuple[str, str]]
    realtime: bool = True
    _by_id: dict[str, Node] = field(default_factory=dict, repr=False)

    def validate(self) -> Pipeline:
        self._by_id = {n.id: n for n in self.nodes}
        if len(self._by_id) != len(self.nodes):
            raise ValueError("two nodes have one id")
        if unknown := {x for e in self.edges for x in e} - set(self._by_id):
            raise ValueError(f"edges name unknown nodes: {sorted(unknown)}")
        if len(self.sources) != 1:
            raise ValueError("a pipeline has one source stream")
        for n in self.nodes:
            if n.kind not in ("stream", "condition", "function"):
                raise ValueError(f"no node kind {n.kind!r}")
            if n.kind != "stream" and not any(a == n.id for a, _ in self.edges):
                raise ValueError(f"node {n.id} leads nowhere")
        state: dict[str, int] = {}

        def visit(at: str) -> None:
            if state.get(at) == 1:
                raise ValueError("a pipeline can't have a cycle")
            if state.get(at) != 2:
                state[at] = 1
                for a, b in self.edges:
                    if a == at:
                        visit(b)
                state[at] = 2

        for n in self.nodes:
            visit(n.id)
        return self

    @property
    def sources(self) -> list[Node]:
        targets = {b for _, b in self.edges}
        return [n for n in self.nodes if n.kind == "stream" and n.id not in targets]

    def apply(self, df: DataFrame) -> dict[str, DataFrame]:
        """What reaches each target stream."""
        self.validate()
        out: dict[str, DataFrame] = {}

        def flow(at: str, rows: DataFrame) -> None:
            for a, b in self.edges:
                if a != at:
                    continue
                node = self._by_id[b]
                if node.kind == "condition":
                    flow(b, rows.where(node.what))
                elif node.kind == "function":
                    flow(b, node.what(rows))
                else:
                    name = node.what or node.id
                    out[name] = out[name].unionByName(rows, allowMissingColumns=True) if name in out else rows
                    flow(b, rows)

        flow(self.sources[0].id, df)
        return out

    def start(self, stream: DataFrame, sink: Callable[[str, DataFrame, int], None], checkpoint: str, once: bool = False):
        """Runs over a streaming DataFrame: every micro-batch goes through the nodes, and sink gets
        each target's rows with the batch's number, by which it can make writing idempotent."""
        self.validate()

        def batch(df: DataFrame, number: int) -> None:
            df.persist()
            for name, rows in self.apply(df).items():
                sink(name, rows, number)
            df.unpersist()

        writer = stream.writeStream.queryName(self.name).foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def check_realtime(pipelines: list[Pipeline]) -> None:
    """One realtime pipeline per source stream."""
    seen: set = set()
    for p in pipelines:
        if p.realtime:
            name = p.validate().sources[0].what or p.sources[0].id
            if name in seen:
                raise ValueError(f"stream {name} has a realtime pipeline already")
            seen.add(name)


def derived_stream(query: Callable[[int, int], DataFrame], sink: Callable[[DataFrame], None], last: int, now: int, period: int, delay: int = 0) -> int:
    """A scheduled pipeline's run: the query over each whole period since the last one, in order.
    Returns where the next run starts."""
    at = last
    while at + period <= now - delay:
        sink(query(at, at + period))
        at += period
    return at


# -- searches in parts -------------------------------------------------------------------------------


def partitions(start: int, end: int, step: int, descending: bool = True, interval: int = 0, mini: int = 0, whole: bool = False) -> list[tuple[int, int]]:
    """Time ranges that a search is answered in, newest first if descending. Their bounds are
    multiples of the histogram interval; the first may be a mini part, so that something shows
    soon; a complex query has a single part."""
    if whole or end <= start:
        return [(start, end)] if end > start else []
    if interval:
        step = max(interval, -(-step // interval) * interval)
        mini = -(-mini // interval) * interval if mini else 0
    out = []
    if descending:
        hi = end
        if mini and end - mini > start:
            lo = end - mini
            lo -= lo % interval if interval else 0
            out.append((max(lo, start), end))
            hi = max(lo, start)
        while hi > start:
            lo = hi - step
            lo -= lo % interval if interval else 0
            out.append((max(lo, start), hi))
            hi = max(lo, start)
        return out
    lo = start
    if mini and start + mini < end:
        hi = start + mini
        hi -= hi % interval if interval else 0
        hi = hi if hi > start else start + mini
        out.append((start, hi))
        lo = hi
    while lo < end:
        hi = lo + step
        hi -= hi % interval if interval else 0
        hi = min(hi if hi > lo else lo + step, end)
        out.append((lo, hi))
        lo = hi
    return out


def search_stream(run: Callable[[int, int], DataFrame], start: int, end: int, step: int, limit: int = -1, **options) -> Iterator[tuple[list, int]]:
    """Rows part by part with the progress in percent; stops once limit rows have come."""
    parts, left = partitions(start, end, step, **options), limit
    for k, (lo, hi) in enumerate(parts, 1):
        rows = run(lo, hi).take(left) if left >= 0 else run(lo, hi).collect()
        left = left - len(rows) if left >= 0 else left
        yield rows, round(100 * k / len(parts))
        if left == 0:
            return


def best_cached(cached: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """Cached time ranges to reuse for a range: the one with the largest overlap, then again among
    those that don't overlap it."""
    left, chosen = [c for c in cached if min(c[1], end) > max(c[0], start)], []
    while left:
        best = max(left, key=lambda c: (min(c[1], end) - max(c[0], start), -c[0]))
        chosen.append(best)
        left = [c for c in left if c[1] <= best[0] or c[0] >= best[1]]
    return sorted(chosen)
