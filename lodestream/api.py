"""What a caller asks for, as Python functions over a catalog."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import TIME, Catalog
from .operators import relational as R
from .operators import traces as TR
from .plans.planner import Planner, Request
from .plans.planner import search as run_search
from .promql import engine as PQ
from .streaming import pipelines as S


class Engine:
    def __init__(self, catalog: Catalog, **planner):
        self.catalog, self.spark = catalog, catalog.spark
        self.planner = Planner(catalog, **planner)
        self.functions: dict[str, Callable] = {}

    # -- search --------------------------------------------------------------------------------

    def search(self, sql: str, start: int = 0, end: int = 0, frm: int = 0, size: int = 0, query_fn: str | None = None, **request) -> dict:
        """Hits as dictionaries without null columns, cut to what was asked, with the total."""
        plan = self.planner.plan(Request(sql, start, end, frm, size, **request))
        df = run_search(self.spark, self.planner, Request(sql, start, end, frm, size, **request))
        if query_fn:
            df = self.apply_function(df, query_fn)
        hits = [{k: v for k, v in r.asDict().items() if v is not None} for r in df.collect()]
        more = plan.shown is not None and len(hits) > plan.shown
        return {"hits": hits[: plan.shown] if plan.shown is not None else hits, "total": min(len(hits), plan.shown or len(hits)), "more": more, "columns": df.columns}

    def search_multi(self, queries: list[str], **request) -> list[dict]:
        return [self.search(q, **request) for q in queries]

    def search_stream(self, sql: str, start: int, end: int, step: int = 3600_000_000, size: int = -1, **request) -> Iterator[tuple[list, int]]:
        plan = self.planner.plan(Request(sql, start, end, size=size, **request))
        part = lambda a, b: run_search(self.spark, self.planner, Request(sql, a, b, size=-1 if plan.complex else size, **request))
        return S.search_stream(part, start, end, step, size, interval=plan.interval or 0, whole=plan.complex)

    def plan_partitions(self, sql: str, start: int, end: int, step: int, **request) -> list[tuple[int, int]]:
        plan = self.planner.plan(Request(sql, start, end, **request))
        return S.partitions(start, end, step, interval=plan.interval or 0 if "histogram" in sql.lower() else 0, whole=plan.complex and "histogram" not in sql.lower())

    def explain(self, sql: str, mode: str = "formatted", **request) -> str:
        df = run_search(self.spark, self.planner, Request(sql, **request))
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def values(self, stream: str, fields: list[str], k: int = 10, start: int = 0, end: int = 0) -> dict[str, DataFrame]:
        df = self.catalog.df(stream)
        for bound, op in ((start, ">="), (end, "<")):
            df = df.where(f"{TIME} {op} {bound}") if bound else df
        return {f: R.values_top_k(df, f, k) for f in fields}

    def around(self, stream: str, key: int, size: int, where: str | None = None) -> DataFrame:
        return R.search_around(self.catalog.df(stream), key, size, where=where)

    def patterns(self, stream: str, column: str, most: int = 10_000, k: int = 100) -> DataFrame:
        return R.log_patterns(self.catalog.df(stream).orderBy(F.desc(TIME)).limit(most), column, k)

    # -- PromQL --------------------------------------------------------------------------------

    def promql_range(self, text: str, start: int, end: int, step: int, **options) -> DataFrame:
        return PQ.query_range(self.catalog, text, start, end, step, **options)

    def promql(self, text: str, at: int, **options) -> DataFrame:
        return PQ.query(self.catalog, text, at, **options)

    def series(self, matchers: list[str], start: int, end: int) -> DataFrame:
        return PQ.series(self.catalog, matchers, start, end)

    def label_values(self, label: str, metric: str, start: int, end: int) -> DataFrame:
        return PQ.label_values(self.catalog, label, metric, start, end)

    def exemplars(self, text: str, start: int, end: int) -> DataFrame:
        return PQ.exemplars(self.catalog, text, start, end)

    def format_query(self, text: str) -> str:
        return PQ.format_query(text)

    # -- traces --------------------------------------------------------------------------------

    def traces_latest(self, stream: str, size: int = 25) -> DataFrame:
        return TR.latest_traces(self.catalog.df(stream, "traces"), size)

    def trace_dag(self, stream: str, trace_id: str) -> tuple[DataFrame, DataFrame]:
        spans = self.catalog.df(stream, "traces")
        return TR.trace_nodes(spans, trace_id), TR.trace_edges(spans, trace_id)

    # -- functions -----------------------------------------------------------------------------

    def register_function(self, name: str, fn: Callable, kind: str = "sql") -> None:
        """kind sql: text arguments to text, by batches, usable in SQL (errors and nulls give '');
        row: a dictionary to a dictionary; result: all hits to all hits."""
        if kind == "sql":

            def safe(*columns: pd.Series) -> pd.Series:
                def one(*x):
                    try:
                        out = fn(*x)
                    except Exception:
                        return ""
                    return "" if out is None else str(out)

                return pd.Series([one(*x) for x in zip(*columns, strict=True)], dtype=object)

            from inspect import signature

            n = len(signature(fn).parameters)
            names = ", ".join(f"a{i}" for i in range(n))
            scope: dict = {"safe": safe, "pd": pd}
            exec(f"def call({', '.join(f'a{i}: pd.Series' for i in range(n))}) -> pd.Series:\n    return safe({names})", scope)
            self.spark.udf.register(name, F.pandas_udf(scope["call"], "string"))
        self.functions[name] = (kind, fn)

    def apply_function(self, df: DataFrame, name: str) -> DataFrame:
        """A stored function over hits: row by row in Arrow batches, or over the whole result, which
        then has to fit one task (a result is bounded by its limit)."""
        kind, fn = self.functions[name]
        schema = df.schema

        def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([fn(r) for r in b.to_dict("records")], columns=schema.names)

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            every = pd.concat(list(batches), ignore_index=True)
            yield pd.DataFrame(fn(every.to_dict("records")), columns=schema.names)

        return df.mapInPandas(rows, schema) if kind == "row" else df.coalesce(1).mapInPandas(whole, schema)

    # -- shapes of responses -------------------------------------------------------------------

    @staticmethod
    def table_response(df: DataFrame) -> list[list]:
        return [list(r) for r in df.collect()]

    @staticmethod
    def metrics_response(df: DataFrame, value: str = "value") -> DataFrame:
        """Rows that differ in time and value only, as one row with their pairs in order of time."""
        labels = [c for c in df.columns if c not in (TIME, value)]
        pair = F.struct(F.col(TIME).alias("t"), F.col(value).cast("string").alias("v"))
        return df.groupBy(*labels).agg(F.array_sort(F.collect_list(pair)).alias("values"))
