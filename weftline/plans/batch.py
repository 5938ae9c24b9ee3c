"""Execution shapes: prepared queries, futures, batches of queries, time limits."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conditions


class Prepared:
    """A query built once from a function without arguments; its placeholders are bound at each execution."""

    def __init__(self, build: Callable, names: tuple[str, ...], name: str = ""):
        self.build, self.names, self.name = build, tuple(names), name

    def bound(self, **params) -> DataFrame:
        missing = [n for n in self.names if n not in params]
        if missing:
            raise ValueError(f"missing parameters: {', '.join(missing)}")
        conditions._bindings.append(params)
        try:
            return self.build().df()
        finally:
            conditions._bindings.pop()

    def execute(self, **params) -> list:
        return self.bound(**params).collect()


def prepare(build: Callable, *names: str, name: str = "") -> Prepared:
    return Prepared(build, names, name)


class Future:
    """A query that runs when asked. kind: list, first or count."""

    def __init__(self, query, kind: str = "list"):
        self.query, self.kind = query, kind

    def frame(self) -> DataFrame:
        if self.kind == "count":
            return self.query.count_frame()
        return self.query.limit(1).df() if self.kind == "first" else self.query.df()

    def result(self):
        rows = self.frame().collect()
        if self.kind == "count":
            return rows[0][0]
        return (rows[0] if rows else None) if self.kind == "first" else rows


def future(query) -> Future:
    return Future(query)


def future_first_or_default(query) -> Future:
    return Future(query, "first")


def future_count(query) -> Future:
    return Future(query, "count")


def run_all(futures: list[Future], threads: int = 8) -> list:
    """All results, in order; the jobs share the cluster."""
    with ThreadPoolExecutor(min(threads, max(1, len(futures)))) as pool:
        return list(pool.map(Future.result, futures))


class QueryBatch:
    """Several queries in one job: a union of (leg, row as JSON), so their scans are planned and run together."""

    def __init__(self):
        self.legs: list[tuple[str, Future]] = []

    def _add(self, query, kind: str) -> int:
        self.legs.append((kind, Future(query, kind)))
        return len(self.legs) - 1

    def add_list(self, query) -> int:
        return self._add(query, "list")

    def add_first_or_default(self, query) -> int:
        return self._add(query, "first")

    def add_count(self, query) -> int:
        return self._add(query, "count")

    def frame(self) -> DataFrame:
        """leg, ordinal (the row's place within its leg), payload."""
        out = None
        for i, (_, f) in enumerate(self.legs):
            df = f.frame()
            part = df.select(F.lit(i).alias("leg"), F.monotonically_increasing_id().alias("ordinal"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("payload"))
            out = part if out is None else out.union(part)
        if out is None:
            raise ValueError("the batch is empty")
        return out

    def execute(self) -> list:
        rows: dict[int, list] = {}
        for r in sorted(self.frame().collect(), key=lambda r: (r["leg"], r["ordinal"])):
            rows.setdefault(r["leg"], []).append(json.loads(r["payload"]))
        out = []
        for i, (kind, _) in enumerate(self.legs):
            got = rows.get(i, [])
            out.append(got if kind == "list" else got[0]["count"] if kind == "count" else got[0] if got else None)
        return out


class QueryTimeout(TimeoutError):
    """A query ran longer than its limit."""


def with_timeout(spark: SparkSession, action: Callable, seconds: float):
    """action() with its jobs stopped after some seconds."""
    tag = f"weftline-{uuid.uuid4().hex}"
    fired = threading.Event()

    def stop():
        fired.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return action()
    except Exception as e:
        if fired.is_set():
            raise QueryTimeout(f"more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


class Tracer:
    """Seconds of the phases of a query, and a call for slow ones."""

    def __init__(self, expected: float = 10.0, on_slow: Callable | None = None):
        self.expected, self.on_slow, self.phases = expected, on_slow, {}

    def run(self, phase: str, action: Callable):
        began = time.perf_counter()
        try:
            return action()
        finally:
            took = time.perf_counter() - began
            self.phases[phase] = self.phases.get(phase, 0.0) + took
            if self.on_slow and took > self.expected:
                self.on_slow(phase, took)
