"""Interactive parameters: a change stops what is out of date and plans again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Variable:
    """Named values that queries depend on, with other names for some of them."""

    def __init__(self, initial: dict | None = None, translate: dict[str, str] | None = None) -> None:
        self.values, self.names, self.watchers = dict(initial or {}), dict(translate or {}), []

    def __getitem__(self, key: str):
        return self.values.get(self.names.get(key, key))

    def from_input(self, changes: dict) -> None:
        new = {self.names.get(k, k): v for k, v in changes.items()}
        if any(self.values.get(k) != v for k, v in new.items()):
            self.values.update(new)
            for w in self.watchers:
                w()


class Interactive:
    """Queries of variables; a change cancels the running jobs of the queries it reaches."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.queries, self.cached = spark, {}, {}

    def register(self, name: str, build: Callable[[], DataFrame], *variables: Variable) -> None:
        group = f"{name}-{uuid.uuid4().hex}"
        self.queries[name] = (build, group)

        def changed() -> None:
            self.cached.pop(name, None)
            self.spark.sparkContext.cancelJobGroup(group)

        for v in variables:
            v.watchers.append(changed)

    def forget(self, name: str) -> None:
        """Remove a query; what it runs is cancelled."""
        _, group = self.queries.pop(name)
        self.cached.pop(name, None)
        self.spark.sparkContext.cancelJobGroup(group)

    def result(self, name: str) -> DataFrame:
        """The query's plan for the present values; run it under its group with :meth:`collect`."""
        if name not in self.cached:
            self.cached[name] = self.queries[name][0]()
        return self.cached[name]

    def collect(self, name: str) -> list:
        self.spark.sparkContext.setJobGroup(self.queries[name][1], name, interruptOnCancel=True)
        return self.result(name).collect()
