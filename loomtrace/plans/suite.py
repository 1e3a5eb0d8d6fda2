"""A named set of queries over the estate, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtrace.plans.estate import Estate, with_views


class Suite:
    def __init__(self) -> None:
        self.runs: dict[str, Callable[[Estate], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None):
        """Registers a function of the estate under ``name``; ``sql`` may use the views."""

        def keep(run: Callable[[Estate], DataFrame]):
            if name in self.runs:
                raise ValueError(f"{name} is registered twice")
            self.runs[name] = run
            if sql:
                self.sql[name] = with_views(sql)
            return run

        return keep

    def queries(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bound(run):
            return lambda spark, sf_dir: run(Estate(spark, sf_dir))

        return {name: bound(run) for name, run in self.runs.items()}
