"""A query and the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None = None


class Registry(dict[str, Entry]):
    """Queries by name."""

    def query(self, name: str, sql: str | None = None) -> Callable[[Run], Run]:
        def register(run: Run) -> Run:
            if name in self:
                raise ValueError(f"{name} is registered twice")
            self[name] = Entry(run, sql)
            return run

        return register


REGISTRY = Registry()
