"""A book of queries: each is a function of the session and the tables' folder, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.queries[name] = query
            if oracle:
                self.oracles[name] = oracle
            return query

        return put


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """For comparison: dates as text, doubles rounded."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append((c.cast("string") if kind == "date" else F.round(c, digits) if kind == "double" else c).alias(name))
    return df.select(*out)
