"""Registers queries and the DuckDB SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None, day: bool = False):
        """Registers a query under its function's name. day: the column `day` is returned as text on both sides."""

        def add(f):
            def run(spark, sf_dir):
                out = f(spark, sf_dir)
                return out.withColumn("day", F.col("day").cast("string")) if day else out

            self.queries[f.__name__] = run
            if sql:
                self.oracle[f.__name__] = f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM ({sql})" if day else sql
            return f

        return add
