"""Registered queries: a name, a callable on (spark, sf_dir), and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DECIMALS = 9


class Tables:
    """The tables and fixture views of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name == "tiles":
            return fixtures.tiles(self.orders.select(F.col("o_orderkey").alias("image_id")))
        if name in fixtures.VIEWS:
            return fixtures.view(self.spark, self.sf_dir, name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None, views: tuple[str, ...] = (), doubles: tuple[str, ...] = ()):
    """Register a function of Tables. Sums of doubles depend on order, so `doubles` are rounded on both sides."""

    def register(make: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = make(Tables(spark, sf_dir))
            return out.withColumns({c: F.round(c, DECIMALS) for c in (x.strip('"') for x in doubles)}) if doubles else out

        QUERIES[name] = run
        if sql is not None:
            body = sql if not sql.lstrip().startswith("WITH") else f"SELECT * FROM ({sql})"
            if doubles:
                body = f"SELECT * REPLACE ({', '.join(f'round({c}, {DECIMALS}) AS {c}' for c in doubles)}) FROM ({sql})"
            ctes = ", ".join(f"{v} AS ({fixtures.VIEWS[v]})" for v in views)
            ORACLES[name] = f"WITH {ctes} {body}" if ctes else body
        return make

    return register
