"""Every registered query of the library with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stormgrid.plans.fixtures import FIXTURES

Query = Callable[[SparkSession, str], DataFrame]

TABLES = "region nation customer supplier part orders lineitem events".split()
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Tables:
    """The given tables and the views derived from them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in FIXTURES:
            raise AttributeError(name)
        used = sorted(set(re.findall(r"\{(\w+)\}", FIXTURES[name])))
        return self.spark.sql(FIXTURES[name], **{u: getattr(self, u) for u in used})


def with_fixtures(sql: str) -> str:
    """Plain SQL on the given tables, with the derived views that it names as common tables."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in FIXTURES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                add(FIXTURES[name])
                needed.append(name)

    add(sql)
    views = [f"{n} as ({re.sub(r'[{}]', '', FIXTURES[n])})" for n in needed]
    start = re.match(r"\s*with\s+(recursive\s+)?", sql, re.I)
    if not views:
        return sql
    if start:
        return f"with {start[1] or ''}{', '.join(views)}, {sql[start.end():]}"
    return f"with {', '.join(views)} {sql}"


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6) -> Callable:
    """Register ``plan(tables) -> DataFrame``; ``doubles`` are compared to ``digits`` decimals."""
    names = doubles.split()

    def keep(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = plan(Tables(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in names}) if names else df

        _QUERIES[name] = run
        if sql is not None:
            rounded = ", ".join(f"round(cast({c} as double), {digits}) + 0.0 as {c}" for c in names)
            full = with_fixtures(sql)
            _SQL[name] = f"select * replace ({rounded}) from ({full}) q" if names else full
        return plan

    return keep


def _load() -> None:
    for module in ("scalars", "rates", "ranking", "losses", "joining", "networks", "draws", "scans", "models"):
        import_module(f"stormgrid.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
