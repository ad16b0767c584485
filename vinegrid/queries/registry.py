"""Queries of the parcel engine, each with its DuckDB twin over the same adapters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinegrid.adapters import ADAPTERS
from vinegrid.functions.indices import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, without a negative zero, as in the twin."""
    return df.withColumns({f.name: rounded(F.col(f"`{f.name}`")) + F.lit(0.0) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})


def with_adapters(sql: str) -> str:
    """Put the adapters that a query names in front of it."""
    used = [name for name in ADAPTERS if re.search(rf"\b{name}\b", sql)]
    views = ", ".join(f"{name} AS ({ADAPTERS[name][1].strip()})" for name in used)
    body = re.sub(r"^\s*WITH\b", ",", sql, count=1, flags=re.I) if used else sql
    return f"WITH {views} {body}" if used else sql


def query(name: str, sql: str | None = None, doubles: str = "", exact: bool = False):
    """Register a query; ``doubles`` names the twin's columns that are rounded, as sums may differ in their last digits.

    ``exact``: doubles stay as they are, where both engines do the same operations in the same order.
    """

    def put(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = f if exact else lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if sql:
            inner = with_adapters(sql)
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({x}, 6) + 0.0 AS {x}' for x in doubles.split())}) FROM ({inner})" if doubles and not exact else inner
        return f

    return put
