"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.plans.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a query under its name; sql, over the named views, is what it must equal."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            if views and body.startswith("with "):
                SQL[f.__name__] = with_views(*views).rstrip() + ",\n" + body.removeprefix("with ")
            else:
                SQL[f.__name__] = (with_views(*views) if views else "") + body
        return f

    return keep


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
