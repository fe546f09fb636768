"""The query catalogue: name -> (Spark query, SQL over the same tables when SQL can say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: Extra digits both engines keep in a first rounding. Means often fall exactly between two rounded
#: values, and summation order decides the last bit; rounding finer first settles those ties.
SETTLE = 4


def settled(sql: str) -> str:
    """Every ``round(x, d)`` with 4 to 6 digits as ``round(round(x, d + 4), d)``."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        if start and (sql[start - 1].isalnum() or sql[start - 1] == "_"):
            out.append(sql[at : start + 6])
            at = start + 6
            continue
        depth, end = 1, start + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        body, comma, digits = sql[start + 6 : end - 1].rpartition(",")
        d = digits.strip()
        if comma and d in ("4", "5", "6"):
            out.append(f"{sql[at:start]}(round(round({settled(body)}, {int(d) + SETTLE}), {d}) + 0)")
        else:
            out.append(sql[at : start + 6] + settled(sql[start + 6 : end - 1]) + ")")
        at = end
    return "".join(out) + sql[at:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is the check a single-node SQL engine runs on the same tables."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = settled(sql)
        return fn

    return add
