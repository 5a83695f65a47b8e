"""Registry of runnable queries and their SQL counterparts.

A check has one output spec, "name:kind ..." with kind i (integer), f (double, six decimals), m (metres, three),
s (text), d (date as text), t (timestamp as text); a missing text is ''. It shapes both sides the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.adapters import ADAPTERS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _fields(spec: str):
    return [f.split(":") for f in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    def one(name, kind):
        c = F.col(name)
        return {"i": lambda: c.cast("bigint"), "m": lambda: F.round(c.cast("double"), 3) + 0.0,
                "f": lambda: F.round(c.cast("double"), 6) + 0.0,
                "s": lambda: F.coalesce(c.cast("string"), F.lit("")),
                "d": lambda: F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("")),
                "t": lambda: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))}[kind]().alias(name)
    return df.select([one(n, k) for n, k in _fields(spec)])


def _quoted(name: str) -> str:
    return '"' + name + '"'


def shape_sql(spec: str, source: str = "result") -> str:
    sql = {"i": "cast({0} as bigint)", "m": "round(cast({0} as double), 3) + 0.0",
           "f": "round(cast({0} as double), 6) + 0.0", "s": "coalesce(cast({0} as varchar), '')",
           "d": "coalesce(strftime({0}, '%Y-%m-%d'), '')", "t": "coalesce(strftime({0}, '%Y-%m-%d %H:%M:%S'), '')"}
    return "select " + ", ".join(f"{sql[k].format(_quoted(n))} as {_quoted(n)}" for n, k in _fields(spec)) + f" from {source}"


def check(name: str, spec: str, needs: str = "", sql: str | None = None, recursive: bool = False):
    """Register the decorated (spark, sf_dir) function; `sql` is a list of CTEs ending with `result`."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate check {name}")
        QUERIES[name] = lambda spark, sf_dir: shape(fn(spark, sf_dir), spec)
        if sql is not None:
            ctes = [f"{n} as ({ADAPTERS[n]})" for n in needs.split()] + [sql.strip()]
            ORACLES[name] = ("with recursive " if recursive else "with ") + ",\n".join(ctes) + "\n" + shape_sql(spec)
        return fn
    return add
