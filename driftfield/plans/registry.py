"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftfield.plans.fixtures import CTE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def finish(df: DataFrame, digits: int) -> DataFrame:
    """Doubles rounded, integers as bigint: the same value types on both engines."""
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            c = F.round(c.cast("double"), digits)
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        cols.append(c.alias(name))
    return df.select(*cols)


def _with(names: str) -> str:
    """WITH clause of the named fixtures and what they build on, in order."""
    wanted: list[str] = []

    def need(name: str) -> None:
        deps, _ = CTE[name]
        for d in deps:
            need(d)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        need(name)
    return ", ".join(f"{n} AS ({CTE[n][1]})" for n in wanted)


def oracle(sql: str, uses: str = "", dbl: str = "", ints: str = "", digits: int = 6) -> str:
    """Full SQL: fixtures, the query, and rounding of its double columns."""
    ctes = _with(uses)
    swaps = [
        f"CASE WHEN isnan({c}) THEN {c} WHEN abs({c}) < {0.5 * 10.0 ** -digits} THEN 0.0::DOUBLE ELSE round({c}::DOUBLE, {digits}) END AS {c}" for c in dbl.split()
    ]
    swaps += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    body = f"SELECT * REPLACE ({', '.join(swaps)}) FROM (\n{sql}\n) _q" if swaps else sql
    if not ctes:
        return body
    # a query may bring its own WITH list: it then starts with "WITH" and is nested, which is fine
    return f"WITH {ctes} {body}"


def query(name: str, sql: str | None = None, uses: str = "", dbl: str = "", ints: str = "", digits: int = 6):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: finish(fn(Tables(spark, sf_dir)), digits)
        if sql is not None:
            ORACLES[name] = oracle(sql, uses, dbl, ints, digits)
        return fn

    return register
