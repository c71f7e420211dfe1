"""Small helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.functions.geometry import round_


def r4(name: str, expr: Column | None = None) -> Column:
    """A column rounded to four decimals, negative zero made zero."""
    return (round_(F.col(name) if expr is None else expr, 4) + 0.0).alias(name)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: round_(F.col(n), 4) + 0.0 for n in names})


def sql_r4(expr: str, name: str) -> str:
    return f"round({expr}, 4) + 0.0::double AS {name}"


def sql_norm(x: str, y: str) -> str:
    return f"sqrt(({x})*({x}) + ({y})*({y}))"


def sql_backward(x: str, rate: str) -> str:
    return f"coalesce(({x} - lag({x}) OVER w)*{rate}, (lead({x}) OVER w - {x})*{rate})"


def sql_gradient(x: str, h: str = "0.1::double") -> str:
    return (
        f"CASE WHEN lag({x}) OVER w IS NULL THEN (lead({x}) OVER w - {x})/{h} "
        f"WHEN lead({x}) OVER w IS NULL THEN ({x} - lag({x}) OVER w)/{h} "
        f"ELSE (lead({x}) OVER w - lag({x}) OVER w)/(2*{h}) END"
    )
