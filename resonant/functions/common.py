"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a side that may go to every task.
SMALL = 100_000


def tidy(x: Column, digits: int = 6) -> Column:
    """Rounded, and without negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable stands for it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def first_of_largest(value: Column, order: Column) -> Column:
    """The order's smallest value among the rows with the largest value, as an aggregate."""
    return F.max_by(order, F.struct(value, -order))


def to_every_task(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df marked for broadcast if it has few rows; beyond that, Spark chooses the join.

    For tables that a caller gives. Streams are not counted, and tables of constants
    need no check.
    """
    if df.isStreaming or df.limit(most + 1).count() > most:
        return df
    return F.broadcast(df)


# complex numbers as struct<re, im>


def cx(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def cx_add(a: Column, b: Column, scale: Column | float = 1.0) -> Column:
    s = scale if isinstance(scale, Column) else F.lit(float(scale))
    return cx(a["re"] + s * b["re"], a["im"] + s * b["im"])


def cx_abs2(a: Column) -> Column:
    return a["re"] * a["re"] + a["im"] * a["im"]


def vector_length(c: Column, s: Column) -> Column:
    return F.sqrt(c * c + s * s)


def correlation(x: Column, y: Column) -> Column:
    """Pearson's, as an aggregate; null if a side does not vary."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), spread)
