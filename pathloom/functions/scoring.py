"""Normalisations over groups and arithmetic on vectors, as Column expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPSILON = 1e-8


def dot(a: Column | str, b: Column | str) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column | str) -> Column:
    """A vector scaled to length 1; a zero vector stays."""
    v = F.col(v) if isinstance(v, str) else v
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(F.lit(0.0)))


def group(*by: str) -> WindowSpec:
    return Window.partitionBy(*by)


def min_max(x: Column, over: WindowSpec, epsilon: float = EPSILON) -> Column:
    """To [0, 1) within a group; 0 where the group is constant."""
    low, high = F.min(x).over(over), F.max(x).over(over)
    return (x - low) / (high - low + epsilon)


def max_norm(x: Column, over: WindowSpec, epsilon: float = EPSILON) -> Column:
    return x / (F.max(x).over(over) + epsilon)


def sum_norm(x: Column, over: WindowSpec) -> Column:
    """Shares of the group's sum; equal shares where the sum is 0."""
    total = F.sum(x).over(over)
    return F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(over))


def normalised(df: DataFrame, x: str, how: str, *by: str, out: str = "x", epsilon: float = EPSILON) -> DataFrame:
    """df with `out`: x normalised within its group as by min_max(), max_norm() or sum_norm() ("min_max", "max", "sum").

    For few large groups, which a window would put into one task each: a group's figures are taken before and after the
    shuffle and come back by a join, whose large keys Spark can split. Null keys are a group.
    """
    value = F.col(x)
    figures = df.groupBy(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by))).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum(value).alias("_total"), F.count(F.lit(1)).alias("_n"))
    on = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    forms = {
        "min_max": (value - F.col("_low")) / (F.col("_high") - F.col("_low") + epsilon),
        "max": value / (F.col("_high") + epsilon),
        "sum": F.when(F.col("_total") > 0, value / F.col("_total")).otherwise(F.lit(1.0) / F.col("_n")),
    }
    if how not in forms:
        raise ValueError(f"no normalisation {how}")
    return df.join(figures, on).withColumn(out, forms[how]).select(*(c for c in df.columns if c != out), out)


def best(over: WindowSpec, *order: Column) -> Column:
    """The rank within a group, 1 first. A filter on it becomes a group limit before the shuffle."""
    return F.row_number().over(over.orderBy(*order))
