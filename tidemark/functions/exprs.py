"""Column expressions: hash order in place of random numbers, vectors, and the maths of §2.8."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(*parts: Column | str) -> Column:
    """md5 of the parts joined by '|': the same order in every engine and run."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def hash32(*parts: Column | str) -> Column:
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("long")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double, inside codegen."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def softplus(x: Column) -> Column:
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def delta_days(ref: Column, ts: Column) -> Column:
    """Days from ts to ref, at least 0; 0 without ts."""
    return F.coalesce(F.greatest((ref - ts) / F.lit(86400.0), F.lit(0.0)), F.lit(0.0))


def dense_ids(df: DataFrame, column: str, name: str, parts: int = 256) -> DataFrame:
    """(column, name): distinct values in ascending order -> 0, 1, 2, ...

    Integers are numbered within `parts` ranges between their approximate quantiles and shifted by the
    ranges' running counts, so each task holds about a share of them however they are spread; only the
    ranges' counts meet in one place. Strings (categories, brands: few) are numbered at once.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    if dict(values.dtypes)[column] == "string":
        return values.select(column, (F.row_number().over(Window.orderBy(column)) - 1).cast("long").alias(name))
    cuts = values.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 16 * parts).alias("_cuts"))
    ranged = values.crossJoin(F.broadcast(cuts)).select(column, F.size(F.filter("_cuts", lambda c: c < F.col(column))).alias("_range"))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    local = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1)
    return local.join(F.broadcast(before), "_range").select(column, (F.col("_place") + F.col("_before")).cast("long").alias(name))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group; Catalyst limits each group before the shuffle too."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(name) <= k)
