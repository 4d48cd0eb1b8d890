"""Range buckets and running totals over a whole table, without one task that sees all rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Rows of a sample for each range.
SAMPLE = 100


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where ``use`` reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def quantiles(df: DataFrame, key: str) -> list:
    """Ascending values of ``key`` that cut it into about as many even ranges as there are shuffle partitions; a value
    of many ranges' rows stands there as often. Keys that aren't numbers are sampled, ``SAMPLE`` rows a range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < 2:
        return []
    if isinstance(df.schema[key].dataType, NumericType):
        return sorted(df.select(F.percentile_approx(key, [i / n for i in range(1, n)], 20 * n)).first()[0] or [])
    keys = df.select(key).filter(F.col(key).isNotNull())
    share = SAMPLE * n / max(1, keys.count())
    found = sorted(r[0] for r in keys.filter(F.rand(1) < share).collect())
    return [found[len(found) * i // n] for i in range(1, n)] if found else []


def range_bounds(df: DataFrame, key: str) -> list:
    """Distinct ``quantiles``. Bounds only set which task works on a row; results never depend on them."""
    return sorted(set(quantiles(df, key)))


def range_bucket(key: Column, bounds: list, kind: str) -> Column:
    """0 for keys up to the first bound, and so on; null keys: 0. Bounds are looked up in two steps, so that
    thousands of them cost some tens of comparisons a row."""
    if not bounds:
        return F.lit(0)
    m = math.isqrt(len(bounds) - 1) + 1
    groups = [bounds[i : i + m] for i in range(0, len(bounds), m)]
    literal = lambda values: F.array(*[F.lit(v).cast(kind) for v in values])
    below = lambda values: F.size(F.filter(values, lambda b: b < key))
    passed = below(literal([g[-1] for g in groups]))
    within = let(passed, lambda i: F.least(i * m, F.lit(len(bounds))) + F.coalesce(below(F.get(F.array(*map(literal, groups)), i)), F.lit(0)))
    return F.when(key.isNull(), F.lit(0)).otherwise(within)


def running_totals(df: DataFrame, key: str, ties: list[str], values: dict[str, str]) -> DataFrame:
    """Adds the running sums of ``values`` (name of the sum to column) over the whole table in the order of ``key`` and
    ``ties``, nulls first; rows that are equal in all of them get the same sums. Buckets of ``key`` run in parallel;
    their totals, as many as there are buckets, come to the driver."""
    bounds = range_bounds(df, key)
    df = df.withColumn("_bucket", range_bucket(F.col(key), bounds, df.schema[key].dataType.simpleString()))
    totals = {r["_bucket"]: r for r in df.groupBy("_bucket").agg(*[F.sum(v).alias(into) for into, v in values.items()]).collect()}
    w = Window.partitionBy("_bucket").orderBy(key, *ties)
    for into, value in values.items():
        before = [0, *accumulate((totals[b][into] or 0) if b in totals else 0 for b in range(len(bounds)))]
        df = df.withColumn(into, F.sum(value).over(w) + F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_bucket")))
    return df.drop("_bucket")
