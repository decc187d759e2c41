"""Rows in order across tasks: running totals and values carried along, with any one key split into ranges.

Rows are dealt into ranges of (key, order) of about equal size, so that a key of
a billion rows lies in many.  What a range needs of those before it is one row a
range and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.lineage import kept

_RANGE = "_range"
#: Rows that a task sorts or groups.
TASK_ROWS = 500_000


def parts(rows: DataFrame, size: int | None = None) -> int:
    """Into how many partitions rows are dealt, so that a task's share of them doesn't grow with the input: the session's number at least."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // (size or TASK_ROWS) + 1)


def dealt(rows: DataFrame, by: list[str], size: int | None = None) -> DataFrame:
    """rows, which are counted, so best a table or cut to files, dealt by key into parts(); joins and groups by the key keep that number."""
    return rows.repartition(parts(rows, size), *by)


def ranged(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows cut to files, with the number of the range that each lies in."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept(rows.repartitionByRange(n, *by, *order).withColumn(_RANGE, F.spark_partition_id()))


def _before(ends: DataFrame, by: list[str], back: bool = False):
    w = Window.partitionBy(*by).orderBy(F.col(_RANGE).desc() if back else _RANGE)
    return w.rowsBetween(Window.unboundedPreceding, -1)


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with each sum over the key's rows up to and with each; order tells a key's rows apart."""
    names = list(sums)
    at = ranged(rows.select("*", *(F.coalesce(c, F.lit(0)).alias(f"_own_{n}") for n, c in sums.items())), by, order)
    w = Window.partitionBy(*by, _RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = at.groupBy(*by, _RANGE).agg(*(F.sum(f"_own_{n}").alias(f"_sum_{n}") for n in names))
    ends = ends.select(*by, _RANGE, *(F.coalesce(F.sum(f"_sum_{n}").over(_before(ends, by)), F.lit(0)).alias(f"_off_{n}") for n in names))
    own = at.select("*", *(F.sum(f"_own_{n}").over(w).alias(f"_run_{n}") for n in names))
    return own.join(ends, [*by, _RANGE]).select(*rows.columns, *((F.col(f"_run_{n}") + F.col(f"_off_{n}")).alias(n) for n in names))


def carried(rows: DataFrame, by: list[str], order: list[str], values: dict[str, Column], back: bool = False) -> DataFrame:
    """rows with the last value of each name that isn't null, at or before each row of the key; with back, the first at or after it."""
    names = list(values)
    at = ranged(rows.select("*", *(c.alias(f"_own_{n}") for n, c in values.items())), by, order)
    ways = [F.col(c).desc() for c in order] if back else order
    w = Window.partitionBy(*by, _RANGE).orderBy(*ways).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pick = F.min_by if back else F.max_by
    place = F.struct(*order)
    ends = at.groupBy(*by, _RANGE).agg(*(pick(f"_own_{n}", F.when(F.col(f"_own_{n}").isNotNull(), place)).alias(f"_end_{n}") for n in names))
    ends = ends.select(*by, _RANGE, *(F.last(f"_end_{n}", ignorenulls=True).over(_before(ends, by, back)).alias(f"_off_{n}") for n in names))
    own = at.select("*", *(F.last(f"_own_{n}", ignorenulls=True).over(w).alias(f"_run_{n}") for n in names))
    return own.join(ends, [*by, _RANGE]).select(*rows.columns, *(F.coalesce(f"_run_{n}", f"_off_{n}").alias(n) for n in names))


def chunked(rows: DataFrame, by: list[str], item: str, size: int) -> DataFrame:
    """by, chunk (from 0), items: the sorted items of each key in arrays of `size`; a key of any number of items is so many rows."""
    numbered = running(rows.select(*by, item), by, [item], {"_n": F.lit(1).cast("long")})
    return numbered.groupBy(*by, F.floor((F.col("_n") - 1) / size).alias("chunk")).agg(F.array_sort(F.collect_list(item)).alias("items"))
