"""Ordered work on keys of any size: ranges of rows instead of one window per key.

A table is sorted over all partitions; what a row needs of earlier rows of its key comes from its own range, or from the few rows that are
handed on at the borders. A border is crossed by one key at most, so what is handed on has no more rows than there are ranges.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.monitor import shared_folder

#: Rows of a key up to which an ordinary window or fold takes it.
FEW = 100_000


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """df as a written table, with _at: numbers that rise in that order; _range: the range that a row is in. Equal rows may lie in any order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    return kept(rows.withColumn("_range", F.shiftright("_at", 33)), "ordered")


def _borders(rows: DataFrame, by: tuple[str, ...], value: Column, over) -> DataFrame:
    """by, _range and _border: `over` of the ranges' values before each range, where there are any."""
    per = rows.groupBy(*by, "_range").agg(value.alias("_value"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(per.withColumn("_border", over("_value").over(before)).where("_border IS NOT NULL").drop("_value"))  # a row for each range at most


def last_before(rows: DataFrame, by: tuple[str, ...], value: str, name: str) -> DataFrame:
    """rows of in_order() with `name`: the last value that is not null in earlier rows of the key."""
    own = Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_at")))
    borders = _borders(rows, by, last, lambda c: F.last(c, ignorenulls=True))
    joined = rows.join(borders, [*by, "_range"], "left")
    return joined.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(own), "_border")).drop("_border")


def running(rows: DataFrame, by: tuple[str, ...], value: str, name: str, over=F.sum) -> DataFrame:
    """rows of in_order() with `name`: the sum (or `over`: F.max, F.min) of value up to and with this row, of its key."""
    own = Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(_borders(rows, by, over(value), over), [*by, "_range"], "left")
    here, past = over(value).over(own), F.col("_border")
    joined = joined.withColumn("_here", here)
    both = F.col("_here") + F.coalesce(past, F.lit(0)) if over is F.sum else F.greatest("_here", past) if over is F.max else F.least("_here", past)
    return joined.withColumn(name, both).drop("_border", "_here")


def running_sum(rows: DataFrame, by: tuple[str, ...], value: str, name: str) -> DataFrame:
    return running(rows, by, value, name)


def split_by_size(df: DataFrame, by: tuple[str, ...], few: int = FEW) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose keys have at most `few`, and the others; None if there are none. Null keys count as few."""
    large = kept(df.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > few).select(*by), "large-keys")
    if large.isEmpty():
        return df, None
    return df.join(large, list(by), "left_anti"), df.join(large, list(by), "left_semi")


def with_previous_row(df: DataFrame, by: tuple[str, ...], order: list[str], values: dict[str, str], few: int = FEW) -> DataFrame:
    """df with the row before in its key: new column -> column whose value there it has (null in the first row). Keys of up to `few` rows, and null keys, take a window."""
    w = Window.partitionBy(*by).orderBy(*order)
    small, large = split_by_size(df, by, few)
    out = small.withColumns({new: F.lag(old).over(w) for new, old in values.items()})
    if large is None:
        return out
    rows = in_order(large.withColumn("_row", F.struct(*(F.col(c).alias(n) for n, c in values.items()))), *by, *order)
    rows = last_before(rows, by, "_row", "_past")
    return out.unionByName(rows.withColumns({n: F.col("_past")[n] for n in values}).drop("_row", "_past", "_at", "_range"))
