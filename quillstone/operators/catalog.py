"""Listing, paging, counting and joining catalog tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a page if none are asked for, and at most.
PAGE, LARGEST_PAGE = 10, 100


def page(df: DataFrame, size: int = PAGE, token: tuple[datetime, str] | None = None, where: Column | None = None, time: str = "update_time", id_: str = "uid") -> DataFrame:
    """size + 1 rows by (time, id) descending, from the token's row on; the last row is the next page's token.

    A filter and a limited sort: each partition hands on size + 1 rows, and no page reads the ones before it.
    """
    rows = df if where is None else df.where(where)
    if token:
        t, u = (F.lit(x) for x in token)
        rows = rows.where((F.col(time) < t) | ((F.col(time) == t) & (F.col(id_) <= u)))
    return rows.orderBy(F.col(time).desc(), F.col(id_).desc()).limit(min(size if size > 0 else PAGE, LARGEST_PAGE) + 1)


def forward(df: DataFrame, size: int, after: str | None = None, id_: str = "uid") -> DataFrame:
    """Rows by ascending id after the given one."""
    return (df if after is None else df.where(F.col(id_) > after)).orderBy(id_).limit(size)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each value of keys, the first in order; candidates are cut to one a partition before the shuffle."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn_ = 1").drop("rn_")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def any_status(text: str, column: str = "process_status") -> Column:
    """Of statuses with commas between any one; the empty text is no restriction."""
    wanted = [x.strip() for x in text.split(",") if x.strip()]
    return F.col(column).isin(*wanted) if wanted else F.lit(True)


def by_any_name(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose id, uid or one of whose aliases is among the names, each once."""
    asked = F.array(*map(F.lit, names))
    return df.where(F.col("id").isin(*names) | F.col("uid").isin(*names) | F.coalesce(F.arrays_overlap("aliases", asked), F.lit(False)))


def token_total(usage: str = "usage_metadata") -> Column:
    """Tokens of content and summary from a JSON text; missing counts are zero."""
    return sum((F.coalesce(F.get_json_object(usage, f"$.{part}.totalTokenCount").cast("bigint"), F.lit(0)) for part in ("content", "summary")), F.lit(0)).cast("long")


def counted(left: DataFrame, right: DataFrame, on: list[str], name: str, missing: int = 0) -> DataFrame:
    """left with the number of right's rows, counted before the join."""
    return left.join(right.groupBy(*on).agg(F.count("*").alias(name)), on, "left").withColumn(name, F.coalesce(name, F.lit(missing)).cast("long"))


def without(left: DataFrame, right: DataFrame, on) -> DataFrame:
    return left.join(right, on, "left_anti")


def sums_by(df: DataFrame, key: str, pairs: str) -> DataFrame:
    """For a map column: the sum for each of its keys."""
    return df.select(key, F.explode(pairs).alias("name", "value")).groupBy(key, "name").agg(F.sum("value").alias("total"))
