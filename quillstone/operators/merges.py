"""Changes to tables as functions of the old rows and the change: (old, delta) -> new.

The result is written as the table's next version; nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators.catalog import first_by


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows whose key is there already, or came earlier among the new ones, are left out."""
    fresh = first_by(new, keys, order).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those of equal key; keys of the new rows are distinct."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (kb_uid, name): the type is taken from the new row even if it is empty, aliases become the distinct union."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, (F.col("o.kb_uid") == F.col("n.kb_uid")) & (F.col("o.name") == F.col("n.name")), "full_outer")
    empty = F.array().cast("array<string>")
    there = F.col("n.name").isNotNull()
    return joined.select(
        F.coalesce("o.kb_uid", "n.kb_uid").alias("kb_uid"),
        F.coalesce("o.name", "n.name").alias("name"),
        F.when(there, F.col("n.entity_type")).otherwise(F.col("o.entity_type")).alias("entity_type"),
        F.array_distinct(F.concat(F.coalesce("o.aliases", empty), F.coalesce("n.aliases", empty))).alias("aliases"),
    )


def replace_by_source(old: DataFrame, new: DataFrame, source: list[str]) -> DataFrame:
    """All rows of the sources that the new rows have go; then the new ones come."""
    return old.join(new.select(*source).distinct(), source, "left_anti").unionByName(new.select(*old.columns))


def bulk_update(old: DataFrame, values: DataFrame, key: str, column: str) -> DataFrame:
    """Set a column where values has the key; a key that old lacks is an error, and nothing changes."""
    missing = [r[0] for r in values.join(old, key, "left_anti").select(key).limit(10).collect()]
    if missing:
        raise KeyError(f"no rows for {missing}")
    return old.join(values.select(key, F.col(column).alias("new_"), F.lit(True).alias("hit_")), key, "left").withColumn(column, F.when(F.col("hit_"), F.col("new_")).otherwise(F.col(column))).select(*old.columns)


def soft_delete(old: DataFrame, where: Column, now: Column) -> DataFrame:
    return old.withColumn("delete_time", F.when(where & F.col("delete_time").isNull(), now).otherwise(F.col("delete_time")))


def add_to_counter(old: DataFrame, deltas: DataFrame, key: str, counter: str, by: str) -> DataFrame:
    """Deltas are summed for each key before they meet the table."""
    total = deltas.groupBy(key).agg(F.sum(by).alias("delta_"))
    return old.join(total, key, "left").withColumn(counter, F.col(counter) + F.coalesce("delta_", F.lit(0))).drop("delta_")


def move(old: DataFrame, column: str, source: str, target: str) -> DataFrame:
    return old.withColumn(column, F.when(F.col(column) == source, target).otherwise(F.col(column)))


def swap(old: DataFrame, column: str, a: str, b: str) -> DataFrame:
    """Both ways in one pass; twice gives the old table."""
    return old.withColumn(column, F.when(F.col(column) == a, b).when(F.col(column) == b, a).otherwise(F.col(column)))


def copy_and_move(links: DataFrame, tables: list[DataFrame], source: str, target: str, column: str = "kb_uid", key: str = "file_uid") -> tuple[DataFrame, list[DataFrame]]:
    """The source's links beside the old ones as the target's, where those aren't there yet; rows of the tables go over to the target."""
    there = links.where(F.col(column) == target).select(key)
    copies = links.where(F.col(column) == source).join(there, key, "left_anti").withColumn(column, F.lit(target)).select(*links.columns)
    return links.unionByName(copies), [move(t, column, source, target) for t in tables]


def single_default(old: DataFrame, id_: str) -> DataFrame:
    return old.withColumn("is_default", F.col("id") == id_)


def delete_with_orphans(links: DataFrame, entities: DataFrame, file_uid) -> tuple[DataFrame, DataFrame]:
    """Links of a file go, and then the entities that no link names."""
    left = links.where(F.col("file_uid") != file_uid)
    return left, entities.join(left, F.col("uid") == F.col("entity_uid"), "left_semi")


def merge_non_zero(old: DataFrame, new: DataFrame, key: str, columns: list[str], always: list[str] = ()) -> DataFrame:
    """New values that are neither null, empty nor zero, compared as their type, win; those in always win in any case."""
    fresh = new.select(key, *(F.col(c).alias(f"new_{c}") for c in [*columns, *always]), F.lit(True).alias("hit_"))
    out = old.join(fresh, key, "left")
    for c in columns:
        v, kind = F.col(f"new_{c}"), new.schema[c].dataType
        given = F.size(v) > 0 if isinstance(kind, T.ArrayType) else v != (0 if isinstance(kind, T.NumericType) else "")
        out = out.withColumn(c, F.when(F.coalesce(given, F.lit(False)), v).otherwise(F.col(c)))
    for c in always:
        out = out.withColumn(c, F.when(F.col("hit_"), F.col(f"new_{c}")).otherwise(F.col(c)))
    return out.select(*old.columns)


def truncate_bytes(text: str, most: int = 65_535) -> Column:
    """The longest prefix of whole characters within that many UTF-8 bytes."""
    cut = F.substring(F.col(text).cast("binary"), 1, most)
    last = F.regexp_extract(F.hex(F.substring(cut, -3, 3)), "((?:F[0-7](?:[89AB][0-9A-F]){0,2}|E[0-9A-F](?:[89AB][0-9A-F])?|[CD][0-9A-F]))$", 1)
    whole = F.expr(f"octet_length({text})") <= most
    return F.when(whole, F.col(text)).otherwise(F.substring(cut, F.lit(1), (F.lit(most) - F.length(last) / 2).cast("int")).cast("string"))
