"""Checks and bulk changes of the tables: duplicates, orphans, widths, purges, revocations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.limits import WIDTHS
from pulsegrid.functions.scalars import key_hash, utf16_len


def find_duplicates(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def find_orphans(table: DataFrame, column: str, parents: DataFrame, parent_column: str = "id") -> DataFrame:
    """Rows whose parent is missing; rows without a parent key have none to miss."""
    p = parents.select(F.col(parent_column).alias(column)).distinct()
    return table.where(F.col(column).isNotNull()).join(p, column, "left_anti").select(*table.columns)


def purge(table: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """The rows of table whose column is not among the ids of gone."""
    return table.join(gone.select(F.col("id").alias(column)).distinct(), column, "left_anti").select(*table.columns)


def purge_tenants(tables: dict[str, DataFrame], tenants: DataFrame) -> dict[str, DataFrame]:
    """All tables without the tenants (id) and what hangs from them."""
    lost = tables["series"].join(tenants.select(F.col("id").alias("tenant_id")), "tenant_id", "left_semi").select("id")
    out = {"tenants": purge(tables["tenants"], "id", tenants)}
    out |= {t: purge(tables[t], "tenant_id", tenants) for t in ("api_keys", "sources", "series")}
    return out | {"points": purge(tables["points"], "series_id", lost)}


def purge_sources(tables: dict[str, DataFrame], sources: DataFrame) -> dict[str, DataFrame]:
    lost = tables["series"].join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("id")
    return tables | {"sources": purge(tables["sources"], "id", sources), "series": purge(tables["series"], "source_id", sources), "points": purge(tables["points"], "series_id", lost)}


def apply_revocations(keys: DataFrame, revocations: DataFrame, at: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys with revoked_at set, revocations of no such key); revocations has api_key, and revoked_at unless at is given.

    Revoking again overwrites the time; of several revocations of one key the latest counts.
    """
    when = F.col("revoked_at") if at is None else F.lit(at).cast("timestamp")
    r = revocations.select(key_hash(F.col("api_key")).alias("key_hash"), when.alias("_at")).groupBy("key_hash").agg(F.max("_at").alias("_at"))
    new = keys.join(r, "key_hash", "left").withColumn("revoked_at", F.coalesce("_at", "revoked_at")).select(*keys.columns)
    return new, r.join(keys.select("key_hash"), "key_hash", "left_anti").select("key_hash")


def check_widths(table: DataFrame, name: str, key: str = "id") -> DataFrame:
    """Values over the width of their column: key, column, length."""
    checks = [F.when(utf16_len(F.col(c)) > w, F.struct(F.lit(c).alias("column"), utf16_len(F.col(c)).alias("length"))) for c, w in WIDTHS[name].items()]
    found = table.select(F.col(key).alias("key"), F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("f"))
    return found.select("key", "f.column", "f.length")
