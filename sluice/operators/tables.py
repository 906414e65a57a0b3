"""Table maintenance: upserts, latest rows, state folds, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial maxima go through the shuffle, not whole groups."""
    rest = [c for c in rows.columns if c not in keys]
    chosen = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return rows.groupBy(*keys).agg(chosen).select(*keys, "r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces rows of old with the same keys."""
    return old.join(new, keys, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows whose keys are already there are left out."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def least_wins(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(value).alias(value))


def retained(plans: DataFrame, events: DataFrame, before: Column) -> DataFrame:
    """plans (event_id, recorded_at) with whether retention drops them: recorded before, or without their event."""
    known = events.select("event_id").distinct().withColumn("known", F.lit(True))
    out = plans.join(known, "event_id", "left")
    reason = F.when(F.col("known").isNull(), "orphan").when(F.col("recorded_at") < before, "expired")
    return out.withColumn("reason", reason).drop("known")
