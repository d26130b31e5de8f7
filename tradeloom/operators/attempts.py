"""Extraction attempts: an append-only history with one active attempt per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(attempts: DataFrame, key: str, id_col: str, order: list[str], failed: Column) -> DataFrame:
    """Adds attempt_number, active_id (the last attempt so far that did not fail), supersedes and is_active.

    A failed attempt is history only: the attempt before it stays active, and it supersedes nothing.
    """
    w = Window.partitionBy(key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = attempts.withColumn("attempt_number", F.row_number().over(w)).withColumn("active_id", F.last(F.when(~failed, F.col(id_col)), ignorenulls=True).over(so_far))
    before = F.lag("active_id").over(w)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    final = F.last(F.when(~failed, F.col(id_col)), ignorenulls=True).over(whole)
    return out.withColumn("supersedes", F.when(~failed, before)).withColumn("is_active", F.coalesce(F.col(id_col) == final, F.lit(False)))


def active(attempts: DataFrame, key: str, id_col: str, order: list[str], failed: Column) -> DataFrame:
    """(key, active_id, n_attempts): one row per document.  A partial maximum finds the active attempt: no sort, no hot key."""
    latest = F.max(F.when(~failed, F.struct(*order, F.col(id_col).alias("_id"))))
    return attempts.groupBy(key).agg(latest.getField("_id").alias("active_id"), F.count("*").alias("n_attempts"))


def judged(requests: DataFrame, key: str, id_col: str, order: list[str], failed: Column, expected: Column) -> DataFrame:
    """Adds current_id and ``decision``: a request is accepted if it names the active attempt before it (null for the first)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    now = F.last(F.when(~failed, F.col(id_col)), ignorenulls=True).over(w)
    out = requests.withColumn("current_id", now)
    code = F.when(expected.eqNullSafe(F.col("current_id")), "ACCEPTED").when(F.col("current_id").isNull(), "NO_ACTIVE").when(expected.isNull(), "REPLACEMENT_REQUIRED").otherwise("STALE_ACTIVE")
    return out.withColumn("decision", code)


def family_fits(result_type: Column, document_type: Column) -> Column:
    """Packing results belong to packing lists, invoice results to any other document."""
    return (result_type == "packing_list") == (document_type == "PACKING_LIST")


def envelope(version: Column, kind: Column, result: Column) -> Column:
    """The stored JSON of a result: versioned, nulls kept."""
    return F.to_json(F.struct(version.alias("schema_version"), kind.alias("result_type"), result.alias("result")), {"ignoreNullFields": "false"})


def status(candidates: DataFrame, key: str, state: str) -> DataFrame:
    """FAILED before NEEDS_REVIEW before EXTRACTED."""
    rank = F.when(F.col(state) == "FAILED", 2).when(F.col(state) == "NEEDS_REVIEW", 1).otherwise(0)
    return candidates.groupBy(key).agg(F.max(rank).alias("_r")).select(key, F.element_at(F.array(*map(F.lit, ["EXTRACTED", "NEEDS_REVIEW", "FAILED"])), F.col("_r") + 1).alias("status"))
