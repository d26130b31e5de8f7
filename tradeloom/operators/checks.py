"""Cross-document checks, their statuses, and readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Statuses in order of report.
STATUSES = ["CRITICAL", "ERROR", "WARNING", "MISSING", "NEEDS_REVIEW", "INSUFFICIENT_EVIDENCE", "PASS", "NOT_CHECKED"]
MONEY = "decimal(18,4)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def within(a: Column, b: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """Equal up to the larger of two tolerances; null if either is null."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute).cast(MONEY), F.lit(relative).cast("decimal(10,6)") * F.abs(b))


def outcome(ok: Column, otherwise: str = "ERROR") -> Column:
    """PASS only where a comparison was made and held."""
    return F.when(ok.isNull(), "INSUFFICIENT_EVIDENCE").when(ok, "PASS").otherwise(otherwise)


def consistent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n_values, status): whether all documents of a dossier agree on a value."""
    out = df.groupBy(*keys).agg(F.countDistinct(value).alias("n_values"))
    return out.withColumn("status", F.when(F.col("n_values") == 0, "MISSING").when(F.col("n_values") == 1, "PASS").otherwise("ERROR"))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def matched(left: DataFrame, right: DataFrame, id_left: str, id_right: str, levels: list[tuple[str, list[str]]]) -> DataFrame:
    """(id_left, id_right, match_type): a cascade of equi-joins, each over what the ones before left unmatched.

    An item matches the first free counterpart of its key, by id, so matches are one to one; the rest is UNMATCHED.
    Both sides go through the levels as one table, so the plan grows by one shuffle a level, not by all levels before it.  Rows that
    take no part in a level (matched before, null in a key or in the id) are dealt by a hash of their id.
    """
    every = list(dict.fromkeys(k for _, keys in levels for k in keys))
    null = lambda df, i: F.lit(None).cast(df.schema[i].dataType)
    a = left.select(F.lit(True).alias("_left"), F.col(id_left).alias("_a"), null(right, id_right).alias("_b"), *every)
    rows = a.union(right.select(F.lit(False), null(left, id_left), F.col(id_right), *every)).withColumn("_match", F.lit(None).cast("string"))
    for level, keys in levels:
        own = F.when(F.col("_left"), F.col("_a").isNotNull()).otherwise(F.col("_b").isNotNull())
        free = own & F.col("_match").isNull() & reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
        cells = [f"_c{i}" for i in range(len(keys) + 1)]
        rows = rows.withColumn("_free", free).withColumns({c: F.when(F.col("_free"), F.col(k)) for c, k in zip(cells, keys)})
        rows = rows.withColumn(cells[-1], F.when(~F.col("_free"), F.xxhash64("_a", "_b"))).repartition(*cells)
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*cells, "_left").orderBy("_a", "_b")))
        pair = Window.partitionBy(*cells, "_k")
        rows = rows.withColumn("_pa", F.max(F.when(F.col("_free"), F.col("_a"))).over(pair)).withColumn("_pb", F.max(F.when(F.col("_free"), F.col("_b"))).over(pair))
        hit = F.col("_free") & F.col("_pa").isNotNull() & F.col("_pb").isNotNull()
        rows = rows.select("_left", "_a", F.when(hit, F.col("_pb")).otherwise(F.col("_b")).alias("_b"), *every, F.when(hit, F.lit(level)).otherwise(F.col("_match")).alias("_match"))
    return rows.where("_left").select(F.col("_a").alias(id_left), F.col("_b").alias(id_right), F.coalesce("_match", F.lit("UNMATCHED")).alias("match_type"))


def results(rules: DataFrame, checked: DataFrame, keys: list[str]) -> DataFrame:
    """Every rule with its status; a rule without a result is NOT_CHECKED."""
    return rules.join(checked, keys, "left").withColumn("status", F.coalesce("status", F.lit("NOT_CHECKED")))


def counted(rules: DataFrame, checked: DataFrame) -> DataFrame:
    """``summary`` of ``results`` by check: statuses are counted before they meet the rules, as a check's rows would all meet in one task."""
    some = checked.groupBy("check", "status").agg(F.count("*").alias("n"))
    rows = results(rules, some, ["check"]).groupBy("check", "status").agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))
    return rows.withColumn("place", _place())


def _place() -> Column:
    return F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")).cast("int")


def summary(checked: DataFrame) -> DataFrame:
    """(check, status, n, place): counts in order of report."""
    return checked.groupBy("check", "status").agg(F.count("*").alias("n")).withColumn("place", _place())


def readiness(checked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lane_a, lane_b, readiness): a critical check that failed or was not made blocks.

    checked: (keys, lane 'A' or 'B', status, critical).
    """
    block = F.when(F.col("status").isin("ERROR", "MISSING") | (F.col("critical") & F.col("status").isin("NOT_CHECKED", "INSUFFICIENT_EVIDENCE")), 2).when(F.col("status") != "PASS", 1).otherwise(0)
    name = lambda r: F.element_at(F.array(*map(F.lit, ["READY", "OPEN", "BLOCK"])), r + 1)
    out = checked.groupBy(*keys).agg(F.max(F.when(F.col("lane") == "A", block)).alias("a"), F.max(F.when(F.col("lane") == "B", block)).alias("b"))
    a, b = F.coalesce("a", F.lit(2)), F.coalesce("b", F.lit(2))
    return out.select(*keys, name(a).alias("lane_a"), name(b).alias("lane_b"), name(F.greatest(a, b)).alias("readiness"))


def released(findings: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Adds ``released``: a named exception for a finding and snapshot.  The finding itself stays."""
    ex = exceptions.select("finding_id", "snapshot_hash", F.lit(True).alias("released")).distinct()
    return findings.join(ex, ["finding_id", "snapshot_hash"], "left").withColumn("released", F.coalesce("released", F.lit(False)))


def stale(outcomes: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Adds ``stale``: whether the inputs changed since an outcome was made."""
    now = snapshots.select(key, F.col("snapshot_hash").alias("_now"))
    return outcomes.join(now, key, "left").withColumn("stale", ~F.col("snapshot_hash").eqNullSafe(F.col("_now"))).drop("_now")


def arrival_policy(df: DataFrame) -> DataFrame:
    """Which source fills the declared weight of a shipment, and what stays open.

    df: mode, an_weight, transport_weight, declared_weight.  The arrival notice decides; a different or missing waybill remains a
    finding by air, and by sea voids the value; without an arrival notice all is blocked.
    """
    an, other, said = F.col("an_weight"), F.col("transport_weight"), F.col("declared_weight")
    agree = an.eqNullSafe(other)
    value = F.when(F.col("mode") == "AIR", an).when(F.col("mode") == "SEA", F.when(agree, an))
    out = df.withColumn("required_weight", value)
    out = out.withColumn("outcome_a", F.when(value.isNull(), "NOT_CHECKED").when(value == said, "PASS").otherwise("FAIL"))
    out = out.withColumn("outcome_b", F.when(an.isNull(), "BLOCK").when(agree, "CLEAR").otherwise(F.when(F.col("mode") == "SEA", "BLOCK").otherwise("OPEN")))
    return out.withColumn("outcome_c", F.when((F.col("outcome_a") == "PASS") & (F.col("outcome_b") == "CLEAR"), "READY").otherwise("BLOCK"))


#: Gates that an arrival notice must pass; nothing replaces it where one fails.
GATES = {"an_id": "ARRIVAL_NOTICE_MISSING", "same_shipment": "WRONG_SHIPMENT", "scope": "SCOPE_UNCLEAR", "revision": "REVISION_UNCLEAR", "weight_kind": "WEIGHT_KIND_UNCLEAR", "unit": "UNIT_UNCLEAR"}


def arrival_gates(df: DataFrame, places: DataFrame) -> DataFrame:
    """Adds loading_code, blocks (all reasons, in the order of GATES) and gate, BLOCK or CLEAR.

    df: the columns of GATES (null or false: not given) with mode and loading_place.  By sea the loading place must be in
    the catalog ``places`` (place, code), written exactly so; no other port stands in for it.
    """
    out = df.join(places.select(F.col("place").alias("loading_place"), F.col("code").alias("_code")).dropDuplicates(["loading_place"]), "loading_place", "left")
    out = out.withColumn("loading_code", F.when(F.col("mode") == "SEA", F.col("_code"))).drop("_code")
    open_ = [F.when(~F.coalesce(F.col(c), F.lit(False)) if c == "same_shipment" else F.col(c).isNull(), code) for c, code in GATES.items()]
    sea = F.when((F.col("mode") == "SEA") & F.col("loading_code").isNull(), "LOADING_PLACE_UNMAPPED")
    return out.withColumn("blocks", F.array_compact(F.array(*open_, sea))).withColumn("gate", F.when(F.size("blocks") > 0, "BLOCK").otherwise("CLEAR"))


def overlaid(extracted: DataFrame, corrections: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The last correction of a value, else the extracted one; ``corrected`` tells which."""
    last = corrections.groupBy(*keys).agg(F.max_by(value, order).alias("_new"))
    out = extracted.join(last, keys, "left").withColumn("corrected", F.col("_new").isNotNull())
    return out.withColumn(value, F.coalesce("_new", value)).drop("_new")
