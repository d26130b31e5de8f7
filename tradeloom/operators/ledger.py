"""An append-only table of attempts: competing requests, one winner a version, batches that may be replayed; and chained audit events.

A batch of requests is judged against all earlier batches and written to a folder of its own, which a replay writes anew with the same
rows.  Nothing is updated: an attempt stops being active because a later one was accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUSES = ["EXTRACTED", "NEEDS_REVIEW", "FAILED"]
ATTEMPT = "document_id string, attempt_id string, seq bigint, status string, decision string, attempt_number bigint, supersedes string, activates boolean"


def state(history: DataFrame) -> DataFrame:
    """(document_id, active_id, attempts): the last accepted attempt of each document that did not fail, by partial maxima."""
    kept = history.where("decision = 'ACCEPTED'")
    latest = F.max(F.when(F.col("activates"), F.struct("attempt_number", "attempt_id")))
    return kept.groupBy("document_id").agg(latest["attempt_id"].alias("active_id"), F.max("attempt_number").alias("attempts"))


def judged(requests: DataFrame, sources: DataFrame, now: DataFrame) -> DataFrame:
    """ATTEMPT rows of requests (document_id, attempt_id, seq, expected_id, source_hash, status), each with its decision.

    sources: (document_id, source_hash) as stored; now: ``state``.  Requests of a document are taken in order of seq, ties by attempt_id; each
    must name the attempt active at its turn, null if there is none.  A failed attempt counts but stays history: what was active stays so.
    A document's requests of one batch are folded in one row, so batches bound them; documents and batches may be any number.
    Null or unknown documents, changed sources and unknown statuses are refused and take no turn; a repeated attempt_id is refused after its first.
    """
    known = sources.select("document_id", F.col("source_hash").alias("_stored")).where("document_id is not null").dropDuplicates(["document_id"])
    rows = requests.join(known, "document_id", "left").join(now, "document_id", "left")
    again = F.row_number().over(Window.partitionBy("document_id", "attempt_id").orderBy("seq")) > 1
    refusal = (
        F.when(F.col("_stored").isNull(), "SOURCE_NOT_FOUND")
        .when(~F.col("source_hash").eqNullSafe(F.col("_stored")), "SOURCE_CHANGED")
        .when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "BAD_STATUS")
        .when(again | F.col("attempt_id").isNull(), "REPEATED_ATTEMPT")
    )
    turn = F.struct("seq", "attempt_id", "expected_id", "status", refusal.alias("refusal"))
    grouped = rows.withColumn("_turn", turn).groupBy("document_id").agg(F.sort_array(F.collect_list("_turn")).alias("turns"), F.first("active_id").alias("active_id"), F.first("attempts").alias("attempts"))
    kind = "struct<attempt_id:string,seq:bigint,status:string,decision:string,attempt_number:bigint,supersedes:string,activates:boolean>"
    start = F.struct(F.col("active_id").alias("active"), F.coalesce("attempts", F.lit(0).cast("bigint")).alias("n"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        stale = F.when(acc["active"].isNull(), "NO_ACTIVE").when(t["expected_id"].isNull(), "REPLACEMENT_REQUIRED").otherwise("STALE_ACTIVE")
        decision = F.coalesce(t["refusal"], F.when(~t["expected_id"].eqNullSafe(acc["active"]), stale), F.lit("ACCEPTED"))
        ok, good = decision == "ACCEPTED", t["status"] != "FAILED"
        one = F.struct(
            t["attempt_id"].alias("attempt_id"), t["seq"].cast("bigint").alias("seq"), t["status"].alias("status"), decision.alias("decision"), F.when(ok, acc["n"] + 1).alias("attempt_number"), F.when(ok & good, acc["active"]).alias("supersedes"), (ok & F.coalesce(good, F.lit(False))).alias("activates")
        )
        return F.struct(F.when(ok & good, t["attempt_id"]).otherwise(acc["active"]).alias("active"), (acc["n"] + F.when(ok, 1).otherwise(0)).cast("bigint").alias("n"), F.concat(acc["out"], F.array(one.cast(kind))).alias("out"))

    folded = F.aggregate("turns", start, step)
    return grouped.select("document_id", F.inline(folded["out"]))


def read(spark: SparkSession, path: str, but: int | None = None) -> DataFrame:
    """All attempts under the path with their batch, without those of one batch."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return spark.createDataFrame([], f"{ATTEMPT}, batch bigint")
    out = spark.read.schema(f"{ATTEMPT}, batch bigint").option("basePath", path).parquet(path)
    return out if but is None else out.where(F.col("batch") != but)


def append(spark: SparkSession, path: str, requests: DataFrame, sources: DataFrame, batch: int) -> None:
    """Judges a batch of requests against the batches before it and writes all decisions to ``batch=<number>``.

    Batches are numbered in order and written by one writer at a time, as ``foreachBatch`` does.  A replay of the last batch changes nothing.
    """
    before = read(spark, path).where(F.col("batch") < batch)
    judged(requests, sources, state(before)).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def history(attempts: DataFrame) -> DataFrame:
    """Accepted attempts, each with is_active: whether it is the one that is active now."""
    now = state(attempts).select("document_id", "active_id")
    kept = attempts.where("decision = 'ACCEPTED'").join(now, "document_id")
    return kept.withColumn("is_active", F.coalesce(F.col("attempt_id") == F.col("active_id"), F.lit(False))).drop("active_id")


def chained(events: DataFrame, key: str, order: list[str], content: Column) -> DataFrame:
    """Adds link and previous: the digest of an event's content, and that of the one before it in its key, which together are its entry's digest.

    An entry's ``entry_hash`` covers its content and its predecessor's content digest, so that a changed, lost or inserted event breaks
    the entry after it, and the place is told by comparing neighbours alone; a key's events are never folded one by one.
    """
    w = Window.partitionBy(key).orderBy(*order)
    out = events.withColumn("link", F.sha2(content.cast("binary"), 256))
    out = out.withColumn("previous", F.coalesce(F.lag("link").over(w), F.lit("")))
    return out.withColumn("entry_hash", F.sha2(F.concat("previous", F.lit(":"), "link").cast("binary"), 256)).drop("link", "previous")


def broken(entries: DataFrame, key: str, order: list[str], content: Column) -> DataFrame:
    """Entries of ``chained`` that don't follow from their content and their predecessor's: what was changed, and what comes after a gap."""
    w = Window.partitionBy(key).orderBy(*order)
    out = entries.withColumn("_link", F.sha2(content.cast("binary"), 256))
    want = F.sha2(F.concat(F.coalesce(F.lag("_link").over(w), F.lit("")), F.lit(":"), "_link").cast("binary"), 256)
    return out.withColumn("_want", want).where(~F.col("entry_hash").eqNullSafe(F.col("_want"))).drop("_link", "_want")
