"""Continuous intake: duplicates within a watermark, and the attempt state of each document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tradeloom.operators import ledger
from tradeloom.operators.storage import work_dir


def deduplicated(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first event of each key.  State lasts as long as the watermark: later repeats pass again."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def run_once(spark: SparkSession, path: str, delay: str = "3650 days", arrivals: Column | None = None) -> DataFrame:
    """Reads all that is there as a stream, writes the deduplicated events and returns them as a table.

    arrivals: how often a client sends each event; once by default.
    """
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + f"[{path[-1]}]")  # a glob: one file or a folder
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if arrivals is not None:
        events = events.withColumn("_sent", F.explode(F.sequence(F.lit(1), arrivals))).drop("_sent")
    out = deduplicated(events.withColumn("second", F.date_trunc("second", "ts")), ["user_id", "event_type", "second"], "ts", delay)
    target = work_dir(spark, "intake")
    query = out.select("user_id", "event_type", "second").writeStream.format("parquet").option("checkpointLocation", f"{target}/state").option("path", f"{target}/data").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("user_id bigint, event_type string, second timestamp").parquet(f"{target}/data")


class Attempts(StatefulProcessor):
    """Numbers the attempts of a document and keeps the last one that did not fail, across micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attempts", "n bigint, active bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, active = (int(x) if x is not None else None for x in (self.state.get() if self.state.exists() else (0, None)))
        for batch in rows:
            out = []
            for r in batch.sort_values(["ts", "event_id"]).itertuples():
                n += 1
                before = active
                if r.event_type != "error":
                    active = int(r.event_id)
                out.append((key[0], int(r.event_id), n, active, before if r.event_type != "error" else None))
            yield pd.DataFrame(out, columns=["user_id", "event_id", "attempt_number", "active_id", "supersedes"]).astype({"active_id": "Int64", "supersedes": "Int64"})
        self.state.update((n, active))

    def close(self) -> None:
        pass


def attempt_state(events: DataFrame) -> DataFrame:
    """(user_id, event_id, attempt_number, active_id, supersedes) of a stream; needs the RocksDB state store."""
    return events.groupBy("user_id").transformWithStateInPandas(Attempts(), "user_id bigint, event_id bigint, attempt_number bigint, active_id bigint, supersedes bigint", "Append", "None")


def append_stream(requests: DataFrame, sources: Callable[[], DataFrame], path: str, checkpoint: str) -> None:
    """Appends a stream of requests to the attempts under the path, all that is there, and returns.

    Every micro-batch is judged against the sources as they are then.  A batch that a failure makes Spark repeat writes its own
    folder anew, and a later call with the same checkpoint goes on behind the last batch, so each request is judged once.
    """
    spark = requests.sparkSession

    def judge(batch: DataFrame, number: int) -> None:
        ledger.append(spark, path, batch, sources(), number)

    requests.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
