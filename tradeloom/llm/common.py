"""Shared pieces of the text operators: session set-up, shared storage, batch helpers."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch.  Texts run to a hundred kilobytes, so batches stay small.
ARROW_ROWS = 1000
#: Characters kept of a plan's description, which Spark holds for every query of a session: jobs of hundreds of steps fill the driver with them.
PLAN_TEXT = 4000
#: Links from which a node counts as hot in ``components``.
HOT = 1000


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches small.

    Workers inherit PYTHONPATH from the context's environment.  On a cluster, ship the package with
    ``--py-files`` or install it on the nodes; then this path is simply not needed.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if spark.conf.get("spark.sql.maxPlanStringLength").rstrip("b") == "2147483632":  # Spark's own value: nobody has set it
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on a local master, where it is unset, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = getattr(spark.sparkContext, "_tradeloom_shared", None)
        if path is None:
            path = "file://" + tempfile.mkdtemp(prefix="tradeloom-")
            spark.sparkContext._tradeloom_shared = path
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tradeloom/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables of ``written`` that no later step reads."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for f in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(f).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def tidy(spark: SparkSession) -> None:
    """Between the steps of a long job: let Spark's cleaner delete shuffle files and broadcasts of steps that are done.

    The cleaner acts on what the driver's collector finds unreachable, by itself every half hour only (spark.cleaner.periodicGC.interval).
    """
    gc.collect()  # frames that Python still holds in cycles keep their plans
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


def held_out(id_col: str, parts: int, rest: int = 2) -> Column:
    """True where crc32 of the id as text leaves the remainder ``rest``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == rest, F.lit(False))


def byte_order(array: pa.Array) -> pa.Array:
    """A string column without nulls (null: empty) and in one chunk."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pc.fill_null(array.cast(pa.string()), "")


def distinct_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Split on ASCII white space.  Returns the distinct words, the word's number at each position, and row offsets.

    The empty string stands among the words wherever a text begins or ends with white space.
    """
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every row, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def by_batch(step: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function from a function of one batch; empty batches are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return run


def bit_table(slots: DataFrame, bits: int) -> Broadcast:
    """A table of so many bits, one set for each value of the only column (0 to bits - 1).  The driver gets bits / 8 bytes, however many rows.

    Keys hashed to slots make it a filter: what finds no bit is surely not among them, what finds one may be and is then joined or counted.
    """
    (slot,) = slots.columns
    words = slots.selectExpr(f"shiftright({slot}, 6) AS word", f"shiftleft(1L, CAST({slot} % 64 AS INT)) AS bit")
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return slots.sparkSession.sparkContext.broadcast(table)


def has_bit(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def components(links: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Smallest id reachable from each id that has a link: (id, component_id).

    Alternates large-star and small-star steps: every step replaces links by links to the smallest
    neighbour, so paths at least halve and the rounds grow with the logarithm of the longest path.
    Each round's links are written to the shared folder.  A null id or a link to itself is ignored.  Links of a node that has more
    than HOT of them stay where they are: such nodes are at most a HOT-th of all links, so their minima are broadcast.
    """

    def lowered(pairs: DataFrame, low: DataFrame) -> DataFrame:
        """pairs (u, v) with the m of u; low: (u, m, n)."""
        hot = F.broadcast(low.where(F.col("n") > HOT).select("u", F.col("m").alias("hot")))
        each = pairs.join(hot, "u", "left")
        cold = each.where("hot is null").join(low.where(F.col("n") <= HOT), "u")
        return each.where("hot is not null").select("u", "v", F.col("hot").alias("m")).union(cold.select("u", "v", "m"))

    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    last = None
    while True:
        # large-star: for each node, its larger neighbours are linked to its smallest neighbour or itself
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = written(lowered(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        # small-star: smaller neighbours and the node itself are linked to the smallest neighbour
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = lowered(large, low2).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(small.union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), name)
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_written(links.sparkSession, edges, large)
        edges = new
        if tuple(state) == last:
            break
        last = tuple(state)
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    )
