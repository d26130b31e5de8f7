"""Window work on keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket, about: a key's rows are dealt to buckets of neighbouring ids, each sorted by one task.
ROWS = 100_000


def bucket_span(df: DataFrame, id_col: str, rows: int = ROWS) -> int:
    """How far apart the ids of a bucket may be, so that it holds about so many rows whether ids are dense or sparse.  One pass over the ids."""
    low, high, n = df.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()
    return max(1, (high - low + 1) * rows // n) if n else 1


def lagged(df: DataFrame, key: str, id_col: str, value: str, name: str, span: int | None = None) -> DataFrame:
    """df with the value of the row before, by id within the key; rows without one are left out, and so are null keys and ids.

    Equals a lag over the key.  A hot key is cut into buckets of ids; only a bucket's first row looks for its value elsewhere, in a table of
    one row a bucket.
    """
    df = df.where(F.col(key).isNotNull() & F.col(id_col).isNotNull())
    rows = df.withColumn("_bucket", F.floor(F.col(id_col) / (span or bucket_span(df, id_col))))
    w = Window.partitionBy(key, "_bucket").orderBy(id_col)
    near = rows.withColumn(name, F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = rows.groupBy(key, "_bucket").agg(F.max_by(value, id_col).alias("_last"))
    last = last.withColumn("_last", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket")))
    out = near.join(last.where(F.col("_last").isNotNull()), [key, "_bucket"], "left")
    out = out.withColumn(name, F.when(F.col("_first"), F.col("_last")).otherwise(F.col(name)))
    return out.where(F.col(name).isNotNull()).select(*df.columns, name)


def predecessors(df: DataFrame, key: str, id_col: str, name: str, span: int | None = None) -> DataFrame:
    """(key, id, name): each integer id with the one before it among the rows of its key, if there is one."""
    return lagged(df.select(key, id_col), key, id_col, id_col, name, span)
