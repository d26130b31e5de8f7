"""Order-free fingerprints of tables, gathered in the pass that reads or writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def row_code(columns: list[str]) -> Column:
    """60 bits of a row's digest: each field with its length, so that neighbouring fields can't trade characters; null differs from blank."""
    texts = [F.col(c).cast("string") for c in columns]
    whole = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, 15), 16, 10).cast("bigint")


def aggregates(columns: list[str]) -> list[Column]:
    """rows, code_sum and code_xor: equal for equal rows in any order; a changed, lost or repeated row changes them."""
    code = row_code(columns)
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(code.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("code_sum"), F.coalesce(F.bit_xor(code), F.lit(0).cast("bigint")).alias("code_xor")]


def observed(df: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, Observation]:
    """df, and what its fingerprint will be once an action has read it; no scan of its own."""
    seen = Observation(name)
    return df.observe(seen, *aggregates(columns)), seen


def unchanged(before: Observation, after: Observation) -> bool:
    """Whether two observed passes saw the same rows.  Waits for both."""
    return before.get == after.get
