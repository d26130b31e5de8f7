"""Stored results: tagged values, versioned JSON, and what is refused on reading."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions and kinds that belong together.
KINDS = [(1, "invoice"), (1, "invoice_items"), (2, "packing_list")]
#: Types that are written as text; those of reading back must give the same text.
TEXT_TYPES = {"decimal": "decimal(38,18)", "date": "date", "datetime": "timestamp_ntz"}


def tagged(kind: Column, value: Column) -> Column:
    """struct(type, value): a value as text with its type; null has the type none."""
    return F.struct(F.when(value.isNull(), "none").otherwise(kind).alias("type"), value.cast("string").alias("value"))


def untagged(tag: Column) -> Column:
    """The text of a tagged value if it is one that a writer could have written, else null; so is that of type none."""
    kind, text = tag["type"], tag["value"]
    number = text.rlike(r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z") & text.try_cast("decimal(38,18)").isNotNull()
    day = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()
    ok = (
        (kind == "str")
        | ((kind == "int") & text.rlike(r"^(?:0|-?[1-9][0-9]*)\z"))
        | ((kind == "bool") & text.isin("true", "false"))
        | ((kind == "float") & text.try_cast("double").isNotNull() & ~F.upper(text).rlike("NAN|INF"))
        | ((kind == "decimal") & number)
        | ((kind == "date") & day)
        | ((kind == "datetime") & text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}") & text.try_cast("timestamp_ntz").isNotNull())
    )
    return F.when(ok, text)


def is_valid_tag(tag: Column) -> Column:
    return F.coalesce((tag["type"] == "none") & tag["value"].isNull(), F.lit(False)) | F.coalesce(untagged(tag).isNotNull(), F.lit(False))


def envelope(version: Column, kind: Column, result: Column) -> Column:
    """The JSON of a result; null where version and kind don't belong together."""
    fits = F.array_contains(F.array(*(F.lit(f"{v}/{k}") for v, k in KINDS)), F.concat_ws("/", version.cast("string"), kind))
    return F.when(fits, F.to_json(F.struct(version.alias("format_version"), kind.alias("result_type"), result.alias("result")), {"ignoreNullFields": "false"}))


def _strict(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _constant(name: str) -> None:
    raise ValueError(name)


@F.pandas_udf(T.BooleanType())
def is_strict_json(texts: pd.Series) -> pd.Series:
    """Whether a text is one JSON object without repeated keys, NaN or infinities.  from_json takes the last of equal keys."""

    def good(text: str | None) -> bool:
        try:
            return isinstance(json.loads(text, object_pairs_hook=_strict, parse_constant=_constant), dict)
        except (ValueError, TypeError, RecursionError):
            return False

    return texts.map(good)


def opened(df: DataFrame, text: str, result_type: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``result``, quarantined rows with ``code``) of stored JSON; result_type: the schema of the result, as DDL."""
    shape = f"format_version int, result_type string, result {result_type}"
    rows = df.withColumn("_strict", is_strict_json(F.col(text))).withColumn("_e", F.from_json(text, shape))
    fits = F.array_contains(F.array(*(F.lit(f"{v}/{k}") for v, k in KINDS)), F.concat_ws("/", F.col("_e.format_version").cast("string"), F.col("_e.result_type")))
    keys = F.array_sort(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))) == F.array(*map(F.lit, ["format_version", "result", "result_type"]))
    code = F.when(~F.col("_strict"), "NOT_STRICT_JSON").when(~F.coalesce(keys, F.lit(False)), "UNKNOWN_KEYS").when(~F.coalesce(fits, F.lit(False)), "UNKNOWN_KIND").when(F.col("_e.result").isNull(), "NO_RESULT")
    rows = rows.withColumn("code", code)
    good = rows.where("code is null").withColumn("result", F.col("_e.result")).drop("_strict", "_e", "code")
    return good, rows.where("code is not null").drop("_strict", "_e")


def foreign(results: DataFrame, id_col: str, candidates: str) -> Column:
    """Whether any candidate of a result names another document as its source, or none, or a confidence that isn't finite."""
    odd = lambda c: ~c["source_document_id"].eqNullSafe(F.col(id_col)) | F.coalesce(F.isnan(c["confidence"]) | (F.abs(c["confidence"]) == float("inf")), F.lit(False))
    return F.coalesce(F.exists(candidates, odd), F.lit(False))


def row_code(active: Column, kind: Column, document_type: Column) -> Column:
    """Why a stored row can't be taken: its flag is neither 0 nor 1, or its kind isn't the document's family."""
    family = (kind == "packing_list").eqNullSafe(document_type == "PACKING_LIST")
    return F.when(~F.coalesce(active.isin(0, 1), F.lit(False)), "BAD_ACTIVE_FLAG").when(~family, "WRONG_FAMILY")


def append_code(hash_: Column, stored_hash: Column, status: Column, expected: Column, active_ids: Column) -> Column:
    """Why a new attempt isn't appended: source changed, unknown status, several active attempts, or another than expected."""
    return (
        F.when(~hash_.eqNullSafe(stored_hash), "SOURCE_CHANGED")
        .when(~F.coalesce(status.isin("EXTRACTED", "NEEDS_REVIEW", "FAILED"), F.lit(False)), "BAD_STATUS")
        .when(F.size(active_ids) > 1, "SEVERAL_ACTIVE")
        .when(~expected.eqNullSafe(F.try_element_at(active_ids, F.lit(1))), F.when(F.size(active_ids) == 0, "NO_ACTIVE").when(expected.isNull(), "REPLACEMENT_REQUIRED").otherwise("STALE_ACTIVE"))
    )
