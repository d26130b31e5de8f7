"""Fields: values next to labels, and one value per field from conflicting candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions import dictionaries as d
from tradeloom.functions import lexical
from tradeloom.operators import labels

def lines(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line: adds ``line`` (from 0), ``content``, and the lines ``before`` and ``after`` it."""
    every = F.split(text_col, r"\R")
    around = F.transform(every, lambda x, i: F.struct(i.alias("line"), x.alias("content"), F.get(every, i - 1).alias("before"), F.get(every, i + 1).alias("after")))
    return pages.select(*[c for c in pages.columns if c != text_col], F.inline(around))


def labelled_values(rows: DataFrame, aliases: dict[str, list[str]] = d.HEADER_ALIASES) -> DataFrame:
    """(... , place, path, raw_value, confidence): every ``LABEL: value`` of the lines that ``lines`` gives.

    A value runs up to the next label of its line.  A label that stands alone on its line is that of the next line, unless this is a
    label or blank; that line is a value then and no longer searched.  A value that begins with = is kept whole and yields no value later.
    """
    sole = lambda x: (F.size(x) == 1) & x[0]["path"].isNotNull() & (x[0]["raw_value"] == "")
    texts = {k: labels.marked(F.col(c), aliases) for k, c in (("_here", "content"), ("_up", "before"), ("_down", "after"))}
    out = lexical.once(rows, **texts)
    is_value = lambda mark, text: F.coalesce(~labels.is_label(F.col(mark)) & (lexical.trim(F.col(text)) != ""), F.lit(False))
    taken = F.coalesce(sole(labels.found(F.col("_up"), aliases)), F.lit(False)) & is_value("_here", "content")
    out = lexical.once(out, _found=F.when(~taken, labels.found(F.col("_here"), aliases)))
    below = F.when(sole(F.col("_found")) & is_value("_down", "after"), lexical.trim(F.col("after")))
    out = out.withColumn("_below", below)
    kept = [c for c in rows.columns if c not in ("before", "after")]
    out = out.select(*kept, F.posexplode("_found").alias("place", "_f"), "_below")
    value = F.when(F.col("_f.raw_value") == "", F.col("_below")).otherwise(F.col("_f.raw_value"))
    out = out.select(*kept, "place", "_f.path", value.alias("raw_value"), "_f.confidence")
    return out.where("path is not null and raw_value <> ''")


def neighbours(cells: DataFrame, aliases: dict[str, list[str]] = d.HEADER_ALIASES) -> DataFrame:
    """(document_id, sheet, row, col, path, raw_value, confidence, value_row, value_col) of labels in cells.

    ``LABEL: value`` in a cell gives that value.  A label alone gives the first cell that isn't blank up to three columns to the right, unless a
    label comes first; else one up to two rows below, unless a label comes first.
    """
    from tradeloom.operators import grids

    rows = grids.with_values(grids.rows(cells, headers=aliases))
    return rows.select("document_id", "sheet", "row", F.inline("found"))


def consolidated(candidates: DataFrame, keys: list[str], value: str, confidence: str, seq: str) -> DataFrame:
    """One value per key: null if several differ; else that of the highest confidence, the earliest among equals.

    Unparseable (null) candidates count as issues but do not void a parseable one.
    """
    out = candidates.groupBy(*keys).agg(
        F.countDistinct(value).alias("distinct_values"),
        F.count_if(F.col(value).isNull()).alias("unparseable"),
        F.max_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.struct(F.col(confidence), -F.col(seq)))).alias("best"),
    )
    code = F.when(F.col("distinct_values") > 1, "CONFLICTING_VALUES").when(F.col("distinct_values") == 0, "UNPARSEABLE").when(F.col("unparseable") > 0, "PARTLY_UNPARSEABLE")
    return out.withColumn("value", F.when(F.col("distinct_values") == 1, F.col("best"))).withColumn("code", code).drop("best")


def vetoed(candidates: DataFrame, keys: list[str], value: str, blocked: str) -> DataFrame:
    """The stricter policy: any blocked evidence, or a second value, leaves the field empty."""
    out = candidates.groupBy(*keys).agg(F.countDistinct(value).alias("distinct_values"), F.coalesce(F.bool_or(blocked), F.lit(False)).alias("is_blocked"), F.min(value).alias("only"))
    return out.withColumn("value", F.when((F.col("distinct_values") == 1) & ~F.col("is_blocked"), F.col("only"))).drop("only")


def distinct_list(candidates: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """(keys, values): distinct values in order of first occurrence.  Each value is aggregated before it is listed."""
    first = candidates.groupBy(*keys, value).agg(F.min(seq).alias("_seq"))
    pairs = F.sort_array(F.collect_list(F.struct("_seq", value)))
    return first.groupBy(*keys).agg(F.transform(pairs, lambda x: x[value]).alias("values"))


def grounded(proposals: DataFrame, sources: DataFrame, filled: DataFrame) -> DataFrame:
    """Adds ``code`` to proposals (document_id, path, raw_value, page, sheet, cell, value): accepted is null.

    A proposal must equal a source at the same place, null for null, agree with it on the value, not fill a field that has one,
    and agree with all other accepted proposals of its field.
    """
    place = ["document_id", "path", "raw_value", "page", "sheet", "cell"]
    s = sources.select(*[F.col(c).alias(f"s_{c}") for c in [*place, "value"]]).distinct()
    same = None
    for c in place:
        test = F.col(c).eqNullSafe(F.col(f"s_{c}"))
        same = test if same is None else same & test
    out = proposals.join(s, same, "left").join(filled.select("document_id", "path", F.lit(True).alias("_has")).distinct(), ["document_id", "path"], "left")
    code = F.when(F.col("s_document_id").isNull(), "NOT_GROUNDED").when(~F.col("value").eqNullSafe(F.col("s_value")) | F.col("value").isNull(), "VALUE_MISMATCH").when(F.col("_has"), "OVERWRITE_REJECTED")
    out = out.withColumn("code", code).drop("_has", *[f"s_{c}" for c in [*place, "value"]])
    w = Window.partitionBy("document_id", "path")
    ok = F.when(F.col("code").isNull(), F.col("value").cast("string"))
    return out.withColumn("code", F.when(F.col("code").isNull() & (F.min(ok).over(w) != F.max(ok).over(w)), "PROPOSALS_DIFFER").otherwise(F.col("code")))
