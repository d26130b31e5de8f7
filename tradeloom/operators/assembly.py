"""From evidence to one checked record per document: routing, gates, assembly, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions import dictionaries as d
from tradeloom.functions import lexical

#: Which verification levels a page's source may have.
LEVELS = {"TEXT_LAYER": ["UNVERIFIED"], "CROSS_VERIFIED_VISUAL": ["CROSS_VERIFIED"], "DOCUMENT_VISION_LOCAL": ["SINGLE_PROVIDER"], "OCR_LOCAL": ["SINGLE_PROVIDER"]}
PARTIES = ["seller", "buyer", "ship_to"]


def page_routes(pages: DataFrame, id_col: str, page: str, usable: str, limit: int) -> DataFrame:
    """Adds route: TEXT_LAYER for usable native text, VISUAL up to ``limit`` such pages of a document, then LIMIT_EXCEEDED."""
    before = Window.partitionBy(id_col).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    visual = F.sum((~F.col(usable)).cast("int")).over(before)
    return pages.withColumn("route", F.when(F.col(usable), "TEXT_LAYER").when(visual <= limit, "VISUAL").otherwise("LIMIT_EXCEEDED"))


def unsafe(requires_review: Column, source: Column, level: Column) -> Column:
    """Why a resolved page can't be relied on, or null."""
    return F.when(requires_review, "PAGE_REQUIRES_REVIEW").when(source == "UNRESOLVED", "SOURCE_UNRESOLVED").when(level == "CONFLICT", "VERIFICATION_CONFLICT").when((source != "TEXT_LAYER") & (level == "UNVERIFIED"), "UNVERIFIED_VISUAL_OCR")


def safe_documents(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """(document_id, n_pages, safe): documents whose pages are all resolved, allowed, and unchanged where native.

    parsed: (document_id, page, text); resolved: those with source, level, requires_review.
    """
    both = parsed.select("document_id", "page", F.col("text").alias("_native"), F.lit(True).alias("_p")).join(resolved, ["document_id", "page"], "full")
    allowed = F.coalesce(*(F.when(F.col("source") == s, F.col("level").isin(*levels)) for s, levels in LEVELS.items()), F.lit(False))
    same = (F.col("source") != "TEXT_LAYER") | F.col("text").eqNullSafe(F.col("_native"))
    ok = F.coalesce(F.col("_p") & allowed & same & unsafe(F.col("requires_review"), F.col("source"), F.col("level")).isNull(), F.lit(False))
    return both.groupBy("document_id").agg(F.count("*").alias("n_pages"), F.bool_and(ok).alias("safe"))


def classified(df: DataFrame, wanted: list[str], threshold: float = d.THRESHOLD) -> DataFrame:
    """Documents with a stored type that extraction accepts: classified, confidence finite and within [threshold, 1]."""
    good = F.col("document_type").isin(*wanted) & (F.col("classification_status") == "CLASSIFIED") & ~F.isnan("confidence") & F.col("confidence").between(threshold, 1.0)
    return df.where(F.coalesce(good, F.lit(False)))


def next_lines(lines: DataFrame, key: list[str], labels: list[str]) -> DataFrame:
    """(key, line, label, raw_value): labels that stand alone on their line, with the next line as value.

    lines: (key, line, content).  The next line counts only if it isn't blank and is no label itself; it is no label's line then.
    """
    names = [d.alias(x) for x in labels]
    w = Window.partitionBy(*key).orderBy("line")
    name = lexical.label(F.col("content"))
    known = name.isin(*names) | F.col("content").rlike(r"^\s*[\p{L}][^:：]{0,48}[:：]")
    rows = lines.withColumn("label", name).withColumn("_sole", name.isin(*names) & F.col("content").rlike(r"[:：]\s*\z")).withColumn("_known", known)
    rows = rows.withColumn("raw_value", lexical.trim(F.lead("content").over(w))).withColumn("_next", F.lead("_known").over(w))
    return rows.where(F.col("_sole") & (F.col("raw_value") != "") & ~F.col("_next")).select(*key, "line", "label", "raw_value")


def sources(cells: DataFrame, labels: dict[str, list[str]]) -> DataFrame:
    """(document_id, path, raw_value, sheet, cell): what proposals may rest on: ``LABEL: value`` in a cell, or a label cell and its
    right neighbour."""
    names = F.create_map(*[F.lit(v) for p, xs in labels.items() for x in xs for v in (d.alias(x), p)])
    rows = cells.select("document_id", "sheet", "row", "col", "coordinate", F.col("value_text").alias("text"))
    head = lexical.normalize_alias(F.regexp_extract("text", r"(?s)^([^:：]*)[:：](.*)\z", 1))
    value = lexical.trim(F.regexp_extract("text", r"(?s)^([^:：]*)[:：](.*)\z", 2))
    inline = rows.select("document_id", F.element_at(names, head).alias("path"), value.alias("raw_value"), "sheet", F.col("coordinate").alias("cell")).where("path is not null and raw_value <> ''")
    label = rows.select("document_id", "sheet", "row", (F.col("col") + 1).alias("col"), F.element_at(names, lexical.label(F.col("text"))).alias("path")).where("path is not null")
    beside = label.join(rows, ["document_id", "sheet", "row", "col"]).where("not startswith(text, '=')")
    return inline.union(beside.select("document_id", "path", lexical.trim(F.col("text")).alias("raw_value"), "sheet", F.col("coordinate").alias("cell")).where("raw_value <> ''"))


def header_cells(cells: DataFrame, items: DataFrame) -> DataFrame:
    """Cells for the header scan: rows that are items are left out, so that an item's text is no label."""
    return cells.join(items.select("document_id", "sheet", "row").distinct(), ["document_id", "sheet", "row"], "left_anti")


def assembled(fields: DataFrame, issues: DataFrame, paths: list[str]) -> DataFrame:
    """One record per document from (document_id, path, value): a column per plain path, a struct per party, and the status.

    A party without any value is null.  Any issue that needs review makes the record NEEDS_REVIEW.
    """
    wide = fields.groupBy("document_id").pivot("path", paths).agg(F.first("value", ignorenulls=True))
    plain = [p for p in paths if "." not in p]
    struct = lambda x: [p for p in paths if p.startswith(x + ".")]
    party = [F.when(F.coalesce(*(F.col(f"`{p}`") for p in struct(x))).isNotNull(), F.struct(*(F.col(f"`{p}`").alias(p.partition(".")[2]) for p in struct(x)))).alias(x) for x in PARTIES if struct(x)]
    review = issues.groupBy("document_id").agg(F.bool_or("requires_review").alias("_review"), F.array_sort(F.collect_set("code")).alias("codes"))
    out = wide.select("document_id", *plain, *party).join(review, "document_id", "left")
    return out.withColumn("status", F.when(F.coalesce("_review", F.lit(False)), "NEEDS_REVIEW").otherwise("EXTRACTED")).withColumn("codes", F.coalesce("codes", F.array().cast("array<string>"))).drop("_review")


def flattened(records: DataFrame, id_col: str, paths: list[str], items: str | None = None, item_fields: list[str] = ()) -> DataFrame:
    """(id, path, value): every field of a record as a row, items as ``items[i].field``."""
    rows = [F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("value")) for p in paths]
    flat = F.array(*rows)
    if items:
        each = F.transform(items, lambda x, i: F.array(*(F.struct(F.concat(F.lit(f"{items}["), i.cast("string"), F.lit(f"].{f}")).alias("path"), x[f].cast("string").alias("value")) for f in item_fields)))
        flat = F.concat(flat, F.coalesce(F.flatten(each), F.array().cast("array<struct<path:string,value:string>>")))
    return records.select(id_col, F.inline(flat))


def violations(accepted: DataFrame, cells: DataFrame, parsed: Column) -> DataFrame:
    """Accepted fields (document_id, path, value, sheet, row, col) that their source cell doesn't yield: ``code`` says why.

    parsed: the value as derived anew from the cell's ``value_text`` and the field's path.
    """
    at = accepted.join(cells.select("document_id", "sheet", "row", "col", "value_text"), ["document_id", "sheet", "row", "col"], "left")
    code = F.when(F.col("value_text").isNull(), "SOURCE_MISSING").when(~parsed.eqNullSafe(F.col("value")), "VALUE_NOT_REPRODUCED")
    return at.withColumn("code", code).where("code is not null").select("document_id", "path", "value", "code")


def outcomes(results: DataFrame, refused: Column, failed: Column) -> tuple[DataFrame, DataFrame]:
    """(attempts to append, refusals): a refusal writes nothing, a failure is stored as FAILED."""
    no = F.coalesce(refused, F.lit(False))
    kept = results.where(~no).withColumn("status", F.when(F.coalesce(failed, F.lit(False)), "FAILED").otherwise(F.col("status")))
    return kept, results.where(no)
