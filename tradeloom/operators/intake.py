"""Intake: validate raw files, then keep the first of equal contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.functions import lexical

#: Extensions that are taken in and the MIME types a client may name for them.
MIME_TYPES = {
    "pdf": ["application/pdf"],
    "xls": ["application/vnd.ms-excel"],
    "xlsx": ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"],
    "csv": ["text/csv", "application/csv", "application/x-csv", "text/comma-separated-values", "application/vnd.ms-excel"],
    "docx": ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
    "jpg": ["image/jpeg", "image/jpg", "image/pjpeg"],
    "jpeg": ["image/jpeg", "image/jpg", "image/pjpeg"],
    "png": ["image/png"],
}
#: First bytes in hex.
SIGNATURES = {"pdf": "255044462D", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "jpeg": "FFD8FF", "xls": "D0CF11E0A1B11AE1", "xlsx": "504B0304", "docx": "504B0304"}
MAX_BYTES = 50 * 1024 * 1024


def mime_fits(ext: Column, mime: Column) -> Column:
    """A missing or generic client MIME type passes; parameters after ';' don't count."""
    kind = F.lower(lexical.trim(F.substring_index(mime, ";", 1)))
    allowed = F.coalesce(*(F.when(ext == e, F.array(*map(F.lit, types))) for e, types in MIME_TYPES.items()), F.array().cast("array<string>"))
    return mime.isNull() | (kind == "") | (kind == "application/octet-stream") | F.array_contains(allowed, kind)


def signature_fits(ext: Column, content: Column) -> Column:
    """Whether a file is what its extension says.

    A spreadsheet's zip directory names entries under xl/ and none under word/, a text document's the other way round.  CSV must be
    text: no NUL, no signature, few control bytes in the first 4,096.
    """
    head = F.hex(F.substring(content, 1, 8))
    start = F.coalesce(*(F.when(ext == e, head.startswith(s)) for e, s in SIGNATURES.items()))
    # a directory entry is a mark, 42 bytes and the name; one byte is one character here
    whole = F.when(ext.isin("xlsx", "docx"), F.decode(content, "ISO-8859-1"))
    named = lambda folder: whole.rlike(rf"(?s)PK\x01\x02.{{42}}{folder}/")
    inside = F.when(named("xl") & named("word"), False).when(ext == "xlsx", named("xl")).when(ext == "docx", named("word")).otherwise(True)
    sample = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    control = F.regexp_count(sample, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    foreign = F.greatest(*(head.startswith(s).cast("int") for s in set(SIGNATURES.values()))) == 1
    text = ~foreign & ~sample.contains("\0") & (control <= 0.05 * F.length(sample))
    return F.coalesce(start & inside, (ext == "csv") & text)


def validated(files: DataFrame) -> DataFrame:
    """Adds ``code``: why a file (shipment_id, filename, mime, content) is refused, or null.  Checks run in a fixed order."""
    ext = lexical.extension(lexical.safe_filename(F.col("filename")))
    size = F.length("content")
    code = (
        F.when(~lexical.is_shipment_id(F.col("shipment_id")), "INVALID_SHIPMENT_ID")
        .when(~F.coalesce(ext.isin(*MIME_TYPES), F.lit(False)), "UNSUPPORTED_EXTENSION")
        .when(~mime_fits(ext, F.col("mime")), "MIME_MISMATCH")
        .when(F.col("content").isNull() | (size == 0), "EMPTY_FILE")
        .when(size > MAX_BYTES, "FILE_TOO_LARGE")
        .when(~signature_fits(ext, F.col("content")), "SIGNATURE_MISMATCH")
    )
    return files.withColumn("file_type", ext).withColumn("code", code)


def deduplicated(df: DataFrame, key: str, id_col: str, content: str) -> DataFrame:
    """Adds content_hash, the winner's id (the smallest id with the same key and content) and is_duplicate.

    The minimum per (key, hash) is aggregated before the shuffle, so a content that fills a third of the rows
    is one row per task; only ids and hashes are joined back, and AQE splits a hot hash.
    """
    rows = df.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256))
    first = rows.groupBy(F.col(key).alias("_key"), F.col("content_hash").alias("_hash")).agg(F.min(id_col).alias("winner_id"))
    out = rows.join(first, rows[key].eqNullSafe(first["_key"]) & (rows["content_hash"] == first["_hash"])).drop("_key", "_hash")
    return out.withColumn("is_duplicate", F.col(id_col) != F.col("winner_id"))


def presence(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Required rows without a counterpart."""
    return required.join(present.select(*keys).distinct(), keys, "left_anti")


def routed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that a parser takes, and issue rows for those that none does."""
    ok = F.col("file_type").isin("pdf", "xlsx", "xls")
    refused = docs.where(~F.coalesce(ok, F.lit(False)))
    return docs.where(ok), refused.select("document_id", F.lit("PARSER_UNSUPPORTED").alias("code"))


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest state of each key in an append-only table: the partial maximum keeps one row per key and task."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")


def integrity(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, for constraints that files can't enforce."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
