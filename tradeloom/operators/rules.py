"""Rules as data: applicability, inputs, operator, tolerance and severity make check results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Categories of rules.
CATEGORIES = ["DATA_VALIDATION", "CROSS_DOCUMENT", "INTERNAL_POLICY", "CUSTOMER_SPECIFIC", "LEGAL", "HEURISTIC"]
OPERATORS = ["present", "equals", "within", "at_most", "one_of"]


def checked(rules: list[dict]) -> list[dict]:
    """The rules, or ValueError: repeated ids, unknown categories or operators, missing inputs, a LEGAL rule without a source."""
    seen = set()
    for r in rules:
        if r["rule_id"] in seen or r.get("category") not in CATEGORIES or r.get("operator") not in OPERATORS or not r.get("inputs"):
            raise ValueError(f"rule {r.get('rule_id')!r} is repeated or incomplete")
        if r["category"] == "LEGAL" and not r.get("source"):
            raise ValueError(f"rule {r['rule_id']!r} is LEGAL and names no source")
        seen.add(r["rule_id"])
    return rules


def _holds(rule: dict) -> Column:
    """Null where an input is missing, except for ``present``."""
    a, *rest = map(F.col, rule["inputs"])
    if rule["operator"] == "present":
        return reduce(lambda x, y: x & y, (c.isNotNull() for c in (a, *rest)))
    if rule["operator"] == "one_of":
        return a.isin(*rule["values"])
    b = rest[0] if rest else F.lit(rule["value"])
    if rule["operator"] == "equals":
        return a == b
    if rule["operator"] == "at_most":
        return a <= b
    return F.abs(a - b) <= F.greatest(F.lit(float(rule.get("absolute", 0))), F.lit(float(rule.get("relative", 0))) * F.abs(b))


def evaluated(df: DataFrame, keys: list[str], rules: list[dict]) -> DataFrame:
    """(keys, rule_id, category, severity, status): one row per row and rule, from one pass over df.

    A rule with ``when`` (column: allowed values) that doesn't apply is NOT_CHECKED, one without its inputs INSUFFICIENT_EVIDENCE;
    present yields MISSING.
    """

    def result(r: dict) -> Column:
        applies = reduce(lambda x, y: x & y, (F.coalesce(F.col(c).isin(*values), F.lit(False)) for c, values in r.get("when", {}).items()), F.lit(True))
        ok = _holds(r)
        wrong = "MISSING" if r["operator"] == "present" else "WARNING" if r["category"] == "HEURISTIC" else "ERROR"
        status = F.when(~applies, "NOT_CHECKED").when(ok.isNull(), "INSUFFICIENT_EVIDENCE").when(ok, "PASS").otherwise(wrong)
        return F.struct(*(F.lit(r.get(k)).cast("string").alias(k) for k in ("rule_id", "category", "severity")), status.alias("status"))

    return df.select(*keys, F.inline(F.array(*map(result, checked(rules)))))


#: The declaration's fields, and the modes in which each applies (both where none is named).
DECLARATION_FIELDS = [
    ("DF-01", "transport reference", None), ("DF-02", "loading place", "SEA"), ("DF-03", "pieces", "AIR"), ("DF-04", "gross weight", "AIR"), ("DF-05", "package count", "SEA"),
    ("DF-06", "gross weight", "SEA"), ("DF-07", "vessel and voyage", "SEA"), ("DF-08", "flight", "AIR"), ("DF-09", "arrival", None), ("DF-10", "container and seal", "SEA"),
    ("DF-11", "importer", None), ("DF-12", "exporter", None), ("DF-13", "invoice number", None), ("DF-14", "invoice date", None), ("DF-15", "currency", None),
    ("DF-16", "delivery term", None), ("DF-17", "declared value", None), ("DF-18", "freight", None), ("DF-19", "insurance", None), ("DF-20", "exchange rate", None),
    ("DF-21", "item quantity and unit", None), ("DF-22", "description and origin", None), ("DF-23", "HS code", None), ("DF-24", "permits", None), ("DF-25", "declaration type and office", None),
    ("DF-26", "line value and tax", None),
]


def field_results(dossiers: DataFrame, found: DataFrame) -> DataFrame:
    """(dossier_id, field_id, status): every field that applies to a dossier's mode; without a result it is NOT_CHECKED.

    dossiers: (dossier_id, mode); found: (dossier_id, field_id, status).
    """
    fields = F.array(*(F.struct(F.lit(i).alias("field_id"), F.lit(m).cast("string").alias("only")) for i, _, m in DECLARATION_FIELDS))
    due = dossiers.select("dossier_id", "mode", F.inline(fields)).where("only is null or only = mode")
    return due.join(found, ["dossier_id", "field_id"], "left").select("dossier_id", "field_id", F.coalesce("status", F.lit("NOT_CHECKED")).alias("status"))


def code_history(lines: DataFrame, history: DataFrame, item: str, code: str, day: str) -> DataFrame:
    """Adds last_code and code_warning: whether an item was declared under another code the last time; nothing is corrected."""
    last = history.groupBy(item).agg(F.max_by(F.col(code), F.struct(F.col(day), F.col(code))).alias("last_code"))
    out = lines.join(last, item, "left")
    return out.withColumn("code_warning", F.coalesce(F.col(code) != F.col("last_code"), F.lit(False)))


def drafts(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Numbered versions of manually entered declarations: adds version (from 1), origin and is_current; none is overwritten."""
    w = Window.partitionBy(key).orderBy(*order)
    return changes.withColumn("version", F.row_number().over(w)).withColumn("origin", F.lit("MANUAL")).withColumn("is_current", F.lead(F.lit(1)).over(w).isNull())
