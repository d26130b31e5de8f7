"""Queries on item rows, packing lists, pages, records, stored results and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.functions import lexical, normalizers
from tradeloom.operators import assembly, codecs, packing, rules, tables
from tradeloom.plans import read


def _pick(k: Column, *values: str | Column | None) -> Column:
    """The value of a number from 0 on."""
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v).cast("string") for v in values)), (k % len(values) + 1).cast("int"))


def _case(k: str, *values: str | None) -> str:
    return f"CASE {k} % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " END"


_ROWS = [
    ({"item_code": "A1", "quantity": "2", "amount": "3"}, "item"),
    ({"item_code": "Total", "amount": "9"}, "summary"),
    ({"item_code": "SUB TOTAL:", "amount": "9"}, "subtotal"),
    ({"item_code": "TOTAL", "quantity": "4", "amount": "9"}, "ambiguous_summary"),
    ({"item_code": "TOTAL", "description": "Wheel", "amount": "9"}, "ambiguous_item"),
    ({"description": "NOTE: fragile"}, "footer"),
    ({}, "blank"),
    ({"unit": "PCS"}, "uncertain"),
    ({"item_code": "TOTAL CONTROL", "quantity": "1"}, "item"),
    ({"item_code": "B7", "description": "REMARKS below"}, "ambiguous_item"),
    ({"item_code": "=A1", "amount": "5"}, "item"),
    ({"description": "NOTEBOOK", "quantity": "5"}, "item"),
]


def item_row_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of an item table, a dozen forms by line, by what they are."""
    maps = F.array(*(F.create_map(*[F.lit(x) for kv in row.items() for x in kv]) if row else F.create_map().cast("map<string,string>") for row, _ in _ROWS))
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(maps, ((F.col("l_orderkey") + F.col("l_partkey")) % len(_ROWS) + 1).cast("int")).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", tables.row_kind(F.col("m")).alias("kind")).groupBy("l_orderkey", "kind").agg(F.count("*").alias("n"))


ITEM_ROW_KINDS = f"SELECT l_orderkey, {_case('(l_orderkey + l_partkey)', *(kind for _, kind in _ROWS))} AS kind, count(*) AS n FROM lineitem GROUP BY ALL"


def competing_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Header rows whose labels stand in one run of columns or, for every third order, in two."""
    k = F.col("o_orderkey")
    far = F.when(k % 3 == 0, 7).otherwise(3)
    labels = F.array(*(F.struct(c.alias("col"), F.lit(v).alias("value_text")) for c, v in ((F.lit(1), "ITEM CODE"), (F.lit(2), "QTY"), (far, "Unit Price:"), (far + 1, "AMOUNT"))))
    cells = read(spark, sf, "orders").select(k.alias("document_id"), F.lit("S").alias("sheet"), F.lit(1).alias("row"), F.inline(labels))
    return tables.column_groups(cells).select("document_id", "first_col", "last_col", F.array_join("paths", ",").alias("paths"))


COMPETING_COLUMNS = """
SELECT o_orderkey AS document_id, 1 AS first_col, 4 AS last_col, 'amount,item_code,quantity,unit_price' AS paths FROM orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 1, 2, 'item_code,quantity' FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 7, 8, 'amount,unit_price' FROM orders WHERE o_orderkey % 3 = 0"""


def packing_values(spark: SparkSession, sf: str) -> DataFrame:
    """Packing cells, taken or refused by the field they are for."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    rows = read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", _pick(k, "s", "s", "s", "n", "f").alias("kind"), _pick(k, "AB-1", "--", " 007 ", "12", "=A1").alias("code"),
        _pick(k, "Wheel\nred", "12", "a\0b", "x", "Nut").alias("text"), _pick(k, "C1", "1-5", "A,B", "7", "8").alias("package"), _pick(k, "1,200.50", "1,200", "3", "2.5", "4").alias("weight"),
    )
    value = lambda path, c: packing.item_value(path, F.col(c), F.col("kind")).alias(path)
    return rows.select("l_orderkey", "l_linenumber", value("item_code", "code"), value("description", "text"), value("package_number", "package"), value("gross_weight", "weight")).distinct()


PACKING_VALUES = f"""
SELECT DISTINCT l_orderkey, l_linenumber, {_case("k", "AB-1", None, "007", None, None)} AS item_code, {_case("k", "Wheel" + chr(10) + "red", None, None, None, None)} AS description,
  {_case("k", "C1", None, None, None, None)} AS package_number, {_case("k", "1200.50", None, "3", "2.5", None)} AS gross_weight
FROM (SELECT *, l_orderkey + l_linenumber AS k FROM lineitem)"""


def packing_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Header fields of packing lists: the priority of an order twice, its date, its customers' invoices, a weight."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    ev = lambda path, raw, blocked, seq: F.struct(F.lit(path).alias("path"), raw.cast("string").alias("raw_value"), blocked.alias("blocked"), F.lit(seq).alias("seq"))
    no, key = F.lit(False), k.cast("string")
    rows = read(spark, sf, "orders").select(k.alias("document_id"), F.inline(F.array(
        ev("packing_list_number", F.concat(F.lit("PL"), key), no, 1), ev("packing_list_number", F.when(k % 4 == 0, F.concat(F.lit("PX"), key)).otherwise(F.concat(F.lit(" PL"), key)), no, 2),
        ev("date", F.when(k % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(day), no, 1), ev("date", day, k % 5 == 0, 2),
        ev("invoice_references", F.concat(F.lit("B"), key), no, 1), ev("invoice_references", F.concat(F.lit("A"), key), no, 2), ev("invoice_references", F.when(k % 7 == 0, "1-5").otherwise(F.concat(F.lit("B"), key)), no, 3),
        ev("total_gross_weight", F.when(k % 2 == 0, "=B4").otherwise("12.50"), no, 1),
    )))
    return packing.header(rows).select("document_id", "path", F.array_join("values", ",").alias("values"), "code")


PACKING_HEADERS = """
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS s, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT k AS document_id, 'packing_list_number' AS path, CASE WHEN k % 4 = 0 THEN '' ELSE 'PL' || s END AS "values", CASE WHEN k % 4 = 0 THEN 'CONFLICTING_VALUES' END AS code FROM o
UNION ALL SELECT k, 'date', CASE WHEN k % 3 = 0 OR k % 5 = 0 THEN '' ELSE d END, CASE WHEN k % 3 = 0 AND k % 5 = 0 THEN 'UNPARSEABLE_DATE_FIELD' WHEN k % 3 = 0 THEN 'UNPARSEABLE_DATE_FIELD' WHEN k % 5 = 0 THEN 'UNSAFE_CELL_EVIDENCE' END FROM o
UNION ALL SELECT k, 'invoice_references', 'B' || s || ',A' || s, CASE WHEN k % 7 = 0 THEN 'AMBIGUOUS_INVOICE_REFERENCE' END FROM o
UNION ALL SELECT k, 'total_gross_weight', CASE WHEN k % 2 = 0 THEN '' ELSE '12.50' END, CASE WHEN k % 2 = 0 THEN 'UNRESOLVED_FORMULA_FIELD' END FROM o"""


def packing_items(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as packing tables; every fourth line has a formula as weight, every tenth order two tables."""
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))).alias("ls"))
    cell = lambda r, c, v, t: F.struct(r.cast("int").alias("row"), F.lit(c).alias("col"), v.cast("string").alias("value_text"), F.lit(t).alias("data_type") if isinstance(t, str) else t.alias("data_type"))
    title = lambda at: [cell(at, 2, F.lit("ITEM CODE"), "s"), cell(at, 3, F.lit("Gross Weight"), "s")]
    one = F.lit(1)
    formula = lambda x: x["l_partkey"] % 4 == 0
    body = F.flatten(F.transform("ls", lambda x, i: F.array(cell(i + 2, 2, F.concat(F.lit("P"), x["l_partkey"].cast("string")), "s"), cell(i + 2, 3, F.when(formula(x), F.lit("=C1")).otherwise(x["l_quantity"].cast("decimal(18,2)").cast("string")), F.when(formula(x), F.lit("f")).otherwise(F.lit("n"))))))
    end = F.size("ls") + 2
    more = F.when(F.col("l_orderkey") % 10 == 0, F.array(*title(end + 3), cell(end + 4, 2, F.lit("Z9"), "s"), cell(end + 4, 3, F.lit("1"), "n"))).otherwise(F.array().cast("array<struct<row:int,col:int,value_text:string,data_type:string>>"))
    grid = F.concat(F.array(*title(one)), body, F.array(cell(end, 2, F.lit("TOTAL"), "s"), cell(end, 3, F.lit("9"), "n")), more)
    cells = lines.select(F.col("l_orderkey").cast("string").alias("document_id"), F.lit("S").alias("sheet"), F.inline(grid))
    return packing.items(cells).select("document_id", F.col("row").cast("int").alias("row"), "item_code", "gross_weight")


PACKING_ITEMS = """
WITH l AS (SELECT l_orderkey, CAST(1 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS INTEGER) AS row, l_partkey, l_quantity FROM lineitem),
g AS (SELECT * FROM l WHERE l_partkey % 4 <> 0)
SELECT CAST(l_orderkey AS VARCHAR) AS document_id, row, 'P' || l_partkey AS item_code, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS gross_weight FROM g WHERE l_orderkey % 10 <> 0
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(max(row) + 5 AS INTEGER), 'Z9', '1' FROM l WHERE l_orderkey % 10 = 0 GROUP BY l_orderkey HAVING bool_and(l_partkey % 4 = 0)"""


def page_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of orders as pages, two in three without usable text, of which a document may show two."""
    pages = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3 == 0).alias("usable")).dropDuplicates(["l_orderkey", "l_linenumber", "usable"])
    pages = pages.groupBy("l_orderkey", "l_linenumber").agg(F.bool_or("usable").alias("usable"))
    return assembly.page_routes(pages, "l_orderkey", "l_linenumber", "usable", 2)


PAGE_ROUTES = """
WITH p AS (SELECT l_orderkey, l_linenumber, bool_or(l_partkey % 3 = 0) AS usable FROM lineitem GROUP BY ALL)
SELECT *, CASE WHEN usable THEN 'TEXT_LAYER' WHEN count(*) FILTER (NOT usable) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 2 THEN 'VISUAL' ELSE 'LIMIT_EXCEEDED' END AS route FROM p"""


def safe_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as documents of three pages, some of them changed, missing, unverified or in conflict."""
    k = F.col("o_orderkey")
    pages = read(spark, sf, "orders").select(k.alias("document_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("page"))
    key = F.col("document_id") * 3 + F.col("page")
    parsed = pages.withColumn("text", F.concat(F.lit("page "), F.col("page").cast("string")))
    source = F.when(key % 13 == 0, "OCR_LOCAL").when(key % 17 == 0, "UNRESOLVED").otherwise("TEXT_LAYER")
    level = F.when(key % 13 == 0, F.when(key % 2 == 0, "SINGLE_PROVIDER").otherwise("UNVERIFIED")).otherwise("UNVERIFIED")
    resolved = parsed.where(key % 29 != 0).withColumn("text", F.when(key % 19 == 0, "else").otherwise(F.col("text"))).withColumn("source", source).withColumn("level", level).withColumn("requires_review", key % 23 == 0)
    return assembly.safe_documents(parsed, resolved)


SAFE_DOCUMENTS = """
WITH p AS (SELECT o_orderkey AS document_id, o_orderkey * 3 + page AS key FROM orders, (VALUES (1), (2), (3)) t(page))
SELECT document_id, count(*) AS n_pages, bool_and(key % 29 <> 0 AND key % 23 <> 0 AND CASE WHEN key % 13 = 0 THEN key % 2 = 0 ELSE key % 17 <> 0 AND key % 19 <> 0 END) AS safe FROM p GROUP BY document_id"""


def next_line_values(spark: SparkSession, sf: str) -> DataFrame:
    """Labels alone on a line with the value below, which for some orders is blank or a label itself."""
    k = F.col("o_orderkey")
    below = _pick(k, F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("  "), F.lit("CURRENCY: USD"), F.lit(" net 30 "))
    text = F.array(F.lit("INVOICE"), F.lit("INVOICE DATE:"), below, F.lit("BUYER: ACME"), F.lit("Currency"), F.lit("EUR"))
    lines = read(spark, sf, "orders").select("o_orderkey", F.posexplode(text).alias("line", "content"))
    return assembly.next_lines(lines, ["o_orderkey"], ["INVOICE DATE", "CURRENCY"])


NEXT_LINE_VALUES = """
SELECT o_orderkey, 1 AS line, 'INVOICE DATE' AS label, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'net 30' END AS raw_value FROM orders WHERE o_orderkey % 4 IN (0, 3)"""


def record_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """One record per order from its fields as rows: every third has no seller, issues of every fifth need review."""
    k = F.col("o_orderkey")
    field = lambda p, v: F.struct(F.lit(p).alias("path"), v.cast("string").alias("value"))
    some = F.array(field("invoice_number", k), field("total_amount", F.col("o_totalprice").cast("decimal(18,2)")), field("seller.name", F.when(k % 3 != 0, F.concat(F.lit("S"), (k % 10).cast("string")))), field("seller.address", F.when(k % 6 == 1, "here")), field("buyer.name", F.col("o_custkey")))
    orders = read(spark, sf, "orders")
    fields = orders.select(k.alias("document_id"), F.inline(some)).where("value is not null")
    issues = orders.where(k % 5 < 2).select(k.alias("document_id"), F.when(k % 5 == 0, "CONFLICTING_VALUES").otherwise("HIDDEN_CONTENT").alias("code"), (k % 5 == 0).alias("requires_review"))
    out = assembly.assembled(fields, issues, ["invoice_number", "total_amount", "seller.name", "seller.address", "buyer.name"])
    return out.select("document_id", "invoice_number", "total_amount", F.col("seller.name").alias("seller_name"), F.col("seller.address").alias("seller_address"), F.col("seller").isNull().alias("no_seller"), F.col("buyer.name").alias("buyer_name"), "status", F.array_join("codes", ",").alias("codes"))


RECORD_ASSEMBLY = """
SELECT o_orderkey AS document_id, CAST(o_orderkey AS VARCHAR) AS invoice_number, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total_amount, CASE WHEN o_orderkey % 3 <> 0 THEN 'S' || (o_orderkey % 10) END AS seller_name,
  CASE WHEN o_orderkey % 6 = 1 THEN 'here' END AS seller_address, o_orderkey % 3 = 0 AS no_seller, CAST(o_custkey AS VARCHAR) AS buyer_name, CASE WHEN o_orderkey % 5 = 0 THEN 'NEEDS_REVIEW' ELSE 'EXTRACTED' END AS status,
  CASE o_orderkey % 5 WHEN 0 THEN 'CONFLICTING_VALUES' WHEN 1 THEN 'HIDDEN_CONTENT' ELSE '' END AS codes FROM orders"""


def flattened_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Records with their items as one row per field."""
    items = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("items"))
    records = read(spark, sf, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("invoice", F.struct(F.col("o_custkey").alias("buyer")))
    return assembly.flattened(records, "o_orderkey", ["invoice.buyer", "o_orderstatus"], "items", ["l_partkey"])


FLATTENED_FIELDS = """
SELECT o_orderkey, 'invoice.buyer' AS path, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderstatus', o_orderstatus FROM orders
UNION ALL SELECT l_orderkey, 'items[' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1) || '].l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""


def grounding_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted totals against the cells they name: some cells are gone, some yield another number."""
    k = F.col("o_orderkey")
    total = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    orders = read(spark, sf, "orders").select(k.alias("document_id"), F.lit("S").alias("sheet"), F.lit(4).alias("row"), F.lit(2).alias("col"), total.alias("total"))
    cells = orders.where("document_id % 11 <> 0").withColumn("value_text", F.when(F.col("document_id") % 7 == 0, "1,200").otherwise(F.concat(F.lit(" "), F.col("total"))))
    accepted = orders.select("document_id", F.lit("total_amount").alias("path"), F.col("total").alias("value"), "sheet", "row", "col")
    return assembly.violations(accepted, cells, lexical.decimal_text(F.col("value_text"))).select("document_id", "path", "code")


GROUNDING_AUDIT = """
SELECT o_orderkey AS document_id, 'total_amount' AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'SOURCE_MISSING' ELSE 'VALUE_NOT_REPRODUCED' END AS code FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0"""


def stored_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Values stored with their types, and tags that no writer writes, read back."""
    k = F.col("o_orderkey")
    kind = _pick(k, "int", "decimal", "date", "decimal", "float", "int", "date", "none", "other", "bool")
    text = _pick(k, k.cast("string"), F.lit("1200.50"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("01.5"), F.lit("NaN"), F.lit("1.0"), F.lit("2026-02-30"), F.lit(None).cast("string"), F.lit("x"), F.lit("true"))
    tag = F.struct(kind.alias("type"), text.alias("value"))
    return read(spark, sf, "orders").select("o_orderkey", codecs.is_valid_tag(tag).alias("valid"), codecs.untagged(tag).alias("value"))


STORED_TAGS = """
SELECT o_orderkey, o_orderkey % 10 IN (0, 1, 2, 7, 9) AS valid, CASE o_orderkey % 10 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '1200.50' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 9 THEN 'true' END AS value FROM orders"""


def stored_results(spark: SparkSession, sf: str) -> DataFrame:
    """Stored JSON of every order, some with a repeated key, NaN, another key or an unknown kind: taken, or why not."""
    k = F.col("o_orderkey")
    good = codecs.envelope(F.lit(1), F.lit("invoice"), F.struct(k.alias("number"), F.lit(None).cast("string").alias("note")))
    text = _pick(k, good, F.lit('{"format_version":1,"result_type":"invoice","result":{"number":1,"number":2}}'), F.lit('{"format_version":1,"result_type":"invoice","result":{"number":NaN}}'), F.lit('{"format_version":1,"result_type":"invoice","result":{"number":1},"more":0}'), F.lit('{"format_version":1,"result_type":"packing_list","result":{"number":1}}'), F.lit("[]"))
    taken, refused = codecs.opened(read(spark, sf, "orders").select("o_orderkey", text.alias("stored")), "stored", "struct<number bigint, note string>")
    return taken.select("o_orderkey", F.col("result.number").alias("number"), F.lit(None).cast("string").alias("code")).union(refused.select("o_orderkey", F.lit(None).cast("bigint"), "code"))


STORED_RESULTS = f"SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey END AS number, {_case('o_orderkey', None, 'NOT_STRICT_JSON', 'NOT_STRICT_JSON', 'UNKNOWN_KEYS', 'UNKNOWN_KIND', 'NOT_STRICT_JSON')} AS code FROM orders"


def stored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to append or to read: what their flags, families, sources and preconditions say."""
    k = F.col("o_orderkey")
    kind, document = _pick(k, "packing_list", "invoice", "invoice"), _pick(k, "PACKING_LIST", "COMMERCIAL_INVOICE", "PACKING_LIST")
    one = F.struct(F.when(k % 8 == 0, k + 1).otherwise(k).alias("source_document_id"), F.when(k % 9 == 0, float("nan")).otherwise(0.9).alias("confidence"))
    rows = read(spark, sf, "orders").select(k.alias("document_id"), codecs.row_code((k % 5).cast("int"), kind, document).alias("row_code"), F.array(one).alias("candidates"), F.when(k % 7 == 0, "h2").otherwise("h1").alias("hash"), F.when(k % 4 == 0, F.lit(None)).otherwise(k % 4).alias("expected"), F.when(k % 6 == 0, F.array().cast("array<bigint>")).when(k % 10 == 1, F.array(F.lit(1), F.lit(2)).cast("array<bigint>")).otherwise(F.array(F.lit(1).cast("bigint"))).alias("active"))
    append = codecs.append_code(F.col("hash"), F.lit("h1"), F.lit("EXTRACTED"), F.col("expected"), F.col("active"))
    return rows.select("document_id", "row_code", codecs.foreign(rows, "document_id", "candidates").alias("foreign"), append.alias("append_code"))


STORED_ROWS = """
WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 4 END AS e, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 2 ELSE 1 END AS n FROM orders)
SELECT k AS document_id, CASE WHEN k % 5 > 1 THEN 'BAD_ACTIVE_FLAG' WHEN k % 3 = 2 THEN 'WRONG_FAMILY' END AS row_code, k % 8 = 0 OR k % 9 = 0 AS "foreign",
  CASE WHEN k % 7 = 0 THEN 'SOURCE_CHANGED' WHEN n = 2 THEN 'SEVERAL_ACTIVE' WHEN n IS NULL THEN CASE WHEN e IS NOT NULL THEN 'NO_ACTIVE' END WHEN e IS NULL THEN 'REPLACEMENT_REQUIRED' WHEN e <> 1 THEN 'STALE_ACTIVE' END AS append_code FROM s"""

#: Rules on orders as dossiers.
RULES = [
    {"rule_id": "STATUS_KNOWN", "category": "DATA_VALIDATION", "severity": "HIGH", "operator": "one_of", "inputs": ["o_orderstatus"], "values": ["O", "F"]},
    {"rule_id": "TOTAL_MATCH", "category": "CROSS_DOCUMENT", "severity": "CRITICAL", "operator": "within", "inputs": ["o_totalprice", "declared"], "absolute": 1, "relative": 0.001, "when": {"o_orderstatus": ["O", "F"]}},
    {"rule_id": "WEIGHT_GIVEN", "category": "INTERNAL_POLICY", "severity": "HIGH", "operator": "present", "inputs": ["weight", "declared"]},
    {"rule_id": "LIGHT", "category": "HEURISTIC", "severity": "LOW", "operator": "at_most", "inputs": ["weight"], "value": 5},
]


def rule_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Four rules on every order, in one pass."""
    k = F.col("o_orderkey")
    orders = read(spark, sf, "orders").withColumn("declared", F.when(k % 9 != 0, F.when(k % 5 == 0, F.col("o_totalprice") * 1.5 + 100).otherwise(F.col("o_totalprice")))).withColumn("weight", F.when(k % 4 != 0, k % 8))
    return rules.evaluated(orders, ["o_orderkey"], RULES).select("o_orderkey", "rule_id", "status")


RULE_CHECKS = """
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders)
SELECT k AS o_orderkey, 'STATUS_KNOWN' AS rule_id, CASE WHEN s IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN s IN ('O', 'F') THEN 'PASS' ELSE 'ERROR' END AS status FROM o
UNION ALL SELECT k, 'TOTAL_MATCH', CASE WHEN s IN ('O', 'F') THEN CASE WHEN k % 9 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN k % 5 = 0 THEN 'ERROR' ELSE 'PASS' END ELSE 'NOT_CHECKED' END FROM o
UNION ALL SELECT k, 'WEIGHT_GIVEN', CASE WHEN k % 4 = 0 OR k % 9 = 0 THEN 'MISSING' ELSE 'PASS' END FROM o
UNION ALL SELECT k, 'LIGHT', CASE WHEN k % 4 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN k % 8 <= 5 THEN 'PASS' ELSE 'WARNING' END FROM o"""


def declaration_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Which declaration fields of orders by sea and air were checked."""
    k = F.col("o_orderkey")
    orders = read(spark, sf, "orders")
    dossiers = orders.select(k.alias("dossier_id"), F.when(k % 2 == 0, "SEA").otherwise("AIR").alias("mode"))
    found = orders.select(k.alias("dossier_id"), F.explode(F.array(F.lit("DF-01"), F.lit("DF-02"), F.lit("DF-03"))).alias("field_id"), F.lit("PASS").alias("status")).where("dossier_id % 3 <> 0")
    return rules.field_results(dossiers, found).groupBy("field_id", "status").agg(F.count("*").alias("n"))


DECLARATION_FIELDS = """
WITH f AS (SELECT 'DF-' || lpad(CAST(i AS VARCHAR), 2, '0') AS field_id, CASE WHEN i IN (2, 5, 6, 7, 10) THEN 0 WHEN i IN (3, 4, 8) THEN 1 END AS rest, i FROM range(1, 27) t(i))
SELECT field_id, CASE WHEN i <= 3 AND o_orderkey % 3 <> 0 THEN 'PASS' ELSE 'NOT_CHECKED' END AS status, count(*) AS n FROM orders, f WHERE rest IS NULL OR o_orderkey % 2 = rest GROUP BY ALL"""


def code_history(spark: SparkSession, sf: str) -> DataFrame:
    """Parts whose goods code differs from the one they were shipped under last."""
    code = lambda c: (F.col(c) % 5).cast("string")
    history = read(spark, sf, "lineitem").select(F.col("l_partkey").alias("item"), code("l_suppkey").alias("hs"), F.col("l_shipdate").alias("day"))
    lines = read(spark, sf, "part").select(F.col("p_partkey").alias("item"), code("p_size").alias("hs"))
    return rules.code_history(lines, history, "item", "hs", "day")


CODE_HISTORY = """
WITH h AS (SELECT l_partkey AS item, max({'day': l_shipdate, 'hs': CAST(l_suppkey % 5 AS VARCHAR)}).hs AS last_code FROM lineitem GROUP BY l_partkey)
SELECT p_partkey AS item, CAST(p_size % 5 AS VARCHAR) AS hs, last_code, coalesce(CAST(p_size % 5 AS VARCHAR) <> last_code, false) AS code_warning FROM part LEFT JOIN h ON item = p_partkey"""


def draft_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer as drafts of one declaration."""
    rows = read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    return rules.drafts(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "version", "origin", "is_current")


DRAFT_VERSIONS = """
WITH d AS (SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS version, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, version, 'MANUAL' AS origin, version = n AS is_current FROM d"""


def normalized_values(spark: SparkSession, sf: str) -> DataFrame:
    """Dates, units, currencies and party names of orders in several spellings."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    date = normalizers.date(_pick(k, F.date_format(day, "yyyy/MM/dd"), F.date_format(day, "dd-MM-yyyy"), F.date_format(day, "d MMM yyyy"), F.date_format(day, "MMM dd, yyyy"), F.date_format(day, "yyyyMMdd"), F.lit("31/02/2026"), F.lit(" ")))
    unit, money = normalizers.unit(_pick(k, " pcs", "Set", "BOX", None)), normalizers.currency(_pick(k, "usd", "$", "rmb", "doubloon"))
    party = normalizers.party(_pick(k, "Acme Co., Ltd.", "ACME", "Foo-Bar GmbH"))
    return read(spark, sf, "orders").select("o_orderkey", date["value"].alias("day"), date["status"].alias("day_status"), unit["value"].alias("unit"), unit["status"].alias("unit_status"), money["value"].alias("currency"), money["status"].alias("currency_status"), party.alias("party"))


NORMALIZED_VALUES = f"""
WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_orderkey % 7 AS f FROM orders),
p AS (SELECT *, f = 1 AND day(d) <= 12 AND day(d) <> month(d) AS either FROM o)
SELECT k AS o_orderkey, CASE WHEN f < 5 AND NOT either THEN d END AS day, CASE WHEN f = 6 THEN NULL WHEN either THEN 'AMBIGUOUS' WHEN f = 5 THEN 'UNKNOWN' ELSE 'PARSED' END AS day_status,
  {_case("k", "PCE", "SET", None, None)} AS unit, {_case("k", "PARSED", "PARSED", "NEEDS_REVIEW", None)} AS unit_status, {_case("k", "USD", None, "CNY", None)} AS currency, {_case("k", "PARSED", "AMBIGUOUS", "PARSED", "NEEDS_REVIEW")} AS currency_status,
  {_case("k", "ACME", "ACME", "FOO BAR")} AS party FROM p"""


def country_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Countries of customers written as names or codes, some of them unknown."""
    catalog = read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    rows = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    said = _pick(F.col("c_custkey"), F.lower("n_name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.lit("ATLANTIS"))
    return normalizers.countries(rows.select("c_custkey", said.alias("said")), "said", catalog).select("c_custkey", "country", "country_status")


COUNTRY_CODES = """
SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'N' || c_nationkey END AS country, CASE WHEN c_custkey % 3 < 2 THEN 'PARSED' ELSE 'NEEDS_REVIEW' END AS country_status FROM customer"""

QUERIES = [
    (item_row_kinds, ITEM_ROW_KINDS),
    (competing_columns, COMPETING_COLUMNS),
    (packing_values, PACKING_VALUES),
    (packing_headers, PACKING_HEADERS),
    (packing_items, PACKING_ITEMS),
    (page_routes, PAGE_ROUTES),
    (safe_documents, SAFE_DOCUMENTS),
    (next_line_values, NEXT_LINE_VALUES),
    (record_assembly, RECORD_ASSEMBLY),
    (flattened_fields, FLATTENED_FIELDS),
    (grounding_audit, GROUNDING_AUDIT),
    (stored_tags, STORED_TAGS),
    (stored_results, STORED_RESULTS),
    (stored_rows, STORED_ROWS),
    (rule_checks, RULE_CHECKS),
    (declaration_fields, DECLARATION_FIELDS),
    (code_history, CODE_HISTORY),
    (draft_versions, DRAFT_VERSIONS),
    (normalized_values, NORMALIZED_VALUES),
    (country_codes, COUNTRY_CODES),
]
