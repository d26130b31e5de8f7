"""Records from sheets and pages: the fixtures, and every way a sheet can be odd."""

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import dictionaries as d
from tradeloom.operators import fields, grids, labels, packing, records

CELL = "document_id string, sheet string, row int, col int, value_text string, data_type string"
SHEET = "document_id string, sheet string, state string, hidden_rows array<int>, hidden_columns array<string>"
MERGE = "document_id string, sheet string, top int, left int, bottom int, right int"
HEAD = [(11, 3, "ITEM CODE"), (11, 4, "DESCRIPTION"), (11, 5, "QTY"), (11, 6, "UNIT"), (11, 7, "UNIT PRICE"), (11, 8, "AMOUNT")]
ROW = lambda r, *values: [(r, c, v) for c, v in zip(range(3, 9), values, strict=True) if v is not None]
BODY = [*ROW(12, "000009", "Synthetic control motor", "0.00", "PCS", "12.50", "0.00"), *ROW(13, "000010", "TOTAL CONTROL", "2.50", "PCS", "4.00", "10.00")]
TOP = [
    (1, 1, "COMMERCIAL INVOICE"), (2, 1, "INVOICE NO"), (2, 2, "0000456"), (3, 1, "INVOICE DATE"), (3, 2, "2026-10-29"), (4, 1, "SELLER"), (4, 2, "Synthetic Exporter"), (5, 1, "BUYER"), (5, 2, "Synthetic Importer"),
    (6, 1, "SHIP TO"), (6, 2, "Synthetic Receiver"), (7, 1, "CURRENCY"), (7, 2, "USD"), (8, 1, "TOTAL AMOUNT"), (8, 2, "123456789012345.1200"), (9, 1, "FREIGHT"), (9, 2, "2.50"),
]
END = [(15, 1, "REMARKS"), (15, 2, "Synthetic payment terms")]


def frame(spark, docs, schema=CELL):
    """Cells of {document: [(row, col, text) or (row, col, text, type)]}."""
    rows = [(doc, "S", c[0], c[1], c[2], c[3] if len(c) > 3 else "s") for doc, cells in docs.items() for c in cells]
    return spark.createDataFrame(rows, schema)


def test_invoice_workbook(spark):
    docs = {"a": TOP + HEAD + BODY + END, "b": TOP[1:5]}
    got = {r.document_id: r for r in records.invoice_records(records.workbook_documents(frame(spark, docs))).collect()}
    a = got["a"]
    assert (a.status, a.codes) == ("EXTRACTED", [])
    assert a.fields == {"invoice_number": "0000456", "invoice_date": "2026-10-29", "seller.name": "Synthetic Exporter", "buyer.name": "Synthetic Importer", "ship_to.name": "Synthetic Receiver", "currency": "USD", "total_amount": "123456789012345.1200", "freight": "2.50"}
    assert [(i.item_code, i.description, i.quantity, i.unit, i.unit_price, i.amount) for i in a["items"]] == [("000009", "Synthetic control motor", "0.00", "PCS", "12.50", "0.00"), ("000010", "TOTAL CONTROL", "2.50", "PCS", "4.00", "10.00")]
    # the label of a number alone is no sure sign of an invoice
    assert (got["b"].status, got["b"].fields, got["b"].codes) == ("REFUSED", None, ["CLASSIFICATION_EVIDENCE_MISMATCH"])
    assert records.invoice_records(records.workbook_documents(frame(spark, {}))).collect() == []


def test_invoice_pages(spark):
    pages = [("p", 1, "COMMERCIAL INVOICE\nINVOICE NO: A1\nINVOICE DATE:\n2026-05-12\nTOTAL AMOUNT: 5.0 | FREIGHT: x"), ("p", 2, "TOTAL AMOUNT: 5.00\nSELLER:\nBUYER: B"), ("q", 1, None), ("q", 2, "")]
    got = {r.document_id: r for r in records.invoice_records(records.page_documents(spark.createDataFrame(pages, "document_id string, page int, text string"))).collect()}
    assert got["p"].fields == {"invoice_number": "A1", "invoice_date": "2026-05-12", "total_amount": "5.0", "buyer.name": "B"}
    assert got["p"].codes == ["PDF_ITEMS_UNSUPPORTED", "UNPARSEABLE_NUMERIC_FIELD"] and got["q"].status == "REFUSED"
    seen = [("p", 1, "COMMERCIAL INVOICE INVOICE NO", "TEXT_LAYER", "UNVERIFIED", False), ("p", 2, "INVOICE NO: 7", "OCR_LOCAL", "UNVERIFIED", False), ("p", 3, "COMMERCIAL INVOICE\nCURRENCY: EUR", "OCR_LOCAL", "SINGLE_PROVIDER", False)]
    (r,) = records.invoice_records(records.page_documents(spark.createDataFrame(seen, "document_id string, page int, text string, source string, level string, requires_review boolean"))).collect()
    assert (r.fields, r.codes) == ({"currency": "EUR"}, ["PDF_ITEMS_UNSUPPORTED", "UNRESOLVED_VISUAL_PAGE"])


#: Document -> (cells, hidden rows, hidden columns, merges, state) and what its items and codes are.
CASES = {
    "good": (HEAD + BODY, [], [], [], "visible", [12, 13], []),
    "twice": ([*HEAD, (11, 9, "QUANTITY"), *BODY], [], [], [], "visible", [], ["AMBIGUOUS_ITEM_COLUMNS"]),
    "two names": ([*HEAD[:-1], (11, 8, "AMOUNT / UNIT PRICE"), *BODY], [], [], [], "visible", [], ["AMBIGUOUS_ITEM_COLUMNS"]),
    "groups": ([(11, 1, "DESCRIPTION"), (11, 2, "QTY"), (11, 5, "ITEM CODE"), (11, 6, "AMOUNT"), (12, 1, "x"), (12, 2, "1")], [], [], [], "visible", [], ["AMBIGUOUS_ITEM_COLUMN_GROUPS"]),
    "one place": ([*HEAD, *BODY, (12, 3, "other")], [], [], [], "visible", [], ["INVALID_ITEM_GRID"]),
    "hidden row": (HEAD + BODY, [12], [], [], "visible", [13], ["HIDDEN_ITEM_ROW"]),
    "hidden blank": ([*HEAD, *BODY[:6], (13, 1, "x"), *ROW(14, "000010", "a", "1", None, None, "1")], [13], [], [], "visible", [12], []),
    "hidden column": (HEAD + BODY, [], ["E"], [], "visible", [], ["HIDDEN_ITEM_COLUMN"]),
    "hidden header": (HEAD + BODY, [11], [], [], "visible", [], ["HIDDEN_ITEM_HEADER"]),
    "hidden sheet": (HEAD + BODY, [], [], [], "hidden", [], ["HIDDEN_ITEM_TABLE"]),
    "merged header": (HEAD + BODY, [], [], [(11, 3, 11, 4)], "visible", [], ["MERGED_ITEM_HEADER"]),
    "merged row": (HEAD + BODY, [], [], [(13, 4, 14, 4)], "visible", [12], ["MERGED_ITEM_ROW"]),
    "merge of one": (HEAD + BODY, [], [], [(13, 4, 13, 4)], "visible", [12, 13], []),
    "merge beside": (HEAD + BODY, [], [], [(1, 1, 20, 2)], "visible", [12, 13], []),
    "subtotal": ([*HEAD, *BODY, *ROW(14, "SUBTOTAL", None, None, None, None, "10"), *ROW(15, "1", "z", "1", None, None, "1")], [], [], [], "visible", [12, 13], ["ITEM_SUBTOTAL_BOUNDARY"]),
    "footer": ([*HEAD, *BODY, *ROW(14, "NOTE: x", None, None, None, None, None)], [], [], [], "visible", [12, 13], ["AMBIGUOUS_ITEM_ROW"]),
    "marker and more": ([*HEAD, *BODY, *ROW(14, "TOTAL", "motor", "1", None, None, "1")], [], [], [], "visible", [12, 13, 14], ["AMBIGUOUS_ITEM_SUMMARY"]),
    "same below": ([*HEAD, *BODY, *[(14, c, t) for _, c, t in HEAD], *ROW(15, "3", "c", "1", "PCS", "1", "1")], [], [], [], "visible", [12, 13, 15], []),
    "same after total": ([*HEAD, *BODY, *ROW(14, "TOTAL", None, None, None, None, "1"), *[(15, c, t) for _, c, t in HEAD], *ROW(16, "3", "c", "1", "PCS", "1", "1")], [], [], [], "visible", [], ["MULTIPLE_ITEM_TABLES"]),
    "same after gap": ([*HEAD, *BODY, *[(15, c, t) for _, c, t in HEAD], *ROW(16, "3", "c", "1", "PCS", "1", "1")], [], [], [], "visible", [], ["MULTIPLE_ITEM_TABLES"]),
    "header alone": (HEAD, [], [], [], "visible", [], ["EMPTY_ITEM_TABLE"]),
    "no letter": ([(11, 4, "DESCRIPTION"), (11, 5, "QTY"), (12, 4, "123"), (12, 5, "1")], [], [], [], "visible", [], ["UNVERIFIED_ITEM_TABLE"]),
    "nothing": ([(1, 1, "x")], [], [], [], "visible", [], ["NO_ITEM_TABLE"]),
    "formula": ([*HEAD, *ROW(12, "1", "a", "=B1", "PCS", "x", "1")], [], [], [], "visible", [12], ["UNPARSEABLE_ITEM_FIELD", "UNRESOLVED_ITEM_FORMULA"]),
    "no number": ([*HEAD, *ROW(12, "1", "a", None, "PCS", None, None)], [], [], [], "visible", [12], ["INCOMPLETE_ITEM_ROW"]),
    "null and blank": ([*HEAD, *BODY, (14, 3, None), (14, 4, "  ")], [], [], [], "visible", [12, 13], []),
    "left of it": ([*HEAD, *BODY, (14, 1, "TOTAL")], [], [], [], "visible", [12, 13], []),
}


@pytest.fixture(scope="module")
def issues(spark):
    cells = frame(spark, {k: v[0] for k, v in CASES.items()})
    sheets = spark.createDataFrame([(k, "S", v[4], v[1], v[2]) for k, v in CASES.items()], SHEET)
    merges = spark.createDataFrame([(k, "S", *m) for k, v in CASES.items() for m in v[3]], MERGE)
    return {r.document_id: r for r in grids.item_documents(cells, sheets, merges).collect()}


@pytest.mark.parametrize("case", CASES)
def test_item_tables(issues, case):
    assert ([i.row for i in issues[case]["items"]], issues[case].codes) == (CASES[case][5], CASES[case][6])


def test_coordinates_and_sheets(spark):
    rows = [("d", "S", r, c, t, "s", f"{chr(64 + c)}{r}") for r, c, t in HEAD + BODY] + [("d", "T", 1, 1, "x", "s", "B1"), ("e", "S", 1, 1, "x", "s", "A1"), ("e", None, 1, 1, "x", "s", "A1")]
    got = {r.document_id: r for r in grids.item_documents(spark.createDataFrame(rows, CELL + ", coordinate string")).collect()}
    assert (got["d"].codes, got["d"]["items"], got["e"].codes) == (["INVALID_ITEM_GRID"], [], ["NO_ITEM_TABLE"])
    named = spark.createDataFrame([("d", "S", "visible", [], []), ("d", "S", "visible", [], [])], SHEET)
    (twice,) = grids.item_documents(frame(spark, {"d": HEAD + BODY}), named).collect()
    assert twice.codes == ["INVALID_ITEM_GRID"]


def test_packing_survives_bad_sheets(spark):
    docs = {"ok": [(1, 1, "ITEM CODE"), (1, 2, "GROSS WEIGHT"), (2, 1, "P1"), (2, 2, "1.5", "n")], "bad": [(1, 1, "ITEM CODE"), (1, 2, "GROSS WEIGHT"), (1, 3, "GROSS WEIGHT"), (2, 1, "P1"), (2, 1, "P2"), (2, 2, "1", "n")]}
    assert [(r.document_id, r.item_code, r.gross_weight) for r in packing.items(frame(spark, docs)).collect()] == [("ok", "P1", "1.5")]


def test_lines(spark):
    page = (
        "INVOICE NO: 5 | DUE DATE: 2026-01-01 | DATE: 2026-02-02\nINVOICE DATE:\n2026-05-12\nSELLER  ACME Ltd  TOTAL AMOUNT = 5.00\nTOTAL AMOUNT: =A1 | INVOICE NO: 6\n"
        "FOO BAR: x ; CURRENCY - USD\n=1 INVOICE NO: 9\nBUYER:\nSELLER: z\nSHIP TO:\n\nSELLER BANK ACCOUNT: 1\nINVOICE NOTES 5\nseller： 甲\n2026-05-12 14:30 INVOICE NO  8"
    )
    rows = fields.lines(spark.createDataFrame([(1, page), (2, None), (3, "")], "id int, text string"), "id", "text")
    got = [(r.line, r.path, r.raw_value, r.confidence) for r in fields.labelled_values(rows).orderBy("line", "place").collect()]
    assert got == [
        (0, "invoice_number", "5", 0.95), (0, "invoice_date", "2026-02-02", 0.70), (1, "invoice_date", "2026-05-12", 0.95), (3, "seller.name", "ACME Ltd", 0.95), (3, "total_amount", "5.00", 0.95),
        (4, "total_amount", "=A1 | INVOICE NO: 6", 0.95), (5, "currency", "USD", 0.95), (8, "seller.name", "z", 0.95), (13, "seller.name", "甲", 0.95),
    ]


def test_cells(spark):
    cells = [(1, 1, "INVOICE NO: 77"), (1, 2, "x"), (3, 1, "SELLER"), (3, 3, "CONSIGNEE"), (4, 1, "ACME"), (6, 1, "BUYER"), (7, 1, "TEL: 5"), (8, 1, "B"), (10, 1, "CURRENCY"), (10, 5, "USD"), (12, 1, "FREIGHT:"), (14, 1, "2.50"), (16, 1, "INVOICE DATE: | SHIP TO: here")]
    got = {(r.path, r.raw_value, r.value_row, r.value_col) for r in fields.neighbours(frame(spark, {"d": cells})).collect()}
    assert got == {("invoice_number", "77", 1, 1), ("seller.name", "ACME", 4, 1), ("freight", "2.50", 14, 1), ("ship_to.name", "here", 16, 1)}


def test_labels(spark):
    df = spark.createDataFrame([(t,) for t in ("INVOICE NO", "NET WEIGHT:", "PHONE: 1", "2026-01-02 10:30", "=A1:B2", "ACME", None, "BANK  ACCOUNT\t1", ":")], "t string")
    assert [r.x for r in df.select(labels.is_label(labels.marked(F.col("t"), d.HEADER_ALIASES)).alias("x")).collect()] == [True, True, True, False, False, False, None, True, True]
