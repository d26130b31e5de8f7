"""Spreadsheet files, visibility, sources and outcomes on small cases."""

import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import lexical, normalizers
from tradeloom.operators import assembly, attempts, codecs, fingerprints, ledger, packing, rules, tables
from tradeloom.sources import xlsx
from tradeloom.streaming import intake

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
SHEET = f"""<worksheet {MAIN}><cols><col min="3" max="5" hidden="1"/><col min="1" max="1"/></cols><sheetData>
<row r="2" hidden="1"><c r="B2" t="s"><v>1</v></c><c r="A2"><v>12500.5</v></c></row>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f>A2*2</f><v>25001</v></c><c r="C1" t="b"><v>1</v></c><c r="D1" s="1"><v>46023</v></c><c r="E1"/></row>
<row r="3"><c r="AA3" t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c r="AB3" t="e"><v>#REF!</v></c></row>
</sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>"""


def workbook():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><sheets><sheet name="One" sheetId="1" r:id="rId7"/><sheet name="Two" sheetId="2" state="hidden" r:id="rId8"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="rId7" Target="worksheets/a.xml"/><Relationship Id="rId8" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>INVOICE NO</t></si><si><r><t>00</t></r><r><t>456</t></r><rPh><t>x</t></rPh></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/a.xml", SHEET)
        z.writestr("xl/worksheets/b.xml", f"<worksheet {MAIN}><sheetData/></worksheet>")
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good.xlsx").write_bytes(workbook())
    (tmp_path / "in" / "bad.xlsx").write_bytes(b"PK no zip")
    files = xlsx.files(spark, str(tmp_path / "in")).withColumn("document_id", F.element_at(F.split("document_id", "/"), -1))
    cells = [(r.coordinate, r.row, r.col, r.value_text, r.displayed, r.data_type, r.is_formula) for r in xlsx.cells(files).collect()]
    assert cells == [
        ("A1", 1, 1, "INVOICE NO", "INVOICE NO", "s", False), ("B1", 1, 2, "=A2*2", None, "f", True), ("C1", 1, 3, "true", "true", "b", False), ("D1", 1, 4, "2026-01-01T00:00:00", "2026-01-01T00:00:00", "d", False),
        ("A2", 2, 1, "12500.5", "12500.5", "n", False), ("B2", 2, 2, "00456", "00456", "s", False), ("AA3", 3, 27, "inline", "inline", "s", False), ("AB3", 3, 28, "#REF!", "#REF!", "e", False),
    ]
    sheets = {(r.document_id, r.sheet): r for r in xlsx.sheets(files).collect()}
    one = sheets["good.xlsx", "One"]
    assert (one.state, one.merged_ranges, one.hidden_rows, one.hidden_columns, one.code) == ("visible", ["A1:B2"], [2], ["C", "D", "E"], None)
    assert sheets["good.xlsx", "Two"].state == "hidden" and sheets["bad.xlsx", None].code == "FILE_CORRUPTED"
    assert xlsx.cells(files.limit(0)).count() == 0 and [xlsx.letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"] and xlsx.bounds("B2:AA10") == (2, 2, 10, 27)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n007,"a, b"\n8,\n')
    assert [tuple(r) for r in xlsx.csv(spark, str(tmp_path / "a.csv"), ["id", "note"]).collect()] == [("007", "a, b"), ("8", None)]


CELL = "document_id string, sheet string, row int, col int, coordinate string, value_text string"


def test_seen(spark):
    cells = spark.createDataFrame([("d", s, r, c, "", "x") for s in "ST" for r in (1, 2, 3) for c in (1, 2)] + [("e", "S", 1, 1, "", "x")], CELL)
    sheets = spark.createDataFrame([("d", "S", "visible", [2], []), ("d", "T", "hidden", [], []), ("e", "S", "hidden", [], [])], "document_id string, sheet string, state string, hidden_rows array<int>, hidden_columns array<string>")
    merges = spark.createDataFrame([("d", "S", 1, 1, 2, 1)], "document_id string, sheet string, top int, left int, bottom int, right int")
    assert sorted((r.document_id, r.sheet, r.row, r.col) for r in tables.seen(cells, sheets).collect()) == [("d", "S", 1, 1), ("d", "S", 1, 2), ("d", "S", 3, 1), ("d", "S", 3, 2), ("e", "S", 1, 1)]
    assert sorted((r.document_id, r.row, r.col) for r in tables.seen(cells, sheets, merges).collect()) == [("d", 1, 2), ("d", 3, 1), ("d", 3, 2), ("e", 1, 1)]


def test_sources_and_routing(spark):
    cells = spark.createDataFrame([("d", "S", 1, 1, "A1", "Invoice No: 17"), ("d", "S", 2, 1, "A2", "CURRENCY"), ("d", "S", 2, 2, "B2", " USD "), ("d", "S", 3, 1, "A3", "DATE:"), ("d", "S", 3, 2, "B3", "=B2"), ("d", "S", 4, 2, "B4", "CURRENCY")], CELL)
    got = {(r.path, r.raw_value, r.cell) for r in assembly.sources(cells, {"number": ["INVOICE NO"], "currency": ["CURRENCY"], "date": ["DATE"]}).collect()}
    assert got == {("number", "17", "A1"), ("currency", "USD", "B2")}
    assert assembly.header_cells(cells, cells.where("row = 2")).count() == 4
    results = spark.createDataFrame([(1, "EXTRACTED", False, False), (2, "EXTRACTED", True, False), (3, "NEEDS_REVIEW", False, True)], "id int, status string, no boolean, bad boolean")
    kept, refused = assembly.outcomes(results, F.col("no"), F.col("bad"))
    assert sorted((r.id, r.status) for r in kept.collect()) == [(1, "EXTRACTED"), (3, "FAILED")] and [r.id for r in refused.collect()] == [2]
    docs = spark.createDataFrame([("a", "PACKING_LIST", "CLASSIFIED", 0.6), ("b", "PACKING_LIST", "CLASSIFIED", float("nan")), ("c", "PACKING_LIST", "NEEDS_REVIEW", 0.9), ("d", "OTHER", "CLASSIFIED", 0.9), ("e", "PACKING_LIST", "CLASSIFIED", 1.5), ("f", "PACKING_LIST", None, None)], "id string, document_type string, classification_status string, confidence double")
    assert [r.id for r in assembly.classified(docs, ["PACKING_LIST"]).collect()] == ["a"]


def test_envelope_and_duplicate_keys(spark):
    rows = spark.createDataFrame([(1, "invoice"), (2, "invoice"), (2, "packing_list")], "v int, k string")
    texts = [r.x for r in rows.select(codecs.envelope(F.col("v"), F.col("k"), F.struct(F.lit(None).cast("string").alias("a"))).alias("x")).collect()]
    assert texts == ['{"format_version":1,"result_type":"invoice","result":{"a":null}}', None, '{"format_version":2,"result_type":"packing_list","result":{"a":null}}']
    odd = spark.createDataFrame([('{"a":{"b":1,"b":1}}',), ('{"a":1e999}',), ("{",), (None,), ('{"a":Infinity}',), ("{}",)], "t string")
    assert [r.x for r in odd.select(codecs.is_strict_json("t").alias("x")).collect()] == [False, True, False, False, False, True]


def test_rules_are_checked():
    good = {"rule_id": "A", "category": "LEGAL", "operator": "present", "inputs": ["a"], "source": "law"}
    assert rules.checked([good])
    for bad in ({**good, "source": None}, {**good, "category": "X"}, {**good, "operator": "x"}, {**good, "inputs": []}):
        with pytest.raises(ValueError, match="rule"):
            rules.checked([bad])
    with pytest.raises(ValueError, match="repeated"):
        rules.checked([good, good])


def test_multiline_evidence_and_parties(spark):
    rows = spark.createDataFrame([("packing_list_number", "PL1\nPL NO: 2", False), ("packing_list_number", "PL1\nmore", False), ("date", "2026-05-01", True), ("date", None, None)], "path string, raw string, blocked boolean")
    got = [(r.o.value, r.o.code) for r in rows.select(packing.observed(F.col("path"), F.col("raw"), F.col("blocked")).alias("o")).collect()]
    assert got == [(None, "AMBIGUOUS_MULTILINE_VALUE"), ("PL1\nmore", None), (None, "UNSAFE_CELL_EVIDENCE"), (None, "MISSING_LABEL_VALUE")]
    names = spark.createDataFrame([("Co Co Ltd",), (None,), ("a.b.c",)], "n string")
    assert [r.x for r in names.select(normalizers.party(F.col("n")).alias("x")).collect()] == ["CO", None, "A B C"]
    assert [r.x for r in names.limit(1).select(normalizers.item_code(F.lit(" 00-a 1")).alias("x")).collect()] == ["00-A1"]
    assert names.limit(1).select(lexical.parse_decimal(F.lit("1,200.50"), "decimal(10,2)").alias("x")).first().x == Decimal("1200.50")


def test_append_with_preconditions(spark, tmp_path):
    path = f"file://{tmp_path}/attempts"
    sources = spark.createDataFrame([(f"d{i}", "h") for i in range(20)] + [("d0", "h"), (None, "h")], "document_id string, source_hash string")
    kind = "document_id string, attempt_id string, seq bigint, expected_id string, source_hash string, status string"
    # 1,000 requests compete for the first attempts of 20 documents
    first = spark.createDataFrame([(f"d{i % 20}", f"a{i}", i, None, "h", "EXTRACTED") for i in range(1000)], kind).repartition(7)
    ledger.append(spark, path, first, sources, 0)
    got = ledger.history(ledger.read(spark, path)).collect()
    assert sorted((r.document_id, r.attempt_id, r.attempt_number, r.is_active) for r in got) == sorted((f"d{i}", f"a{i}", 1, True) for i in range(20))
    assert ledger.read(spark, path).where("decision = 'REPLACEMENT_REQUIRED'").count() == 980
    rows = [
        ("d0", "b1", 1, "a0", "h", "FAILED"), ("d0", "b2", 2, "a0", "h", "NEEDS_REVIEW"), ("d0", "b3", 3, "a0", "h", "EXTRACTED"), ("d0", "b4", 4, "b2", "h", "EXTRACTED"), ("d0", "b4", 5, "b4", "h", "EXTRACTED"),
        ("d1", "c1", 1, "a1", "other", "EXTRACTED"), ("d1", "c2", 2, None, "h", "EXTRACTED"), ("d1", "c3", 3, "a1", "h", "odd"), ("d1", None, 4, "a1", "h", "EXTRACTED"), ("zz", "e", 1, None, "h", "EXTRACTED"), (None, "f", 1, None, "h", "EXTRACTED"),
    ]
    want = [
        ("d0", "b1", "ACCEPTED", 2, None), ("d0", "b2", "ACCEPTED", 3, "a0"), ("d0", "b3", "STALE_ACTIVE", None, None), ("d0", "b4", "ACCEPTED", 4, "b2"), ("d0", "b4", "REPEATED_ATTEMPT", None, None),
        ("d1", "c1", "SOURCE_CHANGED", None, None), ("d1", "c2", "REPLACEMENT_REQUIRED", None, None), ("d1", "c3", "BAD_STATUS", None, None), ("d1", None, "REPEATED_ATTEMPT", None, None), ("zz", "e", "SOURCE_NOT_FOUND", None, None), (None, "f", "SOURCE_NOT_FOUND", None, None),
    ]
    for _ in range(2):  # a replay changes nothing
        ledger.append(spark, path, spark.createDataFrame(rows, kind), sources, 1)
        got = ledger.read(spark, path).where("batch = 1").collect()
        assert sorted(((r.document_id, r.attempt_id, r.decision, r.attempt_number, r.supersedes) for r in got), key=repr) == sorted(want, key=repr)
    whole = {(r.document_id, r.attempt_id): r.is_active for r in ledger.history(ledger.read(spark, path)).collect()}
    assert len(whole) == 23 and sum(whole.values()) == 20 and whole["d0", "b4"] and not whole["d0", "a0"]
    ledger.append(spark, path, spark.createDataFrame([], kind), sources, 2)
    assert ledger.read(spark, path).where("batch = 2").count() == 0


def test_chain(spark):
    events = spark.createDataFrame([(k, i, f"e{i}") for k in "ab" for i in range(5)] + [("c", 0, None)], "k string, i int, body string")
    content = F.concat_ws("|", "k", "i", F.coalesce("body", F.lit("-")))
    entries = ledger.chained(events, "k", ["i"], content)
    assert ledger.broken(entries, "k", ["i"], content).collect() == []
    changed = entries.withColumn("body", F.when((F.col("k") == "a") & (F.col("i") == 2), "x").otherwise(F.col("body")))
    assert [(r.k, r.i) for r in ledger.broken(changed, "k", ["i"], content).orderBy("i").collect()] == [("a", 2), ("a", 3)]
    assert [(r.k, r.i) for r in ledger.broken(entries.where("not (k = 'b' and i = 3)"), "k", ["i"], content).collect()] == [("b", 4)]


def test_attempt_state_survives_a_restart(spark, tmp_path):
    # the state of the first run is found by the second
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "user_id bigint, event_id bigint, ts timestamp, event_type string"
    rows = [(u, 10 * k + u, f"2026-01-01 00:{k:02d}:00", "error" if (k + u) % 3 == 0 else "view") for u in (1, 2) for k in range(6)]
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (0, 1):
        df.where(f"event_id div 30 = {part}").write.mode("append").parquet(str(tmp_path / "in"))
        out = intake.attempt_state(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("user_id", "event_id", "attempt_number", "active_id", "supersedes").collect()
    want = attempts.history(df, "user_id", "event_id", ["ts", "event_id"], F.col("event_type") == "error").select("user_id", "event_id", "attempt_number", "active_id", "supersedes").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(got) == 12


def test_fingerprints(spark):
    rows = [(1, "a", None), (2, "b", ""), (2, "b", "")]
    df = spark.createDataFrame(rows, "i int, t string, u string")

    def seen(frame, name):
        out, found = fingerprints.observed(frame, ["i", "t", "u"], name)
        out.write.format("noop").mode("overwrite").save()
        return found

    first = seen(df, "first")
    assert fingerprints.unchanged(first, seen(df.orderBy(F.desc("i")).repartition(3), "other order"))
    for k, changed in enumerate((df.limit(2), df.union(df.limit(1)), df.fillna(""), df.withColumn("t", F.upper("t")), df.distinct())):
        assert not fingerprints.unchanged(first, seen(changed, f"changed {k}"))
    assert seen(df.limit(0), "none").get == {"rows": 0, "code_sum": 0, "code_xor": 0}


def test_header_evidence_is_grouped_without_a_sort(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000")  # text operators cut plans
    rows = [(1, "date", "2024-13-01", False, 1), (1, "date", "2024-01-02", True, 2), (1, "invoice_references", "B", False, 2), (1, "invoice_references", "A\nINVOICE NO: 2", False, 1), (2, "total_packages", "1,200", None, 1), (2, "packing_list_number", " x ", None, 1)]
    df = spark.createDataFrame(rows, "document_id int, path string, raw_value string, blocked boolean, seq int")
    got = {(r.document_id, r.path): (r["values"], r.code) for r in packing.header(df).collect()}
    assert got == {
        (1, "date"): ([], "UNPARSEABLE_DATE_FIELD"), (1, "invoice_references"): (["B"], "AMBIGUOUS_MULTILINE_VALUE"),
        (2, "total_packages"): ([], "UNPARSEABLE_NUMERIC_FIELD"), (2, "packing_list_number"): (["x"], None),
    }
    plan = packing.header(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    assert packing.REFUSALS == sorted(packing.REFUSALS)
