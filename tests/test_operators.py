"""Truth tables and small cases of the operators."""

import io
import random
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import dictionaries, lexical
from tradeloom.operators import attempts, checks, classify, fields, grids, intake, reconcile, revisions, tables, windows
from tradeloom.plans import documents

DECIMALS = {
    "1200": "1200", "+1200": "1200", "-500": "-500", "0": "0", "1200.50": "1200.50", "12,5": "12.5", "0,05": "0.05", "1,200.50": "1200.50", "1,200,000.50": "1200000.50",
    "1.200,50": "1200.50", "1.200.000,50": "1200000.50", "1234.567": "1234.567", "1,200": None, "1.200": None, "123,456": None, "1,200,000": None, "1.200.000": None,
    "=B4*C4": None, "abc1200": None, "USD 1200": None, "1200 USD": None, "": None, "True": None, "1e5": None, None: None,
}
DATES = {"2026-05-12": True, "2026/05/12": True, "2026.05.12": True, "01/02/2026": False, "2026-02-30": False, "2026-13-01": False, "2026-05/12": False, "2026-05-12 extra": False, "": False, "0000-01-01": False}
NUMBERS = {"1,200.50": "1200.5", "1.200,50": "1200.5", "1,234,567": "1234567", "1,234": "AMBIG:1,234", "007": "7", "-0": "0", "12,50": "12.5", "1..2": "AMBIG:1..2", "12,34.5": "AMBIG:12,34.5", "-1,2,3": "AMBIG:-1,2,3", "-0.0": "-0", "1234.500": "1234.5", "+1.5": "1.5", "--": "RAW:--"}


def one(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_lexical(spark):
    got = one(spark, list(DECIMALS), lexical.parse_decimal)
    assert got == [None if v is None else Decimal(v) for v in DECIMALS.values()]
    assert [x is not None for x in one(spark, list(DATES), lexical.parse_date)] == list(DATES.values())
    assert one(spark, list(NUMBERS), lexical.canonical_number) == list(NUMBERS.values())
    dates = {"2026-1-5 and 13/02/2026 or 01.02.2026": ["2026-01-05", "2026-02-13", "AMBIG:01/02/2026"], "05/05/2026": ["AMBIG:05/05/2026"], "01/13/2026 30.2.2024 2023-02-29 2024-02-29": ["2024-02-29"], None: []}
    assert one(spark, list(dates), lexical.date_tokens) == list(dates.values())
    numbers = {"INV-2026/05/01 7 on 2026.05.01": ["7"], "31/02/2026": ["2", "2026", "31"], "A1B2 12 3": ["12", "3"]}
    assert one(spark, list(numbers), lexical.number_tokens) == list(numbers.values())
    assert one(spark, ["ab12 INV-2026/05/01 xyz 77"], lexical.identifier_tokens) == [["AB12", "INV-2026/05/01"]]
    assert one(spark, ["ref inv-12 no 12"], lexical.identifier_tokens) == [["INV-12"]]
    assert one(spark, ["A", "Z", "AA", "XFD"], lexical.column_number) == [1, 26, 27, 16384]
    assert one(spark, ["CSQU3054383", "csqu 305438-3", "CSQU3054384"], lexical.container_check) == ["CSQU3054383", "CSQU3054383", None]
    assert one(spark, [r"C:\x\a.PDF", "../b.xlsx "], lambda c: lexical.extension(lexical.safe_filename(c))) == ["pdf", "xlsx"]
    assert one(spark, ["ﬁ  Ａ\tß", None], lexical.normalize) == ["fi a ss", None]


@pytest.mark.parametrize(
    ("text", "kind"),
    [("COMMERCIAL INVOICE", "COMMERCIAL_INVOICE"), ("PACKING LIST with GROSS WEIGHT", "PACKING_LIST"), ("This is an AIR WAYBILL", "AIR_WAYBILL"), ("TỜ KHAI HẢI QUAN", "CUSTOMS_DECLARATION"),
     ("BILL OF LADING and AIR WAYBILL combined", "UNKNOWN"), ("", "UNKNOWN"), ("C/O", "UNKNOWN"), ("COMMERCIAL INVOICE per B/L 7", "BILL_OF_LADING")],
)
def test_classification(spark, text, kind):
    df = spark.createDataFrame([(1, text)], "document_id int, text string")
    assert classify.decided(classify.scored(df, "text")).first().document_type == kind


def test_dictionaries():
    assert dictionaries.checked({"a": ["X"], "b": ["Y"]})
    with pytest.raises(ValueError, match="already"):
        dictionaries.checked({"a": ["INVOICE  no"], "b": ["Invoice No"]})


def test_intake(spark):
    rows = [("s-1", "a.pdf", None, b"%PDF-1.7"), ("s-1", "a.png", "image/png", b"%PDF"), ("s 1", "a.pdf", None, b"%PDF-"), ("s", "a.exe", None, b"x"), ("s", "a.csv", "text/csv", b"a,b\n1,2"), ("s", "b.csv", None, b"a\x00b"), ("s", "c.pdf", None, b"")]
    got = intake.validated(spark.createDataFrame(rows, "shipment_id string, filename string, mime string, content binary")).collect()
    assert [r.code for r in got] == [None, "SIGNATURE_MISMATCH", "INVALID_SHIPMENT_ID", "UNSUPPORTED_EXTENSION", None, "SIGNATURE_MISMATCH", "EMPTY_FILE"]
    docs = spark.createDataFrame([(1, "k", "x"), (2, "k", "x"), (3, None, "x"), (4, None, "x")], "id int, key string, text string")
    assert sorted((r.id, r.winner_id) for r in intake.deduplicated(docs, "key", "id", "text").collect()) == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_conflict_policies(spark):
    df = spark.createDataFrame([(1, "a", 0.7, 2, False), (1, "a", 0.9, 1, True), (2, "a", 0.9, 1, False), (2, "b", 0.9, 2, False), (3, None, 0.9, 1, False), (3, "c", 0.5, 2, False)], "k int, v string, conf double, seq int, blocked boolean")
    got = {r.k: (r.value, r.code) for r in fields.consolidated(df, ["k"], "v", "conf", "seq").collect()}
    assert got == {1: ("a", None), 2: (None, "CONFLICTING_VALUES"), 3: ("c", "PARTLY_UNPARSEABLE")}
    assert {r.k: r.value for r in fields.vetoed(df, ["k"], "v", "blocked").collect()} == {1: None, 2: None, 3: "c"}


def test_sheet(spark):
    grid = [(1, 1, "Invoice No:"), (1, 3, "00456"), (2, 1, "INVOICE DATE"), (2, 2, "CURRENCY"), (3, 1, "2026-10-29"), (3, 2, "USD"), (5, 3, "ITEM CODE"), (5, 4, "QTY"), (6, 3, "000009"), (6, 4, "2.50"), (7, 3, "TOTAL CONTROL"), (7, 4, "=A1"), (8, 3, "TOTAL"), (8, 4, "9"), (9, 3, "x"), (9, 4, "1")]
    cells = spark.createDataFrame([("d", "S", *c) for c in grid], "document_id string, sheet string, row int, col int, value_text string")
    assert {(r.path, r.raw_value) for r in fields.neighbours(cells).collect()} == {("invoice_number", "00456"), ("invoice_date", "2026-10-29"), ("currency", "USD")}
    (doc,) = grids.item_documents(cells).collect()
    assert [(i.row, i.item.item_code, i.item.quantity, i.item.codes) for i in doc["items"]] == [(6, "000009", "2.50", []), (7, "TOTAL CONTROL", None, ["UNRESOLVED_ITEM_FORMULA"])]
    merges = spark.createDataFrame([("d", "S", 1, 1, 1, 3), ("d", "S", 1, 2, 2, 2)], "document_id string, sheet string, top int, left int, bottom int, right int")
    assert {r.code for r in tables.merge_conflicts(cells, merges).collect()} == {"POPULATED_MERGE_INTERIOR", "OVERLAPPING_MERGES"}


def test_proposals(spark):
    kind = "document_id string, path string, raw_value string, page int, sheet string, cell string, value string"
    source = spark.createDataFrame([("d", "a", "1", 1, None, None, "1"), ("d", "b", "2", None, "S", "A1", "2")], kind)
    proposed = spark.createDataFrame([("d", "a", "1", 1, None, None, "1"), ("d", "b", "2", None, "S", "A1", "3"), ("d", "a", "1", 2, None, None, "1")], kind)
    got = fields.grounded(proposed, source, spark.createDataFrame([], "document_id string, path string")).collect()
    assert sorted(str(r.code) for r in got) == ["NOT_GROUNDED", "None", "VALUE_MISMATCH"]


def test_attempts(spark):
    rows = spark.createDataFrame([(1, "d", 1, "FAILED"), (2, "d", 2, "EXTRACTED"), (3, "d", 3, "FAILED"), (4, "d", 4, "NEEDS_REVIEW")], "id int, doc string, t int, status string")
    got = attempts.history(rows, "doc", "id", ["t"], F.col("status") == "FAILED").orderBy("id").collect()
    assert [(r.attempt_number, r.active_id, r.supersedes, r.is_active) for r in got] == [(1, None, None, False), (2, 2, None, False), (3, 2, None, False), (4, 4, 2, True)]
    assert attempts.active(rows, "doc", "id", ["t"], F.col("status") == "FAILED").first().active_id == 4


def test_reconciled(spark):
    a = spark.createDataFrame([(1, "total 1,200.50 paid", True), (2, "total 12500.50", True), (3, "x", False)], "page int, text string, usable boolean")
    b = spark.createDataFrame([(1, "total 1200.50 paid", True), (2, "total 125000.50", True), (4, "y", True)], "page int, text string, usable boolean")
    assert {r.page: r.level for r in reconcile.reconciled(a, b, ["page"]).collect()} == {1: "CROSS_VERIFIED", 2: "CONFLICT", 3: "UNVERIFIED", 4: "SINGLE_PROVIDER"}


def test_policy(spark):
    df = spark.createDataFrame([("AIR", 113, 108, 108), ("AIR", 113, 108, 113), ("SEA", 5, 5, 5), ("SEA", None, 5, 5)], "mode string, an_weight int, transport_weight int, declared_weight int")
    got = [(r.outcome_a, r.outcome_b, r.outcome_c) for r in checks.arrival_policy(df).collect()]
    assert got == [("FAIL", "OPEN", "BLOCK"), ("PASS", "OPEN", "BLOCK"), ("PASS", "CLEAR", "READY"), ("NOT_CHECKED", "BLOCK", "BLOCK")]


def written(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, lang string, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_possible_revisions(spark, tmp_path):
    start = "one beginning of more than forty characters in all "
    texts = [start + x for x in ("a b c", "p q r s t u v w x y z k l m n o", "a b d", "a b c", "p q r s t u v w x y z k l m n e")]
    rows = [(i, lang, t) for i, (lang, t) in enumerate([("en", t) for t in texts] + [(None, texts[0]), (None, texts[2]), ("de", texts[0]), ("en", "!"), ("en", None)])]
    want = {}
    for a, la, x in rows:
        for b, lb, y in rows:
            if a < b and la == lb and x and y and x != y:
                p, q = set(x.split()), set(y.split())
                if round(len(p & q) / len(p | q), 6) >= 0.5:
                    want[a, b] = round(len(p & q) / len(p | q), 6)
    folder = written(spark, tmp_path, rows)
    got, members = documents.possible_revisions(spark, folder).collect(), {}
    for r in documents.revision_members(spark, folder).collect():
        members.setdefault(r.text_id, []).append(r.doc_id)
    # pairs of texts stand for all pairs of their documents
    spread = {tuple(sorted((x, y))): r.overlap for r in got for x in members[r.other_id] for y in members[r.doc_id]}
    assert len(got) == 3 and spread == want and len(want) == 4 and sorted(members[0]) == [0, 3]


@pytest.mark.parametrize("split", [1, 2000])
def test_overlapping_words(spark, monkeypatch, split):
    # every pair of sets that reaches the threshold, with frequent words in one part and in many
    monkeypatch.setattr(revisions, "SPLIT", split)
    rng = random.Random(split)
    sets = {i: sorted(set(rng.choices("abcdefghijkl", k=rng.randint(0, 9)))) for i in range(80)}
    df = spark.createDataFrame([(i, "x" if i % 3 else None, str(w), w) for i, w in sets.items()], "id bigint, k string, h string, w array<string>")
    first = {}
    for i, w in sets.items():
        first.setdefault((bool(i % 3), str(w)), i)
    ids = sorted(first.values())
    share = lambda x, y: len(set(x) & set(y)) / (len(set(x) | set(y)) or 1)
    want = {(i, j): round(share(sets[i], sets[j]), 6) for i in ids for j in ids if i < j and bool(i % 3) == bool(j % 3) and share(sets[i], sets[j]) >= 0.5}
    got = {(r.other_id, r.doc_id): r.overlap for r in revisions.overlapping(df, "id", "k", "h", "w", 0.5).collect()}
    assert got == want and len(want) > 30
    assert revisions.overlapping(df.limit(0), "id", "k", "h", "w", 0.5).collect() == []


@pytest.mark.parametrize("words", [1 << 22, 400])
def test_overlapping_in_blocks_and_rounds(spark, monkeypatch, words):
    """Small blocks, tiles and rounds lose no pair, pairs that aren't near leave no task, and an id may have two texts."""
    for name, value in {"WORDS": words, "SPLIT": 5 if words == 400 else 16_384, "TILE": 7, "CELLS": 3000}.items():
        monkeypatch.setattr(revisions, name, value)
    rng = random.Random(words)
    sets = []
    for i in range(90):
        w = rng.choices([f"w{k}" for k in range(400)], k=rng.choice([0, 1, 2, 20, 60, 150]))
        if i % 3 == 0 and sets:
            w = [x for x in rng.choice(sets)[2] if rng.random() < 0.8] + w[:3]
        sets.append((i if i != 50 else 49, "x" if i % 4 else None, sorted(set(w))))
    df = spark.createDataFrame([(i, k, f"{at}", w) for at, (i, k, w) in enumerate(sets)], "id bigint, k string, h string, w array<string>")
    want = []
    for x, (i, k, v) in enumerate(sets):
        for j, m, w in sets[x + 1 :]:
            both = len(set(v) & set(w))
            share = both / (len(v) + len(w) - both) if v or w else 1.0
            if k == m and i != j and share >= 0.5:
                want.append((min(i, j), max(i, j), share))
    got = sorted(map(tuple, revisions.overlapping(df, "id", "k", "h", "w", 0.5).collect()))
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and len(want) > 20
    assert all(abs(x[2] - y[2]) < 1e-6 for x, y in zip(got, sorted(want), strict=True))
    texts = df.where("size(w) > 0").selectExpr("coalesce(k, '-') AS key", "id", "xxhash64(h) AS t", "size(w) AS n", "transform(w, x -> hash(x)) AS codes")
    near = revisions._near(texts, 0.5)
    assert (len(near) > 1) == (words == 400)
    assert sum(x.count() for x in near) == sum(len(sets[a][2]) > 0 for a, *_ in _pairs(sets, 0.5))


def _pairs(sets, least):
    """(a, b): places of sets of a key that overlap, those of one id too."""
    each = [(a, b, set(sets[a][2]), set(sets[b][2])) for b in range(len(sets)) for a in range(b) if sets[a][1] == sets[b][1]]
    return [(a, b) for a, b, v, w in each if (v or w) and len(v & w) >= least * len(v | w)]


def test_page_conflict_reads_whole_texts(spark, tmp_path, monkeypatch):
    # a number beyond 400 characters, and texts that hold the number that was added before
    rows = [(3, "en", "total 77 paid"), (6, "en", "x " * 300 + "total 1,200.50 and 7777"), (9, "en", "no number")]
    seen = []
    whole = reconcile.reconciled
    monkeypatch.setattr(reconcile, "reconciled", lambda a, b, keys: seen.extend(r.text for r in a.collect()) or whole(a, b, keys))
    got = documents.page_conflict(spark, written(spark, tmp_path, rows)).collect()
    assert [(r.level, r.n) for r in got] == [("CONFLICT", 3)]
    assert sorted(seen) == sorted(t for _, _, t in rows)


def test_predecessors(spark):
    rows = [(k, i) for k in "ab" for i in (3, 7, 8, 250, 251, 900, 901)] + [("c", 5)]
    got = windows.predecessors(spark.createDataFrame(rows, "k string, id bigint"), "k", "id", "before", span=100).collect()
    assert sorted((r.k, r.id, r.before) for r in got) == [(k, b, a) for k in "ab" for a, b in ((3, 7), (7, 8), (8, 250), (250, 251), (251, 900), (900, 901))]


def test_types_conflict(spark):
    a = spark.createDataFrame([(1, "COMMERCIAL INVOICE one two three", True)], "page int, text string, usable boolean")
    b = spark.createDataFrame([(1, "PACKING LIST INVOICE one two three", True)], "page int, text string, usable boolean")
    got = reconcile.reconciled(a, b, ["page"]).first()
    assert (got.level, got.text, got.requires_review) == ("CONFLICT", "", True)
    pages = spark.createDataFrame([("d", 1, "CONFLICT", True), ("d", 2, "CROSS_VERIFIED", False), ("e", 1, "SINGLE_PROVIDER", False)], "id string, page int, level string, requires_review boolean")
    assert {r.id: (r.requires_review, r.unresolved_pages) for r in reconcile.rolled_up(pages, "id", "page").collect()} == {"d": (True, [1]), "e": (False, [])}


def zipped(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n in names:
            z.writestr(n, "x" * 500)
    return out.getvalue()


def test_containers_and_mime(spark):
    rows = [("a.xlsx", None, zipped("xl/workbook.xml")), ("a.xlsx", None, zipped("word/document.xml")), ("a.docx", None, zipped("word/document.xml")), ("a.docx", None, zipped("xl/a", "word/b")), ("a.xlsx", None, zipped("docs/xl/a")), ("a.xlsx", None, b"PK\x03\x04 no zip"),
            ("a.csv", "text/comma-separated-values; charset=utf-8", b"a,b\x7f\n"), ("a.csv", "text/plain", b"a,b"), ("a.jpg", "image/pjpeg", b"\xff\xd8\xff\xe0"), ("a.csv", None, b"a" * 94 + b"\x01" * 6), ("a.csv", None, b"a" * 95 + b"\x01" * 5)]
    got = intake.validated(spark.createDataFrame([("s", *r) for r in rows], "shipment_id string, filename string, mime string, content binary")).collect()
    bad = "SIGNATURE_MISMATCH"
    assert [r.code for r in got] == [None, bad, None, bad, bad, bad, None, "MIME_MISMATCH", None, bad, None]


def test_small_operators(spark):
    docs = spark.createDataFrame([("d1", "pdf"), ("d2", "csv"), ("d3", None)], "document_id string, file_type string")
    kept, refused = intake.routed(docs)
    assert [r.document_id for r in kept.collect()] == ["d1"] and {r.document_id for r in refused.collect()} == {"d2", "d3"}
    events = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert {r.k: r.v for r in intake.latest(events, "k", ["t"]).collect()} == {"a": "z", "b": None}
    assert [(r.k, r.n) for r in intake.integrity(events, ["k"]).collect()] == [("a", 3)]
    states = spark.createDataFrame([("a", "EXTRACTED"), ("a", "NEEDS_REVIEW"), ("b", "EXTRACTED"), ("c", "FAILED")], "k string, s string")
    assert {r.k: r.status for r in attempts.status(states, "k", "s").collect()} == {"a": "NEEDS_REVIEW", "b": "EXTRACTED", "c": "FAILED"}
    outcomes = spark.createDataFrame([("a", "h1"), ("b", "h1")], "k string, snapshot_hash string")
    assert {r.k: r.stale for r in checks.stale(outcomes, spark.createDataFrame([("a", "h1"), ("b", "h2")], "k string, snapshot_hash string"), "k").collect()} == {"a": False, "b": True}
    numbers = spark.createDataFrame([(7.0, "0000"), (-7.0, "000"), (7.5, "0000"), (7.0, "General")], "n double, f string")
    assert [r.x for r in numbers.select(lexical.padded_number(F.col("n"), F.col("f")).alias("x")).collect()] == ["0007", "-007", None, "7"]
    cells = spark.createDataFrame([("d", "S", 1, 1, "A1"), ("d", "S", 1, 1, "A1"), ("d", "S", 2, 3, "B2"), ("d", "S", 0, 1, "A0"), ("d", "T", 1, 2, "B1")], "document_id string, sheet string, row int, col int, coordinate string")
    assert {(r.sheet, r.code) for r in tables.grid_issues(cells).collect()} == {("S", "DUPLICATE_CELL"), ("S", "COORDINATE_MISMATCH"), ("S", "OUT_OF_BOUNDS")}
    sheets = spark.createDataFrame([("d", "S", "visible", [2], ["C"]), ("d", "T", "hidden", [], [])], "document_id string, sheet string, state string, hidden_rows array<int>, hidden_columns array<string>")
    assert [(r.row, r.col) for r in tables.visible(cells.distinct().where("row > 0"), sheets).collect()] == [(1, 1)]
    assert [r.x for r in spark.createDataFrame([("packing_list", "PACKING_LIST"), ("invoice", "PACKING_LIST"), ("invoice", "OTHER")], "a string, b string").select(attempts.family_fits(F.col("a"), F.col("b")).alias("x")).collect()] == [True, False, True]


def test_yaml_keys(tmp_path):
    good, bad = tmp_path / "a.yaml", tmp_path / "b.yaml"
    good.write_text("a: [x]\nb: [y]\n")
    bad.write_text("a: [x]\na: [y]\n")
    assert dictionaries.load_yaml(str(good)) == {"a": ["x"], "b": ["y"]}
    with pytest.raises(ValueError, match="repeated"):
        dictionaries.load_yaml(str(bad))


def test_matched_with_nulls_ties_and_repeats(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, "c", None), (None, "a", "x")], "l int, k string, m string")
    right = spark.createDataFrame([("r1", "a", "y"), ("r2", None, "x"), ("r3", "z", "x"), ("r4", "c", None), (None, "a", "x")], "r string, k string, m string")
    got = checks.matched(left, right, "l", "r", [("KEY", ["k"]), ("OTHER", ["m"])])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "r1", "KEY"), (4, "r4", "KEY"), (2, "r2", "OTHER"), (3, "r3", "OTHER"), (None, None, "UNMATCHED")], key=repr)
    assert checks.matched(left.limit(0), right, "l", "r", [("KEY", ["k"])]).count() == 0
    assert {r.match_type for r in checks.matched(left, right.limit(0), "l", "r", [("KEY", ["k"])]).collect()} == {"UNMATCHED"}
    fresh = checks.matched(left, right, "l", "r", [("KEY", ["k"]), ("OTHER", ["m"])])  # not run yet: one plan, not two
    assert fresh._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_statuses_are_counted_before_they_meet_their_rules(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000")  # text operators cut plans
    rules = spark.createDataFrame([("A",), ("B",)], "check string")
    made = spark.createDataFrame([("A", "PASS"), ("A", "PASS"), ("A", "ERROR"), ("C", "PASS")], "check string, status string")
    got = checks.counted(rules, made)
    assert {(r.check, r.status, r.n) for r in got.collect()} == {("A", "PASS", 2), ("A", "ERROR", 1), ("B", "NOT_CHECKED", 1)}
    plain = checks.summary(checks.results(rules, made, ["check"]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.dtypes == plain.dtypes
    from tradeloom.plans import business

    # below the join with the rules, every branch of the plan is an aggregate of statuses
    plan = business.check_status_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join LeftOuter") :]
    assert "Aggregate [check" in below and below.index("Aggregate [check") < below.index("Union")


def test_equal_readings_are_not_read(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000")  # text operators cut plans
    rows = [(1, "a 1", True), (2, "a 1", True), (3, None, True), (4, "x 2 y", True), (5, "a 1", False)]
    a = spark.createDataFrame(rows, "k int, text string, usable boolean")
    b = spark.createDataFrame([(1, "a 1", True), (2, "a 2", True), (3, None, True), (4, "x y 2", True), (5, "b", True)], "k int, text string, usable boolean")
    out = reconcile.reconciled(a, b, ["k"])
    got = {r.k: r.level for r in out.collect()}
    assert got == {1: "CROSS_VERIFIED", 2: "CONFLICT", 3: got[3], 4: "CROSS_VERIFIED", 5: "SINGLE_PROVIDER"}
    # tokens are read from texts that differ alone: their expressions take the text under that condition
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(a_text" in plan and " = b_text" in plan


def test_trim_looks_at_both_ends_only(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000")  # text operators cut plans
    odd = [chr(i) for i in range(1, 0x3100)]
    df = spark.createDataFrame([(c + "a " + c + "b" + c,) for c in odd] + [("",), (" \r\n",), (None,)], "t string")
    assert df.where(~lexical.trim(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert "regexp" not in df.select(lexical.trim(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_decimals_by_one_pattern_equal_those_by_all(spark):
    r = random.Random(3)
    df = spark.createDataFrame([("".join(r.choice("0159.,+- ") for _ in range(r.randint(0, 8))),) for _ in range(20000)] + [("x",), (None,)], "t string")
    assert df.where(~lexical.decimal_text(F.col("t")).eqNullSafe(lexical._decimal_text(lexical.trim(F.col("t"))))).count() == 0
