"""Queries that compare documents of a dossier, and roll the checks up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.operators import checks, fuzzy, intake
from tradeloom.plans import read
from tradeloom.streaming import intake as stream


def document_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that lack an order, and orders that lack lines."""
    customers = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    orders = read(spark, sf, "orders")
    no_order = intake.presence(customers, orders.select(F.col("o_custkey").alias("key")), ["key"]).select("key", F.lit("ORDER").alias("missing"))
    no_line = intake.presence(orders.select(F.col("o_orderkey").alias("key")), read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key")), ["key"])
    return no_order.union(no_line.select("key", F.lit("LINES").alias("missing")))


DOCUMENT_PRESENCE = """
SELECT c_custkey AS key, 'ORDER' AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT o_orderkey, 'LINES' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"""


def quantity_check(spark: SparkSession, sf: str) -> DataFrame:
    """Quantities of an order against those of its lines that were shipped, summed by part."""
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum(checks.money(F.col("l_quantity"))).alias("ordered"), F.sum(F.when(F.col("l_linestatus") == "F", checks.money(F.col("l_quantity")))).alias("shipped"))
    return rows.select("l_orderkey", "l_partkey", (F.col("ordered") - F.col("shipped")).cast("decimal(28,4)").alias("delta"), checks.outcome(checks.within(F.col("shipped"), F.col("ordered"))).alias("status"))


QUANTITY_CHECK = """
WITH q AS (SELECT l_orderkey, l_partkey, sum(CAST(l_quantity AS DECIMAL(18,4))) AS a, sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(18,4)) END) AS b FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_partkey, CAST(a - b AS DECIMAL(28,4)) AS delta, CASE WHEN b IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN abs(b - a) <= 0 THEN 'PASS' ELSE 'ERROR' END AS status FROM q"""


def _amounts(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part").select("p_partkey", checks.money(F.col("p_retailprice")).alias("price"))
    lines = read(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    want = (checks.money(F.col("l_quantity")) * F.col("price")).cast("decimal(28,4)")
    return lines.select("l_orderkey", "l_linenumber", checks.money(F.col("l_extendedprice")).alias("amount"), want.alias("expected"))


def amount_check(spark: SparkSession, sf: str) -> DataFrame:
    """Line amounts against quantity times list price, within five percent; statuses counted per line number."""
    rows = _amounts(spark, sf).withColumn("status", checks.outcome(checks.within(F.col("amount"), F.col("expected"), 0.01, 0.05)))
    return rows.groupBy("l_linenumber", "status").agg(F.count("*").alias("n"), F.sum(F.col("amount") - F.col("expected")).cast("decimal(38,4)").alias("delta"))


AMOUNT_CHECK = """
WITH a AS (SELECT l_linenumber, CAST(l_extendedprice AS DECIMAL(18,4)) AS amount, CAST(CAST(l_quantity AS DECIMAL(18,4)) * CAST(p_retailprice AS DECIMAL(18,4)) AS DECIMAL(28,4)) AS expected FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
SELECT l_linenumber, CASE WHEN expected IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN abs(amount - expected) <= greatest(CAST(0.01 AS DECIMAL(18,4)), CAST(0.05 AS DECIMAL(10,6)) * abs(expected)) THEN 'PASS' ELSE 'ERROR' END AS status,
  count(*) AS n, CAST(sum(amount - expected) AS DECIMAL(38,4)) AS delta FROM a GROUP BY ALL"""


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(checks.money(F.col("l_extendedprice"))).alias("lines"))
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", checks.money(F.col("o_totalprice")).alias("total")).join(lines, "o_orderkey", "left")
    return orders.withColumn("status", checks.outcome(checks.within(F.col("lines"), F.col("total"), 0.01, 0.1), "WARNING"))


def total_check(spark: SparkSession, sf: str) -> DataFrame:
    return _totals(spark, sf).select("o_orderkey", (F.col("total") - F.col("lines")).cast("decimal(38,4)").alias("delta"), "status")


_TOTALS = """
SELECT o_orderkey, o_orderpriority, total, lines, CASE WHEN lines IS NULL THEN 'INSUFFICIENT_EVIDENCE' WHEN abs(lines - total) <= greatest(CAST(0.01 AS DECIMAL(18,4)), CAST(0.1 AS DECIMAL(10,6)) * abs(total)) THEN 'PASS' ELSE 'WARNING' END AS status
FROM (SELECT o_orderkey, o_orderpriority, CAST(o_totalprice AS DECIMAL(18,4)) AS total FROM orders)
LEFT JOIN (SELECT l_orderkey AS o_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS lines FROM lineitem GROUP BY l_orderkey) USING (o_orderkey)"""
TOTAL_CHECK = f"SELECT o_orderkey, CAST(total - lines AS DECIMAL(38,4)) AS delta, status FROM ({_TOTALS})"


def item_match_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a list against a copy that misses some keys, brands and names: by key, then name and brand, then type and size."""
    part = read(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    left = part.select(F.col("p_partkey").alias("left_id"), F.col("p_partkey").alias("code"), "p_name", "p_brand", "p_type", "p_size")
    right = part.where("p_partkey % 11 <> 0").select((F.col("p_partkey") + 1000000).alias("right_id"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).alias("code"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("p_name"), "p_brand", "p_type", "p_size")
    out = checks.matched(left, right, "left_id", "right_id", [("EXACT", ["code"]), ("HIGH", ["p_name", "p_brand"]), ("POSSIBLE", ["p_type", "p_size"])])
    return out


ITEM_MATCH_CASCADE = """
WITH l AS (SELECT p_partkey AS left_id, * FROM part),
r AS (SELECT p_partkey + 1000000 AS right_id, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS code, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS name, p_brand, p_type, p_size FROM part WHERE p_partkey % 11 <> 0),
m1 AS (SELECT left_id, right_id, 'EXACT' AS match_type FROM l JOIN r ON l.p_partkey = r.code),
l2 AS (SELECT *, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY left_id) AS k FROM l WHERE left_id NOT IN (SELECT left_id FROM m1)),
r2 AS (SELECT *, row_number() OVER (PARTITION BY name, p_brand ORDER BY right_id) AS k FROM r WHERE right_id NOT IN (SELECT right_id FROM m1) AND name IS NOT NULL),
m2 AS (SELECT left_id, right_id, 'HIGH' AS match_type FROM l2 JOIN r2 ON l2.p_name = r2.name AND l2.p_brand = r2.p_brand AND l2.k = r2.k),
m12 AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2),
l3 AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_size ORDER BY left_id) AS k FROM l WHERE left_id NOT IN (SELECT left_id FROM m12)),
r3 AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_size ORDER BY right_id) AS k FROM r WHERE right_id NOT IN (SELECT right_id FROM m12)),
m3 AS (SELECT left_id, right_id, 'POSSIBLE' AS match_type FROM l3 JOIN r3 ON l3.p_type = r3.p_type AND l3.p_size = r3.p_size AND l3.k = r3.k),
m AS (SELECT * FROM m12 UNION ALL SELECT * FROM m3)
SELECT * FROM m UNION ALL SELECT left_id, NULL, 'UNMATCHED' FROM l WHERE left_id NOT IN (SELECT left_id FROM m)"""


def item_fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a list against a copy with misspelt, shortened and added words, within a brand, one to one."""
    part = read(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    name, kind = F.col("p_name"), F.col("p_partkey") % 4
    left = part.select(F.col("p_partkey").alias("left_id"), "p_brand", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    odd = F.when(kind == 0, F.translate(name, "ie", "ea")).when(kind == 1, F.concat(name, F.lit(" no. "), F.col("p_partkey") % 7)).when(kind == 2, F.upper(F.substring(name, 2, 100))).otherwise(name)
    right = part.where("p_partkey % 11 <> 0").select((F.col("p_partkey") + 1000000).alias("right_id"), "p_brand", F.concat_ws(" ", odd, "p_type").alias("text"))
    return fuzzy.matched(left, right, "left_id", "right_id", "p_brand", "text")


# all pairs of a brand in order of likeness, taken one by one while both texts have items left
ITEM_FUZZY_MATCH = """
WITH RECURSIVE li AS (SELECT p_partkey AS id, p_brand AS brand, p_name || ' ' || p_type AS text FROM part),
ri AS (SELECT p_partkey + 1000000 AS id, p_brand AS brand, CASE p_partkey % 4 WHEN 0 THEN translate(p_name, 'ie', 'ea') WHEN 1 THEN p_name || ' no. ' || (p_partkey % 7) WHEN 2 THEN upper(substr(p_name, 2)) ELSE p_name END || ' ' || p_type AS text FROM part WHERE p_partkey % 11 <> 0),
lt AS (SELECT brand, text, min(id) AS t, count(*) AS n, ' ' || lower(text) || ' ' AS w FROM li GROUP BY brand, text),
rt AS (SELECT brand, text, min(id) AS t, count(*) AS n, ' ' || lower(text) || ' ' AS w FROM ri GROUP BY brand, text),
lg AS (SELECT *, list_distinct([w[i:i + 2] for i in range(1, length(w) - 1)]) AS g FROM lt),
rg AS (SELECT *, list_distinct([w[i:i + 2] for i in range(1, length(w) - 1)]) AS g FROM rt),
j AS (SELECT lg.brand, lg.t AS l, rg.t AS r, lg.n AS nl, rg.n AS nr, len(list_intersect(lg.g, rg.g)) AS b, len(lg.g) + len(rg.g) AS s FROM lg JOIN rg ON lg.brand = rg.brand),
p AS (SELECT *, b * 1000000 // (s - b) AS score, row_number() OVER (PARTITION BY brand ORDER BY b * 1000000 // (s - b) DESC, md5(l || ':' || r) DESC) AS i FROM j WHERE b * 1000000 // (s - b) >= 500000),
w AS (
  SELECT brand, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(l BIGINT, r BIGINT, n BIGINT, lk BIGINT, rk BIGINT, score BIGINT)[]) AS done FROM p GROUP BY brand
  UNION ALL
  SELECT brand, i, CASE WHEN least(nl - lk, nr - rk) > 0 THEN list_append(done, {'l': l, 'r': r, 'n': least(nl - lk, nr - rk), 'lk': lk, 'rk': rk, 'score': score}) ELSE done END
  FROM (SELECT w.brand, p.i, w.done, p.l, p.r, p.nl, p.nr, p.score,
      CAST(coalesce(list_sum([x.n for x in w.done if x.l = p.l]), 0) AS BIGINT) AS lk, CAST(coalesce(list_sum([x.n for x in w.done if x.r = p.r]), 0) AS BIGINT) AS rk
    FROM w JOIN p ON w.brand = p.brand AND p.i = w.i + 1)),
m AS (SELECT unnest(arg_max(done, i), recursive := true) FROM w GROUP BY brand),
la AS (SELECT id, t, row_number() OVER (PARTITION BY t ORDER BY id) - 1 AS k FROM li JOIN lt USING (brand, text)),
ra AS (SELECT id, t, row_number() OVER (PARTITION BY t ORDER BY id) - 1 AS k FROM ri JOIN rt USING (brand, text))
SELECT la.id AS left_id, ra.id AS right_id, m.score AS score
FROM la LEFT JOIN m ON m.l = la.t AND la.k >= m.lk AND la.k < m.lk + m.n LEFT JOIN ra ON ra.t = m.r AND ra.k = la.k - m.lk + m.rk"""


def party_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Names of customers and suppliers of the same number, by similarity."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.upper("c_name").alias("a"))
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.upper("s_name").alias("b"))
    rows = c.join(s, "key").withColumn("similarity", F.round(checks.similarity(F.col("a"), F.col("b")), 6))
    return rows.select("key", "similarity", F.when(F.col("similarity") >= 0.9, "SAME").when(F.col("similarity") >= 0.5, "SIMILAR").otherwise("DIFFERENT").alias("bucket"))


PARTY_COMPARE = """
SELECT key, similarity, CASE WHEN similarity >= 0.9 THEN 'SAME' WHEN similarity >= 0.5 THEN 'SIMILAR' ELSE 'DIFFERENT' END AS bucket
FROM (SELECT c_custkey AS key, round(1 - levenshtein(upper(c_name), upper(s_name)) / CAST(greatest(length(c_name), length(s_name)) AS DOUBLE), 6) AS similarity FROM customer JOIN supplier ON c_custkey = s_suppkey)"""

#: Unit words and what they stand for; others are unknown and need a review.
UNITS = {"ECONOMY": "PCS", "STANDARD": "PCS", "SMALL": "SET", "LARGE": "CTN"}


def unit_normalize(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.upper(F.element_at(F.split("p_type", " "), 1))
    mapped = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), unit)
    return read(spark, sf, "part").groupBy(unit.alias("unit"), mapped.alias("normalized")).agg(F.count("*").alias("n")).withColumn("status", F.when(F.col("normalized").isNull(), "NEEDS_REVIEW").otherwise("PASS"))


UNIT_NORMALIZE = """
SELECT u AS unit, CASE u WHEN 'ECONOMY' THEN 'PCS' WHEN 'STANDARD' THEN 'PCS' WHEN 'SMALL' THEN 'SET' WHEN 'LARGE' THEN 'CTN' END AS normalized, count(*) AS n,
  CASE WHEN u IN ('ECONOMY', 'STANDARD', 'SMALL', 'LARGE') THEN 'PASS' ELSE 'NEEDS_REVIEW' END AS status
FROM (SELECT upper(split_part(p_type, ' ', 1)) AS u FROM part) GROUP BY u"""


def value_consistency(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the orders of a customer agree on their priority."""
    return checks.consistent(read(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


VALUE_CONSISTENCY = "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_values, CASE count(DISTINCT o_orderpriority) WHEN 0 THEN 'MISSING' WHEN 1 THEN 'PASS' ELSE 'ERROR' END AS status FROM orders GROUP BY o_custkey"


def check_status_summary(spark: SparkSession, sf: str) -> DataFrame:
    """All checks by status, with those that no rule made, in order of report."""
    made = _totals(spark, sf).select(F.lit("TOTAL").alias("check"), "status")
    made = made.union(value_consistency(spark, sf).select(F.lit("PRIORITY"), "status")).union(quantity_check(spark, sf).select(F.lit("QUANTITY"), "status"))
    rules = spark.createDataFrame([("TOTAL",), ("PRIORITY",), ("QUANTITY",), ("HS_CODE",)], "check string")
    return checks.counted(rules, made)


CHECK_STATUS_SUMMARY = f"""
WITH c AS (SELECT 'TOTAL' AS "check", status FROM ({_TOTALS}) UNION ALL SELECT 'PRIORITY', status FROM ({VALUE_CONSISTENCY}) UNION ALL SELECT 'QUANTITY', status FROM ({QUANTITY_CHECK}) UNION ALL SELECT 'HS_CODE', 'NOT_CHECKED')
SELECT "check", status, count(*) AS n, CAST(list_position(['CRITICAL', 'ERROR', 'WARNING', 'MISSING', 'NEEDS_REVIEW', 'INSUFFICIENT_EVIDENCE', 'PASS', 'NOT_CHECKED'], status) AS INTEGER) AS place FROM c GROUP BY "check", status"""


def readiness_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Readiness of each order: lane A from its total, lane B from its lines' quantities."""
    a = _totals(spark, sf).select("o_orderkey", F.lit("A").alias("lane"), "status", (F.col("o_orderpriority") == "1-URGENT").alias("critical"))
    b = quantity_check(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), F.lit("B").alias("lane"), "status", F.lit(True).alias("critical"))
    return checks.readiness(a.union(b.join(a.select("o_orderkey"), "o_orderkey", "left_semi")), ["o_orderkey"])


READINESS_ROLLUP = f"""
WITH c AS (SELECT o_orderkey, 'A' AS lane, status, o_orderpriority = '1-URGENT' AS critical FROM ({_TOTALS})
  UNION ALL SELECT l_orderkey, 'B', status, true FROM ({QUANTITY_CHECK}) WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
r AS (SELECT o_orderkey, lane, max(CASE WHEN status IN ('ERROR', 'MISSING') OR (critical AND status IN ('NOT_CHECKED', 'INSUFFICIENT_EVIDENCE')) THEN 2 WHEN status <> 'PASS' THEN 1 ELSE 0 END) AS k FROM c GROUP BY ALL),
w AS (SELECT o_orderkey, coalesce(max(CASE WHEN lane = 'A' THEN k END), 2) AS a, coalesce(max(CASE WHEN lane = 'B' THEN k END), 2) AS b FROM r GROUP BY o_orderkey)
SELECT o_orderkey, ['READY', 'OPEN', 'BLOCK'][a + 1] AS lane_a, ['READY', 'OPEN', 'BLOCK'][b + 1] AS lane_b, ['READY', 'OPEN', 'BLOCK'][greatest(a, b) + 1] AS readiness FROM w"""


def correction_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Order priorities with the last of up to two corrections on top."""
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    fixes = orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("CORRECTED-1").alias("o_orderpriority"), F.lit(1).alias("at"))
    fixes = fixes.union(orders.where("o_orderkey % 8 = 0").select("o_orderkey", F.lit("CORRECTED-2"), F.lit(2)))
    return checks.overlaid(orders, fixes, ["o_orderkey"], "o_orderpriority", "at")


CORRECTION_OVERLAY = """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'CORRECTED-2' WHEN o_orderkey % 4 = 0 THEN 'CORRECTED-1' ELSE o_orderpriority END AS o_orderpriority, o_orderkey % 4 = 0 AS corrected FROM orders"""


def arrival_policy(spark: SparkSession, sf: str) -> DataFrame:
    """The declared weight's source and outcomes for every order as a shipment."""
    o = read(spark, sf, "orders")
    k, w = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    rows = o.select("o_orderkey", F.when(k % 2 == 0, "AIR").otherwise("SEA").alias("mode"), F.when(k % 7 != 0, w).alias("an_weight"), F.when(k % 11 != 0, F.when(k % 3 == 0, w + 5).otherwise(w)).alias("transport_weight"), F.when(k % 5 == 0, w + 5).otherwise(w).alias("declared_weight"))
    return checks.arrival_policy(rows).select("o_orderkey", "mode", "required_weight", "outcome_a", "outcome_b", "outcome_c")


ARRIVAL_POLICY = """
WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'AIR' ELSE 'SEA' END AS mode, CAST(floor(o_totalprice) AS BIGINT) AS w, o_orderkey AS k FROM orders),
t AS (SELECT *, CASE WHEN k % 7 <> 0 THEN w END AS an, CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 3 = 0 THEN w + 5 ELSE w END END AS other, CASE WHEN k % 5 = 0 THEN w + 5 ELSE w END AS said FROM s),
u AS (SELECT *, CASE WHEN mode = 'AIR' OR an = other THEN an END AS required_weight FROM t),
v AS (SELECT *, CASE WHEN required_weight IS NULL THEN 'NOT_CHECKED' WHEN required_weight = said THEN 'PASS' ELSE 'FAIL' END AS outcome_a,
  CASE WHEN an IS NULL THEN 'BLOCK' WHEN an = other THEN 'CLEAR' WHEN mode = 'SEA' THEN 'BLOCK' ELSE 'OPEN' END AS outcome_b FROM u)
SELECT o_orderkey, mode, required_weight, outcome_a, outcome_b, CASE WHEN outcome_a = 'PASS' AND outcome_b = 'CLEAR' THEN 'READY' ELSE 'BLOCK' END AS outcome_c FROM v"""


def arrival_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Which shipments an arrival notice releases, with the nations as a catalog of loading places."""
    k = F.col("o_orderkey")
    given = lambda n, c: F.when(k % n != 0, F.lit(c))
    place = F.when(k % 6 == 0, "NOWHERE").otherwise(F.col("n_name"))
    rows = read(spark, sf, "orders").join(read(spark, sf, "nation"), k % 25 == F.col("n_nationkey")).select(
        "o_orderkey", F.when(k % 2 == 0, "SEA").otherwise("AIR").alias("mode"), place.alias("loading_place"), given(13, "AN").alias("an_id"), (k % 17 != 0).alias("same_shipment"),
        given(19, "ALL").alias("scope"), given(23, "1").alias("revision"), given(29, "GROSS").alias("weight_kind"), given(31, "KGS").alias("unit"),
    )
    places = read(spark, sf, "nation").select(F.col("n_name").alias("place"), F.col("n_nationkey").alias("code"))
    return checks.arrival_gates(rows, places).select("o_orderkey", "loading_code", F.array_join("blocks", ",").alias("blocks"), "gate")


ARRIVAL_GATES = """
WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 25 AS INTEGER) END AS code FROM orders),
b AS (SELECT k, code, concat_ws(',', CASE WHEN k % 13 = 0 THEN 'ARRIVAL_NOTICE_MISSING' END, CASE WHEN k % 17 = 0 THEN 'WRONG_SHIPMENT' END, CASE WHEN k % 19 = 0 THEN 'SCOPE_UNCLEAR' END,
  CASE WHEN k % 23 = 0 THEN 'REVISION_UNCLEAR' END, CASE WHEN k % 29 = 0 THEN 'WEIGHT_KIND_UNCLEAR' END, CASE WHEN k % 31 = 0 THEN 'UNIT_UNCLEAR' END,
  CASE WHEN k % 2 = 0 AND code IS NULL THEN 'LOADING_PLACE_UNMAPPED' END) AS blocks FROM s)
SELECT k AS o_orderkey, n_nationkey AS loading_code, blocks, CASE WHEN blocks = '' THEN 'CLEAR' ELSE 'BLOCK' END AS gate FROM b LEFT JOIN nation ON n_nationkey = code"""


def stream_intake_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Events taken in as a stream, every third sent twice: the first of equal (user, type, second) within the watermark."""
    found = stream.run_once(spark, f"{sf}/events.parquet", arrivals=F.when(F.col("event_id") % 3 == 0, 2).otherwise(1))
    return found.withColumn("second", F.date_format("second", "yyyy-MM-dd HH:mm:ss"))


STREAM_INTAKE_DEDUP = "SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS second FROM events"

QUERIES = [
    (document_presence, DOCUMENT_PRESENCE),
    (quantity_check, QUANTITY_CHECK),
    (amount_check, AMOUNT_CHECK),
    (total_check, TOTAL_CHECK),
    (item_match_cascade, ITEM_MATCH_CASCADE),
    (item_fuzzy_match, ITEM_FUZZY_MATCH),
    (party_compare, PARTY_COMPARE),
    (unit_normalize, UNIT_NORMALIZE),
    (value_consistency, VALUE_CONSISTENCY),
    (check_status_summary, CHECK_STATUS_SUMMARY),
    (readiness_rollup, READINESS_ROLLUP),
    (correction_overlay, CORRECTION_OVERLAY),
    (arrival_policy, ARRIVAL_POLICY),
    (arrival_gates, ARRIVAL_GATES),
    (stream_intake_dedup, STREAM_INTAKE_DEDUP),
]
