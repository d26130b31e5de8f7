"""Items of two lists matched one to one by the likeness of their texts: q-gram candidates, then rounds of mutual best pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradeloom.operators.storage import dropped, written
from tradeloom.operators.windows import bucket_span

#: Texts of a side's posting list that meet in one task; longer lists are cut into parts, and part meets part.
SPLIT = 2000
#: Items of equal text that one row deals out at a time.
BLOCK = 10_000
#: Likeness is counted in millionths, so that equal scores are equal.
UNIT = 1_000_000


def grams(text: Column, q: int = 3) -> Column:
    """The distinct q-grams of a text in lower case, with a blank before and after; a text shorter than q is one gram."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - q + 1, F.lit(1))), lambda i: F.substring(padded, i, q)))


def _texts(items: DataFrame, id_col: str, key: str, text: str) -> DataFrame:
    """(key, text, t, n): each text of a key once, named by its smallest item, with its number of items."""
    rows = items.select(F.col(id_col).alias("i"), F.col(key).alias("key"), F.col(text).alias("text")).where("i is not null and key is not null and text is not null")
    return rows.groupBy("key", "text").agg(F.min("i").alias("t"), F.count("*").alias("n"))


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(l, r, score): texts (key, text, t) of the two sides whose q-grams have a Jaccard of at least ``least``.

    Two such sets share one of their first few grams, rarest first, so only texts that do are compared.  A key's frequent gram is cut
    into parts on both sides that meet pairwise.
    """
    sides = left.select(F.lit(True).alias("left"), "key", "t", grams(F.col("text")).alias("g")).union(right.select(F.lit(False), "key", "t", grams(F.col("text"))))
    each = sides.select("left", "key", "t", F.size("g").alias("n"), F.explode("g").alias("gram"))
    count = lambda side: F.count(F.when(side, 1))
    often = each.groupBy("key", "gram").agg(count(F.col("left")).alias("ml"), count(~F.col("left")).alias("mr"))
    each = each.join(often, ["key", "gram"])
    # the places of a text's grams, rarest first, are ranked inside its own row
    order = F.sort_array(F.collect_list(F.struct((F.col("ml") + F.col("mr")).alias("m"), "gram", "ml", "mr")))
    first = each.groupBy("left", "key", "t", "n").agg(order.alias("o"))
    first = first.select("left", "key", "t", "n", F.posexplode("o").alias("pos", "o")).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * least))
    first = first.select("left", "key", "t", "n", "pos", "o.gram", F.ceil(F.col("o.ml") / SPLIT).cast("int").alias("pl"), F.ceil(F.col("o.mr") / SPLIT).cast("int").alias("pr")).where("pl > 0 and pr > 0")
    part = lambda parts: F.pmod(F.xxhash64("t"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    a = first.where("left").select("key", "gram", part("pl").alias("x"), every("pr").alias("y"), F.col("t").alias("l"), F.col("n").alias("ln"), F.col("pos").alias("lpos"))
    b = first.where("not left").select("key", "gram", every("pl").alias("x"), part("pr").alias("y"), F.col("t").alias("r"), F.col("n").alias("rn"), F.col("pos").alias("rpos"))
    room = F.least(F.col("ln") - F.col("lpos"), F.col("rn") - F.col("rpos"))
    fits = (room * (1 + least) >= (F.col("ln") + F.col("rn")) * least) & (F.least("ln", "rn") >= F.greatest("ln", "rn") * least)
    pairs = a.join(b, ["key", "gram", "x", "y"]).where(fits).select("l", "r").distinct()
    pairs = pairs.join(sides.where("left").select(F.col("t").alias("l"), F.col("g").alias("lg")), "l").join(sides.where("not left").select(F.col("t").alias("r"), F.col("g").alias("rg")), "r")
    both = F.size(F.array_intersect("lg", "rg"))
    score = F.floor(both * UNIT / (F.size("lg") + F.size("rg") - both)).cast("long")
    return pairs.select("l", "r", score.alias("score")).where(F.col("score") >= int(least * UNIT))


def mutual(pairs: DataFrame) -> DataFrame:
    """(l, r, score, lk, rk, take): a stable one-to-one matching of pairs (l, r, score, nl, nr), where nl items stand behind l and nr behind r.

    Pairs rank by score, then by a digest of (l, r), which tells the same order everywhere and lets ties fall at random, so that few
    rounds are needed.  A round matches every pair that is the best of both its ends, as many items as both have left, and takes
    away ends that have none; what results equals taking all pairs in that order.  lk and rk count each side's items used before.
    """
    tie = F.md5(F.concat_ws(":", F.col("l").cast("string"), F.col("r").cast("string")))
    open_ = written(pairs.withColumns({"tie": tie, "lk": F.lit(0).cast("long"), "rk": F.lit(0).cast("long")}), "pairs")
    found: DataFrame | None = None
    while open_.take(1):
        rank = F.max(F.struct("score", "tie", "l", "r")).alias("best")
        of_l, of_r = open_.groupBy("l").agg(rank).select("best.l", "best.r"), open_.groupBy("r").agg(rank).select("best.l", "best.r")
        hits = open_.join(of_l.join(of_r, ["l", "r"]), ["l", "r"], "left_semi")
        hits = written(hits.select("l", "r", "score", "lk", "rk", F.least(F.col("nl") - F.col("lk"), F.col("nr") - F.col("rk")).alias("take")), "matches")
        found = hits if found is None else found.union(hits)
        used_l, used_r = hits.select("l", F.col("take").alias("ul")), hits.select("r", F.col("take").alias("ur"))
        rest = open_.join(used_l, "l", "left").join(used_r, "r", "left").join(hits.select("l", "r"), ["l", "r"], "left_anti")
        rest = rest.withColumns({"lk": F.col("lk") + F.coalesce("ul", F.lit(0)), "rk": F.col("rk") + F.coalesce("ur", F.lit(0))})
        rest = written(rest.where("lk < nl and rk < nr").select(*open_.columns), "pairs")
        dropped(open_)
        open_ = rest
    dropped(open_)
    return found if found is not None else pairs.select("l", "r", "score", F.col("nl").alias("lk"), F.col("nr").alias("rk"), F.col("nl").alias("take")).limit(0)


def _placed(items: DataFrame, texts: DataFrame, id_col: str, key: str, text: str) -> DataFrame:
    """(i, t, k): each item with its text and its place among that text's items, by id.  A hot text is ranked in buckets of ids."""
    rows = items.select(F.col(id_col).alias("i"), F.col(key).alias("key"), F.col(text).alias("text")).where("i is not null and key is not null and text is not null")
    rows = rows.join(texts.select("key", "text", "t"), ["key", "text"]).select("i", "t")
    rows = rows.withColumn("bucket", F.floor(F.col("i") / bucket_span(rows, "i")))
    counts = rows.groupBy("t", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("t").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("t", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("t", "bucket").orderBy("i"))
    return rows.withColumn("own", own).join(counts, ["t", "bucket"]).select("i", "t", (F.col("before") + F.col("own") - 1).alias("k"))


def matched(left: DataFrame, right: DataFrame, id_left: str, id_right: str, key: str, text: str, least: float = 0.5) -> DataFrame:
    """(id_left, id_right, score): every left item once, with its counterpart of the same key and its likeness in millionths, or nulls.

    Items have integer ids; those without an id match nothing and keep their row, as do items without key or text.  Equal texts of a
    key are compared once and matched as many times as both sides have items, in order of their ids; repeated ids are items of their own.
    """
    ltexts, rtexts = written(_texts(left, id_left, key, text), "left"), written(_texts(right, id_right, key, text), "right")
    pairs = candidates(ltexts, rtexts, least)
    pairs = pairs.join(ltexts.select(F.col("t").alias("l"), F.col("n").alias("nl")), "l").join(rtexts.select(F.col("t").alias("r"), F.col("n").alias("nr")), "r")
    hits = mutual(pairs)
    # one row for each matched item: blocks first, so that no row deals out all items of a hot text
    blocks = hits.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1, F.lit(BLOCK).cast("long"))).alias("from")).repartition("l", "r", "from")
    each = blocks.select("l", "r", "score", "lk", "rk", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + BLOCK, F.col("take")) - 1)).alias("j"))
    each = each.select("l", "r", "score", (F.col("lk") + F.col("j")).alias("lk"), (F.col("rk") + F.col("j")).alias("rk"))
    b = _placed(right, rtexts, id_right, key, text).select(F.col("t").alias("r"), F.col("k").alias("rk"), F.col("i").alias(id_right))
    each = each.join(b, ["r", "rk"]).select("l", "lk", id_right, "score")
    a = _placed(left, ltexts, id_left, key, text).select(F.col("t").alias("l"), F.col("k").alias("lk"), F.col("i").alias(id_left))
    rows = a.join(each, ["l", "lk"], "left").select(id_left, id_right, "score")
    none = left.where(F.col(id_left).isNull() | F.col(key).isNull() | F.col(text).isNull())
    return rows.union(none.select(F.col(id_left), F.lit(None).cast(right.schema[id_right].dataType), F.lit(None).cast("long")))
