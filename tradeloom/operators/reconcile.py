"""Two readings of one page: agreement, conflict, or one of them alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions import dictionaries as d
from tradeloom.functions import lexical
from tradeloom.operators import classify

OVERLAP = 0.35


def strong_types(text: Column, clues: classify.Clues = d.CLUES) -> Column:
    """Sorted types of which a strong clue occurs."""
    strong = {kind: (first, []) for kind, (first, _) in clues.items()}
    normal = lexical.normalize(text)
    found = [F.when(reduce(lambda a, b: a | b, (hit for *_, hit in each)), F.lit(kind)) for kind, each in classify.hits(normal, strong).items() if each]
    return F.array_sort(F.array_compact(F.array(*found)))


def signals(text: Column, clues: classify.Clues = d.CLUES) -> Column:
    """What two readings of a page must agree on."""
    return F.struct(lexical.date_tokens(text).alias("dates"), lexical.identifier_tokens(text).alias("identifiers"), lexical.number_tokens(text).alias("numbers"), strong_types(text, clues).alias("types"))


def reconciled(first: DataFrame, second: DataFrame, keys: list[str], overlap: float = OVERLAP) -> DataFrame:
    """(keys, level, text, requires_review) from two readings (keys, text, usable).

    Both usable: equal dates, identifiers, numbers and strong document types and enough common words verify the first; else a conflict
    yields no text.  One usable is taken as it is; with none the page stays unverified, without text.
    """
    side = lambda df, p: df.select(*keys, F.col("text").alias(f"{p}_text"), F.col("usable").alias(f"{p}_ok"))
    both = side(first, "a").join(side(second, "b"), keys, "full")
    a, b = F.coalesce("a_ok", F.lit(False)), F.coalesce("b_ok", F.lit(False))
    # equal texts agree in everything; the others are read, and what differs first spares the rest
    differ = a & b & ~F.coalesce(F.col("a_text") == F.col("b_text"), F.lit(False))
    x, y = F.when(differ, F.col("a_text")), F.when(differ, F.col("b_text"))
    same = reduce(lambda p, q: p & q, (of(x) == of(y) for of in (lexical.number_tokens, lexical.date_tokens, lexical.identifier_tokens)))
    same = ~differ | (same & (strong_types(x) == strong_types(y)) & (lexical.jaccard(lexical.word_set(x), lexical.word_set(y)) >= overlap))
    level = F.when(a & b, F.when(same, "CROSS_VERIFIED").otherwise("CONFLICT")).when(a | b, "SINGLE_PROVIDER").otherwise("UNVERIFIED")
    out = lexical.once(both, level=level)
    text = F.when(F.col("level") == "CROSS_VERIFIED", F.col("a_text")).when(F.col("level") == "SINGLE_PROVIDER", F.when(a, F.col("a_text")).otherwise(F.col("b_text"))).otherwise("")
    return out.select(*keys, "level", text.alias("text"), F.col("level").isin("CONFLICT", "UNVERIFIED").alias("requires_review"))


def rolled_up(pages: DataFrame, id_col: str, page: str) -> DataFrame:
    """(id, requires_review, unresolved_pages) of each document."""
    return pages.groupBy(id_col).agg(F.bool_or("requires_review").alias("requires_review"), F.array_sort(F.collect_list(F.when(F.col("level").isin("CONFLICT", "UNVERIFIED"), F.col(page)))).alias("unresolved_pages"))
