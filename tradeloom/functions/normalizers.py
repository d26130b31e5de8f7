"""Normal forms of dates, units, currencies, parties and item codes; what is doubtful is flagged, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradeloom.functions import lexical

#: Default spellings; any mapping of the same shape can take their place.  Pieces and sets are different units.
UNITS = {"PCE": ["PC", "PCS", "PIECE", "PIECES", "EA"], "SET": ["SET", "SETS"], "KGM": ["KG", "KGS", "KILOGRAM"], "MTR": ["M", "METER", "METRE"], "CTN": ["CARTON", "CARTONS", "CTNS"]}
CURRENCIES = {"USD": ["US$", "US DOLLAR"], "EUR": ["€", "EURO"], "CNY": ["RMB", "YUAN"], "VND": ["₫", "VND DONG"], "JPY": ["JP¥", "YEN"]}
#: Spellings that stand for more than one currency.
UNSURE = ["$", "¥"]
_SUFFIXES = r"(?:\s+(?:CO|CORP|INC|LTD|LLC|JSC|GMBH|COMPANY|LIMITED|CORPORATION))+\z"


def date(c: Column) -> Column:
    """struct(value, status): PARSED, AMBIGUOUS (day and month could change places), UNKNOWN, or null for a blank."""
    t = lexical.trim(c)
    read = lambda x, form: F.to_date(F.try_to_timestamp(x, F.lit(form)))
    parts = F.split(t, "[-/.]")
    first, second = F.try_element_at(parts, F.lit(1)).try_cast("int"), F.try_element_at(parts, F.lit(2)).try_cast("int")
    numeric = t.rlike(r"^[0-9]{1,2}([-/.])[0-9]{1,2}\1[0-9]{4}\z")
    either = numeric & (first <= 12) & (second <= 12) & (first != second)
    plain = F.regexp_replace(t, "[-/.]", "-")
    named = F.initcap(F.regexp_replace(F.regexp_replace(t, "[-,.]", " "), r"\s+", " "))
    value = F.coalesce(
        lexical.parse_date(t),
        F.when(numeric & ~either, F.coalesce(read(plain, "d-M-yyyy"), read(plain, "M-d-yyyy"))),
        F.when(t.rlike(r"^[0-9]{8}\z"), read(t, "yyyyMMdd")),
        F.when(named.rlike(r"^[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4}\z"), read(named, "d MMM yyyy")),
        F.when(named.rlike(r"^[A-Z][a-z]{2} [0-9]{1,2} [0-9]{4}\z"), read(named, "MMM d yyyy")),
    )
    status = F.when(t != "", F.when(either, "AMBIGUOUS").when(value.isNotNull(), "PARSED").otherwise("UNKNOWN"))
    return F.struct(F.when(~either, value).alias("value"), status.alias("status"))


def coded(c: Column, spellings: dict[str, list[str]], unsure: list[str] = ()) -> Column:
    """struct(value, status): the code of a spelling; what is unknown or stands for several codes needs review."""
    key = lexical.normalize_alias(c)
    pairs = {s: code for code, names in spellings.items() for s in [code, *names]}
    value = F.element_at(F.create_map(*[F.lit(v) for kv in pairs.items() for v in kv]), key)
    status = F.when(key != "", F.when(value.isNotNull(), "PARSED").when(key.isin(*unsure), "AMBIGUOUS").otherwise("NEEDS_REVIEW"))
    return F.struct(value.alias("value"), status.alias("status"))


def unit(c: Column) -> Column:
    return coded(c, UNITS)


def currency(c: Column) -> Column:
    return coded(c, CURRENCIES, UNSURE)


def party(c: Column) -> Column:
    """A party's name for comparison: upper case, no punctuation, no legal form at its end."""
    name = lexical.normalize_alias(F.regexp_replace(c, r"[\p{P}]", " "))
    return F.regexp_replace(name, _SUFFIXES, "")


def item_code(c: Column) -> Column:
    """Upper case without blanks; leading zeros and hyphens stay."""
    return F.upper(F.regexp_replace(c, lexical.BLANKS, ""))


def countries(df: DataFrame, c: str, catalog: DataFrame) -> DataFrame:
    """Adds country and country_status by a catalog (name, code) of exact names or codes in any case."""
    names = catalog.select(lexical.normalize_alias(F.col("name")).alias("_name"), F.col("code").alias("country"))
    names = names.union(catalog.select(lexical.normalize_alias(F.col("code")), "code")).dropDuplicates(["_name"])
    out = df.join(names, lexical.normalize_alias(F.col(c)) == F.col("_name"), "left").drop("_name")
    return out.withColumn("country_status", F.when(F.col("country").isNotNull(), "PARSED").when(F.col(c).isNotNull(), "NEEDS_REVIEW"))
