"""Scalar functions on text, numbers and dates as native Column expressions.

Patterns say ``(?U)`` where Unicode classes are meant and end in ``\\z``.  Every function yields null for null.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = r"(?U)\s+"
#: The characters of ``(?U)\s``.
BLANK = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are evaluated once a row, however often later expressions refer to them.

    The optimizer merges projections and so repeats their expressions; it does not merge across a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def trim(c: Column) -> Column:
    # looks at both ends only: a pattern would be tried at every character, and trim is called several times a cell
    return F.btrim(c, F.lit(BLANK))


def normalize_ascii(c: Column) -> Column:
    """Lower case, single blanks, trimmed: equals ``normalize`` for ASCII text."""
    return F.lower(trim(F.regexp_replace(c, BLANKS, " ")))


def normalized(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(T.StringType())
def _normalized(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normalized(t))


def normalize(c: Column) -> Column:
    """NFKC, case-folded, single blanks, trimmed.  Spark has no NFKC: texts that hold more than ASCII go through pandas, the others
    don't leave the JVM."""
    plain = c.rlike(r"^[\x00-\x7F]*\z")
    return F.when(plain, normalize_ascii(F.regexp_replace(c, r"[\x1C-\x1F]", " "))).otherwise(_normalized(F.when(~plain, c)))


def normalize_alias(c: Column) -> Column:
    return F.upper(trim(F.regexp_replace(c, BLANKS, " ")))


def label(c: Column, colons: str = "+") -> Column:
    """A label cell without its final colons (``colons``: a regex quantifier, '?' for one at most)."""
    return trim(F.regexp_replace(normalize_alias(c), f"[:：]{colons}$", ""))


def clue_regex(clue: str) -> str:
    """A clue as a pattern over normalized text: word borders only next to ASCII letters and digits; B/L and B.L. alike."""
    text = normalized(clue)
    if re.fullmatch(r"b[./]l\.?", text):
        return r"(?U)\bb[./]l\.?\b"
    edge = lambda ch: r"\b" if ch.isascii() and ch.isalnum() else ""
    return "(?U)" + edge(text[0]) + re.sub(r"([.^$*+?{}\[\]\\|()/\-#&~])", r"\\\1", text) + edge(text[-1])


# --- strict numbers and dates: anything doubtful is null ---


def decimal_text(c: Column) -> Column:
    """The canonical text of a strictly written decimal: grouping needs both separators; 1,200 is ambiguous."""
    t = trim(c)
    # what is canonical already, and what holds no digit, is told by one pattern
    return F.when(t.rlike(r"^(?:[0-9]+|[0-9]{4,}\.[0-9]+|[0-9]{1,3}\.(?:[0-9]{1,2}|[0-9]{4,}))\z"), t).when(t.rlike("[0-9]"), _decimal_text(t))


def _decimal_text(t: Column) -> Column:
    sign = F.regexp_extract(t, r"^([+-]?)", 1)
    body = trim(F.substring(t, F.length(sign) + 1, F.length(t)))
    return F.concat(
        F.when(sign == "-", "-").otherwise(""),
        F.when(body.rlike(r"^[0-9]+\z"), body)
        .when(body.rlike(r"^[0-9]{1,3}(,[0-9]{3})+\.[0-9]+\z"), F.replace(body, F.lit(","), F.lit("")))
        .when(body.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+,[0-9]+\z"), F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(body.rlike(r"^[0-9]+[.,][0-9]+\z") & ~body.rlike(r"^[0-9]{1,3}[.,][0-9]{3}\z"), F.replace(body, F.lit(","), F.lit("."))),
    )


def parse_decimal(c: Column, kind: str = "decimal(38,18)") -> Column:
    return decimal_text(c).try_cast(kind)


def parse_date(c: Column) -> Column:
    """YYYY-MM-DD with one of - / . used twice; other forms, impossible days and the year 0 are null."""
    t = trim(c)
    return F.when(t.rlike(r"^(?!0000)[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}\z"), F.to_date(F.try_to_timestamp(F.regexp_replace(t, "[/.]", "-"), F.lit("yyyy-MM-dd"))))


def canonical_number(c: Column) -> Column:
    """A number token for comparing two readings: repeated groups of three are an integer, a doubtful grouping is AMBIG, no number RAW.

    Unlike ``parse_decimal`` it never fails, so that equal doubts compare as equal.
    """
    sign = F.regexp_extract(c, r"^([+-]?)", 1)
    body = F.regexp_replace(c, r"^[+-]", "")
    whole = F.when(body.rlike(r"^\d+\z"), body).when(body.rlike(r"^\d+(,\d{3}){2,}\z") | body.rlike(r"^\d+(\.\d{3}){2,}\z"), F.regexp_replace(body, "[.,]", ""))
    broken = (
        F.when(body.rlike(r"^\d+(,\d{3})+\.\d+\z"), F.replace(body, F.lit(","), F.lit("")))
        .when(body.rlike(r"^\d+(\.\d{3})+,\d+\z"), F.replace(F.replace(body, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(body.rlike(r"^\d+[.,]\d+\z") & ~body.rlike(r"^\d{1,3}[.,]\d{3}\z"), F.replace(body, F.lit(","), F.lit(".")))
    )
    short = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^0+(?=\d)", ""), r"(\.\d*?)0+\z", "$1"), r"\.\z", "")
    minus = F.when(sign == "-", "-").otherwise("")
    odd = F.when(body.rlike(r"\d"), F.concat(F.lit("AMBIG:"), sign, body)).otherwise(F.concat(F.lit("RAW:"), c))
    return F.when(c.isNotNull(), F.coalesce(F.concat(F.when(short(whole) != "0", minus).otherwise(""), short(whole)), F.concat(minus, short(broken)), odd))


# --- evidence in free text ---


def _alone(pattern: str, neighbour: str) -> str:
    """A pattern with no such character right before or after it."""
    return f"(?<!{neighbour})(?:{pattern})(?!{neighbour})"


def _days(order: str) -> str:
    """Real days, with - / or . between the parts: order names year, month and day."""
    long, short = "0?[13578]|1[02]", "0?[469]|11"
    leap = "[0-9]{2}(?:0[48]|[2468][048]|[13579][26])|(?:0[48]|[2468][048]|[13579][26])00"
    kinds = [
        {"y": "(?!0000)[0-9]{4}", "m": long, "d": "3[01]|[12][0-9]|0?[1-9]"},
        {"y": "(?!0000)[0-9]{4}", "m": short, "d": "30|[12][0-9]|0?[1-9]"},
        {"y": "(?!0000)[0-9]{4}", "m": "0?2", "d": "2[0-8]|1[0-9]|0?[1-9]"},
        {"y": leap, "m": "0?2", "d": "29"},
    ]
    return "|".join("[-/.]".join(f"(?:{k[x]})" for x in order) for k in kinds)


_YEAR_FIRST = _alone(_days("ymd"), "[0-9]")
#: Day and month that could change places.
_EITHER = _alone("[-/.]".join(["(?:0?[0-9]|1[0-2])"] * 2 + ["[0-9]{4}"]), "[0-9]")
_DAY_FIRST = _alone(_days("dmy"), "[0-9]")
def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), 1)


def date_tokens(c: Column) -> Column:
    """Sorted dates of a text in ISO form; day and month that could change places are marked AMBIG; impossible days are none."""
    part = lambda x, i: F.element_at(F.split(x, "[-/.]"), i)
    iso = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    sure = F.transform(_all(c, _YEAR_FIRST), lambda x: iso(part(x, 1), part(x, 2), part(x, 3)))
    either = F.transform(_all(c, _EITHER), lambda x: F.concat(F.lit("AMBIG:"), F.regexp_replace(x, "[-.]", "/")))
    # a day above 12, so that these are not those above
    turned = F.filter(_all(c, _DAY_FIRST), lambda x: part(x, 1).cast("int") > 12)
    return _set(F.concat(sure, either, F.transform(turned, lambda x: iso(part(x, 3), part(x, 2), part(x, 1)))))


def _pieces(c: Column, kept: str) -> Column:
    """What stands between characters that can't belong to a token; ``kept`` names those that can."""
    return F.filter(F.split(c, f"[^{kept}]+"), lambda x: x != "")


def identifier_tokens(c: Column) -> Column:
    """Sorted identifiers, in upper case: runs of letters and digits, joined by single hyphens or slashes, that hold both."""
    # doubled joints, and those that join nothing on one side, part runs
    parted = F.regexp_replace(F.regexp_replace(c, "[-/]{2,}", " "), "(^|[^A-Za-z0-9])[-/]|[-/](?![A-Za-z0-9])", "$1 ")
    return _set(F.transform(F.filter(_pieces(parted, "A-Za-z0-9/-"), lambda x: x.rlike("[A-Za-z]") & x.rlike("[0-9]")), F.upper))


def number_tokens(c: Column) -> Column:
    """Sorted canonical numbers outside dates and identifiers; the digits of impossible days count.

    What is left without dates and words that hold a letter is cut at all but digits, points, commas and signs, and before each sign.  A sign counts
    right before a digit and not right after one; points and commas around a piece belong to the sentence.
    """
    mark = "\ue000"  # stands for a date, so that an identifier around it is still seen whole
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, _YEAR_FIRST, mark), _EITHER, mark), _DAY_FIRST, mark)
    some = f"[0-9{mark}]"
    word = f"(?:{some}+[-/])*{some}*[A-Za-z][A-Za-z0-9{mark}]*(?:[-/][A-Za-z0-9{mark}]+)*"
    rest = F.translate(F.regexp_replace(rest, word, " "), mark, " ")
    rest = F.regexp_replace(F.regexp_replace(rest, "([0-9])[-+]", "$1 "), "([-+])", " $1")
    pieces = F.transform(_pieces(rest, "0-9.,+-"), lambda x: F.regexp_replace(F.regexp_replace(x, "[.,]+$", ""), "^[-+]?[.,]+|^[-+]$", ""))
    return _set(F.transform(F.filter(pieces, lambda x: x != ""), canonical_number))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


# --- text quality ---


def text_statistics(c: Column) -> Column:
    """length, replacement, control, nonspace and meaningful (letters and digits) characters of the trimmed text."""

    def of(t: Column) -> Column:
        # runs, not characters: a text without oddities is one match
        kept = lambda pattern, x=t: F.length(F.regexp_replace(x, pattern, ""))
        return F.struct(
            F.length(t).alias("length"),
            kept("[^\\x{FFFD}]+").alias("replacement"),
            kept(r"[^\p{C}]+", F.translate(t, "\n\r\t", "")).alias("control"),
            kept(r"(?U)\s+").alias("nonspace"),
            kept(r"[^\p{L}\p{N}]+").alias("meaningful"),
        )

    # the trimmed text is made once and bound
    return F.get(F.transform(F.array(trim(F.coalesce(c, F.lit("")))), of), F.lit(0))


def is_usable(s: Column, min_chars: int = 12, max_control: float = 0.02, max_replacement: float = 0.01, min_ratio: float = 0.45) -> Column:
    """Whether a text with these statistics can be relied on."""
    n = F.greatest(s["length"], F.lit(1))
    return (
        (s["meaningful"] >= min_chars)
        & (s["control"] / n <= max_control)
        & (s["replacement"] / n <= max_replacement)
        & (s["meaningful"] / F.greatest(s["nonspace"], F.lit(1)) >= min_ratio)
    )


# --- identifiers and names ---


def is_shipment_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9_-]+\z"), F.lit(False))


def is_clean_id(c: Column) -> Column:
    return F.coalesce((F.length(c) > 0) & (c == trim(c)), F.lit(False))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def safe_filename(c: Column) -> Column:
    """The last path segment without control characters, trimmed."""
    return trim(F.regexp_replace(F.element_at(F.split(c, r"[/\\]"), -1), r"[\x00-\x1f\x7f]", ""))


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"\.([^./\\]+)\z", 1))


def column_number(letters: Column) -> Column:
    """A1 column letters to a number: A is 1, AA is 27."""
    return F.aggregate(F.filter(F.split(F.upper(letters), ""), lambda x: x != ""), F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)


def padded_number(c: Column, number_format: Column) -> Column:
    """A whole number as text, with the zeros that a format of zeros shows; fractions are null."""
    n = F.when(c == F.floor(c), F.abs(c).cast("bigint").cast("string"))
    wide = F.when(number_format.rlike(r"^0+\z"), F.lpad(n, F.greatest(F.length(number_format), F.length(n)), F.lit("0"))).otherwise(n)
    return F.concat(F.when(c < 0, "-").otherwise(""), wide)


def container_check(c: Column) -> Column:
    """A container number without blanks and hyphens, if its check digit is right; else null."""
    t = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    # letters count from 10 and skip the multiples of 11
    value = lambda x: F.when(x.rlike("[0-9]"), x.try_cast("int")).otherwise(F.ascii(x) - 55 + F.floor((F.ascii(x) - 56) / 10).cast("int"))
    digits = F.slice(F.filter(F.split(t, ""), lambda x: x != ""), 1, 10)
    total = F.aggregate(F.transform(digits, lambda x, i: value(x) * F.pow(F.lit(2), i).cast("int")), F.lit(0), lambda a, b: a + b)
    return F.when(t.rlike(r"^[A-Z]{3}[UJZ][0-9]{7}\z") & (total % 11 % 10 == F.substring(t, 11, 1).try_cast("int")), t)
