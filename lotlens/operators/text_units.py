"""Apartment units mined from free text: patterns in, an array of distinct unit names out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """Patterns with (pattern, groups), range patterns, and what a unit may look like."""

    singles: Sequence[tuple[str, int]]
    number_range: str | None = None
    letter_range: str | None = None
    range_limit: int = 0
    range_span: int = 0
    letter_span: int = 0
    max_length: int = 10
    max_number: int | None = None
    strip: bool = False
    needs_digit: bool = False
    excluded: Sequence[str] = ()


# The pattern sets of the four generations of unit mining, and what several of their patterns begin with.
_APT = r"(?:APT|APARTMENT|UNIT|SUITE|#|APT\.)\s*"
_ANY_FLOOR = r"(?:FLOOR|FLR|FL)\s+"
BASIC = Rules(
    singles=[
        (_APT + r"([0-9]{1,4}[A-Z]?)", 1), (r"(?:APT|APARTMENT|UNIT|SUITE)\s+([A-Z]-?[0-9]+)", 1), (r"\b([0-9]{1,2}[A-Z])\b", 1), (r"\b([A-Z][0-9]{1,3})\b", 1),
        (r"(?:FLOOR|FL)\s*([0-9]+)\s*(?:APT|UNIT)\s*([A-Z0-9]+)", 2), (r"UNITS?\s+([0-9]+[A-Z]?)\s+(?:AND|&)\s+([0-9]+[A-Z]?)", 2),
        (r"(?:APT|APARTMENT|UNIT)\s+([0-9]{1,4})\b", 1), (r"\b(PH-?[A-Z0-9]+)\b", 1), (r"\b(PENTHOUSE)\b", 1),
    ],
    strip=True, needs_digit=True, excluded=("FLOOR", "STORY", "STORIES", "FEET", "INCH", "YEAR", "ST", "ND", "RD", "TH", "STREET", "AVENUE", "AVE"),
)
ADVANCED = Rules(
    singles=[
        (_APT + r"([0-9]{1,4}[A-Z]?)", 1), (r"(?:APT|APARTMENT|UNIT|SUITE)\s+([A-Z]-?[0-9]+)", 1), (r"\b([0-9]{1,2}[A-Z])\b", 1), (r"\b([A-Z][0-9]{1,3})\b", 1), (r"\b(PH-?[A-Z0-9]+)\b", 1),
        (_ANY_FLOOR + r"([0-9]{1,2})\s+(?:FRONT|REAR|F|R)", 1), (_ANY_FLOOR + r"([0-9]{1,2}[A-Z])", 1), (r"([0-9]{1,2})(?:ST|ND|RD|TH)\s+(?:FLOOR|FLR)", 1),
        (r"\b(BSMT|BASEMENT|GARDEN|GDN|PENTHOUSE|PH)\b", 1), (r"\b(STORE|STOREFRONT|COMMERCIAL)\b", 1), (r"(?:,|\s)#?([0-9]{1,3}[A-Z])(?:,|\s|$)", 1), (r"(?:,|\s)APT\.?\s*([0-9]+)(?:,|\s|$)", 1),
    ],
    number_range=r"(?:APTS?|UNITS?)\s+([0-9]+)\s*-\s*([0-9]+)", letter_range=r"(?:APTS?|UNITS?)\s+([A-Z])\s*-\s*([A-Z])", range_limit=500, range_span=100, letter_span=26,
)
STRICT = Rules(
    singles=[
        (_APT + r"([0-9]{1,4}[A-Z]?)\b", 1), (r"(?:APT|APARTMENT|UNIT|SUITE)\s+([A-Z]-?[0-9]+)\b", 1), (r"\b([0-9]{1,2}[A-Z])\b(?!\s*(?:ST|ND|RD|TH|STREET|AVENUE|FLOOR))", 1), (r"\b([A-Z][0-9]{1,3})\b(?!\s*STREET)", 1),
        (r"\b(PH-?[A-Z0-9]+)\b", 1), (r"\b(PENTHOUSE)\b", 1), (r"\b(BASEMENT|BSMT|GARDEN|GDN)\b", 1), (_ANY_FLOOR + r"([0-9]{1,2})\s*(?:FRONT|REAR|F|R)\b", 1), (_ANY_FLOOR + r"([0-9]{1,2}[A-Z])\b", 1),
        (r"\b([0-9]{1,2})(?:ST|ND|RD|TH)\s+(?:FLOOR|FLR)\b", 1), (r"(?:,|\s)#\s*([0-9]{1,3}[A-Z]?)(?:,|\s|$)", 1), (r"(?:,|\s)APT\.?\s*([0-9]+[A-Z]?)(?:,|\s|$)", 1),
    ],
    number_range=r"(?:APTS?|UNITS?)\s+([0-9]+)\s*-\s*([0-9]+)\b", letter_range=r"(?:APTS?|UNITS?)\s+([A-Z])\s*-\s*([A-Z])\b", range_limit=100, range_span=30, letter_span=12, max_number=9999,
)
ADDRESS_ONLY = Rules(
    singles=[
        (_APT + r"([0-9]{1,4}[A-Z]?)", 1), (r"(?:APT|APARTMENT|UNIT|SUITE)\s+([A-Z]-?[0-9]+)", 1), (r"\b([0-9]{1,2}[A-Z])\b", 1), (r"\b([A-Z][0-9]{1,3})\b", 1), (r"\b(PH-?[A-Z0-9]+)\b", 1),
        (r"(?:FLOOR|FL|FLR)\s*([0-9]{1,2})", 1), (r"\b([0-9]{3,4})\b(?=\s*$)", 1),
    ],
    max_length=6, excluded=("ST", "AVE", "ROAD", "DR", "PL", "CT", "LN", "WAY"),
)


def _pairs(text: Column, pattern: str) -> Column:
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("b"))


def extract_units(c: Column, rules: Rules) -> Column:
    """Sorted distinct units of a text; an empty array for null."""
    text = F.upper(F.coalesce(c, F.lit("")))
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, groups in rules.singles for g in range(1, groups + 1)]))
    found = F.transform(found, lambda u: F.replace(F.replace(F.trim(u), F.lit(" "), F.lit("")), F.lit("-"), F.lit("")) if rules.strip else F.trim(u))

    def valid(u: Column) -> Column:
        ok = (u != "") & (F.length(u) <= rules.max_length)
        if rules.excluded:
            ok = ok & ~u.isin(*rules.excluded)
        if rules.needs_digit:
            ok = ok & (u.rlike("[0-9]") | u.isin("PH", "PENTHOUSE"))
        if rules.max_number is not None:
            ok = ok & ~F.coalesce(F.when(u.rlike("^[0-9]+$"), u.try_cast("bigint") > rules.max_number), F.lit(False))
        return ok

    parts = [F.filter(found, valid)]
    if rules.number_range:
        none = F.array().cast("array<string>")

        def numbers(p: Column) -> Column:
            a, b = p["a"].try_cast("int"), p["b"].try_cast("int")
            ok = F.coalesce((a >= 1) & (a < b) & (b <= rules.range_limit), F.lit(False))
            return F.when(ok, F.transform(F.sequence(a, F.least(b, a + rules.range_span - 1)), lambda n: n.cast("string"))).otherwise(none)

        def letters(p: Column) -> Column:
            a, b = F.ascii(p["a"]), F.ascii(p["b"])
            return F.when((a < b) & (b - a <= rules.letter_span), F.transform(F.sequence(a, b), lambda n: F.chr(n))).otherwise(none)

        parts += [F.flatten(F.transform(_pairs(text, rules.number_range), numbers)), F.flatten(F.transform(_pairs(text, rules.letter_range), letters))]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def mine_units(source: str, df: DataFrame, id_col: str, text_col: str, rules: Rules, *keys: str) -> DataFrame:
    """Long table source, source_id, keys, unit, raw_text (500 signs), unique by source, id and unit.

    Of several texts of an id the first in order stays, with its keys.
    """
    rows = df.select(F.lit(source).alias("source"), F.col(id_col).cast("string").alias("source_id"), *keys, F.explode(extract_units(F.col(text_col), rules)).alias("unit"), F.left(F.col(text_col), F.lit(500)).alias("raw_text"))
    first = rows.groupBy("source", "source_id", "unit").agg(F.min(F.struct("raw_text", *keys)).alias("_row"))
    return first.select("source", "source_id", *[F.col("_row")[k].alias(k) for k in keys], "unit", F.col("_row.raw_text").alias("raw_text"))
