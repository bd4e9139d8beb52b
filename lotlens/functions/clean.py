"""Cleaning of messy scalar values. Every function takes and returns columns and never fails on dirty input."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit texts that name no apartment, short and long list.
JUNK_UNITS = ("N/A", "NA", "0", "00", "000", "-", ".", "NONE", "X", "XX", "TIMES", "APT", "UNIT")
JUNK_UNITS_LONG = (
    *JUNK_UNITS, "BLDG", "BUILDING", "ALL", "ENTIRE", "BSMT", "BASEMENT", "CELLAR", "STORE", "GARAGE", "PARKING", "ROOF", "LOBBY", "HALLWAY", "COMMON",
    "COMMERCIAL", "OFFICE", "SUPER", "BOILER", "PUBLIC", "VACANT", "OUTSIDE", "HALL", "STAIRS", "STAIRWAY",
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once a row, however often it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_float(c: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default).cast("double"))


def parse_int(c: Column, default: int | None = 0) -> Column:
    """Truncates through double, so "7.9" is 7."""
    return F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def money(c: Column, default: float | None = None) -> Column:
    """ "$1,234.50" is 1234.5; anything else that is no number is the default."""
    return parse_float(F.regexp_replace(c, r"[$,\s]", ""), default)


def money_int(c: Column, default: int | None = None) -> Column:
    return F.coalesce(money(c).try_cast("bigint"), F.lit(default).cast("bigint"))


def integer_prefix(c: Column) -> Column:
    """The numeric prefix of a text, 0 without one."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?\d{1,18})", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def per_unit(numerator: Column, denominator: Column, digits: int = 0) -> Column:
    """Half-even ratio, 0 if either side is empty or zero."""
    filled = (numerator != 0) & (denominator != 0)
    return F.coalesce(F.when(filled, F.bround(F.try_divide(numerator.cast("double"), denominator.cast("double")), digits)), F.lit(0.0))


def _by_pattern(c: Column, *patterns: tuple[str, str]) -> Column:
    return F.coalesce(*[F.when(c.rlike(f"^(?:{pattern})$"), F.try_to_date(c, fmt)) for pattern, fmt in patterns])


def normalize_date(c: Column) -> Column:
    """ISO with or without a time, YYYYMMDD or M/D/YYYY; anything else is null."""

    def day(text: Column) -> Column:
        iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10).try_cast("date"))
        return F.coalesce(iso, _by_pattern(text, (r"\d{8}", "yyyyMMdd"), (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy")))

    return let(F.trim(c.cast("string")), day)


MONTH_NAME = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATE_IN_TEXT = rf"(?i)\b(\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}/\d{{1,2}}/\d{{2}}|{MONTH_NAME}[a-z]*\s+\d{{1,2}},\s+\d{{4}})\b"


def parse_display_date(c: Column) -> Column:
    """The first date inside a display text: 1/5/2024, 1/5/24, Jan 5, 2024 or January 5, 2024."""

    def day(found: Column) -> Column:
        numeric = _by_pattern(found, (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"), (r"\d{1,2}/\d{1,2}/\d{2}", "M/d/yy"))
        named = F.regexp_replace(F.initcap(found), r"^([A-Z][a-z]{2})[a-z]*", "$1")
        return F.coalesce(numeric, let(named, lambda n: F.when(n.rlike("^[A-Z][a-z]{2} "), F.try_to_date(n, "MMM d, yyyy"))))

    return let(F.regexp_replace(F.regexp_extract(c, DATE_IN_TEXT, 1), r"\s+", " "), day)


def capture_time(c: Column) -> Column:
    """A 14-digit archive stamp as a timestamp."""
    return F.when(c.rlike(r"^\d{14}$"), F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss")))


def display_price(c: Column) -> Column:
    """The number in the first line of a price label, before any change arrow."""
    return F.regexp_replace(F.split(c, "[\n↓↑]")[0], r"[^\d.]", "").try_cast("double")


def price_in_text(c: Column) -> Column:
    return F.replace(F.regexp_extract(c, r"\$\s*([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit("")).try_cast("double")


def display_area(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "").try_cast("bigint")


def asking_price(c: Column) -> Column:
    return F.replace(F.regexp_extract(c, r"asking:\s*\$([\d,]+)", 1), F.lit(","), F.lit("")).try_cast("double")


def discount_percent(c: Column) -> Column:
    return F.regexp_extract(c, r"([+-]?\d+\.?\d*)%", 1).try_cast("double")


def normalize_unit(c: Column) -> Column:
    """Upper case without blanks and leading number signs; null is empty."""
    return F.replace(F.ltrim(F.trim(F.upper(F.coalesce(c, F.lit("")))), F.lit("#")), F.lit(" "), F.lit(""))


def not_blank(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def is_unit(c: Column, junk: Sequence[str] = JUNK_UNITS, max_length: int = 10) -> Column:
    """False for blanks, junk words and long texts."""
    unit = F.upper(F.trim(c))
    return F.coalesce((unit != "") & ~unit.isin(*junk) & (F.length(unit) <= max_length), F.lit(False))


def map_values(c: Column, labels: Mapping[str, str], fallback: str = "raw") -> Column:
    """Code to label; without one the code itself ("raw"), in lower case ("lower") or null ("null")."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    rest = {"raw": c, "lower": F.lower(c), "null": F.lit(None).cast("string")}[fallback]
    return F.coalesce(F.try_element_at(table, c), rest)


def any_ilike(c: Column, words: Sequence[str]) -> Column:
    """Contains any of the words, in any case."""
    out = F.lit(False)
    for w in words:
        out = out | c.ilike(f"%{w}%")
    return F.coalesce(out, F.lit(False))


def since(c: Column, as_of: Column, months: int, month_days: int = 30) -> Column:
    """On or after as_of less so many months of a fixed length."""
    return c >= F.date_sub(as_of, months * month_days)


def bathrooms(full: Column, half: Column) -> Column:
    return F.coalesce(full, F.lit(0)) + 0.5 * F.coalesce(half, F.lit(0))
