"""Parcel keys: one borough digit, five of the block and four of the lot."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Borough digits and codes by name.
BOROUGH_DIGITS = {"MANHATTAN": "1", "BRONX": "2", "BROOKLYN": "3", "QUEENS": "4", "STATEN ISLAND": "5", "STATEN IS": "5"}
BOROUGH_CODES = {
    "Manhattan": "MN", "New York": "MN", "New York City": "MN", "Brooklyn": "BK", "Kings": "BK", "Queens": "QN", "Bronx": "BX", "The Bronx": "BX", "Staten Island": "SI",
    "MN": "MN", "BK": "BK", "QN": "QN", "BX": "BX", "SI": "SI",
}


def _map(labels: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])


def zero_filled(c: Column, width: int) -> Column:
    """Never truncates, unlike lpad."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def borough_digit(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.coalesce(F.try_element_at(_map(BOROUGH_DIGITS), F.upper(text)), text)


def make_key(borough: Column, block: Column, lot: Column) -> Column:
    """Ten digits as a number, or null: a borough name or digit, a block, and the last four digits of the lot."""
    # each part is named as seldom as it can be, the text once: the code of many copies is only interpreted by the JVM
    filled = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    text = F.concat(F.nullif(borough_digit(borough), F.lit("")), zero_filled(filled(block), 5), F.substring(zero_filled(filled(lot), 4), -4, 4))
    return F.regexp_extract(text, r"^[1-5]\d{9}$", 0).try_cast("bigint")


def padded_key(borough: Column, block: Column, lot: Column) -> Column:
    """Text key by right-aligned padding that keeps the last digits."""
    pad = lambda c, n: F.right(F.concat(F.lit("0" * n), F.trim(c.cast("string"))), F.lit(n))
    return F.concat(F.trim(borough.cast("string")), pad(block, 5), pad(lot, 4))


def key_from_number(c: Column) -> Column:
    """A key written as a decimal number, such as 1000010010.00000000."""
    return c.try_cast("decimal(28,8)").try_cast("bigint")


def key_from_text(c: Column) -> Column:
    """BROOKLYN0232100080 with the borough's name, five block digits, and four or five of the lot."""
    text = F.upper(F.trim(c))
    name = F.regexp_extract(text, r"^([A-Z ]+)", 1)
    rest = F.regexp_extract(text, r"^[A-Z ]+(\d{9,10})$", 1)
    lot = F.right(F.substring(rest, 6, 5), F.lit(4))
    return F.when(rest != "", F.concat(F.try_element_at(_map(BOROUGH_DIGITS), F.trim(name)), F.substring(rest, 1, 5), lot).try_cast("bigint"))


def is_usable(c: Column) -> Column:
    """Ten digits of which the first is a borough."""
    return F.coalesce(c.cast("string").rlike(r"^[1-5]\d{9}$"), F.lit(False))


def normalize_length(c: Column) -> Column:
    """Ten signs stay, longer texts are cut to ten, shorter ones are null."""
    return F.when(F.length(c) >= 10, F.substring(c, 1, 10))


def block_of(key: Column) -> Column:
    return F.substring(key.cast("string"), 1, 6)


def lot_of(key: Column) -> Column:
    return F.pmod(key.cast("bigint"), F.lit(10_000)).cast("int")


def borough_of(key: Column) -> Column:
    return F.substring(key.cast("string"), 1, 1)


def borough_code(c: Column) -> Column:
    return F.try_element_at(_map(BOROUGH_CODES), F.trim(c))


def unit_id(parcel: Column, building: Column, source: Column, source_id: Column, unit: Column) -> Column:
    """Composed of the parcel, else the building, else the source's own id."""
    key = F.coalesce(parcel.cast("string"), building.cast("string"), F.concat_ws("-", source, source_id.cast("string")))
    return F.concat_ws("-", key, unit)
