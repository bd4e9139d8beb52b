"""Listing events, labels, amenities and prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts of navigation elements that are no events.
NOISE = (
    "Browse Buildings", "Market Data", "Facts", "Building Class", "District", "Owned by", "Documents and Permits", "Previously Listed",
    "Amenities", "Floor Plans", "Schools", "Transportation", "Nearby Buildings", "Similar", "Landmark", "Historical",
)
# Canonical event by exact text, and by a text it contains.
EXACT_EVENTS = {
    "LISTED": "listed", "Listing sold": "sold", "SOLD": "sold", "RENTED": "rented", "Listing entered contract": "in_contract", "IN_CONTRACT": "in_contract",
    "Listing is no longer available": "delisted", "NO_LONGER_AVAILABLE": "delisted", "No longer available": "delisted",
    "PRICE_DECREASE": "price_change", "PRICE_INCREASE": "price_change", "RELISTED": "relisted", "RECORDED_SALE": "sold",
}
PARTIAL_EVENTS = {"Price decreased": "price_change", "Price increased": "price_change", "Relisted": "relisted", "Previous Sale recorded": "sold"}
# Display events in their order of precedence.
DISPLAY_EVENTS = {
    "Listed by": "listed", "Delisted by": "delisted", "Rented by": "rented", "Sold by": "sold", "Closing record": "closing", "Price decreased": "price_decrease",
    "Price increased": "price_increase", "No longer available": "no_longer_available", "Temporarily off market": "off_market", "In contract": "in_contract", "Recorded closing": "closing",
}


def _contains(c: Column, word: str) -> Column:
    return F.contains(c, F.lit(word))


def is_noise(c: Column) -> Column:
    out = F.lit(False)
    for w in NOISE:
        out = out | _contains(c, w)
    return F.coalesce(out, F.lit(False))


def canonical_event(c: Column) -> Column:
    """Struct event, broker: null for noise, price_point where nothing is recognised."""
    e = F.trim(F.coalesce(c, F.lit("")))
    broker = F.regexp_extract(e, r"^Listed by (.+)$", 1)
    exact = F.create_map(*[F.lit(x) for pair in EXACT_EVENTS.items() for x in pair])
    event = F.when(is_noise(e), F.lit(None).cast("string")).when(broker != "", "listed").when(F.try_element_at(exact, e).isNotNull(), F.try_element_at(exact, e))
    for word, name in PARTIAL_EVENTS.items():
        event = event.when(_contains(e, word), name)
    return F.struct(event.otherwise("price_point").alias("event"), F.when((broker != "") & ~is_noise(e), F.trim(broker)).alias("broker"))


def display_event(c: Column) -> Column:
    """Struct event, broker for texts of a history panel; the first phrase in the list that stands in it decides.

    "Listed by" stands in no "Delisted by", whose letter is small.
    """
    e = F.trim(F.coalesce(c, F.lit("")))
    event = F.when(F.lit(False), "")
    for phrase, name in DISPLAY_EVENTS.items():
        event = event.when(_contains(e, phrase), name)
    broker = F.when(F.lit(False), "")
    for phrase in ("Listed by", "Delisted by", "Rented by"):
        broker = broker.when(_contains(e, phrase), F.trim(F.replace(e, F.lit(phrase), F.lit(""))))
    broker = broker.when(_contains(e, "Sold by"), F.trim(F.split(F.element_at(F.split(e, "Sold by"), -1), "Closing")[0]))
    return F.struct(event.otherwise("other").alias("event"), broker.alias("broker"))


def ownership_type(property_type: Column) -> Column:
    kind = F.lower(F.coalesce(property_type, F.lit("")))
    return F.when(kind.like("%condop%"), "condop").when(kind.like("%condo%"), "condo").when(kind.like("%co-op%") | kind.like("%coop%"), "coop").when(kind.like("%rental%"), "rental").otherwise("unknown")


def unit_label(c: Column) -> Column:
    """Struct beds, baths, unit, price of "1 Bedroom | Bath 1.0 | Apt 015M | $4945"; a studio has no bedroom."""
    unit = F.regexp_extract(c, r"(?i)Apt\s*(\S+)", 1)
    return F.struct(
        F.coalesce(F.regexp_extract(c, r"(?i)(\d+)\s*Bedroom", 1).try_cast("int"), F.lit(0)).alias("beds"),
        F.coalesce(F.regexp_extract(c, r"(?i)Bath\s*([\d.]+)", 1).try_cast("double"), F.lit(1.0)).alias("baths"),
        F.coalesce(unit, F.lit("")).alias("unit"),
        F.replace(F.regexp_extract(c, r"\$([\d,]+)", 1), F.lit(","), F.lit("")).try_cast("bigint").alias("price"),
    )


def is_valid_listing(unit: Column, rooms: Column, price: Column, available: Column) -> Column:
    """A unit, a price from $500 to $50,000, and well-formed rooms and date where they are given."""
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    amount = F.regexp_replace(price, "[$,]", "").try_cast("bigint")
    return F.coalesce(
        given(unit)
        & (~given(rooms) | rooms.rlike(r"(?i)(?:Studio|\d+)\s*(?:Bed|Bath)"))
        & price.rlike(r"^\$[\d,]+$")
        & amount.between(500, 50_000)
        & (~given(available) | available.rlike(r"\d")),
        F.lit(False),
    )


def has_amenity(amenities: Column, codes: tuple[str, ...], pattern: str) -> Column:
    """amenities: array of structs with code and description."""
    return F.coalesce(F.exists(amenities, lambda a: F.coalesce(a["code"].isin(*codes), F.lit(False)) | F.coalesce(a["description"].rlike(pattern), F.lit(False))), F.lit(False))


def has_washer_dryer(amenities: Column) -> Column:
    return has_amenity(amenities, ("WasherDryer", "Washer/Dryer"), "(?i)washer.*dryer")


def floor_number(amenities: Column) -> Column:
    """From the first amenity that has a floor code (FS02) or says "2nd floor"."""
    floors = F.transform(amenities, lambda a: F.coalesce(F.regexp_extract(a["code"], r"^FS(\d+)$", 1).try_cast("int"), F.regexp_extract(a["description"], r"(?i)(\d+)(?:st|nd|rd|th)\s+floor", 1).try_cast("int")))
    return F.get(F.filter(floors, lambda x: x.isNotNull()), F.lit(0))


def lease_terms(rates: Column) -> Column:
    """Map of months to price as an array of (term, price), by term."""
    return F.array_sort(F.transform(F.map_entries(rates), lambda e: F.struct(e["key"].try_cast("int").alias("term"), e["value"].alias("price"))))


def primary_price(terms: Column, term: int = 12) -> Column:
    """Price of the given term, else the least."""
    return F.coalesce(F.get(F.filter(terms, lambda t: t["term"] == term), F.lit(0))["price"], F.array_min(F.transform(terms, lambda t: t["price"])))


def rooms_label(beds: Column, baths: Column) -> Column:
    bed = F.when(beds == 0, "Studio").when(beds == 1, "1 Bed").otherwise(F.concat(beds.cast("string"), F.lit(" Beds")))
    bath = F.when(baths == 1, "1 Bath").otherwise(F.concat(F.format_string("%s", F.regexp_replace(baths.cast("string"), r"\.0$", "")), F.lit(" Baths")))
    return F.concat_ws(" / ", bed, bath)


def derived_fields(street: Column, unit: Column, city: Column, price: Column, area: Column, beds: Column, baths: Column) -> Column:
    """Struct of the full address, the rooms label and the price per area unit (null without an area)."""
    place = F.array_join(F.filter(F.array(F.concat_ws(" ", street, F.when(unit != "", unit)), city), lambda x: x != ""), ", ")
    return F.struct(place.alias("full_address"), rooms_label(beds, baths).alias("rooms"), F.round(F.try_divide(price.cast("double"), F.nullif(area, F.lit(0)).cast("double")), 2).alias("price_per_area"))


def price_bucket(price: Column, edges: tuple[float, ...]) -> Column:
    """Number of edges at or under the price."""
    return sum((F.when(price >= e, 1).otherwise(0) for e in edges), F.lit(0))


def listing_events(list_date: Column, list_price: Column, close_date: Column, close_price: Column, kind: Column) -> Column:
    """Array of (event, event_date, price): listed, and sold or rented once it closed."""
    shape = "array<struct<event:string,event_date:date,price:double>>"
    listed = F.when(list_date.isNotNull(), F.struct(F.lit("listed").alias("event"), list_date.cast("date").alias("event_date"), list_price.cast("double").alias("price")))
    closed = F.when(close_date.isNotNull(), F.struct(F.when(kind == "rental", "rented").otherwise("sold").alias("event"), close_date.cast("date").alias("event_date"), F.coalesce(close_price, list_price).cast("double").alias("price")))
    return F.array_compact(F.array(listed, closed)).cast(shape)
