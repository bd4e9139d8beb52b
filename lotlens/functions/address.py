"""Addresses, listing links and slugs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotlens.functions.keys import borough_code

# Street abbreviations in the order in which they are replaced.
ABBREVIATIONS = {
    " AVENUE": " AVE", " STREET": " ST", " BOULEVARD": " BLVD", " DRIVE": " DR", " PLACE": " PL", " ROAD": " RD",
    " COURT": " CT", " LANE": " LN", " TERRACE": " TERR", " PARKWAY": " PKWY", " SQUARE": " SQ", " CRESCENT": " CRES",
}
# Words that end a street's name.
SUFFIXES = ("ST", "AVE", "BLVD", "DR", "PL", "RD", "CT", "LN", "TERR", "PKWY", "SQ", "CRES", "WAY", "CIR", "HWY", "OVAL", "ALY", "ROW", "WALK", "BROADWAY", "BOWERY")
# City endings of building slugs.
SLUG_CITIES = {"new_york": "MN", "manhattan": "MN", "brooklyn": "BK", "queens": "QN", "bronx": "BX", "the_bronx": "BX", "staten_island": "SI"}


def normalize_address(c: Column) -> Column:
    """Upper case with abbreviated street types; plain substring replacements, null is empty."""
    start = F.replace(F.trim(F.upper(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-"))
    return reduce(lambda a, pair: F.replace(a, F.lit(pair[0]), F.lit(pair[1])), ABBREVIATIONS.items(), start)


def address_key(address: Column, borough: Column) -> Column:
    return F.concat_ws("|", normalize_address(address), borough)


def parse_listing_address(c: Column) -> Column:
    """Struct street, unit, city, state, zip, borough of "200 E 23RD ST 7C, New York, NY 10010".

    The street ends at the last word that is a street type or an ordinal; what follows is the unit. Without such a
    word, or with nothing after it, all of the first part is the street.
    """
    parts = F.split(c, ",")
    part = lambda i: F.coalesce(F.trim(F.get(parts, F.lit(i))), F.lit(""))
    words = F.filter(F.split(part(0), r"\s+"), lambda w: w != "")
    ends = F.transform(words, lambda w, i: F.when(F.rtrim(F.upper(w), F.lit(".,")).rlike(rf"^(?:{'|'.join(SUFFIXES)}|\d+(?:ST|ND|RD|TH))$"), i + 1))
    last = F.coalesce(F.array_max(ends), F.lit(0))
    cut = (last > 0) & (last < F.size(words))
    joined = lambda a: F.array_join(a, " ")
    tail = F.split(part(2), r"\s+")
    return F.when(
        c.isNotNull() & (c != ""),
        F.struct(
            F.when(cut, joined(F.slice(words, F.lit(1), last))).otherwise(part(0)).alias("street"),
            F.when(cut, joined(F.slice(words, last + 1, F.size(words)))).otherwise("").alias("unit"),
            part(1).alias("city"),
            F.coalesce(F.get(tail, F.lit(0)), F.lit("")).alias("state"),
            F.coalesce(F.get(tail, F.lit(1)), F.lit("")).alias("zip"),
            borough_code(part(1)).alias("borough"),
        ),
    )


def parse_building_url(c: Column) -> Column:
    """Struct slug, unit of ".../building/<slug>/<unit>"; null where nothing matches."""
    pattern = r"/building/([^/?]+)(?:/([^/?]+))?(?:\?|$)"
    get = lambda k: F.when(F.regexp_extract(c, pattern, k) != "", F.regexp_extract(c, pattern, k))
    return F.struct(get(1).alias("slug"), get(2).alias("unit"))


def slug_city(c: Column) -> Column:
    """The longest known city that ends the slug."""
    slug = F.lower(c)
    cities = F.array(*[F.lit(x) for x in sorted(SLUG_CITIES, key=len, reverse=True)])
    return F.get(F.filter(cities, lambda x: F.endswith(slug, F.concat(F.lit("-"), x))), F.lit(0))


def slug_borough(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SLUG_CITIES.items() for x in pair])
    return F.try_element_at(table, slug_city(c))


def slug_address(c: Column) -> Column:
    """The slug without its city, as a normalised address."""
    return normalize_address(F.replace(F.left(c, F.length(c) - F.length(slug_city(c)) - 1), F.lit("-"), F.lit(" ")))


def address_to_slug(c: Column, city: str = "new_york") -> Column:
    return F.concat(F.trim(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(f"-{city}"))


def zip_of(c: Column) -> Column:
    """Five digits at the end of an address."""
    found = F.regexp_extract(c, r"(\d{5})(?:-\d{4})?\s*$", 1)
    return F.when(found != "", found)


# Parts of links that are no listing or building.
SKIPPED_PATHS = ("/search", "/for-sale", "/for-rent", "/neighborhoods", "/no-fee", "/agents", "/login", "/signup", "/blog", "/sitemap", "?", "/amenity/", "/reviews", "/floorplans")


def canonical_url(c: Column) -> Column:
    """Without query, fragment and trailing slashes, and of one protocol: http is https."""
    bare = F.rtrim(F.split_part(F.split_part(c, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), F.lit("/"))
    return F.when(F.startswith(bare, F.lit("http://")), F.concat(F.lit("https://"), F.substr(bare, F.lit(8)))).otherwise(bare)


def classify_url(c: Column, host: str, skipped: tuple[str, ...] = SKIPPED_PATHS) -> Column:
    """Struct kind (rental, sale, building, skip) and id for links of one host."""
    skip = F.lit(False)
    for s in skipped:
        skip = skip | F.contains(F.lower(c), F.lit(s))
    site = rf"https?://(?:www\.)?{host}"
    unit = rf"{site}/(rental|sale)/(\d+)"
    slug = F.regexp_extract(c, rf"{site}/building/([\w-]+)", 1)
    is_building = (slug != "") & ~slug.isin("search", "no-fee", "featured")
    kind = F.when(skip, "skip").when(c.rlike(unit), F.regexp_extract(c, unit, 1)).when(is_building, "building").otherwise("skip")
    key = F.when(~skip & c.rlike(unit), F.regexp_extract(c, unit, 2)).when(~skip & is_building, slug)
    return F.struct(kind.alias("kind"), key.alias("id"))
