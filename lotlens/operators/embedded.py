"""JSON that stands inside pages and scripts: balanced values behind an opening, and typed fields out of them.

A value ends where its brackets are closed outside strings, so nested lists, brackets in strings and escaped quotes are
read whole. The brackets are matched in Arrow batches, a text once for all openings; everything behind that is
expressions: `from_json`, `get_json_object`, variants.

A null text holds nothing. A value that never closes is left out, one that is no valid JSON gives null fields.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lotlens.functions.clean import let, money, parse_display_date

_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|["\[\]{}]', re.DOTALL)
_STRING = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.DOTALL)
_CLOSES = {"]": "[", "}": "{"}


class _Brackets:
    """Ends of the values of one text; a bracket that one scan has passed is not scanned again."""

    def __init__(self, text: str):
        self.text, self.ends = text, {}

    def end(self, start: int) -> int | None:
        """Where the object, list or string that begins at `start` ends; None if it doesn't."""
        if self.text[start : start + 1] == '"':
            found = _STRING.match(self.text, start)
            return found and found.end()
        if self.text[start : start + 1] not in ("{", "["):
            return None
        if start not in self.ends:
            self._scan(start)
        return self.ends[start]

    def _scan(self, start: int) -> None:
        stack = []
        for token in _TOKEN.finditer(self.text, start):
            sign, at = token.group(), token.start()
            if sign in ("{", "["):
                stack.append(at)
            elif sign in _CLOSES:
                if self.text[stack[-1]] != _CLOSES[sign]:
                    break
                self.ends[stack.pop()] = at + 1
                if not stack:
                    return
            elif sign == '"':  # a string that never ends
                break
        for at in stack:
            self.ends[at] = None


def balanced_values(text: str | None, opening: re.Pattern, inner: bool = False) -> list[str]:
    """Values that begin where a match of `opening` ends, in order; those inside a value found before only if `inner`."""
    out: list[str] = []
    brackets, at = _Brackets(text or ""), 0
    while found := opening.search(brackets.text, at):
        end = brackets.end(found.end())
        if end is None:
            at = max(found.end(), found.start() + 1)
        else:
            out.append(brackets.text[found.end() : end])
            at = max(found.end(), found.start() + 1) if inner else end
    return out


def json_values(text: Column, openings: Mapping[str, str], inner: Sequence[str] = ()) -> Column:
    """Struct of arrays of JSON texts: for each name the values behind its opening, a Python regular expression.

    Under the names in `inner`, values within values are found too.
    """
    patterns = {name: re.compile(p) for name, p in openings.items()}
    shape = f"struct<{','.join(f'{name}:array<string>' for name in patterns)}>"

    @F.arrow_udf(shape)
    def values(texts: pa.Array) -> pa.Array:
        found = {name: [] for name in patterns}
        for t in texts.to_pylist():
            for name, p in patterns.items():
                found[name].append(balanced_values(t, p, name in inner))
        return pa.StructArray.from_arrays([pa.array(v, pa.list_(pa.string())) for v in found.values()], names=list(found))

    return values(text)


def _parsed(value: Column, schema: str) -> Column:
    return F.from_json(value, schema)


def _is_object(value: Column) -> Column:
    return F.startswith(value, F.lit("{"))


def _regex(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


# Names and marks of the pages' embedded records.
BUILDING_OPENINGS = {
    "listed": r'"amenities":(?=\{"list":)',
    "shown": r'"amenities":(?=\{"Services)',
    "features": r'"unitFeatures":(?=\[)',
    "owner": r'(?=\{"owner":)',
    "address": r'"address":(?=\{"street":)',
    "policies": r'"policies":(?=\[)',
    "sale": r'"saleInventorySummary":(?=[\[{])',
    "rental": r'"rentalInventorySummary":(?=[\[{])',
    "description": r'"description":(?="[^"\\]*+(?:\\.[^"\\]*+)*+",")',
}
NO_OWNER = "UNAVAILABLE OWNER"
LAYER_OPENING = r"(?:dataLayer\s*=\s*\[|dataLayer\.push\s*\()\s*(?=\{)"
LAYER_KEYS = ("listing", "property", "ecommerce", "price", "listingPrice", "beds", "propertyType", "address", "buildingName", "neighborhood")
LAYER_FIELDS = {
    "price": ("price", "listingPrice", "listing_price"),
    "beds": ("beds", "bedrooms", "numBedrooms"),
    "baths": ("baths", "bathrooms", "numBathrooms"),
    "sqft": ("sqft", "squareFeet", "area"),
    "ppsf": ("ppsf", "pricePerSqFt"),
    "status": ("status", "listingStatus"),
    "listing_type": ("listingType", "listing_type", "propertyType"),
    "agent": ("agent", "agentName", "listing_agent"),
    "brokerage": ("brokerage", "brokerageName", "office"),
    "building_name": ("buildingName", "building_name"),
    "address": ("address", "streetAddress"),
    "neighborhood": ("neighborhood", "area_name"),
    "borough": ("borough", "city"),
    "city": ("city",),
    "state": ("state",),
    "zipcode": ("zipcode", "postalCode"),
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lng", "lon"),
    "year_built": ("yearBuilt", "year_built"),
    "building_type": ("buildingType", "building_type"),
    "amenities": ("amenities",),
}
LAYER_NUMBERS = ("price", "beds", "baths", "sqft", "ppsf", "latitude", "longitude", "year_built")
HISTORY_OPENINGS = {
    "lists": r'"(?:pastListings|past_listings|listing_history|priceHistory|price_history)"\s*:\s*(?=\[)',
    "props": r'"PastListingsExperience"[^{]*(?=\{)',
    "blobs": r"(?=\[\s*\{)",
}
PROP_LISTS = ("listings", "pastListings", "items", "history")
BLOB_KEYS = ("date", "price", "event", "eventType", "event_type")
HISTORY_FIELDS = {
    "event_date": ("date", "eventDate", "event_date", "closingDate", "listedDate"),
    "event_type": ("event", "eventType", "event_type", "type", "status"),
    "price": ("price", "listPrice", "salePrice", "amount"),
    "price_change": ("priceChange", "price_change"),
    "broker": ("broker", "agent", "brokerage"),
}


def listing_record(text: Column) -> Column:
    """Struct of what a building's page embeds, from its joined and unescaped script chunks.

    amenities, amenities_shown, unit_features, owner, developer, street, city, state, zipcode, neighborhood,
    building_id, pet_policy, sale_inventory and rental_inventory (JSON texts of the breakdowns by bedrooms), description.
    """
    v = json_values(text, BUILDING_OPENINGS)
    first = lambda name: F.get(v[name], F.lit(0))
    categories = F.filter(F.map_values(_parsed(first("shown"), "map<string,string>")), lambda x: F.startswith(x, F.lit("[")))
    items = F.flatten(F.transform(categories, lambda x: _parsed(x, "array<string>")))
    named = F.array_compact(F.transform(items, lambda x: F.when(_is_object(x), F.get_json_object(x, "$.name")).otherwise(x)))
    features = F.transform(_parsed(first("features"), "array<struct<name:string,description:string>>"), lambda f: F.coalesce(f["name"], f["description"], F.lit("")))
    shown = let(named, lambda x: F.when(F.size(x) > 0, x))
    owned = F.get(F.filter(F.transform(v["owner"], lambda x: _parsed(x, "owner string, developer string")), lambda o: o["owner"].isNotNull() & o["developer"].isNotNull()), F.lit(0))
    place = _parsed(first("address"), "street string, city string, state string, zipCode string")
    pets = F.filter(_parsed(first("policies"), "array<string>"), lambda p: _is_object(p) & F.contains(F.lower(p), F.lit("pet")))
    breakdown = lambda name: json_values(first(name), {"rows": r'(?=\{[^{}]*"bedroomTitle")'})["rows"]
    told = F.get_json_object(F.concat(F.lit('{"d":'), first("description"), F.lit("}")), "$.d")
    bare = F.regexp_replace(F.regexp_replace(F.replace(told, F.lit("</p>"), F.lit(" ")), "<[^>]*>", ""), r"^\s+|\s+$", "")
    return F.struct(
        _parsed(first("listed"), "list array<string>")["list"].alias("amenities"),
        shown.alias("amenities_shown"),
        features.alias("unit_features"),
        F.nullif(F.nullif(owned["owner"], F.lit(NO_OWNER)), F.lit("")).alias("owner"),
        F.nullif(owned["developer"], F.lit("")).alias("developer"),
        place["street"].alias("street"), place["city"].alias("city"), place["state"].alias("state"), place["zipCode"].alias("zipcode"),
        _regex(text, r'"neighborhood":"([^"]+)"').alias("neighborhood"),
        _regex(text, r'"buildingId":"(\d+)"').alias("building_id"),
        F.get(pets, F.lit(0)).alias("pet_policy"),
        breakdown("sale").alias("sale_inventory"), breakdown("rental").alias("rental_inventory"),
        let(bare, lambda x: F.when(F.length(x) > 20, x)).alias("description"),
    )


def _truthy(value: Column) -> Column:
    """A filled value; an empty text, list or object, 0 and false are passed over."""
    return let(value, lambda x: F.when(~x.isin("", "0", "0.0", "false", "[]", "{}"), x))


def first_layer(html: Column, known: Sequence[str] = LAYER_KEYS) -> Column:
    """JSON text of the first data-layer object that has one of the known keys at its top."""
    layers = json_values(html, {"layers": LAYER_OPENING})["layers"]
    keys = F.array(*[F.lit(k) for k in known])
    return F.get(F.filter(layers, lambda x: F.coalesce(F.arrays_overlap(F.json_object_keys(x), keys), F.lit(False))), F.lit(0))


def layer_record(html: Column) -> Column:
    """Struct of the listing's fields in the page's data layer, flattened by one level, of each the first filled synonym.

    Where a name stands at the top and one level down, or twice, the last one holds. Numbers lose `$` and `,`.
    """
    wanted = sorted({s for synonyms in LAYER_FIELDS.values() for s in synonyms})

    def record(layer: Column) -> Column:
        top = F.map_entries(_parsed(layer, "map<string,string>"))
        nested = F.coalesce(F.flatten(F.transform(top, lambda e: F.when(_is_object(e["value"]), F.map_entries(_parsed(e["value"], "map<string,string>"))).otherwise(F.array(e)))), F.array())
        return let(F.filter(nested, lambda e: e["key"].isin(*wanted)), lambda known: fields(known, layer))

    def fields(known: Column, layer: Column) -> Column:
        at = lambda name: _truthy(F.try_element_at(F.filter(known, lambda e: e["key"] == name), F.lit(-1))["value"])
        columns = []
        for name, synonyms in LAYER_FIELDS.items():
            value = F.coalesce(*[at(s) for s in synonyms])
            columns.append((money(value) if name in LAYER_NUMBERS else value).alias(name))
        return F.struct(*columns, layer.alias("raw"))

    return let(first_layer(html), record)


def past_listings(html: Column) -> Column:
    """Array of (event_date, event_type, price, price_change, broker, raw) of a page's price history.

    All lists under a history's name; without items in them, the lists in the component's props, or the props as one
    item; without those, the first list of objects anywhere whose first object is dated, priced or an event.
    """
    items = lambda x: F.filter(F.coalesce(_parsed(x, "array<string>"), F.array().cast("array<string>")), _is_object)
    keys = F.array(*[F.lit(k) for k in BLOB_KEYS])

    def found(v: Column) -> Column:
        lists = F.flatten(F.transform(v["lists"], items))
        held = lambda obj: F.flatten(F.array(*[items(F.get_json_object(obj, f"$.{k}")) for k in PROP_LISTS]))
        props = F.flatten(F.transform(F.filter(v["props"], lambda o: F.json_object_keys(o).isNotNull()), lambda o: let(held(o), lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(o)))))
        dated = lambda x: F.coalesce(F.arrays_overlap(F.json_object_keys(F.get_json_object(x, "$[0]")), keys), F.lit(False))
        blob = items(F.get(F.filter(v["blobs"], dated), F.lit(0)))
        return let(lists, lambda x: F.when(F.size(x) > 0, x).otherwise(let(props, lambda y: F.when(F.size(y) > 0, y).otherwise(blob))))

    def row(item: Column) -> Column:
        value = {name: F.coalesce(*[_truthy(F.get_json_object(item, f"$.{s}")) for s in synonyms]) for name, synonyms in HISTORY_FIELDS.items()}
        day = let(value["event_date"], lambda d: F.coalesce(parse_display_date(d).cast("string"), d))
        return F.struct(day.alias("event_date"), value["event_type"].alias("event_type"), money(value["price"]).alias("price"), money(value["price_change"]).alias("price_change"), value["broker"].alias("broker"), item.alias("raw"))

    return F.transform(let(json_values(html, HISTORY_OPENINGS, inner=["blobs"]), found), row)
