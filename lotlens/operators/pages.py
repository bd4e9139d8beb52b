"""Structured fields out of saved pages, by expressions; only table rows go through an HTML parser."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.clean import let, parse_display_date, price_in_text
from lotlens.operators import embedded


# The patterns of this module name marks of the pages they read.


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found)


def title(html: Column) -> Column:
    return _first(html, r"<title>([^<]+)</title>")


def page_facts(html: Column) -> Column:
    """Struct of title, address, neighborhood, building type, year, stories, units, lat, lng."""
    name = title(html)
    description = _first(html, r'<meta\s+name="description"\s+content="([^"]*)"')
    place = F.split(_first(html, r'<meta\s+name="ICBM"\s+content="([^"]*)"'), ";")
    spot = lambda i: F.when(F.size(place) == 2, F.trim(F.get(place, F.lit(i))).try_cast("double"))
    return F.struct(
        name.alias("title"),
        F.coalesce(F.trim(_first(name, r"^(.+?)\s+in\s+.+?\s*:")), F.trim(F.split_part(name, F.lit("|"), F.lit(1)))).alias("address"),
        F.trim(_first(name, r"^.+?\s+in\s+(.+?)\s*:")).alias("neighborhood"),
        F.initcap(_first(description, r"(?i)is a (condo|co-op|condop|rental|townhouse|multi-family)\b")).alias("building_type"),
        _first(description, r"built in (\d{4})").try_cast("int").alias("year_built"),
        _first(description, r"has (\d+) stor").try_cast("int").alias("stories"),
        _first(description, r"(\d+) unit").try_cast("int").alias("units"),
        spot(0).alias("lat"),
        spot(1).alias("lng"),
    )


def embedded_text(html: Column) -> Column:
    """The pushed script chunks of a page, joined and unescaped; in a chunk that is no valid string, the usual escapes."""
    chunks = F.regexp_extract_all(html, F.lit(r'(?s)self\.__next_f\.push\(\[\d+,"(.*?)"\]\)'), F.lit(1))

    def plain(chunk: Column) -> Column:
        usual = chunk
        for escaped, sign in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\/", "/")):
            usual = F.replace(usual, F.lit(escaped), F.lit(sign))
        return F.coalesce(F.get_json_object(F.concat(F.lit('{"s":"'), chunk, F.lit('"}')), "$.s"), usual)

    return F.array_join(F.transform(chunks, plain), "")


def embedded_object(text: Column, name: str, schema: str) -> Column:
    """The first flat object or array of scalars under a name, as a typed value; null where it doesn't parse."""
    raw = _first(text, rf'(?s)"{name}"\s*:\s*(\[[^\[\]]*\]|\{{[^{{}}]*\}})')
    return F.from_json(raw, schema, {"mode": "PERMISSIVE"})


def building_record(html: Column) -> Column:
    """`text_record` of a page's embedded text."""
    return let(embedded_text(html), text_record)


def text_record(text: Column) -> Column:
    """Struct of amenities, features, policies, owner, address and inventory from the embedded data."""
    listed = "array<string>"
    return F.struct(
        embedded_object(text, "amenities", listed).alias("amenities"),
        embedded_object(text, "features", listed).alias("features"),
        embedded_object(text, "policies", listed).alias("policies"),
        embedded_object(text, "owner", "name string").getField("name").alias("owner"),
        embedded_object(text, "address", "street string, city string, zipCode string").alias("address"),
        embedded_object(text, "inventory", "forSale int, forRent int").alias("inventory"),
    )


def data_layer(html: Column, known: tuple[str, ...]) -> Column:
    """The first data-layer object (as JSON text) that has one of the known names at its top."""
    return embedded.first_layer(html, known)


def layer_field(layer: Column, *names: str) -> Column:
    """The first of the names that the object holds, at the top or one level down."""
    return F.coalesce(*[F.get_json_object(layer, f"$.{n}") for n in names], *[_first(layer, rf'"{n}"\s*:\s*"?([^",}}]+)') for n in names])


def price_history(html: Column) -> Column:
    """Array of (date, price, event) from the page's embedded history; see `embedded.past_listings` for all fields."""
    return F.transform(embedded.past_listings(html), lambda r: F.struct(r["event_date"].alias("date"), r["price"].alias("price"), r["event_type"].alias("event")))


class _Rows(HTMLParser):
    """Cells of table rows, and whether the table's headers allow it to be a price history.

    Open tables are a stack: what stands in a table inside a cell belongs to that table's cells, and to the outer cell.
    """

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[dict] = []
        self.open: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.open.append({"head": [], "rows": [], "cell": None, "is_head": False})
            self.tables.append(self.open[-1])
        elif self.open and tag == "tr":
            self._close_cell()
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            self._close_cell()
            self.open[-1] |= {"cell": [], "is_head": tag == "th"}

    def handle_endtag(self, tag: str) -> None:
        if self.open and tag in ("td", "th", "tr", "table"):
            self._close_cell()
            if tag == "table":
                self.open.pop()

    def close(self) -> None:
        super().close()
        while self.open:
            self.handle_endtag("table")

    def handle_data(self, data: str) -> None:
        for t in self.open:
            if t["cell"] is not None:
                t["cell"].append(data)

    def _close_cell(self) -> None:
        t = self.open[-1]
        if t["cell"] is None:
            return
        text = " ".join(" ".join(t["cell"]).split())
        if t["is_head"]:
            t["head"].append(text.lower())
        elif t["rows"]:
            t["rows"][-1].append(text)
        t["cell"] = None


def table_cells(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, row, cells of the tables that have no headers or name a date and a price or rent."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, html in batch.itertuples(index=False):
                parser = _Rows()
                parser.feed(html or "")
                parser.close()
                for t in parser.tables:
                    head = " ".join(t["head"])
                    if not head or ("date" in head and ("price" in head or "rent" in head)):
                        out += [(key, i, cells) for i, cells in enumerate(t["rows"]) if len(cells) >= 2]
            yield pd.DataFrame(out, columns=["id", "row", "cells"])

    return pages.select(id_col, html_col).mapInPandas(run, f"id {dict(pages.dtypes)[id_col]}, row int, cells array<string>")


def table_history(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, row, event_date, price, event of history tables: the first cell with a date, with a price, and with neither."""
    read = F.transform("cells", lambda c: F.struct(c.alias("cell"), parse_display_date(c).alias("day"), F.contains(c, F.lit("$")).alias("price")))

    def fields(cells: Column) -> Column:
        first = lambda test: F.get(F.filter(cells, test), F.lit(0))
        rest = first(lambda c: c["day"].isNull() & ~c["price"])["cell"]
        return F.struct(first(lambda c: c["day"].isNotNull())["day"].alias("event_date"), price_in_text(first(lambda c: c["price"])["cell"]).alias("price"), rest.alias("event"))

    out = table_cells(pages, id_col, html_col).select("id", "row", let(read, fields).alias("_f")).select("id", "row", "_f.*")
    return out.filter("event_date is not null or price is not null or event is not null")


def links(html: Column) -> Column:
    """Distinct link targets in order of the page."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"#]+)"'), F.lit(1)))


def cards(html: Column, word: str) -> Column:
    """Fragments of a page, each from an element whose class contains the word to the next such element."""
    pieces = F.split(html, rf'(?=<\w+[^>]*class="[^"]*{word}[^"]*")')
    return F.filter(pieces, lambda p: p.rlike(rf'^<\w+[^>]*class="[^"]*{word}'))


def card_unit(card: Column) -> Column:
    """Struct of unit, price, beds, baths, area of a card, by its visible text."""
    text = F.regexp_replace(F.regexp_replace(card, "<[^>]*>", " "), r"\s+", " ")
    number = lambda p: _first(text, p).try_cast("double")
    return F.struct(
        F.coalesce(_first(text, r"(?i)(?:apt|unit|residence|#)\.?\s*#?([0-9A-Z-]+)")).alias("unit"),
        price_in_text(text).alias("price"),
        F.when(text.rlike("(?i)studio"), 0.0).otherwise(number(r"(?i)(\d+(?:\.\d+)?)\s*(?:bed|br)")).alias("beds"),
        number(r"(?i)(\d+(?:\.\d+)?)\s*ba").alias("baths"),
        F.replace(_first(text, r"(?i)([\d,]+)\s*(?:sq|ft)"), F.lit(","), F.lit("")).try_cast("double").alias("area"),
    )


# Marks of the layouts that unit pages come in.
SECTION_MARK, SECTION_UNIT = r'<h4\s+class="pc-card-title">', r'data-unitid="(\d+)"'
TABLE_MARK = r"(?is)<caption[^>]*>Apartment Details.*?Floor Plan:\s*"
TABLE_ROW = r"(?s)data-label='Apartment'[^>]*>#?(\w+)</th>.*?data-label=Sq\.Ft\.>(\d+)</td>.*?data-label='Rent'>\$([\d,]+)</td>"
LEASE = r'(?i)<option\s+value="\d+">\s*(\d+)\s+Months?\s+\(([\d,.]+)\s+USD\)'
PRICE_TAG = r'class="pprice"[^>]*>([^<]+)'


def _rooms(label: Column) -> tuple[Column, Column]:
    """Beds and baths of a heading: a studio has no bedroom, and one bath is the least."""
    beds = F.when(label.rlike("(?i)studio"), 0).otherwise(F.coalesce(F.regexp_extract(label, r"(?i)(\d+)\s*bed", 1).try_cast("int"), F.lit(0)))
    return beds, F.coalesce(F.regexp_extract(label, r"(?i)(\d+(?:\.\d+)?)\s*bath", 1).try_cast("double"), F.lit(1.0))


def _whole(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("bigint")


def section_units(html: Column) -> Column:
    """Array of id, unit, beds, baths, area, available, terms (months, price), price, stabilized of pages that group
    units under headings; the price is that of 12 months, else the least."""
    sections = F.slice(F.split(html, SECTION_MARK), 2, 2_000_000_000)

    def units(section: Column) -> Column:
        beds, baths = _rooms(F.split_part(section, F.lit("</h4>"), F.lit(1)))
        rows = F.filter(F.split(section, f"(?={SECTION_UNIT})"), lambda r: r.rlike("^" + SECTION_UNIT))

        def unit(row: Column) -> Column:
            number = F.regexp_extract(row, SECTION_UNIT, 1)
            months, prices = (F.regexp_extract_all(row, F.lit(LEASE), F.lit(k)) for k in (1, 2))
            terms = F.zip_with(months, prices, lambda m, p: F.struct(m.try_cast("int").alias("months"), F.replace(p, F.lit(","), F.lit("")).try_cast("double").try_cast("bigint").alias("price")))
            year = F.get(F.filter(terms, lambda x: x["months"] == 12), F.lit(0))["price"]
            return F.struct(
                number.alias("id"), F.coalesce(_first(row, 'data-title="([^"]+)"'), number).alias("unit"), beds.alias("beds"), baths.alias("baths"), _whole(F.regexp_extract(row, r'data-th="Sqft"[^>]*>\s*([\d,]+)', 1)).alias("area"),
                _first(row, 'data-available-date="([^"]+)"').alias("available"), terms.alias("terms"), F.coalesce(year, F.array_min(F.transform(terms, lambda x: x["price"]))).alias("price"), F.contains(row, F.lit('data-all-dhcr-units="True"')).alias("stabilized"),
            )

        return F.transform(rows, unit)

    return F.flatten(F.transform(sections, units))


def table_units(html: Column) -> Column:
    """Array of unit, beds, baths, area, price of pages with a captioned table for each floor plan."""
    sections = F.slice(F.split(html, TABLE_MARK), 2, 2_000_000_000)

    def units(section: Column) -> Column:
        beds, baths = _rooms(F.split_part(section, F.lit("<"), F.lit(1)))
        rows = F.regexp_extract_all(section, F.lit(TABLE_ROW), F.lit(0))
        field = lambda r, k: F.regexp_extract(r, TABLE_ROW, k)
        return F.transform(rows, lambda r: F.struct(field(r, 1).alias("unit"), beds.alias("beds"), baths.alias("baths"), field(r, 2).try_cast("bigint").alias("area"), _whole(field(r, 3)).alias("price")))

    return F.flatten(F.transform(sections, units))


def detail_unit(html: Column, listing: Column) -> Column:
    """Struct price, beds, baths of one listing's page; null without a price and beds.

    The price of the appointment link goes before that of a price tag; telephone numbers are no tags.
    """
    tags = F.transform(F.regexp_extract_all(html, F.lit(PRICE_TAG), F.lit(1)), lambda x: F.trim(x))
    tags = F.filter(tags, lambda x: ~x.rlike(r"^\d{3}\.\d{3}"))
    last = lambda found: F.element_at(F.filter(found, lambda x: x.isNotNull()), -1)
    linked = F.concat(F.lit(r'schedule-appointment-listing-today/\?lid='), listing.cast("string"), F.lit(r'[^"]*?price=(\d+)'))
    price = F.coalesce(F.call_function("regexp_extract", html, linked, F.lit(1)).try_cast("bigint"), F.get(F.transform(F.filter(tags, lambda x: x.rlike(r"^[\d,]+$")), _whole), F.lit(0)))
    named = F.filter(F.transform(tags, lambda x: F.when(x.rlike(r"(?i)\d\s*BR"), F.regexp_extract(x, r"(?i)(\d+)\s*BR", 1).try_cast("int")).when(x.rlike("(?i)studio"), 0)), lambda x: x.isNotNull())
    beds = F.coalesce(F.when(F.size(named) > 0, last(named)), F.regexp_extract(html, r"(?i)CONV(\d)", 1).try_cast("int"))
    baths = F.filter(F.transform(tags, lambda x: F.regexp_extract(x, r"(?i)(\d+(?:\.\d+)?)\s*Bath", 1).try_cast("double")), lambda x: x.isNotNull())
    return F.when(price.isNotNull() | beds.isNotNull(), F.struct(price.alias("price"), beds.alias("beds"), F.when(F.size(baths) > 0, last(baths)).alias("baths")))


def card_rows(pages: DataFrame, id_col: str, html_col: str, word: str) -> DataFrame:
    return pages.select(F.col(id_col), F.posexplode(cards(F.col(html_col), word)).alias("pos", "card")).select(id_col, "pos", card_unit(F.col("card")).alias("u")).select(id_col, "pos", "u.*")
