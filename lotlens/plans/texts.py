"""Units mined from text, and fields, links and captures of saved pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.functions import address
from lotlens.operators import pages, windows
from lotlens.operators import text_units as tu
from lotlens.plans.registry import Tables, query, spread


@query("""SELECT c_custkey, unnest([CAST(1 + c_custkey % 40 AS VARCHAR) || 'B', 'C' || CAST(1 + c_custkey % 9 AS VARCHAR), 'PENTHOUSE']) AS unit FROM customer""")
def mine_units_basic(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    text = F.concat(F.lit("Repair in apt "), (1 + c % 40).cast("string"), F.lit("b, suite c-"), (1 + c % 9).cast("string"), F.lit(" and the penthouse on Main street"))
    return t.customer.select("c_custkey", F.explode(tu.extract_units(text, tu.BASIC)).alias("unit"))


@query("""SELECT DISTINCT c_custkey, unit FROM (SELECT c_custkey, CAST(unnest(range(2, least(4 + c_custkey % 30, 32))) AS VARCHAR) AS unit FROM customer UNION ALL SELECT c_custkey, unnest(['A', 'B', 'C', 'D', 'BASEMENT', '3']) FROM customer)""")
def mine_units_ranges(t: Tables) -> DataFrame:
    text = F.concat(F.lit("work at units 2-"), (3 + F.col("c_custkey") % 30).cast("string"), F.lit("; apts a - d; basement and 3rd floor"))
    return t.customer.select("c_custkey", F.explode(tu.extract_units(text, tu.STRICT)).alias("unit"))


@query("""WITH s AS (SELECT 'a' AS source, c_custkey AS id, CAST(1 + c_custkey % 7 AS VARCHAR) AS unit FROM customer UNION ALL SELECT 'b', s_suppkey, '12F' FROM supplier) SELECT source, CAST(id AS VARCHAR) AS source_id, unit FROM s""")
def mine_many_sources(t: Tables) -> DataFrame:
    a = tu.mine_units("a", t.customer.withColumn("text", F.concat(F.lit("apt "), (1 + F.col("c_custkey") % 7).cast("string"), F.lit(" leaking"))), "c_custkey", "text", tu.ADVANCED)
    b = tu.mine_units("b", t.supplier.withColumn("text", F.lit("corner of Oak, unit 12f")), "s_suppkey", "text", tu.ADDRESS_ONLY)
    return a.union(b).select("source", "source_id", "unit")


@query("""SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS units FROM (SELECT len(list_distinct(regexp_extract_all(upper(text), '\\b([0-9]{1,2}[A-Z])\\b', 1))) AS n FROM documents) WHERE n > 0""")
def mine_documents(t: Tables) -> DataFrame:
    rules = tu.Rules(singles=[(r"(?-U)\b([0-9]{1,2}[A-Z])\b", 1)])
    n = F.size(tu.extract_units(F.col("text"), rules))
    return t.documents.select(n.alias("n")).filter("n > 0").agg(F.count("*").alias("documents"), F.sum("n").alias("units"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]+)</title>', 1) AS title FROM pages""")
def page_titles(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.coalesce(pages.page_facts(F.col("html"))["title"], F.lit("")).alias("title"))


@query("""SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="([^"#]+)"', 1))) AS n, string_agg(DISTINCT u, ' ' ORDER BY u) AS targets FROM (SELECT page_id, html, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS u FROM pages) GROUP BY page_id, html""")
def page_links(t: Tables) -> DataFrame:
    l = t.pages.select("page_id", pages.links(F.col("html")).alias("l"))  # noqa: E741
    return l.filter(F.size("l") > 0).select("page_id", F.size("l").cast("long").alias("n"), F.array_join(F.array_sort("l"), " ").alias("targets"))


@query("""SELECT u AS target, count(*) AS pages FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS u FROM pages) GROUP BY 1""")
def link_targets(t: Tables) -> DataFrame:
    """Links are distinct within a page, so the count needs no second shuffle."""
    return t.pages.select(F.explode(pages.links(F.col("html"))).alias("target")).groupBy("target").agg(F.count("*").alias("pages"))


@query("""SELECT page_id, regexp_replace(rtrim(split_part(split_part(url, '?', 1), '#', 1), '/'), '^http://', 'https://') AS canonical, CASE WHEN url LIKE '%?%' THEN 'skip' WHEN regexp_matches(url, 'https?://[a-z.]+/(en|fr|de|es)/\\d+') THEN 'page' ELSE 'other' END AS kind FROM pages""")
def canonical_urls(t: Tables) -> DataFrame:
    u = F.col("url")
    kind = F.when(F.contains(u, F.lit("?")), "skip").when(u.rlike(r"https?://[a-z.]+/(en|fr|de|es)/\d+"), "page").otherwise("other")
    return t.pages.select("page_id", address.canonical_url(u).alias("canonical"), kind.alias("kind"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'rental' WHEN 1 THEN 'sale' WHEN 2 THEN 'building' ELSE 'skip' END AS kind, CASE p_size % 4 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN 'oak-' || p_partkey END AS id FROM part""")
def classify_urls(t: Tables) -> DataFrame:
    k, n = F.col("p_size") % 4, F.col("p_partkey").cast("string")
    path = F.when(k == 0, F.concat(F.lit("rental/"), n)).when(k == 1, F.concat(F.lit("sale/"), n)).when(k == 2, F.concat(F.lit("building/oak-"), n)).otherwise(F.concat(F.lit("building/oak/floorplans/"), n))
    c = address.classify_url(F.concat(F.lit("https://www.homes.example/"), path), r"homes\.example")
    return t.part.select("p_partkey", c.alias("c")).select("p_partkey", "c.kind", "c.id")


def capture_queue(captures: DataFrame, url: str, stamp: str, processed: DataFrame) -> DataFrame:
    """The latest capture of each canonical link that was not processed yet."""
    rows = captures.withColumn("canonical", address.canonical_url(F.col(url)))
    return windows.latest(rows, ["canonical"], F.col(stamp), url).join(processed, "canonical", "left_anti")


_CAPTURES = """WITH c AS (SELECT page_id, regexp_replace(rtrim(split_part(split_part(url, '?', 1), '#', 1), '/'), '^http://', 'https://') AS canonical, CASE WHEN url LIKE '%?%' THEN 'skip' WHEN regexp_matches(url, '^https?://[a-z.]+/(en|fr|de|es)/[0-9]+') THEN 'page' ELSE 'other' END AS kind FROM pages),
 known AS (SELECT canonical FROM c WHERE page_id % 17 = 0) """


def _captures(t: Tables) -> DataFrame:
    """Captures of pages, each link classified by its form."""
    u = F.col("url")
    kind = F.when(F.contains(u, F.lit("?")), "skip").when(u.rlike(r"^https?://[a-z.]+/(en|fr|de|es)/[0-9]+"), "page").otherwise("other")
    return t.pages.select("page_id", "url", kind.alias("kind"), address.canonical_url(u).alias("canonical"))


@query(_CAPTURES + "SELECT canonical, max(page_id) AS page_id FROM c WHERE kind = 'page' GROUP BY 1 HAVING canonical NOT IN (SELECT canonical FROM known)")
def capture_queue_pages(t: Tables) -> DataFrame:
    """The newest capture of each page that was not processed, by its canonical link; other links are skipped."""
    captures = _captures(t)
    done = captures.filter("page_id % 17 = 0").select("canonical").distinct()
    return capture_queue(captures.filter("kind = 'page'").select("page_id", "url"), "url", "page_id", done).select("canonical", "page_id")


def queue_links(pages_with_links: DataFrame, links: str, page_url: str, known: DataFrame) -> DataFrame:
    """canonical, found_on: links that pages hold and that are neither known nor queued, with the first page that names them."""
    target = F.explode(links)
    found = pages_with_links.select(F.col(page_url).alias("_page"), target.alias("_link"))
    host = F.regexp_extract("_page", r"^(https?://[^/]+)", 1)
    whole = F.when(F.startswith(F.col("_link"), F.lit("/")), F.concat(host, "_link")).otherwise(F.col("_link"))
    return found.select(address.canonical_url(whole).alias("canonical"), "_page").groupBy("canonical").agg(F.min("_page").alias("found_on")).join(known.select(address.canonical_url(F.col("canonical")).alias("canonical")).distinct(), "canonical", "left_anti")


@query(_CAPTURES + """SELECT canonical, min(url) AS found_on FROM (SELECT url, regexp_replace(rtrim(split_part(split_part(CASE WHEN u LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || u ELSE u END, '?', 1), '#', 1), '/'), '^http://', 'https://') AS canonical
 FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"#]+)"', 1)) AS u FROM pages)) WHERE canonical NOT IN (SELECT canonical FROM c) GROUP BY 1""")
def queued_links(t: Tables) -> DataFrame:
    """Links found on the captured pages go to the queue unless they were captured."""
    return queue_links(t.pages.select("url", pages.links(F.col("html")).alias("l")), "l", "url", _captures(t))


@query("""SELECT p_partkey, DATE '2024-01-05' + CAST(p_size AS INTEGER) AS event_date, 1000.0 + p_partkey AS price, CASE p_size % 2 WHEN 0 THEN 'Listed' ELSE 'Sold' END AS event FROM part""")
def table_history(t: Tables) -> DataFrame:
    """A page with a history table is written for each part and read again."""
    d = F.date_format(F.date_add(F.lit("2024-01-05").cast("date"), F.col("p_size")), "MMM d, yyyy")
    event = F.when(F.col("p_size") % 2 == 0, "Listed").otherwise("Sold")
    html = F.concat(F.lit("<table><tr><th>Date</th><th>Event</th><th>Price</th></tr><tr><td>"), d, F.lit("</td><td>"), event, F.lit("</td><td>$"), F.format_number(1000 + F.col("p_partkey"), 0), F.lit("</td></tr></table><table><tr><th>Age</th></tr><tr><td>1</td><td>$2</td></tr></table>"))
    return pages.table_history(spread(t.part).select("p_partkey", html.alias("html")), "p_partkey", "html").select(F.col("id").alias("p_partkey"), "event_date", "price", "event")


@query("""SELECT p_partkey, n AS pos, CAST(p_size + n AS VARCHAR) || 'A' AS unit, 1000.0 + p_partkey AS price, CASE WHEN n = 0 THEN 0.0 ELSE 2.0 END::DOUBLE AS beds, 1.5::DOUBLE AS baths FROM part, (SELECT CAST(unnest([0, 1]) AS INTEGER) AS n)""")
def card_pages(t: Tables) -> DataFrame:
    card = lambda n, beds: F.concat(F.lit('<div class="unit-card"><h3>Apt '), (F.col("p_size") + n).cast("string"), F.lit(f"A</h3> {beds} <i>1.5 baths</i><b>$"), F.format_number(1000 + F.col("p_partkey"), 0), F.lit("</b></div>"))
    rows = t.part.select("p_partkey", F.concat(F.lit("<body>"), card(0, "studio"), card(1, "2 beds"), F.lit("</body>")).alias("html"))
    return pages.card_rows(rows, "p_partkey", "html", "unit-card").select("p_partkey", "pos", "unit", "price", "beds", "baths")


@query("""SELECT p_partkey, CAST(p_size AS DOUBLE) AS price, CAST(p_size % 9 AS VARCHAR) AS beds, 'sold' AS event FROM part""")
def embedded_data(t: Tables) -> DataFrame:
    """Data-layer fields and an embedded history list."""
    s = F.col("p_size").cast("string")
    html = F.concat(F.lit('<script>dataLayer = [{"page":"x"}]; dataLayer.push({"listPrice":1,"bedrooms":"'), (F.col("p_size") % 9).cast("string"), F.lit('"})</script><script>{"priceHistory": [{"date":"2024-01-01","price":'), s, F.lit(',"event":"sold"}]}</script>'))
    rows = t.part.select("p_partkey", html.alias("html"))
    h = F.get(pages.price_history(F.col("html")), F.lit(0))
    return rows.select("p_partkey", h["price"].alias("price"), pages.layer_field(pages.data_layer(F.col("html"), ("bedrooms",)), "beds", "bedrooms").alias("beds"), h["event"].alias("event"))


def _lease_html() -> F.Column:
    n = F.col("p_size")
    row = lambda i, stable: F.concat(F.lit('<tr data-unitid="'), (F.col("p_partkey") * 10 + i).cast("string"), F.lit('" data-title="'), (n + i).cast("string"), F.lit(f'C" data-available-date="2024-02-0{1 + i}"{stable}><td data-th="Sqft">1,0'), (10 + n).cast("string"), F.lit('</td><option value="24">24 Months (3,310.00 USD)</option><option value="'), F.lit("12" if i else "18"), F.lit('">'), F.lit("12" if i else "18"), F.lit(" Months ("), (3000 + n).cast("string"), F.lit(".50 USD)</option></tr>"))
    return F.concat(F.lit('<div>no unit</div><h4 class="pc-card-title">Studio 1 Bath</h4>'), row(0, ""), F.lit('<h4 class="pc-card-title">2 Bed 2 Bath</h4>'), row(1, ' data-all-dhcr-units="True"'))


@query("""SELECT p_partkey, CAST(p_partkey * 10 + i AS VARCHAR) AS id, CAST(p_size + i AS VARCHAR) || 'C' AS unit, CAST(2 * i AS INTEGER) AS beds, 1.0::DOUBLE + i AS baths, CAST(1000 + 10 + p_size AS BIGINT) AS area, '2024-02-0' || (1 + i) AS available, CAST(3000 + p_size AS BIGINT) AS price, i = 1 AS stabilized, CASE i WHEN 1 THEN '24,12' ELSE '24,18' END AS months FROM part, (SELECT unnest([0, 1]) AS i)""")
def section_pages(t: Tables) -> DataFrame:
    """Units under headings with lease terms; a page is written for each part and read again."""
    units = t.part.select("p_partkey", F.explode(pages.section_units(_lease_html())).alias("u")).select("p_partkey", "u.*")
    return units.withColumn("months", F.array_join(F.transform("terms", lambda x: x["months"].cast("string")), ",")).drop("terms")


@query("""SELECT p_partkey, CASE i WHEN 0 THEN CAST(p_size AS VARCHAR) || 'A' ELSE 'PH' || p_size END AS unit, CAST(CASE i WHEN 0 THEN 3 ELSE 0 END AS INTEGER) AS beds, CASE i WHEN 0 THEN 1.5 ELSE 1.0 END::DOUBLE AS baths, CAST(500 + p_size AS BIGINT) AS area, CAST(2000 + p_size AS BIGINT) AS price FROM part, (SELECT unnest([0, 1]) AS i)""")
def table_pages(t: Tables) -> DataFrame:
    """Floor plans as captioned tables."""
    n = F.col("p_size").cast("string")
    row = lambda unit: F.concat(F.lit("<tr><th data-label='Apartment' x>#"), unit, F.lit("</th><td data-label=Sq.Ft.>"), (500 + F.col("p_size")).cast("string"), F.lit("</td><td data-label='Rent'>$2,0"), F.lpad(n, 2, "0"), F.lit("</td></tr>"))
    html = F.concat(F.lit("<table><caption class=c>Apartment Details for Floor Plan: A - 3 Bedroom(s), 1.5 Bathroom(s)</caption>"), row(F.concat(n, F.lit("A"))), F.lit("</table><table><caption>Apartment Details<br>Floor Plan: B - Studio</caption>"), row(F.concat(F.lit("PH"), n)), F.lit("</table>"))
    return t.part.select("p_partkey", F.explode(pages.table_units(html)).alias("u")).select("p_partkey", "u.*")


@query("""SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN 5000 + p_size WHEN 1 THEN 1250 WHEN 2 THEN NULL ELSE NULL END AS BIGINT) AS price, CAST(CASE p_size % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 3 END AS INTEGER) AS beds, CASE p_size % 4 WHEN 0 THEN 1.5 WHEN 1 THEN 1.0 END::DOUBLE AS baths FROM part WHERE p_size % 4 < 3""")
def detail_pages(t: Tables) -> DataFrame:
    """One listing a page: the linked price, a price tag, only a convertible's rooms, or nothing."""
    tag = lambda *x: F.concat(*[F.lit(f'<p class="pprice" b>{v}</p>') for v in x])
    link = F.concat(F.lit('<iframe src="/schedule-appointment-listing-today/?lid='), F.col("p_partkey").cast("string"), F.lit("&amp;price="), (5000 + F.col("p_size")).cast("string"), F.lit('"></iframe>'))
    k = F.col("p_size") % 4
    html = F.when(k == 0, F.concat(link, tag("2 BR", "1.5 Bath", "9,999", "212.535.0500"))).when(k == 1, tag("212.535.0500", "1,250", "Studio", "1 Bath")).when(k == 2, F.lit("<b>CONV3</b>")).otherwise(F.lit("<b>gone</b>"))
    return t.part.select("p_partkey", pages.detail_unit(html, F.col("p_partkey")).alias("u")).filter("u is not null").select("p_partkey", "u.*")


@query("""SELECT p_partkey, 'Gym,Floor ' || p_size AS amenities, 'Owner "' || p_brand || '"' AS owner, CAST(p_size AS VARCHAR) || ' Main St' AS street, CAST(p_size AS INTEGER) AS for_sale, CAST(CASE WHEN p_size % 2 = 0 THEN 1 END AS INTEGER) AS for_rent, '{"amenities": ["Gym","Floor ' || p_size || '"]' AS opening FROM part""")
def embedded_records(t: Tables) -> DataFrame:
    """Script chunks, escaped and cut in two, joined and read as a building's record."""
    q, n = '\\"', F.col("p_size").cast("string")
    first = F.concat(F.lit(f"{{{q}amenities{q}: [{q}Gym{q},{q}Floor "), n, F.lit(f"{q}]"))
    rent = F.when(F.col("p_size") % 2 == 0, F.lit(f",{q}forRent{q}:1")).otherwise("")
    second = F.concat(F.lit(f",{q}owner{q}: {{{q}name{q}: {q}Owner '"), "p_brand", F.lit(f"'{q}}},{q}address{q}: {{{q}street{q}: {q}"), n, F.lit(f" Main St{q}}},{q}inventory{q}: {{{q}forSale{q}: "), n, rent, F.lit("}}"))
    html = F.concat(F.lit('<script>self.__next_f.push([1,"'), first, F.lit('"])</script><script>self.__next_f.push([1,"'), second, F.lit('"])</script>'))
    rows = spread(t.part).select("p_partkey", pages.embedded_text(html).alias("x")).select("p_partkey", pages.text_record(F.col("x")).alias("b"), "x")
    opening = F.substring_index("x", ",\"owner", 1)
    return rows.select("p_partkey", F.array_join("b.amenities", ",").alias("amenities"), F.replace("b.owner", F.lit("'"), F.lit('"')).alias("owner"), F.col("b.address.street").alias("street"), F.col("b.inventory.forSale").alias("for_sale"), F.col("b.inventory.forRent").alias("for_rent"), opening.alias("opening"))


@query("""SELECT p_partkey, CAST(p_size AS VARCHAR) || ' Oak Avenue' AS address, 'Old Hill' AS neighborhood, CASE p_size % 2 WHEN 0 THEN 'Condo' ELSE 'Co-op' END AS building_type, CAST(1900 + p_size AS INTEGER) AS year_built, CAST(p_size AS INTEGER) AS stories, 40.5::DOUBLE AS lat FROM part""")
def page_facts(t: Tables) -> DataFrame:
    """Title and description of a building's page."""
    n = F.col("p_size").cast("string")
    html = F.concat(F.lit("<title>"), n, F.lit(' Oak Avenue in Old Hill : Sales</title><meta name="description" content="It is a '), F.when(F.col("p_size") % 2 == 0, "condo").otherwise("co-op"), F.lit(" building built in "), (1900 + F.col("p_size")).cast("string"), F.lit(". It has "), n, F.lit(' stories and 9 units."><meta name="ICBM" content="40.5; -73.9">'))
    return t.part.select("p_partkey", pages.page_facts(html).alias("f")).select("p_partkey", "f.address", "f.neighborhood", "f.building_type", "f.year_built", "f.stories", "f.lat")
