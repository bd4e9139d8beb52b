"""JSON embedded in pages, on pages that are written from the provided data in the layouts of real ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.operators import embedded, pages
from lotlens.plans.registry import Tables, query, spread
from lotlens.sources import io

_SIZE = "p_size"


def _text(template: str, **values: Column | str) -> Column:
    """A text with <name> replaced by the values."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit(f"<{name}>"), value.cast("string") if isinstance(value, Column) else F.col(value).cast("string"))
    return out


def _pushed(record: Column, cut: int = 400) -> Column:
    """The record, escaped, as two chunks that a page's scripts push."""
    escaped = F.replace(F.replace(record, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    push = lambda x: F.concat(F.lit('<script>self.__next_f.push([1,"'), x, F.lit('"])</script>'))
    at = F.locate(",", escaped, cut)  # never within an escape
    return F.concat(push(F.left(escaped, at)), push(F.substr(escaped, at + 1)))


BUILDING = (
    '{"building":{"buildingId":"<id>","neighborhood":"Old [Hill] <n>","amenities":{"list":["GYM","ROOF}<n>"]},"unitFeatures":[{"name":"Oven <n>","tags":["a",["b"]]},{"description":"View [n]"},{"other":1}],'
    '"details":{"owner":"<owner>","built":1930,"developer":"<developer>"},"address":{"street":"<n> Main St","city":"New {York}","state":"NY","zipCode":"10<zip>"},'
    '"policies":["none",{"type":"Pets","rules":[{"max":<n>}]}],'
    '"saleInventorySummary":{"rows":[{"bedroomTitle":"Studio","available":<n>},{"bedroomTitle":"1 Bed","available":2}],"total":[3]},"rentalInventorySummary":[],'
    '"shown":{"amenities":{"Services and Facilities":[{"name":"Doorman","icon":{"id":1}},"Lift <n>"],"count":2,"Outdoor":[{"name":"Roof [deck]"}]}},'
    '"description":"<about>","more":true}}'
)
PLAIN_BUILDING = '{"buildingId":"<id>","unitFeatures":[{"name":"never closes"},"description":"short","list":{"owner":"only"}}'


@query("""SELECT p_partkey, CASE WHEN k < 2 THEN 'GYM,ROOF}' || n END AS amenities, CASE WHEN k < 2 THEN 'Doorman,Lift ' || n || ',Roof [deck]' END AS amenities_shown, CASE WHEN k < 2 THEN 'Oven ' || n || ',View [n],' END AS unit_features,
 CASE WHEN k = 0 THEN p_brand END AS owner, CASE WHEN k = 1 THEN p_type END AS developer, CASE WHEN k < 2 THEN n || ' Main St' END AS street, CASE WHEN k < 2 THEN 'New {York}' END AS city, CASE WHEN k < 2 THEN '10' || lpad(n, 3, '0') END AS zipcode,
 CASE WHEN k < 2 THEN 'Old [Hill] ' || n END AS neighborhood, CAST(p_partkey AS VARCHAR) AS building_id, CASE WHEN k < 2 THEN '{"type":"Pets","rules":[{"max":' || n || '}]}' END AS pet_policy,
 CASE WHEN k < 2 THEN 'Studio ' || n || ',1 Bed 2' ELSE '' END AS sale_inventory, '' AS rental_inventory, CASE WHEN k < 2 THEN 'A "quiet" house, built ' || n || ' years ago. ' || p_name END AS description
 FROM (SELECT *, CAST(p_size AS VARCHAR) AS n, p_size % 3 AS k FROM part)""")
def building_records(t: Tables) -> DataFrame:
    """Building pages: amenities in two forms, features, owner, address, policies, inventory, description; a third are torn."""
    k, n = F.col(_SIZE) % 3, F.col(_SIZE)
    about = _text('<p>A "quiet" house, built <n> years ago.</p><name>', n=_SIZE, name="p_name")
    about = F.replace(about, F.lit('"'), F.lit('\\"'))
    whole = _text(BUILDING, id="p_partkey", n=_SIZE, zip=F.lpad(n.cast("string"), 3, "0"), owner=F.when(k == 0, F.col("p_brand")).otherwise(embedded.NO_OWNER), developer=F.when(k == 1, F.col("p_type")).otherwise(""), about=about)
    record = F.when(k < 2, whole).otherwise(_text(PLAIN_BUILDING, id="p_partkey"))
    page = spread(t.part).select("p_partkey", F.concat(F.lit("<html><title>x</title>"), _pushed(record, 60), F.lit("</html>")).alias("html"))
    b = page.select("p_partkey", pages.embedded_text(F.col("html")).alias("x")).select("p_partkey", embedded.listing_record(F.col("x")).alias("b")).select("p_partkey", "b.*")
    joined = lambda c: F.array_join(F.col(c), ",").alias(c)
    rows = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws(" ", F.get_json_object(r, "$.bedroomTitle"), F.get_json_object(r, "$.available"))), ",")
    return b.select(
        "p_partkey", joined("amenities"), joined("amenities_shown"), joined("unit_features"), "owner", "developer", "street", "city", "zipcode", "neighborhood", "building_id", "pet_policy",
        F.coalesce(rows("sale_inventory"), F.lit("")).alias("sale_inventory"), F.coalesce(rows("rental_inventory"), F.lit("")).alias("rental_inventory"), "description",
    )


@query("""SELECT p_partkey, CASE k WHEN 0 THEN 1000.5 + n WHEN 1 THEN 2000.0 + n END::DOUBLE AS price, CASE k WHEN 0 THEN 2.0 WHEN 1 THEN CASE WHEN n % 5 = 0 THEN 3 ELSE n % 5 END END::DOUBLE AS beds, CASE k WHEN 0 THEN 'Active ' || n END AS status, CASE k WHEN 0 THEN '["gym","[pool]"]' END AS amenities,
 CASE k WHEN 0 THEN '1 Main, #' || n WHEN 1 THEN '2 Oak' END AS address, CASE k WHEN 1 THEN p_brand END AS agent, CASE k WHEN 1 THEN 40.5 END::DOUBLE AS latitude FROM (SELECT p_partkey, p_brand, CAST(p_size AS BIGINT) AS n, p_size % 3 AS k FROM part)""")
def data_layers(t: Tables) -> DataFrame:
    """Listing fields of the first data layer with a known name, one level down too; a third have no such layer."""
    one = _text('<script>dataLayer = [{"page":{"listing":1}}, {"price":7}]; dataLayer.push({"listing":{"price":"$1,000.50 + <n>","beds":2,"status":"Active <n>","amenities":["gym","[pool]"],"history":[{"x":[1]}]},"address":"1 Main, #<n>","items":[{"a":1},{"b":[2]}]});</script>', n=_SIZE)
    one = F.replace(one, _text("$1,000.50 + <n>", n=_SIZE), F.concat(F.lit("$1,0"), F.lpad(F.col(_SIZE).cast("string"), 2, "0"), F.lit(".50")))
    two = _text('<script>dataLayer=[{"beds":<m>,"numBedrooms":3,"listingPrice":<p>,"price":0,"nested":{"lat":40.5,"agentName":"<brand>"},"streetAddress":"2 Oak"}]</script>', m=F.col(_SIZE) % 5, p=2000 + F.col(_SIZE), brand="p_brand")
    none = F.lit('<script>dataLayer.push({"event":"load","deep":{"price":1}}); dataLayer.push({"price":</script>')
    html = F.when(F.col(_SIZE) % 3 == 0, one).when(F.col(_SIZE) % 3 == 1, two).otherwise(none)
    rows = spread(t.part).select("p_partkey", html.alias("html")).select("p_partkey", embedded.layer_record(F.col("html")).alias("r"))
    return rows.select("p_partkey", "r.price", "r.beds", "r.status", "r.amenities", "r.address", "r.agent", "r.latitude")


@query("""SELECT p_partkey, CAST(i AS INTEGER) AS pos, CASE k WHEN 0 THEN CASE i WHEN 0 THEN '2024-01-05' ELSE 'early ' || n END WHEN 1 THEN '2023-0' || (1 + i) || '-01' WHEN 2 THEN CASE WHEN i = 0 THEN '2022-02-03' END ELSE '2021-01-01' END AS event_date,
 CASE k WHEN 0 THEN CASE i WHEN 0 THEN 'Listed "again"' ELSE 'SOLD' END WHEN 1 THEN 'Closed' WHEN 2 THEN CASE WHEN i = 0 THEN 'Rented' END ELSE 'gone' END AS event_type,
 CASE k WHEN 0 THEN CASE i WHEN 0 THEN 1000 + n ELSE 900 END WHEN 1 THEN 500 + i WHEN 2 THEN CASE i WHEN 0 THEN 3000 ELSE 5 END ELSE n END::DOUBLE AS price, CASE WHEN k = 0 AND i = 0 THEN -5.5 END::DOUBLE AS price_change, CASE WHEN k = 1 THEN 'Ann' END AS broker
 FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS n, p_size % 5 AS k FROM part) JOIN (SELECT unnest([0, 1]) AS i) ON k < 3 OR (k = 3 AND i = 0)""")
def listing_histories(t: Tables) -> DataFrame:
    """Price histories in each of the three places a page may have them, with nested lists, quotes and brackets in texts."""
    k = F.col(_SIZE) % 5
    lists = _text('<script>{"a":[1],"priceHistory": [{"date":"Jan 5, 2024","event":"Listed \\"again\\"","price":"$1,0<two>","priceChange":-5.5,"tags":["a",["b]"]]}],"x":{"past_listings":[{"date":0,"eventDate":"early <n>","price":null,"amount":900,"status":"SOLD"},"note"]}}</script>', n=_SIZE, two=F.lpad(F.col(_SIZE).cast("string"), 2, "0"))
    props = F.lit('<script>["PastListingsExperience", {"id":[1,{"z":2}],"items":[{"closingDate":"2023-01-01","type":"Closed","salePrice":500,"agent":"Ann"},{"closingDate":"2023-02-01","type":"Closed","salePrice":501,"agent":"Ann"}]}]</script>')
    blob = F.lit('<script>var a = [{"id":1,"kids":[{"k":[2]}]}], b = [{"date":"2/3/2022","price":3000,"event_type":"Rented","more":{"c":["}"]}}, {"price":5}], c = [{"price":9}];</script>')
    bare = _text('<script>"PastListingsExperience":{"date":"2021-01-01","status":"gone","price":<n>,"list":[[]]}</script>', n=_SIZE)
    html = F.when(k == 0, lists).when(k == 1, props).when(k == 2, blob).when(k == 3, bare).otherwise(F.lit('<script>"pastListings":[{"date":"2020-01-01"</script>'))
    rows = spread(t.part).select("p_partkey", html.alias("html")).select("p_partkey", F.posexplode(embedded.past_listings(F.col("html"))).alias("pos", "h"))
    return rows.select("p_partkey", "pos", "h.event_date", "h.event_type", "h.price", "h.price_change", "h.broker")


@query("""SELECT o_orderkey, o_orderpriority AS kind, o_totalprice AS price, 'A' || o_custkey AS agent, CASE WHEN o_orderkey % 2 = 0 THEN 'B' || o_orderkey END AS second_agent, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey AS BIGINT) END AS rooms FROM orders WHERE o_orderkey % 7 > 0
 UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 7 = 0""")
def flatten_variant(t: Tables) -> DataFrame:
    """Feed records without a schema: nested lists, a text where a number should be, and records that are torn."""
    second = F.when(F.col("o_orderkey") % 2 == 0, _text(',{"name":"B<k>","offices":[{"id":[1]}]}', k="o_orderkey")).otherwise("")
    rooms = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey").cast("string")).otherwise(F.lit('"many"'))
    whole = _text('{"kind":"<kind>","price":{"list":<price>},"agents":[{"name":"A<c>"}<second>],"rooms":{"all":<rooms>}}', kind="o_orderpriority", price="o_totalprice", c="o_custkey", second=second, rooms=rooms)
    record = F.when(F.col("o_orderkey") % 7 > 0, whole).otherwise(F.left(whole, F.lit(30)))
    fields = {"kind": ("$.kind", "string"), "price": ("$.price.list", "double"), "agent": ("$.agents[0].name", "string"), "second_agent": ("$.agents[1].name", "string"), "rooms": ("$.rooms.all", "bigint")}
    return io.flatten_variant(t.orders.select("o_orderkey", record.alias("j")), "j", fields, ["o_orderkey"])
