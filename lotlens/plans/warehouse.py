"""Curated tables: each raw source projected, cleaned and resolved to a building's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions import address, clean, keys
from lotlens.operators import joins, windows
from lotlens.operators.aggregates import first_k_text

# Contact roles and the document types of the sales table.
ROLES = {"HeadOfficer": "head officer", "IndividualOwner": "owner", "CorporateOwner": "corporate owner", "Agent": "agent", "SiteManager": "site manager", "Officer": "officer", "Shareholder": "shareholder", "JointOwner": "joint owner"}
DOC_TYPES = ("DEED", "MTGE", "SAT", "AGMT", "LPNS", "AL&R", "AALR", "LPEN", "RPTT&RET", "DEED, TS", "DEED, LE", "ASST", "PREL")
DOC_TYPES_SHORT = ("DEED", "MTGE", "SAT", "AGMT", "LPNS", "AL&R")

c = F.col
day = clean.normalize_date
count = lambda x: clean.parse_int(c(x)).cast("int")


def buildings(pluto: DataFrame) -> DataFrame:
    """Residential lots with areas per unit; the largest row of a key wins, at ties the first by address and then by all else."""
    units = clean.parse_int(c("unitsres"))
    out = pluto.filter(units > 0).select(
        keys.key_from_number(c("bbl")).alias("bbl"), "borough", F.upper(F.trim("address")).alias("address"), "zipcode", c("bldgclass").alias("building_class"),
        count("yearbuilt").alias("year_built"), clean.parse_float(c("numfloors")).alias("num_floors"), count("unitsres").alias("units_residential"), count("unitstotal").alias("units_total"),
        c("ownername").alias("owner_name"), clean.parse_float(c("assesstot")).alias("assessed_total"), count("resarea").alias("residential_area"),
        clean.per_unit(clean.parse_float(c("resarea")), units).cast("int").alias("avg_unit_sqft"), clean.per_unit(clean.parse_float(c("assesstot")), units).cast("int").alias("assessed_per_unit"),
        clean.parse_float(c("latitude"), None).alias("latitude"), clean.parse_float(c("longitude"), None).alias("longitude"),
    )
    first = ["units_residential", "address"]
    ties = [c(name) for name in out.columns if name not in ("bbl", *first)]
    return windows.best_per_group(out.filter(keys.is_usable(c("bbl"))), ["bbl"], [F.desc("units_residential"), c("address"), *ties])


def bin_map(bridge: DataFrame) -> DataFrame:
    """Building number to parcel key, only usable ones; the smaller key at ties."""
    out = bridge.select(c("bin").cast("string").try_cast("bigint").alias("bin"), keys.key_from_number(c("bbl")).alias("bbl"))
    return out.filter(c("bin").isNotNull() & keys.is_usable(c("bbl"))).groupBy("bin").agg(F.min("bbl").alias("bbl"))


def by_bin(df: DataFrame, lookup: DataFrame) -> DataFrame:
    return joins.bridge(df.withColumn("bin", c("bin").cast("string").try_cast("bigint")), lookup, "bin", "bbl")


def _keyed(df: DataFrame, key: Column) -> DataFrame:
    """With the key as `bbl`, made once a row: a filter on the key itself would go below the columns and make it once more."""
    return df.withColumn("bbl", F.explode(F.array(key)))


def by_bbl(df: DataFrame, known: DataFrame, column: str = "bbl") -> DataFrame:
    return joins.semi(_keyed(df, keys.key_from_number(c(column))), known.select("bbl"), "bbl")


def by_parts(df: DataFrame, borough: str = "borough", block: str = "block", lot: str = "lot", usable: bool = True) -> DataFrame:
    key = keys.make_key(c(borough), c(block), c(lot))
    return _keyed(df, key).filter(c("bbl").isNotNull()) if usable else df.withColumn("bbl", key)


def sales(master: DataFrame, legals: DataFrame, parties: DataFrame, known: DataFrame, types: tuple[str, ...] = DOC_TYPES) -> DataFrame:
    """Documents with parcel, unit, dates, amount and up to three names a side.

    Of several parcels of a document a direct match goes before a condo's, then the smaller key; legals and parties
    are reduced to the wanted documents before they are aggregated. Of several records of a document the last one holds.
    """
    used = ["document_id", "doc_type", "document_date", "recorded_datetime", "document_amt"]
    wanted = windows.best_per_group(master.filter(c("doc_type").isin(*types)).select(*used), ["document_id"], [F.desc_nulls_last("recorded_datetime"), *[c(x) for x in used[1:]]])
    ids = wanted.select("document_id")
    lots = joins.resolve_condo(by_parts(joins.semi(legals, ids, "document_id")), known, "bbl", "units_residential").filter("resolved is not null")
    unit = F.when(clean.is_unit(c("unit")), F.upper(F.trim("unit")))
    parcel = windows.best_per_group(lots.select("document_id", c("resolved").alias("bbl"), unit.alias("unit"), (c("method") != "direct").alias("_far")), ["document_id"], [c("_far"), c("bbl"), c("unit")]).drop("_far")
    named = joins.semi(parties, ids, "document_id")
    side = lambda kind, name: first_k_text(named.filter(c("party_type") == kind), ["document_id"], "name", [], name=name)
    out = joins.star(wanted.join(parcel, "document_id"), "document_id", side("1", "seller"), side("2", "buyer"))
    return out.select("document_id", "bbl", "unit", "doc_type", day(c("document_date")).alias("document_date"), day(c("recorded_datetime")).alias("recorded_date"), clean.money(c("document_amt"), 0.0).alias("amount"), "seller", "buyer")


def hpd_complaints(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    return by_bin(raw, lookup).select("bbl", c("apartment").alias("unit"), c("major_category").alias("category"), c("minor_category").alias("subcategory"), "status", day(c("received_date")).alias("received_date"), "type")


def service_requests(raw: DataFrame, known: DataFrame) -> DataFrame:
    return by_bbl(raw, known).select("bbl", "complaint_type", "descriptor", day(c("created_date")).alias("created_date"), day(c("closed_date")).alias("closed_date"), "status")


def permits(raw: DataFrame) -> DataFrame:
    return by_parts(raw).select("bbl", "job_type", c("job_description").alias("description"), c("job_status_description").alias("status"), day(c("latest_action_date")).alias("action_date"), clean.money(c("initial_cost"), 0.0).alias("estimated_cost"), count("existing_dwelling_units").alias("existing_units"), count("proposed_dwelling_units").alias("proposed_units"))


def merged_permits(new_feed: DataFrame, undated: DataFrame, legacy: DataFrame) -> DataFrame:
    """New feed, then rows without a date, then the legacy feed: the first row of a job wins."""
    return windows.first_by_source([new_feed, undated, legacy], ["job_id"], ["bbl"])


def dob_complaints(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    return by_bin(raw.drop("bbl"), lookup).select("bbl", "complaint_number", c("complaint_category").alias("category"), "unit", c("disposition_code").alias("code"), day(c("disposition_date")).alias("disposition_date"))


def violations(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    return by_bin(raw, lookup).select("bbl", "severity", "violation_type", day(c("issue_date")).alias("issue_date"), c("ecb_violation_status").alias("status"), clean.money(c("penality_imposed"), 0.0).alias("penalty"), clean.money(c("balance_due"), None).alias("balance_due"))


def litigation(raw: DataFrame, known: DataFrame) -> DataFrame:
    return by_bbl(raw, known).select("bbl", c("litigationid").alias("case_id"), c("casetype").alias("case_type"), day(c("caseopendate")).alias("open_date"), c("casestatus").alias("status"))


def contacts(registrations: DataFrame, people: DataFrame, lookup: DataFrame) -> DataFrame:
    joined = by_bin(registrations, lookup).join(people, "registrationid")
    name = F.coalesce(F.nullif(F.trim("corporationname"), F.lit("")), F.trim(F.concat_ws(" ", "firstname", "lastname")))
    return joined.select("bbl", clean.map_values(c("contacttype"), ROLES, "lower").alias("role"), name.alias("name"), day(c("lastregistrationdate")).alias("registered"))


def rent_stabilization(raw: DataFrame, known: DataFrame, lookup: DataFrame) -> DataFrame:
    """By parcel, else by building; the most units and any flag of each building."""
    keyed = raw.select(keys.key_from_number(c("bbl")).alias("_b"), c("bin").try_cast("bigint").alias("bin"), "num_stabilized_units", "has_421a", "has_j51")
    tiers = [("bbl", ["_b"], known.select(c("bbl").alias("_b"), "bbl")), ("bin", ["bin"], lookup)]
    out = joins.resolve_tiers(keyed, tiers, "bbl").filter("bbl is not null")
    return out.groupBy("bbl").agg(F.max("num_stabilized_units").alias("stab_units"), F.bool_or("has_421a").alias("has_421a"), F.bool_or("has_j51").alias("has_j51"))


def evictions(raw: DataFrame, known: DataFrame) -> DataFrame:
    """By address and zip, else by address."""
    ref = known.select(address.normalize_address(c("address")).alias("_a"), c("zipcode").cast("string").alias("_z"), "bbl")
    rows = raw.select("*", address.normalize_address(c("eviction_address")).alias("_a"), c("eviction_zip").alias("_z"))
    out = joins.resolve_tiers(rows, [("address and zip", ["_a", "_z"], ref), ("address", ["_a"], ref)], "bbl").filter("bbl is not null")
    return out.select("bbl", c("eviction_apartment").alias("unit"), day(c("executed_date")).alias("executed_date"), "method")


def certificates(raw: DataFrame, known: DataFrame, lookup: DataFrame) -> DataFrame:
    """By building, else by parcel, else by the condo block."""
    keyed = by_parts(raw, usable=False).withColumn("bin", c("bin").try_cast("bigint")).withColumnRenamed("bbl", "_b").withColumn("_block", F.when(keys.lot_of(c("_b")) >= 1000, keys.block_of(c("_b"))))
    blocks = joins.condo_lookup(known, "bbl", "units_residential").select(c("block").alias("_block"), c("main").alias("bbl"))
    tiers = [("bin", ["bin"], lookup), ("bbl", ["_b"], known.select(c("bbl").alias("_b"), "bbl")), ("block", ["_block"], blocks)]
    out = joins.resolve_tiers(keyed, tiers, "bbl").filter("bbl is not null")
    return out.select("bbl", "job_number", day(c("co_issue_date")).alias("issue_date"), "co_type", count("existing_dwelling_units").alias("existing_units"), count("proposed_dwelling_units").alias("proposed_units"), "method")


def hpd_violations(raw: DataFrame) -> DataFrame:
    return by_parts(raw, "boroid").select("bbl", "apartment", "class", day(c("inspectiondate")).alias("inspection_date"), day(c("approveddate")).alias("approved_date"), c("novdescription").alias("description"), "currentstatus", (c("rentimpairing") == "Y").alias("rent_impairing"))


def rolling_sales(raw: DataFrame) -> DataFrame:
    return by_parts(raw, usable=False).select("bbl", "address", "zip_code", count("residential_units").alias("residential_units"), count("year_built").alias("year_built"), clean.money(c("sale_price"), 0.0).alias("sale_price"), day(c("sale_date")).alias("sale_date"))


def tax_liens(raw: DataFrame) -> DataFrame:
    place = F.array_join(F.filter(F.array("house_number", "street_name"), lambda x: clean.not_blank(x)), " ")
    return by_parts(raw, usable=False).select("bbl", place.alias("address"), "month", "cycle", "tax_class_code", "building_class")


def dob_now_jobs(raw: DataFrame) -> DataFrame:
    key = F.coalesce(keys.key_from_number(c("bbl")), keys.make_key(c("borough"), c("block"), c("lot")))
    return _keyed(raw, key).filter(keys.is_usable(c("bbl"))).select("bbl", c("job_filing_number").alias("job_id"), "job_type", day(c("filing_date")).alias("filing_date"), clean.money(c("initial_cost"), 0.0).alias("estimated_cost"))


def vacate_orders(raw: DataFrame) -> DataFrame:
    return _keyed(raw, keys.key_from_number(c("bbl"))).filter(keys.is_usable(c("bbl"))).select("bbl", "vacate_type", "primary_vacate_reason", day(c("vacate_effective_date")).alias("effective_date"), count("number_of_vacated_units").alias("units"))


def subway_stations(raw: DataFrame) -> DataFrame:
    return raw.select("station_id", "name", "lines", clean.parse_float(c("latitude"), None).alias("latitude"), clean.parse_float(c("longitude"), None).alias("longitude"))


def slug_buildings(slugs: DataFrame, known: DataFrame) -> DataFrame:
    """Building slugs matched to parcels by address and borough."""
    clean_slug = F.trim(F.split_part("value", F.lit("?"), F.lit(1)), F.lit("/"))
    rows = slugs.select(clean_slug.alias("slug")).withColumn("_a", address.slug_address(c("slug"))).withColumn("_b", address.slug_borough(c("slug"))).filter("_b is not null")
    ref = known.select(address.normalize_address(c("address")).alias("_a"), c("borough").alias("_b"), "bbl")
    return joins.resolve_tiers(rows, [("address", ["_a", "_b"], ref)], "bbl").select("slug", "bbl", "method")
