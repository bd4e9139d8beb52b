"""Area names and zips: what a user types becomes a set of zips, or one building."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.operators.joins import phrase_join
from lotlens.operators.ranking import top
from lotlens.operators.windows import ranked

# Names of areas and the zips that each covers; a zip may be in several areas.
AREA_ZIPS = {
    "gramercy": "10003 10010",
    "east village": "10003 10009",
    "west village": "10014 10011",
    "chelsea": "10001 10011",
    "flatiron": "10010 10003",
    "union square": "10003",
    "lower east side": "10002",
    "les": "10002",
    "soho": "10012 10013",
    "noho": "10012 10003",
    "nolita": "10012",
    "tribeca": "10013 10007",
    "greenwich village": "10003 10011 10014 10012",
    "the village": "10003 10011 10014 10012",
    "midtown": "10016 10017 10018 10019 10020 10022 10036",
    "murray hill": "10016",
    "kips bay": "10016 10010",
    "stuyvesant": "10009 10003",
    "stuy town": "10009 10010",
    "alphabet city": "10009",
    "upper east side": "10021 10028 10065 10075 10128",
    "ues": "10021 10028 10065 10075 10128",
    "upper west side": "10023 10024 10025",
    "uws": "10023 10024 10025",
    "harlem": "10026 10027 10029 10030 10035 10037 10039",
    "williamsburg": "11206 11211 11249",
    "bushwick": "11206 11221 11237",
    "bed stuy": "11205 11206 11216 11221 11233",
    "park slope": "11215 11217",
    "prospect heights": "11217 11238",
    "crown heights": "11213 11216 11225 11233 11238",
    "cobble hill": "11201",
    "boerum hill": "11201 11217",
    "brooklyn heights": "11201",
    "dumbo": "11201",
    "fort greene": "11205 11217",
    "clinton hill": "11205 11238",
    "greenpoint": "11222",
    "astoria": "11102 11103 11105 11106",
    "long island city": "11101 11109",
    "lic": "11101 11109",
    "jackson heights": "11372 11373",
    "sunnyside": "11104",
    "woodside": "11377",
}


def area_names(spark: SparkSession) -> DataFrame:
    """name, zip of the known areas."""
    return spark.createDataFrame([(name, z) for name, zips in AREA_ZIPS.items() for z in zips.split()], "name string, zip string")


def resolve_areas(asked: DataFrame, text: str, names: DataFrame) -> DataFrame:
    """text, zip, how: the zips that each asked text stands for, each once.

    how: "zip" for five digits, "list" for what stands between commas, "name" for an area's name, "part" for a part of
    the names of areas (all of them count), "within" for a text that holds an area's name (the longest, the first in
    the alphabet of equally long ones). The first of these that finds something holds. Case and outer blanks do not
    count; `names` (name, zip) has lower-case names. A text that finds nothing, an empty one and null have no rows.
    """
    rows = asked.select(text).distinct().withColumn("_q", F.lower(F.trim(text))).filter("_q <> ''")
    digits = rows.filter(F.col("_q").rlike(r"^\d{5}$")).select(text, F.col("_q").alias("zip"), F.lit(0).alias("_tier"))
    listed = rows.filter(F.contains("_q", F.lit(","))).select(text, F.explode(F.transform(F.split("_q", ","), lambda x: F.trim(x))).alias("zip"), F.lit(1).alias("_tier")).filter("zip <> ''")
    named = rows.join(names.withColumnRenamed("name", "_q"), "_q").select(text, "zip", F.lit(2).alias("_tier"))
    words = names.select(F.col("name").alias("_name")).distinct()
    of = lambda found, tier: found.join(names.withColumnRenamed("name", "_name"), "_name").select(text, "zip", F.lit(tier).alias("_tier"))
    part = of(phrase_join(words, "_name", rows, "_q"), 3)
    within = ranked(phrase_join(rows, "_q", words, "_name"), [text], [F.length("_name").desc(), F.col("_name")], "_k").filter("_k = 1")
    found = digits.union(listed).union(named).union(part).union(of(within, 4))
    first = found.groupBy(text).agg(F.min("_tier").alias("_tier"))
    how = F.element_at(F.array(*[F.lit(x) for x in ("zip", "list", "name", "part", "within")]), F.col("_tier") + 1)
    return found.join(first, [text, "_tier"]).select(text, "zip", how.alias("how")).distinct()


def look_up(buildings: DataFrame, asked: str, key: str, address: str, units: str, digits: int = 10, limit: int = 20) -> DataFrame:
    """The building with a key of so many digits, else the largest whose address holds the text, in any case."""
    asked = asked.strip()
    if asked.isdigit() and len(asked) == digits:
        return buildings.filter(F.col(key) == F.lit(int(asked)))
    held = buildings.filter((F.col(units) > 0) & F.contains(F.lower(address), F.lit(asked.lower())))
    return top(held, [F.desc(units), F.col(key)], limit)
