"""Scores of named areas and of single buildings. Stand-ins: an area is a word of part names, its zips are brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.operators import areas, joins
from lotlens.plans.registry import Tables, query
from lotlens.plans.scoring import _BOARD, area_board, score_buildings

ASKED = ("Anvil", "g", "east widget row", "Brand#11, Brand#12", "12345", "zzz", " BOLT ", "", "ol", "small nut and bolt")


def _names(t: Tables) -> DataFrame:
    """Both words of a part's name, and the two together, each with the brands of its parts of few sizes."""
    parts = t.part.filter("p_size % 10 = 3").select(F.col("p_brand").alias("zip"), F.split("p_name", " ").alias("w"), "p_name")
    return parts.select(F.explode(F.array(F.get("w", F.lit(0)), F.get("w", F.lit(1)), F.col("p_name"))).alias("name"), "zip").distinct()


_NAMES = "WITH n AS (SELECT DISTINCT unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_name]) AS name, p_brand AS zip FROM part WHERE p_size % 10 = 3), "
_RESOLVED = """q AS (SELECT asked, lower(trim(asked)) AS l FROM (SELECT unnest([""" + ", ".join(f"'{a}'" for a in ASKED) + """]) AS asked) WHERE trim(asked) <> ''),
 f AS (SELECT asked, l AS zip, 0 AS tier FROM q WHERE regexp_matches(l, '^\\d{5}$') UNION ALL SELECT asked, trim(x), 1 FROM (SELECT asked, unnest(string_split(l, ',')) AS x FROM q WHERE contains(l, ',')) UNION ALL SELECT asked, zip, 2 FROM q JOIN n ON name = l
  UNION ALL SELECT asked, zip, 3 FROM q JOIN n ON contains(name, l)
  UNION ALL SELECT asked, n.zip, 4 FROM (SELECT asked, name, row_number() OVER (PARTITION BY asked ORDER BY length(name) DESC, name) AS k FROM q JOIN (SELECT DISTINCT name FROM n) ON contains(l, name)) w JOIN n ON n.name = w.name WHERE k = 1),
 z AS (SELECT DISTINCT asked, zip, ['zip', 'list', 'name', 'part', 'within'][tier + 1] AS how FROM f WHERE tier = (SELECT min(tier) FROM f g WHERE g.asked = f.asked)) """


@query(_NAMES + _RESOLVED + "SELECT asked, zip, how FROM z")
def area_zips(t: Tables) -> DataFrame:
    """What users type, as zips: names, parts of names, texts around a name, lists, single zips."""
    asked = t.spark.createDataFrame([(a,) for a in ASKED], "asked string")
    return areas.resolve_areas(asked, "asked", _names(t))


@query(_BOARD + ", " + _NAMES.removeprefix("WITH ").rstrip().removesuffix(",") + " SELECT key, quality, availability FROM x JOIN part ON p_partkey = key WHERE p_brand IN (SELECT zip FROM n WHERE name = 'anvil' OR contains(name, 'olt'))")
def score_named_area(t: Tables) -> DataFrame:
    """Buildings of the areas that two texts name, a whole name and a part of several."""
    asked = t.spark.createDataFrame([("Anvil",), ("olt",)], "asked string")
    zips = areas.resolve_areas(asked, "asked", _names(t)).select(F.col("zip").alias("p_brand")).distinct()
    return score_buildings(area_board(t, joins.semi(t.part, zips, "p_brand"))).select("key", "quality", "availability")


@query(_BOARD + ", a AS (SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS k FROM part WHERE contains(p_name, 'large w')) WHERE k <= 20 UNION SELECT max(p_partkey) FROM part) SELECT key, quality, availability, signal_count FROM x WHERE key IN (SELECT p_partkey FROM a)")
def score_one(t: Tables) -> DataFrame:
    """Scores of what a fragment finds, and of the building with the largest key."""
    key = t.part.agg(F.max("p_partkey")).first()[0]
    one = lambda asked, digits: areas.look_up(t.part, asked, "p_partkey", "p_name", "p_size", digits)
    found = one("Large W", 10).union(one(str(key), len(str(key)))).distinct()
    return score_buildings(area_board(t, found)).select("key", "quality", "availability", "signal_count")
