"""Readers and writers. Every reader takes a schema or a fixed layout: nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.operators.observed import write_observed


def scan_json_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batch files of a folder, flat or nested, each one array of records."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "batch_*.json").json(path)


def scan_table(spark: SparkSession, path: str, columns: Sequence[str], where: str | None = None) -> DataFrame:
    """Columns and filter reach the Parquet scan."""
    df = spark.read.parquet(path)
    return (df.filter(where) if where else df).select(*columns)


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def scan_lines(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One value per line, blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias(name)).filter(F.col(name) != "")


def scan_archive_index(spark: SparkSession, path: str, layout: str, whole: bool = False) -> DataFrame:
    """timestamp, original of a capture index: "arrays" with a header row, "objects" one a line, or "fields" by spaces.

    An array file is one JSON value, so it is read as a whole; the other layouts are split by line.
    """
    if layout == "arrays":
        captures = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("rows"))
        # each file has its own header; without the names, the first two columns are taken
        place = lambda name, default: F.coalesce(F.nullif(F.array_position(F.col("rows")[0], F.lit(name)), F.lit(0)), F.lit(default)).cast("int")
        rows = captures.select(place("timestamp", 1).alias("t"), place("original", 2).alias("o"), F.explode(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).alias("r"))
        return rows.filter(F.size("r") >= F.greatest("t", "o")).select(F.col("r")[F.col("t") - 1].alias("timestamp"), F.col("r")[F.col("o") - 1].alias("original"))
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if layout == "objects":
        return lines.select(F.from_json("value", "timestamp string, original string").alias("r")).select("r.*")
    if layout == "fields":
        parts = F.split(F.trim("value"), r"\s+")
        return lines.select(F.get(parts, F.lit(1)).alias("timestamp"), F.get(parts, F.lit(2)).alias("original"))
    raise ValueError(f"no such layout: {layout}")


def scan_dynamic(df: DataFrame, fields: Sequence[str], text_fields: Sequence[str]) -> DataFrame:
    """The fields as text, missing or null as '', and the filled text fields joined in `raw_text`."""
    out = df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in fields])
    return out.withColumn("raw_text", F.array_join(F.filter(F.array(*text_fields), lambda x: x != ""), " "))


def flatten_variant(df: DataFrame, json_col: str, fields: Mapping[str, tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """Nested record to flat row by (path, type), without a schema; what is absent or of another kind is null.

    The text is parsed once, for all fields; one that is no JSON gives nulls.
    """
    parsed = df.select(*keep, F.try_parse_json(json_col).alias("_v"))
    return parsed.select(*keep, *[F.try_variant_get("_v", path, kind).alias(name) for name, (path, kind) in fields.items()])


def flatten_listing(df: DataFrame, json_col: str, schema: str, mapping: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Nested record to flat row; a path is a.b or a[0].b, and what is absent is null."""
    parsed = df.select(*keep, F.from_json(json_col, schema).alias("_r"))
    return parsed.select(*keep, *[_path(F.col("_r"), path).alias(name) for name, path in mapping.items()])


def _path(c: Column, path: str) -> Column:
    for part in path.replace("[", ".[").split("."):
        c = F.get(c, F.lit(int(part[1:-1]))) if part.startswith("[") else c.getField(part)
    return c


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> int:
    """The number of rows written, observed by the plan that writes them."""
    return write_observed(df, lambda rows: rows.write.mode(mode).partitionBy(*partition_by).parquet(path), rows=F.count("*"))["rows"]


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
