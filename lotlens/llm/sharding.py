"""Sharding by proportional stratified interleaving.

Rows are put in a seeded random order within each source; a row's fractional rank (its place over the source's
count) orders all rows, and equal cuts of that order are the shards, so each shard holds every source in its share.

Both ranks are exact and no source is ever one task: a source is split into cells of about `cell_rows` rows by its
uniform hash, the fractional order into equal intervals, and running sums over the cell counts (a table of one row
per cell) give each cell's offset.

Nulls: a null source is a source of its own, apart from the empty one and any other; a null text has size 1 and the
checksum of an empty text; rows without an id are placed by their text. Repeated rows are placed one by one; where
more than `cell_rows` of them are alike, their places in the table tell them apart, so that no cell is hot. An empty
table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.spark_util import exact_rank, materialize, pick, unsigned_crc32

UNIT = float(1 << 52)


def _digits(text: F.Column, n: int) -> F.Column:
    """The first n hex digits of the text's md5 as a number: seeded, and the same in any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n), 16, 10).cast("long")


def _uniform(*cols: F.Column | str) -> F.Column:
    """In [0, 1), from a hash of the columns; nulls are left out."""
    return _digits(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]), 13) / F.lit(UNIT)


def interleave_shards(docs: DataFrame, shards: int = 16, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cell_rows: int = 500) -> DataFrame:
    """Columns doc_id, source, size, text_crc32, shard, slot; shard counts differ by one row at most."""
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = pick(docs, doc_id=docs[id_col], source=docs[source_col], size=(F.octet_length(text) + 1).cast("long"), text_crc32=unsigned_crc32(text), tie=_digits(text, 15), row=F.monotonically_increasing_id())
    rows = materialize(rows)
    alike = rows.groupBy(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).agg(F.count("*").alias("copies")).filter(F.col("copies") > cell_rows)
    salted = rows.join(alike, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")), "left").withColumn("salt", F.when(F.col("copies").isNotNull(), F.col("row")))
    rows = materialize(salted.drop("_id", "_tie", "copies").withColumn("u", _uniform(F.lit(seed), "doc_id", "tie", "salt")))

    per_source = rows.groupBy("source").agg(F.count("*").alias("n")).withColumn("cells", F.ceil(F.col("n") / cell_rows))
    placed = _join(rows, per_source).withColumn("cell", F.floor(F.col("u") * F.col("cells")))
    ranked = exact_rank(placed, ["source"], "cell", ["u", "tie", "doc_id", "size", "row"])
    fraction = (F.col("rank") + _uniform(F.lit(seed + 1), "source")) / F.col("n")
    total = rows.agg(F.count("*").alias("total"))
    spread = ranked.withColumn("fraction", fraction).select("doc_id", "source", "size", "text_crc32", "tie", "row", "fraction").crossJoin(F.broadcast(total))
    spread = materialize(spread.withColumn("span", F.floor(F.col("fraction") * F.ceil(F.col("total") / cell_rows))))
    placed = exact_rank(spread, [], "span", ["fraction", "source", "tie", "doc_id", "size", "row"])
    # whole numbers: a double would round the product of a large rank
    shard = F.expr(f"rank * {shards} div total")
    begins = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("rank") - begins)
    return placed.select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))


def _join(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Null sources join too; Spark broadcasts the counts only if they are under its size threshold."""
    key = F.struct(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("z"))
    return rows.withColumn("_k", key).join(per_source.withColumn("_k", key).drop("source"), "_k").drop("_k")
