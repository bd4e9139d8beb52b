"""The warehouse as written tables: what is there for the same inputs is not made again.

A table's folder is named by a fingerprint: of its source files (name, length, time of change) and of the tables it is
made from. A folder with a success marker is finished; a second run lists files and reads none, a run that was broken
off goes on where it stopped, and a changed source leads to new folders for what depends on it alone. The tables that
need nothing unfinished are made one after the other; Spark spreads the work of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.operators.observed import write_observed
from lotlens.plans import curated, curated_more
from lotlens.plans.files import scratch
from lotlens.plans.registry import ORACLES, Tables, query


@dataclass(frozen=True)
class Table:
    """What a table is made from (sources or other tables, by name), how, and a mark to change with its code."""

    needs: tuple[str, ...]
    make: Callable[[Mapping[str, DataFrame]], DataFrame]
    mark: str = "1"


@dataclass(frozen=True)
class Built:
    folder: str
    made: bool
    rows: int | None


def source_fingerprint(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of a source's files, listed but not read."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def build_tables(spark: SparkSession, path: str, sources: Mapping[str, str], tables: Mapping[str, Table]) -> dict[str, Built]:
    """Makes what is not there yet, inputs first; `sources` are Parquet folders or files by name."""
    prints = {name: source_fingerprint(spark, p) for name, p in sources.items()}
    folders = dict(sources)
    built: dict[str, Built] = {}

    def finish(name: str, above: tuple[str, ...] = ()) -> None:
        if name in prints:
            return
        if name in above:
            raise ValueError(f"tables need each other: {' -> '.join((*above, name))}")
        table = tables[name]
        for need in table.needs:
            finish(need, (*above, name))
        prints[name] = hashlib.sha256("|".join([name, table.mark, *[prints[n] for n in table.needs]]).encode()).hexdigest()
        folder = f"{path}/{name}/{prints[name][:32]}"
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        made = not marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)
        rows = None
        if made:
            out = table.make({n: spark.read.parquet(folders[n]) for n in table.needs})
            rows = write_observed(out, lambda df: df.write.mode("overwrite").parquet(folder), rows=F.count("*"))["rows"]
        folders[name], built[name] = folder, Built(folder, made, rows)

    for name in tables:
        finish(name)
    return built


class _Given(Tables):
    """The tables of a query by name, from frames that are at hand."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame]):
        self.spark, self.frames = spark, frames

    def __getattr__(self, name: str) -> DataFrame:
        return self.frames[name]


def _curated() -> dict[str, Table]:
    """Every curated table, and a report over three of them, with what each reads."""
    reads = {
        "curated_buildings": ("part",), "curated_bin_map": ("part",), "curated_vacate_orders": ("part",), "curated_rent_stabilization": ("part",), "curated_certificates": ("part",),
        "curated_sales": ("part", "orders", "lineitem"), "curated_permits": ("orders",), "curated_rolling_sales": ("orders",), "curated_dob_now_jobs": ("orders",), "curated_merged_permits": ("orders",),
        "curated_violations": ("part", "lineitem"), "curated_litigation": ("part", "lineitem"), "curated_hpd_violations": ("lineitem",),
        "curated_hpd_complaints": ("part", "events"), "curated_service_requests": ("part", "events"), "curated_dob_complaints": ("part", "events"),
        "curated_evictions": ("part", "customer"), "curated_liens": ("customer",), "curated_contacts": ("part", "customer", "supplier"), "curated_slug_buildings": ("part", "customer"), "curated_subway_stations": ("supplier",),
    }
    made = lambda name: lambda frames: getattr(curated if hasattr(curated, name) else curated_more, name)(_Given(next(iter(frames.values())).sparkSession, frames))
    out = {name: Table(needs, made(name)) for name, needs in reads.items()}

    def report(frames: Mapping[str, DataFrame]) -> DataFrame:
        parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in frames.items()]
        return parts[0].union(parts[1]).union(parts[2])

    return out | {"report": Table(("curated_buildings", "curated_liens", "curated_sales"), report)}


_AGAIN = ("curated_evictions", "curated_liens", "curated_contacts", "curated_slug_buildings", "report")


@query(" UNION ALL ".join(f"SELECT '{name}' AS name, {'CAST(3 AS BIGINT)' if name == 'report' else f'(SELECT count(*) FROM ({ORACLES[name]}))'} AS rows, true AS made_first, false AS made_again, {str(name in _AGAIN).lower()} AS made_after_a_change" for name in _curated()))
def warehouse_build(t: Tables) -> DataFrame:
    """All curated tables written; then again, when nothing is made; then with other customers, when their tables are."""
    path = scratch(t.spark)
    sources = {n: f"{t.sf_dir}/{n}.parquet" for n in ("part", "orders", "lineitem", "events", "supplier")} | {"customer": f"{path}/customer"}
    t.customer.write.parquet(sources["customer"])
    runs = [build_tables(t.spark, f"{path}/out", sources, _curated()) for _ in range(2)]
    t.customer.limit(1).write.mode("append").parquet(sources["customer"])
    runs.append(build_tables(t.spark, f"{path}/out", sources, _curated()))
    rows = [(name, b.rows, b.made, runs[1][name].made, runs[2][name].made) for name, b in runs[0].items()]
    return t.spark.createDataFrame(rows, "name string, rows bigint, made_first boolean, made_again boolean, made_after_a_change boolean")
