"""Streams: alerts on watched keys, and listing snapshots folded into a versioned state table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lotlens.operators.upsert import track_snapshot


def alert_stream(events: DataFrame, watchlist: DataFrame, key: str, event_time: str, delay: str = "8 days") -> DataFrame:
    """Each event of a watched key once: a stream-static semi join, then duplicates dropped within the watermark.

    The delay is longer than the look-back of a week, so a replayed pull raises no second alert; state older than
    the delay is forgotten.
    """
    watched = events.join(watchlist.select(key).distinct(), key, "left_semi")
    return watched.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key, "event_type", "event_id"])


def windowed_counts(events: DataFrame, event_time: str, window: str, slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """Events by type in tumbling or sliding windows; late rows beyond the delay are dropped."""
    return events.withWatermark(event_time, delay).groupBy(F.window(event_time, window, slide), "event_type").agg(F.count("*").alias("n"))


def snapshot_stream(pulls: DataFrame, state_path: str, source: str, checkpoint: str) -> StreamingQuery:
    """Fold pulls of source_id, price, pulled_at into the state at <state_path>/source=<source>/v<batch>.

    A source has a folder of its own, so a batch rewrites only what its source shows or has shown. It reads the version
    before it and writes its own with overwrite, so a repeated batch gives the same files; older versions than that
    are deleted. Of two pulls of an id at one time the larger price holds.
    """
    mine = f"{state_path}/source={source}"

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = batch.agg(F.max("pulled_at").cast("string").alias("now")).first()["now"]
        if newest is None:
            return
        empty = spark.createDataFrame([], "source string, source_id string, price double, status string, first_seen timestamp, last_seen timestamp")
        before = _newest_before(spark, mine, batch_id)
        state = empty if before is None else spark.read.parquet(before)
        latest = batch.groupBy("source_id").agg(F.max_by("price", F.struct("pulled_at", "price")).alias("price"))
        track_snapshot(state, latest, source, newest).write.mode("overwrite").parquet(f"{mine}/v{batch_id:08d}")
        _prune(spark, mine, batch_id)

    return pulls.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_state(spark: SparkSession, state_path: str, source: str) -> DataFrame:
    """The last version of a source's state."""
    return spark.read.parquet(_newest_before(spark, f"{state_path}/source={source}", 1 << 62))


def _versions(spark: SparkSession, path: str):
    """The file system of a path, and the numbers of the versions there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return fs, sorted(int(n[1:]) for n in names if n.startswith("v"))


def _newest_before(spark: SparkSession, path: str, batch_id: int) -> str | None:
    known = [n for n in _versions(spark, path)[1] if n < batch_id]
    return f"{path}/v{known[-1]:08d}" if known else None


def _prune(spark: SparkSession, path: str, batch_id: int) -> None:
    """A batch may be repeated, so the version before its own stays."""
    fs, known = _versions(spark, path)
    for n in [n for n in known if n < batch_id][:-1]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n:08d}"), True)
