"""The journal as a stream: the last record of each chunk, kept up batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.journal import last_records


def _parts(spark, path: str) -> dict[int, str]:
    """The numbered folders under a path, those that are complete."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    store = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.listStatus(top) if store.exists(top) else []
    named = {int(f.getPath().getName()[2:]): f.getPath() for f in found if f.getPath().getName().startswith("n=")}
    return {n: p.toString() for n, p in named.items() if store.exists(hadoop.Path(p, "_SUCCESS"))}


def _delete(spark, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_view(spark, path: str, schema, by: str = "line_no", key: str = "chunk_id") -> DataFrame:
    """The last record of each chunk as of the batches written under path: the latest base and the batches
    after it."""
    bases = _parts(spark, f"{path}/base")
    base = max(bases, default=-1)
    parts = [bases[base]] if bases else []
    parts += [p for n, p in _parts(spark, f"{path}/batch").items() if n > base]
    rows = spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
    return last_records(rows, by, key)


def run_view(stream: DataFrame, path: str, checkpoint: str, by: str = "line_no", key: str = "chunk_id", compact: int = 20, **trigger):
    """Keep a last-record view under path, for read_view. A batch costs what it holds: its own last records
    are written. Every `compact` batches the view becomes the new base; the batches that it holds and
    bases before the one before it go. A batch that is run again writes the same again."""
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, n: int) -> None:
        last_records(batch, by, key).write.mode("overwrite").parquet(f"{path}/batch/n={n}")
        if (n + 1) % compact == 0:
            read_view(spark, path, schema, by, key).write.mode("overwrite").parquet(f"{path}/base/n={n}")
            kept = sorted(_parts(spark, f"{path}/base"))[-2:]
            for old, place in _parts(spark, f"{path}/base").items():
                if old not in kept:
                    _delete(spark, place)
            for old, place in _parts(spark, f"{path}/batch").items():
                if old <= kept[0]:  # a reader of the base before may still want the others
                    _delete(spark, place)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stalled(events: DataFrame, time: str = "ts", key: str = "chunk_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of activity of each chunk: key, start, end, n. Works on streams (with a watermark) and
    on tables alike."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    found = marked.groupBy(key, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return found.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
