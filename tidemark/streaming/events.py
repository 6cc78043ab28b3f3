"""Streams over the events: windows with watermarks, sessions, deduplication, order books.

Each function takes a streaming (or a static) DataFrame of events and returns one; ``drain`` runs a stream over what is
there and returns the result as a table of files in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import checkpointed, removed, shared_folder
from tidemark.streaming.state import on_disk

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, files: int = 8) -> DataFrame:
    """The events of a folder as a stream of new files: events.parquet is a file or a folder of them."""
    # By its plain name only a folder can be streamed from, by a pattern both.
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(f"{folder}/events.parque[t]")


def tumbling(events: DataFrame, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return grouped.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, size: str = "2 days", slide: str = "1 day", late: str = "2 hours") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def books(events: DataFrame) -> DataFrame:
    """Best bid and ask and the depth of both sides per ticker, over the quotes so far: views bid, clicks ask."""
    bid = F.col("event_type") == "view"
    quotes = events.where("event_type IN ('view', 'click')").select(
        (F.col("user_id") % 20).alias("ticker"), bid.alias("bid"), F.when(bid, 100 - F.col("value") / 100).otherwise(100.5 + F.col("value") / 100).alias("price"), (F.col("event_id") % 97 + 1).alias("volume")
    )
    side = lambda is_bid, c: F.when(F.col("bid") if is_bid else ~F.col("bid"), F.col(c))
    depth = lambda is_bid: F.coalesce(F.sum(side(is_bid, "volume")), F.lit(0))
    return quotes.groupBy("ticker").agg(F.max(side(True, "price")).alias("best_bid"), F.min(side(False, "price")).alias("best_ask"), depth(True).alias("bid_depth"), depth(False).alias("ask_depth"))


def deduplicated(events: DataFrame, late: str | None = None) -> DataFrame:
    """The first of the events of an id, whenever the others come: ids stay in the state. With ``late`` ids that watermark
    has left behind by so much go from it, and events that come later than that are dropped."""
    if late is None:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def drain(spark: SparkSession, stream: DataFrame, mode: str = "complete", fold: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """Run the stream over all files that are there; the result is a checkpoint in the shared folder, of any size, and what
    the stream has written goes.

    ``fold`` is applied to each batch before it is written. A complete result is that of the last batch; else those of all
    batches are there one below the other.
    """
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    written = run(stream, folder, mode, fold)
    out = checkpointed(written if written is not None else fold(spark.createDataFrame([], stream.schema)))
    removed(spark, folder)
    return out


def run(stream: DataFrame, folder: str, mode: str, fold: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame | None:
    """Go on with the stream of ``folder`` over the files that are new, and the batches that this run has written there. A
    batch that is run again overwrites itself."""
    spark, written = stream.sparkSession, {}

    def write(batch: DataFrame, number: int) -> None:
        out = fold(batch)
        out.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        written[number] = out.schema

    with on_disk(spark):
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    if not written:
        return None
    numbers = [max(written)] if mode == "complete" else sorted(written)
    return spark.read.schema(written[numbers[0]]).parquet(*(f"{folder}/batch-{n}" for n in numbers))


def into_table(stream: DataFrame, path: str, checkpoint: str, key: str, order: str | None = None):
    """Batches of a stream written as Parquet by batch number, so that a batch run again overwrites itself: of equal keys in
    a batch the last by ``order`` stays, without it any."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order or key).alias("last")).select("last.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
