"""Exact duplicates by a stateful stream: of equal texts one row stays.

The files of a table go through a stream in batches. Its state, in RocksDB, without expiry, holds for each digest the
identifier that stays, the place of a content (the least file and row) and how many rows there were; it is the state of a
streaming aggregation, so what comes to it is summed within the tasks first. Texts whose digest was hit are then checked
against the content at its place, byte by byte; digests that stand for several texts are settled by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import common

#: The store of the state, on the executors' disks and in the shared folder, with a bound on its memory.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Without it every store sets some megabytes of disk aside, one store a partition.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: A group is joined by broadcast if it holds over one in so many rows: there are fewer such groups than this.
HOT_SHARE = 2000
#: Bits of the map of repeated digests that keeps other texts out of the check.
MAP_BITS = 24


@contextmanager
def _state_on_disk(spark: SparkSession):
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def _placed(docs: DataFrame, normal: Callable[[Column], Column], digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, known, id, file, row, text) of the rows of files; ``text`` is the normalised one."""
    text = normal(F.coalesce(F.col("text").cast("string"), F.lit("")))
    i = F.col("doc_id").cast("long")
    places = docs.select(i.isNotNull().alias("known"), F.coalesce(i, F.lit(0)).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), text.alias("text"))
    return places.select(digest(F.col("text")).alias("digest"), "known", "id", "file", "row", "text")


def _kept(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """(digest, best, content, n) of the state at the stream's end: the identifier that stays with its place, the place of
    the content, the number of rows."""
    state = rows.groupBy("digest").agg(F.max(F.struct("known", "id", "file", "row")).alias("best"), F.min(F.struct("file", "row")).alias("content"), F.count("*").alias("n"))
    write = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/kept/batch={number}")
    with _state_on_disk(spark):
        query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
        query.awaitTermination()
    spark.createDataFrame([], state.schema).write.parquet(f"{folder}/kept/batch=-1")  # so that there is a file
    seen = spark.read.schema(state.schema).parquet(f"{folder}/kept")
    # A digest comes out of every batch that has it, the last time with all its rows.
    return seen.groupBy("digest").agg(F.max_by(F.struct("best", "content"), "n").alias("last"), F.max("n").alias("n")).select("digest", "last.best", "last.content", "n")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, file, row, text) of one row of each text of an Arrow batch, that of the least place; whole texts count."""
    for batch in batches:
        digests, files, numbers = (batch.column(c).to_pylist() for c in range(3))
        texts, least = batch.column(3), {}
        for i, digest in enumerate(digests):
            same = least.setdefault(digest, [])
            at = next((k for k, j in enumerate(same) if texts[j].as_py() == texts[i].as_py()), None) if same else None
            if at is None:
                same.append(i)
            elif (files[i], numbers[i]) < (files[same[at]], numbers[same[at]]):
                same[at] = i
        yield batch.take(pa.array([i for same in least.values() for i in same], pa.int64()))


def _colliding(placed: DataFrame, kept: DataFrame) -> DataFrame:
    """(digest) of those that stand for more than one text: texts of hits are compared with the content at its place."""
    hit = kept.where("n > 1")
    # A map of 2^24 bits, in at most 2^18 rows, of the digests that were hit: other texts need not move.
    bit = F.pmod(F.xxhash64("digest"), F.lit(1 << MAP_BITS))
    word, one = F.floor(bit / 64).cast("long"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(digest), {1 << MAP_BITS}), 64) as int))")
    repeated = hit.groupBy(word.alias("of_word")).agg(F.bit_or(one).alias("bits"))
    some = placed.withColumn("word", word).withColumn("bit", one).join(F.broadcast(repeated), F.col("word") == F.col("of_word"))
    some = some.where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("digest", "file", "row", "text")
    texts = some.mapInArrow(_together, "digest string, file string, row long, text string")
    # Joined by the digest alone, so that the texts move once; the place is compared as a range for that.
    at = hit.select(F.col("digest").alias("d"), F.col("content.file").alias("f"), F.col("content.row").alias("r"))
    here = (F.col("file") >= F.col("f")) & (F.col("file") <= F.col("f")) & (F.col("row") >= F.col("r")) & (F.col("row") <= F.col("r"))
    contents = texts.join(at, (F.col("digest") == F.col("d")) & here).select("d", F.col("text").alias("content"))
    return texts.join(contents, (F.col("digest") == F.col("d")) & (F.col("text") != F.col("content"))).select("digest").distinct()


def exact_duplicates(
    spark: SparkSession, path: str, *, normal: Callable[[Column], Column] = lambda text: text, digest: Callable[[Column], Column] = lambda text: F.sha2(text, 256), bytes_per_batch: int = 1 << 40, files_per_batch: int | None = None
) -> DataFrame:
    """Groups of rows of equal text in the Parquet file or folder ``path``, which holds doc_id and text.

    Of equal texts (after ``normal``) the row of largest doc_id stays. Returns (doc_id, keep_id, group_size, kept,
    text_sha256), one line a row. The stream takes ``bytes_per_batch`` or ``files_per_batch`` at a time; the result
    depends on neither, nor on the order of the files.

    * null text: an empty one; empty texts are equal to each other;
    * null doc_id: below all others; a group without any other keeps null;
    * ties, as when equal texts repeat a doc_id: the row of the larger (file, row) stays, so exactly one is kept;
    * one doc_id with several texts: each row is in the group of its own text;
    * very long texts are compared two at a time; an empty table gives an empty result;
    * further columns, of whatever names, are not read.
    """
    common.ship(spark)
    folder = f"{common.shared_folder(spark)}/dedup-{uuid4().hex}"
    schema = StructType([f for f in spark.read.parquet(path).schema.fields if f.name in ("doc_id", "text")])
    stream = spark.readStream.schema(schema)
    stream = stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream.option("maxBytesPerTrigger", str(bytes_per_batch))
    # By its plain name only a folder can be streamed from, by a pattern both.
    kept = _kept(spark, _placed(stream.parquet(f"{path[:-1]}[{path[-1]}]"), normal, digest).drop("text"), folder)
    kept = common.checkpointed(kept)
    common.removed(spark, folder)
    placed = _placed(spark.read.schema(schema).parquet(path), normal, digest)
    colliding = common.checkpointed(_colliding(placed, kept))
    best = F.when(F.col("best.known"), F.col("best.id")).alias("keep_id")
    groups = kept.select(F.col("digest").alias("of_digest"), best, F.col("best.file").alias("keep_file"), F.col("best.row").alias("keep_row"), F.col("n").alias("size"))

    rows = placed.select("digest", F.when(F.col("known"), F.col("id")).alias("doc_id"), "file", "row", F.sha2("text", 256).alias("text_sha256"), "text")
    sure, unsure = rows.drop("text"), None
    if not colliding.isEmpty():
        sure = sure.join(colliding, "digest", "left_anti")
        unsure = rows.join(colliding, "digest", "left_semi")
    total = groups.agg(F.sum("size")).first()[0] or 0
    # Fewer than HOT_SHARE groups hold over 1 / HOT_SHARE of the rows each.
    hot = groups.where(F.col("size") * HOT_SHARE > total).select([F.col(c).alias(f"hot_{c}") for c in groups.columns])
    found = sure.join(F.broadcast(hot), F.col("digest") == F.col("hot_of_digest"), "left")
    cold_key = F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(F.concat_ws(":", "file", "row"))
    found = found.withColumn("key", cold_key).join(groups.where(F.col("size") * HOT_SHARE <= total), F.col("key") == F.col("of_digest"), "left")
    either = lambda c: F.when(F.col("hot_size").isNull(), F.col(c)).otherwise(F.col(f"hot_{c}"))
    kept = (F.col("file") == either("keep_file")) & (F.col("row") == either("keep_row"))
    result = found.select("doc_id", either("keep_id").alias("keep_id"), either("size").alias("group_size"), kept.alias("kept"), "text_sha256")
    if unsure is None:
        return result
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "file", "row")).alias("best")
    texts = unsure.groupBy(F.col("digest").alias("d"), F.col("text").alias("t")).agg(best, F.count("*").alias("group_size"))
    settled = unsure.join(texts, (F.col("digest") == F.col("d")) & (F.col("text") == F.col("t")))
    stays = (F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))
    return result.unionByName(settled.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256"))
