"""A keyed table of Parquet files that is changed by upserts, with versions that appear whole or not at all.

Rows are dealt to buckets by a hash of their key. An upsert reads and writes the buckets of its keys only, into a folder of
its own; then a manifest, which says for each bucket where its rows lie, is renamed into place as the next version. A
version that is there already is never replaced, so of two writers at once one fails; what a failed write leaves behind
belongs to no version, and readers go on with the old one.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.shared import removed


class Conflict(RuntimeError):
    """Another writer has made the version that this one wanted to make."""


class KeyedStore:
    """The table of ``folder`` with the columns of ``schema``, at most one row for each value of ``keys``."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = 16) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder, keys, buckets
        self.schema = StructType.fromDDL(schema)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        return sorted(int(n.removeprefix("version-").removesuffix(".json")) for n in names if n.startswith("version-"))

    def _manifest(self, version: int | None = None) -> tuple[int, dict[str, str]]:
        versions = self.versions()
        if not versions:
            return 0, {}
        version = versions[-1] if version is None else version
        said = self._fs.open(self._path(f"version-{version:08d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(said, "UTF-8")
        finally:
            said.close()
        return version, json.loads(text)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one that is still there."""
        _, places = self._manifest(version)
        return self._rows(places)

    def _rows(self, places: dict[str, str]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/{p}" for p in places.values()))

    def upsert(self, rows: DataFrame, order: str, deleted: DataFrame | None = None) -> int:
        """Write the rows over those of their keys; of equal keys the last by ``order`` stays. The keys of ``deleted`` go
        first. Returns the version. Rows with a null in their key are refused."""
        version, places = self._manifest()
        columns = self.schema.fieldNames()
        lines = rows.select(F.struct(*columns).alias("row"), *self.keys, F.lit(2).alias("rank"), F.col(order).alias("of"))
        if deleted is not None:
            none = F.lit(None).cast(self.schema)
            lines = lines.unionByName(deleted.select(none.alias("row"), *self.keys, F.lit(1).alias("rank"), F.lit(None).cast(lines.schema["of"].dataType).alias("of")))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        newest = lambda df: df.groupBy(*self.keys).agg(F.max_by("row", F.struct("rank", "of", F.xxhash64("row"))).alias("row"), F.max(F.struct("rank", "of")).alias("at"))
        # One line for each key first, so that a key that is written again and again is no burden.
        fresh = newest(lines)
        name = f"data-{uuid4().hex}"
        fresh.withColumn("bucket", bucket).write.parquet(f"{self.folder}/incoming-{name}")
        fresh = self.spark.read.parquet(f"{self.folder}/incoming-{name}")
        nulls = F.lit(False)
        for k in self.keys:
            nulls = nulls | F.col(k).isNull()
        if not fresh.where(nulls).isEmpty():
            removed(self.spark, f"{self.folder}/incoming-{name}")
            raise ValueError("a key holds a null")
        touched = {str(r[0]) for r in fresh.select("bucket").distinct().collect()}  # at most as many as there are buckets
        old = self._rows({b: p for b, p in places.items() if b in touched})
        stored = old.select(F.struct(*columns).alias("row"), *self.keys, bucket.alias("bucket"))
        kept = stored.join(fresh.select(*self.keys), self.keys, "left_anti").unionByName(fresh.where("row IS NOT NULL").select("row", *self.keys, "bucket"))
        kept.select(F.col("bucket").alias("_bucket"), "row.*").repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{name}")
        made = {s.getPath().getName() for s in self._fs.listStatus(self._path(name))}
        after = {b: p for b, p in places.items() if b not in touched} | {b: f"{name}/_bucket={b}" for b in touched if f"_bucket={b}" in made}
        self._commit(version + 1, after)
        removed(self.spark, f"{self.folder}/incoming-{name}")
        return version + 1

    def _commit(self, version: int, places: dict[str, str]) -> None:
        draft, final = self._path(f"draft-{uuid4().hex}"), self._path(f"version-{version:08d}.json")
        out = self._fs.create(draft)
        try:
            out.write(bytearray(json.dumps(places), "utf-8"))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version} is there already")

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the newest ``keep`` versions, and files that none of those has."""
        versions = self.versions()
        used = {p.split("/")[0] for v in versions[-keep:] for p in self._manifest(v)[1].values()}
        for status in self._fs.listStatus(self._path("")):
            name = status.getPath().getName()
            old = name.startswith("version-") and int(name[8:16]) not in versions[-keep:]
            if old or (name.startswith(("data-", "incoming-", "draft-")) and name not in used):
                self._fs.delete(status.getPath(), True)
