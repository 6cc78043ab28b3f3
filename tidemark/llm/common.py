"""What the corpus operators share: shipping this package to executors, the shared folder, text helpers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.shared import checkpointed, removed, shared_folder  # noqa: F401

#: A key is common if over one in so many rows has it: there are fewer such keys than this.
HOT_SHARE = 2_000
#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = tempfile.mkdtemp(prefix="tidemark-ship-")
    sc.addPyFile(shutil.make_archive(f"{target}/tidemark_package", "zip", package.parent, package.name))
    sc._tidemark_shipped = True


def joined_by_key(rows: DataFrame, groups: DataFrame, key: str, size: str = "n") -> DataFrame:
    """``rows`` with the line of ``groups`` that has their key; ``groups`` has one line for each key and its number of rows.

    The lines of common keys, fewer than HOT_SHARE, are sent to the rows, so that a key of any share of the rows is in no one
    task; the others are joined by key. Rows of a null key, and of keys without a line, go. Both are read more than once and
    ``groups`` is summed at once, so they are best tables or checkpoints.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot, cold = groups.where(F.col(size) * HOT_SHARE > total), groups.where(F.col(size) * HOT_SHARE <= total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def string_or_empty(name: str):
    """The text column with null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
