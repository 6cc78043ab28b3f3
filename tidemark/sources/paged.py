"""Feeds that come in pages, one window of a day after the other, as a data source: in batches and as a stream.

What a feed has answered lies in a folder as JSON lines, a run of pages of a day to a file: ``day=2024-01-05/page=00000/last=00999``
holds the first thousand, and each line says its page. (Files in ``page=00000`` itself are of that page.) So there are as many
files as the items need, not one a page. A batch read has a task for each day, or several for a day of many pages; the range
of days that is asked for reaches the reader, which opens no page of other days. A stream goes on after the last page that it
has taken.

The range is given to ``read``. The reader also takes filters on the day that Spark pushes down, if the session has
spark.sql.python.filterPushdown.enabled; this library does not set it, since Spark 4.1 then keeps a filter for later queries
of the same DataFrame.
"""

from __future__ import annotations

import datetime
import io
import json
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tidemark.sources.shared import removed, scratch

# The source goes to the workers by value, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "tidemark_pages"


#: Pages of a file that is written, and of a task that reads.
RUN = 1000

#: Characters of lines that are parsed in one go; a longer line is parsed alone.
PARSED = 1 << 18


def record(items: DataFrame, folder: str, day: str, order: list[str], page_size: int = 100, run: int = RUN) -> None:
    """Write items as the pages of a feed: those of a day in their order, ``page_size`` to a page and ``run`` pages to a file.
    Items without a day go."""
    spark, laid = items.sparkSession, scratch(items.sparkSession, "items")
    placed = numbered(items, day, order, laid).withColumns({"_page": F.floor(F.col("_place") / page_size), "last": F.floor((F.col("_all") - 1) / page_size)}).drop("_place", "_all")
    first = F.floor(F.col("_page") / run) * run
    # Five digits at least.
    text = lambda n: F.when(n < 100_000, F.lpad(n.cast("string"), 5, "0")).otherwise(n.cast("string"))
    rows = placed.withColumns({"page": text(first), "last": text(F.least(F.col("last"), first + run - 1)), "_page": text(F.col("_page"))}).withColumnRenamed(day, "day")
    rows.repartition("day", "page").sortWithinPartitions("day", "page", "last", "_page", *order).write.mode("append").partitionBy("day", "page", "last").json(folder)
    removed(spark, laid)


def numbered(items: DataFrame, day: str, order: list[str], laid: str) -> DataFrame:
    """The items that have a day, with their place in it (``_place``, from 0) and the number of all of that day (``_all``).

    They are laid down in ranges of day and order, sorted, so a day of any size is dealt over the tasks; a place is that in the
    range after all of the day in earlier ranges. Only items that are equal in day and order stay in one task.
    """
    ranges = items.where(F.col(day).isNotNull()).repartitionByRange(day, *order).sortWithinPartitions(day, *order)
    ranges.withColumn("_at", F.monotonically_increasing_id()).write.parquet(laid)
    # The upper bits of the number are the task's.
    rows = items.sparkSession.read.parquet(laid).withColumn("_task", F.shiftright("_at", 33))
    of_day = Window.partitionBy(day)
    before = F.sum("_n").over(of_day.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy(day, "_task").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    starts = counts.select(day, "_task", (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_n").over(of_day).alias("_all"))
    # A line for each day and one more for each task.
    return rows.join(F.broadcast(starts), [day, "_task"]).withColumn("_place", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_shift")


def _files(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder) if ":" in folder else FileSystem.from_uri(f"file://{folder}")


def _place(day: str, page: str) -> tuple[str, int, str]:
    """What pages are ordered by: a number of six digits comes after those of five."""
    return day, len(page), page


def runs(folder: str, first: str | None = None, last: str | None = None) -> list[tuple[str, str, str]]:
    """(day, first page, last page) of the files that are there, in order; those of days out of the range are not even
    listed."""
    from pyarrow.fs import FileSelector, FileType

    system, path = _files(folder)
    named = lambda p, key: sorted((i.base_name.removeprefix(key) for i in system.get_file_info(FileSelector(p, allow_not_found=True)) if i.type == FileType.Directory and i.base_name.startswith(key)), key=lambda n: (len(n), n))
    days = [d for d in named(path, "day=") if (first is None or d >= first) and (last is None or d <= last)]
    return [(d, p, (named(f"{path}/day={d}/page={p}", "last=") or [p])[-1]) for d in days for p in named(f"{path}/day={d}", "page=")]


def _text(number: int) -> str:
    return f"{number:05d}"


def pages(folder: str, first: str | None = None, last: str | None = None) -> list[tuple[str, str]]:
    """(day, page) of the pages that are there, in order."""
    return [(day, _text(n)) for day, low, high in runs(folder, first, last) for n in range(int(low), int(high) + 1)]


class Pages(InputPartition):
    """Some pages of a day: by the file (its first page) that holds them, the first and the last number."""

    def __init__(self, day: str, files: dict[str, tuple[int, int]]) -> None:
        super().__init__((day, files))
        self.day, self.files = day, files

    @property
    def size(self) -> int:
        return sum(high - low + 1 for low, high in self.files.values())

    @property
    def numbers(self) -> list[str]:
        return [_text(n) for low, high in self.files.values() for n in range(low, high + 1)]


def by_day(found: list[tuple[str, str, str]], above: dict | None = None, to: dict | None = None) -> list[Pages]:
    """The pages of these files that come after ``above`` and not after ``to`` (a day and a page), a day and at most about
    ``RUN`` of them to a task."""
    out: list[Pages] = []
    for day, first, last in found:
        low, high = int(first), int(last)
        if above and above["day"] == day:
            low = max(low, int(above["page"]) + 1)
        if to and to["day"] == day:
            high = min(high, int(to["page"]))
        if low > high:
            continue
        if out and out[-1].day == day and out[-1].size + high - low + 1 <= RUN:
            out[-1].files[first] = (low, high)
        else:
            out.append(Pages(day, {first: (low, high)}))
    return out


def _read(folder: str, schema: StructType, part: Pages) -> Iterator[list]:
    from pyarrow.fs import FileSelector

    system, path = _files(folder)
    parsers = {"date": datetime.date.fromisoformat, "timestamp": datetime.datetime.fromisoformat, "timestamp_ntz": lambda v: datetime.datetime.fromisoformat(v).replace(tzinfo=None)}
    names = [f.name for f in schema.fields]
    parsed = [(at, parsers[f.dataType.simpleString()]) for at, f in enumerate(schema.fields) if f.dataType.simpleString() in parsers]
    for first, (low, high) in part.files.items():
        for info in sorted(system.get_file_info(FileSelector(f"{path}/day={part.day}/page={first}", recursive=True)), key=lambda i: i.path):
            if not info.base_name.endswith(".json"):
                continue
            # Only a line feed ends an item: texts may hold other line separators.
            with system.open_input_stream(info.path) as said, io.TextIOWrapper(said, "utf-8", newline="\n") as lines:
                while some := lines.readlines(PARSED):
                    items = json.loads(f"[{','.join(some)}]")
                    if len(items) != len(some):
                        raise ValueError(f"not an item a line: {info.path}")
                    for item in items:
                        page = item.pop("_page", first)
                        if low <= int(page) <= high:
                            item["day"], item["page"] = part.day, page
                            row = [item.get(name) for name in names]
                            for at, parse in parsed:
                                if row[at] is not None:
                                    row[at] = parse(row[at])
                            yield row


class PagedReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, first: str | None = None, last: str | None = None) -> None:
        self.folder, self.schema, self.first, self.last = folder, schema, first, last

    def partitions(self) -> list[Pages]:
        return by_day(runs(self.folder, self.first, self.last)) or [Pages("", {})]

    def read(self, partition: Pages) -> Iterator[list]:
        return _read(self.folder, self.schema, partition)


class PushedReader(PagedReader):
    """The reader where Spark pushes filters down."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes all that is said of the day; the rest is left to Spark."""
        step = datetime.timedelta(days=1)
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("day",) or not isinstance(value, datetime.date):
                yield f
                continue
            low = value if isinstance(f, (EqualTo, GreaterThanOrEqual)) else value + step if isinstance(f, GreaterThan) else None
            high = value if isinstance(f, (EqualTo, LessThanOrEqual)) else value - step if isinstance(f, LessThan) else None
            if low is None and high is None:
                yield f
            self.first = max(filter(None, (self.first, low and low.isoformat())), default=None)
            self.last = min(filter(None, (self.last, high and high.isoformat())), default=None)


class PagedStream(DataSourceStreamReader):
    """An offset is the last page taken. Pages that come later must be of a later day, or of the last day and behind it."""

    def __init__(self, folder: str, schema: StructType) -> None:
        self.folder, self.schema = folder, schema
        self.seen = {"day": "", "page": ""}

    def initialOffset(self) -> dict:
        return {"day": "", "page": ""}

    def latestOffset(self) -> dict:
        found = runs(self.folder, self.seen["day"] or None)
        if found and _place(found[-1][0], found[-1][2]) > _place(**self.seen):
            self.seen = {"day": found[-1][0], "page": found[-1][2]}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.seen = max(self.seen, end, key=lambda o: _place(**o))
        return by_day(runs(self.folder, start["day"] or None, end["day"] or None), start, end)

    def read(self, partition: Pages) -> Iterator[list]:
        return _read(self.folder, self.schema, partition)

    def commit(self, end: dict) -> None:
        self.seen = max(self.seen, end, key=lambda o: _place(**o))


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> PagedReader:
        kind = PushedReader if self.options.get("pushed") == "true" else PagedReader
        return kind(self.options["path"], schema, self.options.get("first"), self.options.get("last"))

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(self.options["path"], schema)


def _options(spark: SparkSession, schema: str) -> dict[str, str]:
    spark.dataSource.register(PagedFeed)
    return {"schema": f"day date, page string, {schema}", "pushed": str(spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).lower()}


def read(spark: SparkSession, folder: str, schema: str, first: datetime.date | None = None, last: datetime.date | None = None) -> DataFrame:
    """(day, page, items) of the pages of the days from ``first`` to ``last``, of all days without them."""
    bounds = {name: d.isoformat() for name, d in (("first", first), ("last", last)) if d is not None}
    return spark.read.format(NAME).options(**_options(spark, schema), **bounds).load(folder)


def stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The same as a stream of new pages; a batch takes all that are there."""
    return spark.readStream.format(NAME).options(**_options(spark, schema)).load(folder)
