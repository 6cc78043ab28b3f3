"""Feeds in pages: the range of days reaches the reader, batch and stream agree, a stream goes on where it stopped."""

import datetime
import pickle
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan
from pyspark.sql.types import StructType

from tidemark.sources import paged
from tidemark.streaming import events as S

SCHEMA = "id long, kind string, v double"


def items(spark, first, days, each=25):
    rows = [(datetime.date(2024, 1, first + d), 100 * (first + d) + i, "ab"[i % 2], None if i % 5 == 0 else i / 4) for d in range(days) for i in range(each)]
    return spark.createDataFrame([*rows, (None, 9, "a", 1.0)], f"on date, {SCHEMA}")


def said(df):
    return sorted((r.day, r.page, r.id, r.kind, -1 if r.v is None else r.v) for r in df.collect())


@pytest.fixture
def folder(spark, tmp_path):
    paged.record(items(spark, 1, 9), str(tmp_path / "feed"), "on", ["id"], page_size=10)
    return str(tmp_path / "feed")


def test_pages_and_rows(spark, folder):
    assert paged.pages(folder) == [(f"2024-01-0{d}", f"0000{p}") for d in range(1, 10) for p in range(3)]
    wanted = [(r.on, f"{(r.id % 100) // 10:05d}", r.id, r.kind, -1 if r.v is None else r.v) for r in items(spark, 1, 9).where("on IS NOT NULL").collect()]
    assert said(paged.read(spark, folder, SCHEMA)) == sorted(wanted)


def test_no_page_of_another_day_is_opened(spark, folder, tmp_path):
    """Pages out of the range are broken: whoever opened one would fail."""
    for day in ("2024-01-01", "2024-01-08"):
        (tmp_path / "feed" / f"day={day}" / "page=00000" / "broken.json").write_text("{no json")
    d = lambda n: datetime.date(2024, 1, n)
    got = paged.read(spark, folder, SCHEMA, d(2), d(7)).where("kind = 'a'")
    assert got.count() == 6 * 13 and {r.day.day for r in got.select("day").collect()} == set(range(2, 8))
    assert paged.read(spark, folder, SCHEMA, d(9)).count() == 25 and paged.read(spark, folder, SCHEMA, d(20)).count() == 0
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        paged.read(spark, folder, SCHEMA).count()


def test_filters_that_the_reader_takes(folder):
    reader = paged.PushedReader(folder, StructType.fromDDL(f"day date, page string, {SCHEMA}"))
    d = lambda n: datetime.date(2024, 1, n)
    other = EqualTo(("kind",), "a")
    assert list(reader.pushFilters([GreaterThan(("day",), d(2)), other, LessThan(("day",), d(6)), LessThan(("day",), d(9))])) == [other]
    assert [(p.day, len(p.numbers)) for p in reader.partitions()] == [(f"2024-01-0{n}", 3) for n in (3, 4, 5)]


def test_pushed_filters_reach_the_reader(spark, folder, tmp_path):
    (tmp_path / "feed" / "day=2024-01-08" / "page=00000" / "broken.json").write_text("{no json")
    name = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(name, "true")
    try:
        assert paged.read(spark, folder, SCHEMA).where("day >= DATE'2024-01-03' AND day < DATE'2024-01-08' AND kind = 'b'").count() == 5 * 12
    finally:
        spark.conf.unset(name)


def test_stream_and_batch_agree(spark, folder):
    assert said(S.drain(spark, paged.stream(spark, folder, SCHEMA), "append")) == said(paged.read(spark, folder, SCHEMA))


def test_stream_goes_on_with_new_pages(spark, folder, tmp_path):
    first = S.run(paged.stream(spark, folder, SCHEMA), str(tmp_path / "out"), "append")
    assert first.count() == 225
    paged.record(items(spark, 10, 2), folder, "on", ["id"], page_size=10)
    second = S.run(paged.stream(spark, folder, SCHEMA), str(tmp_path / "out"), "append")
    assert second.agg(F.min("day"), F.count("*")).first() == (datetime.date(2024, 1, 10), 50)
    assert S.run(paged.stream(spark, folder, SCHEMA), str(tmp_path / "out"), "append") is None


def files(folder):
    return sorted(str(f.parent.relative_to(folder)) for f in Path(folder).rglob("*.json"))


def test_pages_share_files(spark, tmp_path):
    """As many files as the items need: one for the three pages of a day, or one for each run of two."""
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    paged.record(items(spark, 1, 9), one, "on", ["id"], page_size=10)
    paged.record(items(spark, 1, 9), two, "on", ["id"], page_size=10, run=2)
    assert files(one) == [f"day=2024-01-0{d}/page=00000/last=00002" for d in range(1, 10)]
    assert files(two) == sorted(f"day=2024-01-0{d}/page={p}" for d in range(1, 10) for p in ("00000/last=00001", "00002/last=00002"))
    assert paged.pages(one) == paged.pages(two) and said(paged.read(spark, one, SCHEMA)) == said(paged.read(spark, two, SCHEMA))


def test_a_stream_that_stopped_within_a_file(tmp_path):
    """Offsets name pages: those of a file up to the offset are not taken again, and 100000 comes after 99999."""
    line = lambda p: f'{{"_page": "{p}", "id": {int(p)}}}\n'
    for first, last in (("99998", "99999"), ("100000", "100002")):
        (tmp_path / "day=2024-01-01" / f"page={first}" / f"last={last}").mkdir(parents=True)
        (tmp_path / "day=2024-01-01" / f"page={first}" / f"last={last}" / "x.json").write_text("".join(line(f"{n:05d}") for n in range(int(first), int(last) + 1)))
    source = paged.PagedStream(str(tmp_path), StructType.fromDDL("day date, page string, id long"))
    assert source.latestOffset() == {"day": "2024-01-01", "page": "100002"}
    parts = source.partitions({"day": "2024-01-01", "page": "99998"}, {"day": "2024-01-01", "page": "100001"})
    assert [r[2] for p in parts for r in source.read(p)] == [99999, 100000, 100001]


def test_lines_end_with_a_line_feed_only(spark, tmp_path):
    kinds = ["a\u2028b", "c\u0085d", "e\nf", "g\r\nh"]
    rows = spark.createDataFrame([(datetime.date(2024, 1, 1), i, k, None) for i, k in enumerate(kinds)], f"on date, {SCHEMA}")
    paged.record(rows, str(tmp_path / "feed"), "on", ["id"])
    assert [r.kind for r in paged.read(spark, str(tmp_path / "feed"), SCHEMA).orderBy("id").collect()] == kinds


def most_read(spark, group, work):
    """Most rows that one task of this work reads from a shuffle."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    store, jobs = sc._jsc.sc().statusStore(), sc.statusTracker()
    listed = [store.taskList(stage, 0, 100) for job in jobs.getJobIdsForGroup(group) for stage in jobs.getJobInfo(job).stageIds]
    metrics = [tasks.apply(i).taskMetrics() for tasks in listed for i in range(tasks.size())]
    return max(m.get().shuffleReadMetrics().recordsRead() for m in metrics if m.isDefined())


def test_no_task_takes_a_whole_day(spark, tmp_path):
    """All items are of one day, in no order; they are dealt over the tasks and numbered through."""
    n, feed, coalesce = 20_000, str(tmp_path / "feed"), "spark.sql.adaptive.coalescePartitions.enabled"
    rows = spark.range(n).select(F.expr("DATE'2024-01-01'").alias("on"), (F.col("id") * 7919 % n).alias("id"), F.lit("a").alias("kind"), F.lit(0.5).alias("v"))
    spark.conf.set(coalesce, "false")
    try:
        most = most_read(spark, "one day", lambda: paged.record(rows, feed, "on", ["id"], run=10))
    finally:
        spark.conf.unset(coalesce)
    assert most < 0.6 * n
    assert len(files(feed)) == 20 and paged.pages(feed) == [("2024-01-01", f"{p:05d}") for p in range(200)]
    assert [(r.page, r.n, r.low, r.high) for r in paged.read(spark, feed, SCHEMA).groupBy("page").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).orderBy("page").collect()] == [(f"{p:05d}", 100, 100 * p, 100 * p + 99) for p in range(200)]


def test_places_over_days_and_ranges(spark, tmp_path):
    """Ranges that end within a day, and ones that hold many: places are those of a window over each day."""
    data = items(spark, 1, 9, each=40).select("*", (-F.col("id")).alias("down"))
    got = paged.numbered(data, "on", ["down"], str(tmp_path / "laid"))
    assert sorted((r.on, r.id, r._place, r._all) for r in got.collect()) == sorted((r.on, r.id, 39 - r.id % 100, 40) for r in data.where("on IS NOT NULL").collect())


def test_tasks_of_a_stream_name_ranges(spark, tmp_path):
    """What a task is sent does not grow with its pages."""
    (tmp_path / "day=2024-01-01" / "page=00000" / "last=00999").mkdir(parents=True)
    parts = paged.PagedStream(str(tmp_path), StructType.fromDDL("day date, page string")).partitions({"day": "2024-01-01", "page": "00009"}, {"day": "2024-01-01", "page": "00997"})
    assert len(parts) == 1 and len(parts[0].numbers) == 988 and parts[0].numbers[0] == "00010" and len(pickle.dumps(parts[0].value)) < 100
