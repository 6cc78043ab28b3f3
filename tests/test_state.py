"""Streams with state against plain loops: any number of micro-batches, files in reverse order, a restart, a stored ledger."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.streaming import events as S
from tidemark.streaming import state as K

DAY = 86_400_000_000


def event_rows(n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=rng.randrange(40_000)), rng.randrange(6), rng.choice(["error", "view", "click"]), float(i % 50), "{}") for i in range(n)]
    return rows + [rows[k] for k in range(0, n, 7)]


def write(folder, rows, files, reverse):
    """In files of their time, or the latest first."""
    (folder / "events.parquet").mkdir(parents=True)
    rows = sorted(rows, key=lambda r: r[1], reverse=reverse)
    size = -(-len(rows) // files)
    for k in range(files):
        frame = pd.DataFrame(rows[k * size : (k + 1) * size], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
        frame.astype({"ts": "datetime64[us, UTC]"}).to_parquet(folder / "events.parquet" / f"part-{k:03d}.parquet")


@pytest.mark.parametrize(("files", "reverse"), [(1, False), (20, False), (20, True)])
def test_deduplication_and_totals(spark, tmp_path, files, reverse):
    rows = event_rows()
    write(tmp_path, rows, files, reverse)
    got = S.drain(spark, S.deduplicated(S.read(spark, str(tmp_path), 7)).select("event_id"), "append")
    assert sorted(r.event_id for r in got.collect()) == sorted({r[0] for r in rows})
    totals = S.drain(spark, K.running_totals(S.read(spark, str(tmp_path), 7)), "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))
    wanted = {u: (sum(r[2] == u for r in rows), sum(r[4] for r in rows if r[2] == u)) for u in range(6)}
    assert {r.user_id: (r.n, r.total) for r in totals.collect()} == wanted


@pytest.mark.parametrize(("files", "reverse", "late"), [(1, False, None), (9, True, None), (9, False, DAY), (9, True, 60 * DAY)])
def test_cache_log(spark, tmp_path, files, reverse, late):
    rows = list({r[0]: r for r in event_rows()}.values())
    write(tmp_path, rows, files, reverse)
    ttl, wanted, since = 6 * 3_600_000_000, {}, {}
    for i, ts, user, kind, *_ in sorted(rows, key=lambda r: (r[1], r[0])):
        t = int(ts.timestamp()) * 1_000_000
        wanted[i] = user not in since or t - since[user] > ttl
        if wanted[i] and kind != "error":
            since[user] = t
    log = S.read(spark, str(tmp_path), 4).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") != "error").alias("storable"))
    got = K.newest(S.drain(spark, K.cache_log(log, "user_id", ttl, late), "update"), "event_id")
    assert {r.event_id: r.fetched for r in got.collect()} == wanted


def plain_ledger(entries, prices, expires):
    out = {}
    for ticker, t, i, action, rec, target, stop in entries:
        status, resolved, last = "open", None, None
        for p_t, value in sorted((p[1], p[2]) for p in prices if p[0] == ticker and p[1] > t):
            last = value
            if action == "buy" and target is not None and value >= target:
                status = "target"
            elif action == "buy" and stop is not None and value <= stop:
                status = "stopped"
            elif p_t - t > expires:
                status = "expired"
            if status != "open":
                resolved = p_t
                break
        out[i] = (status, resolved, last, None if last is None else round((last - rec) / rec * 100, 6))
    return out


def ledger_rows(seed=2):
    rng = random.Random(seed)
    prices = [(k, d * DAY, round(100 + 8 * rng.gauss(0, 1), 2)) for k in ("AA", "BB", "CC") for d in range(140)]
    entries = [(k, rng.randrange(150) * DAY, f"{k}{j}", rng.choice(["buy", "sell"]), 100.0, rng.choice([112.0, 120.0, None]), rng.choice([85.0, None])) for k in ("AA", "BB", "CC", "DD") for j in range(12)]
    return entries, prices


ENTRY = "ticker string, t long, id string, action string, rec_price double, target double, stop double"
PRICE = "ticker string, t long, value double"


def streamed(spark, folder, entries, prices, late=None, stored=None):
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name}")
    return K.ledger(read("entries", ENTRY), read("prices", PRICE), expires=60 * DAY, late=late, stored=stored)


def add(spark, folder, entries, prices, files, reverse=False):
    for name, rows, schema in (("entries", entries, ENTRY), ("prices", prices, PRICE)):
        rows = sorted(rows, key=lambda r: r[1], reverse=reverse)
        size = -(-len(rows) // files) or 1
        for k in range(files):
            spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def said(lines):
    return {r.id: (r.status, r.resolved, r.last_price, None if r.return_pct is None else round(r.return_pct, 6)) for r in K.newest(lines, "id").collect()}


@pytest.mark.parametrize(("files", "reverse", "late"), [(1, False, None), (5, False, None), (5, True, None), (5, False, 200 * DAY)])
def test_ledger_in_any_batches(spark, tmp_path, files, reverse, late):
    entries, prices = ledger_rows()
    add(spark, tmp_path, entries, prices, files, reverse)
    got = said(S.drain(spark, streamed(spark, tmp_path, entries, prices, late), "update"))
    assert got == plain_ledger(entries, prices, 60 * DAY)
    assert {s for s, *_ in got.values()} == {"target", "stopped", "expired", "open"}


def test_ledger_goes_on_after_a_restart(spark, tmp_path):
    entries, prices = ledger_rows(3)
    early = lambda rows: [r for r in rows if r[1] < 70 * DAY]
    add(spark, tmp_path / "in", early(entries), early(prices), 2)
    first = S.run(streamed(spark, tmp_path / "in", entries, prices), str(tmp_path / "out"), "update")
    assert said(first) == plain_ledger(early(entries), early(prices), 60 * DAY)
    add(spark, tmp_path / "in", [r for r in entries if r[1] >= 70 * DAY], [r for r in prices if r[1] >= 70 * DAY], 2)
    second = S.run(streamed(spark, tmp_path / "in", entries, prices), str(tmp_path / "out"), "update")
    assert said(first.unionByName(second)) == plain_ledger(entries, prices, 60 * DAY)


def test_ledger_that_is_stored_already(spark, tmp_path):
    entries, prices = ledger_rows(4)
    stored = [(e[0], e[2], e[1], *e[3:], "open", None, None, None) for e in entries if e[0] == "AA"]
    stored.append(("AA", "done", 0, "buy", 100.0, 120.0, 80.0, "stopped", 0, 0, 79.0))
    before = spark.createDataFrame(stored, f"ticker string, {K.ENTRY}")
    add(spark, tmp_path, [e for e in entries if e[0] != "AA"], prices, 3)
    got = said(S.drain(spark, streamed(spark, tmp_path, entries, prices, stored=before), "update"))
    wanted = plain_ledger(entries, prices, 60 * DAY)
    assert "done" not in got and got == {i: w for i, w in wanted.items() if i in got}
    assert {i for i in wanted if i not in got} == {e[2] for e in entries if e[0] == "AA" and wanted[e[2]][2] is None}
