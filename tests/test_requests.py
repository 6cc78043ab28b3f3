"""Limiter, cache, held attempts and joins in time against plain loops, on random bursts and ties."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, requests

H = 3_600_000_000


def calls(seed, n=160, keys=3):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in rng.sample(range(n), n):
        t += rng.choice([0, 0, 1, H // 3, H, 5 * H, 40 * H]) if rng.random() < 0.5 else 0
        rows.append((rng.choice([*range(keys), None]), t, i, rng.choice(["error", "signup", "view", "view"]), rng.choice([None, 1.5, 2.5]), rng.randrange(4)))
    return rows


SCHEMA = "user_id long, t long, event_id long, event_type string, payload double, topic long"


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize(("seed", "most", "per"), [(1, 1, H), (2, 2, 24 * H), (3, 5, 3 * H), (4, 3, 1)])
def test_released_as_the_loop_does(spark, seed, most, per):
    rows = [r for r in calls(seed) if r[0] is not None]
    wanted = {}
    for own in by_key(rows).values():
        stamps, now = [], 0
        for r in own:
            now = max(now, r[1])
            stamps = [s for s in stamps if s > now - per]
            if len(stamps) >= most:
                now = max(now, stamps[0] + per)
                stamps = [s for s in stamps if s > now - per]
            stamps.append(now)
            wanted[r[2]] = now
    got = requests.released(spark.createDataFrame(rows, SCHEMA).repartition(3), ["user_id"], "t", "event_id", most, per)
    assert {r.event_id: r.released for r in got.collect()} == wanted


@pytest.mark.parametrize(("seed", "ttl"), [(5, H), (6, 24 * H), (7, 0)])
def test_read_through_as_the_loop_does(spark, seed, ttl):
    rows = calls(seed)
    wanted = {}
    for own in by_key(rows).values():
        stored = None
        for r in own:
            if stored and r[1] - stored[0] <= ttl:
                wanted[r[2]] = ("cache", stored[1])
            else:
                wanted[r[2]] = ("fetch", r[4])
                stored = (r[1], r[4]) if r[4] is not None else stored
    got = requests.read_through(spark.createDataFrame(rows, SCHEMA).repartition(3), ["user_id"], "t", "event_id", "payload", ttl)
    assert {r.event_id: (r.origin, r.value) for r in got.collect()} == wanted


def test_attempts_as_the_loop_does(spark):
    rows = [r for r in calls(8, 300) if r[0] is not None]
    wanted = {}
    for own in by_key(rows).values():
        failure, refused = None, set()
        for r in own:
            if r[5] in refused:
                wanted[r[2]] = "denied"
            elif failure is not None and r[1] - failure < 12 * H:
                wanted[r[2]] = "held"
            else:
                wanted[r[2]] = "tried"
                if r[3] == "error":
                    failure = r[1]
                elif r[3] == "signup":
                    refused.add(r[5])
    assert len(set(wanted.values())) == 3
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"failed": F.col("event_type") == "error", "refused": F.col("event_type") == "signup"})
    got = requests.attempts(df.repartition(5), "user_id", "t", "event_id", "topic", "failed", "refused", 12 * H)
    assert {r.event_id: r.outcome for r in got.collect()} == wanted


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_as_of(spark, forward, keys):
    rng = random.Random(9)
    day = lambda: date(2020, 1, 1) + timedelta(days=rng.randrange(400))
    left = [(i, rng.choice(["a", "b", None]), day() if i % 9 else None) for i in range(120)]
    facts = [(rng.choice(["a", "b", None]), day() if i % 7 else None, float(rng.randrange(50))) for i in range(40)]
    wanted = {}
    for i, k, d in left:
        known = [(f[1], f[2]) for f in facts if d and f[1] and (not keys or f[0] == k) and (f[1] >= d if forward else f[1] <= d)]
        wanted[i] = (min(known) if forward else max(known)) if known else None
    got = asof.as_of(spark.createDataFrame(left, "i long, k string, d date").repartition(3), spark.createDataFrame(facts, "k string, at date, v double"), keys, "d", "at", "v", "fact", lambda c: F.floor(F.unix_date(c) / 30), forward=forward)
    assert {r.i: tuple(r.fact) if r.fact else None for r in got.collect()} == wanted


def test_valid_at(spark):
    rng = random.Random(10)
    day = lambda: date(2020, 1, 1) + timedelta(days=rng.randrange(500))
    left = [(i, day() if i % 9 else None) for i in range(90)]
    facts = [(rng.choice("xyz"), day(), float(i)) for i in range(25)] + [("w", date(2030, 1, 1), 1.0), ("x", None, 2.0)]
    wanted = set()
    for i, d in left:
        for s in "xyzw":
            known = [(f[1], f[2]) for f in facts if f[0] == s and d and f[1] and f[1] <= d]
            if known:
                wanted.add((i, s, max(known)[1]))
    got = asof.valid_at(spark.createDataFrame(left, "i long, d date"), spark.createDataFrame(facts, "series string, known date, v double"), "series", "d", "known", "v")
    assert {(r.i, r.series, r.v) for r in got.collect()} == wanted
