"""Requests to services: a limiter that delays calls, a cache with time to live, and attempts that a failure holds back.

Times are whole numbers (microseconds); requests of a key are taken in the order of (time, id), ids are unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import as_of, running_last
from tidemark.sources.shared import checkpointed

DAY = 86_400_000_000


def day(t: Column) -> Column:
    return F.floor(t / DAY).cast("long")


def released(calls: DataFrame, keys: list[str], at: str, id_col: str, most: int, per: int) -> DataFrame:
    """Adds ``released``: when each call goes out if at most ``most`` calls of a key may within ``per``, and a call that must
    wait holds up those behind it.

    The i-th call goes out at the latest of its own time, the release before it and that of call i - most plus per, so at
    max over j <= i of a_j + per * floor((i - j) / most). With i = most * q + r that is a prefix maximum of a_j - per * q_j
    for each remainder r, taken day by day with what the days before end with; one key's calls need no one task.
    """
    of_day = Window.partitionBy(*keys, "_day").orderBy(at, id_col)
    days = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    rows = calls.withColumn("_day", day(F.col(at)))
    counts = rows.groupBy(*keys, "_day").agg(F.count("*").alias("_n"))
    before = counts.select(*keys, "_day", F.coalesce(F.sum("_n").over(days), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_k", F.row_number().over(of_day)).join(before, [*keys, "_day"]).withColumn("_i", F.col("_before") + F.col("_k") - 1)
    placed = placed.withColumns({"_q": F.floor(F.col("_i") / most).cast("long"), "_r": F.pmod("_i", F.lit(most)).cast("int")}).withColumn("_x", F.col(at) - F.lit(per) * F.col("_q"))
    # For r the largest of those whose remainder is at most r, and with the last r of all.
    upto = lambda r: F.when(F.col("_r") <= r, F.col("_x"))
    ends = placed.groupBy(*keys, "_day").agg(*(F.max(upto(r)).alias(f"_e{r}") for r in range(most)))
    ends = ends.select(*keys, "_day", F.array(*(F.max(f"_e{r}").over(days) for r in range(most))).alias("_ends"))
    so_far = of_day.rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("_own", F.array(*(F.max(upto(r)).over(so_far) for r in range(most)))).join(ends, [*keys, "_day"])
    best = lambda r: F.greatest(F.get("_own", r), F.get("_ends", r))
    out = F.lit(per) * F.col("_q") + F.greatest(best(F.col("_r")), best(F.lit(most - 1)) - per)
    return own.select(*calls.columns, out.alias("released"))


def anchored(points: DataFrame, keys: list[str], at: str, id_col: str, gap: int, skip: Column | None = None) -> DataFrame:
    """(id) of the points of a chain: the first of each key, and from one of them on the first that is ``gap`` later at
    least. Where ``skip`` holds the next is the point right after.

    Each point is linked to the one that would follow it; the chain is found by doubling the links, in as many rounds as the
    logarithm of the longest chain, which time bounds and not the number of points.
    """
    i = F.col(id_col)
    asks = points.select(*keys, i.alias("_id"), F.col(at).alias("_own"), (F.col(at) + gap).alias("_later"), *([skip.alias("_skip")] if skip is not None else []))
    links = as_of(asks, points, keys, "_later", at, id_col, "_next", day, forward=True)
    follower = F.col("_next.v")
    if skip is not None:
        following = points.select(*keys, F.col(at).alias("_t"), i.alias("_id2"), F.struct(i.alias("v")).alias("_me"))
        after = running_last(following, keys, day(F.col("_t")), ["_t", "_id2"], "_me", "_after", forward=True, strict=True).select(F.col("_id2"), F.col("_after.v").alias("_right_after"))
        links = links.join(after, F.col("_id") == F.col("_id2"))
        follower = F.when(F.col("_skip"), F.col("_right_after")).otherwise(follower)
    links = checkpointed(links.select(F.col("_id").alias("a"), follower.alias("b")).where("b IS NOT NULL"))
    marks = points.groupBy(*keys).agg(F.min_by(i, F.struct(at, id_col)).alias("a")).select("a")
    while True:
        marks = checkpointed(marks.unionByName(marks.join(links, "a").select(F.col("b").alias("a"))))
        links = checkpointed(links.join(links.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
        if links.isEmpty():
            return marks.select(F.col("a").alias(id_col))


def read_through(requests: DataFrame, keys: list[str], at: str, id_col: str, payload: str, ttl: int) -> DataFrame:
    """Adds ``origin`` (fetch or cache) and ``value`` of requests that go through a cache: a key is fetched if what is stored
    is older than ``ttl``; a fetch gives the request's own ``payload``, and a null payload is not stored."""
    fetched = anchored(requests, keys, at, id_col, ttl + 1, F.col(payload).isNull()).withColumnRenamed(id_col, "_fetch")
    rows = requests.join(fetched, F.col(id_col) == F.col("_fetch"), "left")
    rows = rows.withColumn("_stored", F.when(F.col("_fetch").isNotNull() & F.col(payload).isNotNull(), F.struct(F.col(payload).alias("v"))))
    rows = running_last(rows, keys, day(F.col(at)), [at, id_col], "_stored", "_last")
    hit = F.col("_fetch").isNull()
    return rows.select(*requests.columns, F.when(hit, "cache").otherwise("fetch").alias("origin"), F.when(hit, F.col("_last.v")).otherwise(F.col(payload)).alias("value"))


def folded(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable, schema: str) -> DataFrame:
    """Rows of each key in order through ``step(state, row)``, which changes the state and returns an output row or None.

    A task takes its keys one after the other from sorted Arrow batches, so it holds one key's state, not its rows.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, names = object(), None, [f.split()[0] for f in schema.split(", ")]
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != now:
                    now, state = key, start()
                if (line := step(state, row)) is not None:
                    out.append(line)
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fold, schema)


def attempts(rows: DataFrame, key: str, at: str, id_col: str, topic: str, failed: str, refused: str, cooldown: int) -> DataFrame:
    """(id, outcome) of attempts to reach a service per ``key``: denied for a topic that has been refused before, held within
    ``cooldown`` of the last attempt that failed, else tried. Only an attempt that is made can fail or be refused; the state
    of a key is one time and its refused topics."""

    def step(state: dict, row) -> tuple:
        t, subject = getattr(row, at), getattr(row, topic)
        if subject in state["refused"]:
            return getattr(row, id_col), "denied"
        if state["failure"] is not None and t - state["failure"] < cooldown:
            return getattr(row, id_col), "held"
        if getattr(row, failed):
            state["failure"] = t
        elif getattr(row, refused):
            state["refused"].add(subject)
        return getattr(row, id_col), "tried"

    start = lambda: {"failure": None, "refused": set()}
    kind = rows.schema[id_col].dataType.simpleString()
    return folded(rows.select(key, at, id_col, topic, failed, refused), [key], [at, id_col], start, step, f"{id_col} {kind}, outcome string")
