"""What was known last, or comes next, in time: by buckets, so that no key's whole history meets in one task.

Rows are dealt by key and bucket of time. Within a bucket a running window answers; what a bucket ends with is one line, and
those lines are carried on over the buckets of a key by a scan that has a line a bucket only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month(d: Column) -> Column:
    """The bucket of a date: months since 1970."""
    return F.year(d) * 12 + F.month(d)


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[f"of{name}"])
    return condition


def running_last(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, out: str, *, forward: bool = False, strict: bool = False) -> DataFrame:
    """Adds ``out``: the last ``value`` that is not null up to each row in ``order`` (before it if ``strict``), per keys.

    ``bucket`` must not fall as ``order`` rises. With ``forward`` it is the first one from each row on. Rows with a null
    bucket get null.
    """
    flip, pick = (F.desc, F.min_by) if forward else (F.asc, F.max_by)
    dealt = rows.withColumn("_b", bucket)
    within = Window.partitionBy(*keys, "_b").orderBy(*(flip(c) for c in order))
    inside = F.last(value, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1 if strict else 0))
    # With min_by and max_by rows without a value must not win: they are left out of the order.
    ends = dealt.groupBy(*keys, "_b").agg(pick(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    over = Window.partitionBy(*keys).orderBy(flip("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.where("_b IS NOT NULL").select(*(F.col(k).alias(f"of{k}") for k in keys), F.col("_b").alias("of_b"), F.last("_end", ignorenulls=True).over(over).alias("_carried"))
    found = dealt.withColumn("_inside", inside)
    joined = found.join(carried, _same(found, carried, [*keys, "_b"]), "left")
    answer = F.when(F.col("_b").isNotNull(), F.coalesce("_inside", "_carried"))
    return joined.select(*(found[c] for c in rows.columns if c != out), answer.alias(out))


def as_of(left: DataFrame, facts: DataFrame, keys: list[str], left_time: str, fact_time: str, value: str, out: str, bucket: Callable[[Column], Column], *, forward: bool = False) -> DataFrame:
    """Adds ``out``, a struct (at, v) of the newest fact at or before each row's time (``forward``: the next at or after it).

    Facts without a time are no facts; of facts of equal time the largest value counts (forward: the smallest). Rows
    without a time, or without a fact, get null.
    """
    is_fact = F.lit(1 if forward else 0)  # facts come before the rows that ask at the same time, in either direction
    known = facts.where(F.col(fact_time).isNotNull()).select(*keys, F.col(fact_time).alias("_t"), is_fact.alias("_src"), F.col(value).alias("_v"), F.struct(F.col(fact_time).alias("at"), F.col(value).alias("v")).alias("_fact"))
    asks = left.withColumns({"_t": F.col(left_time), "_src": 1 - is_fact})
    both = asks.unionByName(known, allowMissingColumns=True)
    found = running_last(both, keys, bucket(F.col("_t")), ["_t", "_src", "_v"], "_fact", out, forward=forward)
    return found.where(F.col("_src") == 1 - is_fact).select(*(c for c in left.columns if c != out), out)


def valid_at(left: DataFrame, facts: DataFrame, key: str, left_day: str, fact_day: str, value: str, *, days: int = 32, shares: int = 8) -> DataFrame:
    """Every row of ``left`` with each series of ``facts`` that has a value on its day: adds ``key`` and ``value``.

    A fact holds from its day until the next one of its series. It is laid into the buckets of ``days`` days that it holds
    in, and rows meet the facts of their bucket only, in ``shares`` shares of them: no row meets all facts. Rows before a
    series' first fact, or without a day, have no line for it; of facts of one series and day the largest value counts.
    """
    number = lambda c: F.unix_date(c)
    bucket = lambda n: F.floor(n / days).cast("long")
    one_a_day = facts.where(F.col(fact_day).isNotNull()).groupBy(key, fact_day).agg(F.max(value).alias(value))
    until = left.agg(F.max(left_day).alias("_horizon"))  # one line
    following = F.lead(fact_day).over(Window.partitionBy(key).orderBy(fact_day))
    spans = one_a_day.withColumn("_next", following).join(F.broadcast(until)).where(F.col(fact_day) <= F.col("_horizon"))
    last = F.coalesce(number(F.col("_next")) - 1, number(F.col("_horizon")))
    spans = spans.select(key, value, number(F.col(fact_day)).alias("_from"), last.alias("_to"))
    laid = spans.withColumn("_b", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_to"))))).withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    asks = left.withColumns({"_n": number(F.col(left_day)), "_mine": F.pmod(F.xxhash64(*left.columns), F.lit(shares)).cast("int")}).withColumn("_at", bucket(F.col("_n")))
    met = asks.join(laid, (F.col("_at") == F.col("_b")) & (F.col("_mine") == F.col("_share")) & F.col("_n").between(F.col("_from"), F.col("_to")))
    return met.select(*(asks[c] for c in left.columns), key, value)
