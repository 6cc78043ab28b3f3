"""Event study: sampled bars, what came after them, and what it says of a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bars before the first event, bars between events, bars an event is followed.
HISTORY, STEP, WINDOW = 200, 5, 60


def sampled(numbered: DataFrame, bar: str = "rn") -> DataFrame:
    """Every fifth bar with enough history before and enough bars after it."""
    return numbered.where((F.col(bar) >= HISTORY) & ((F.col(bar) - HISTORY) % STEP == 0) & (F.col(bar) <= F.col("n") - WINDOW))


def first_touch(frame: DataFrame) -> DataFrame:
    """Adds si, ti (the bar of the following ones that first touches stop and target; 0 for none) and resolution.

    A bar that touches both counts as the stop.
    """
    si = F.array_position(F.transform("lows", lambda x: x <= F.col("stop")), True)
    ti = F.array_position(F.transform("highs", lambda x: x >= F.col("target")), True)
    out = frame.withColumns({"si": si, "ti": ti})
    stop = (F.col("si") > 0) & ((F.col("ti") == 0) | (F.col("si") <= F.col("ti")))
    return out.withColumn("resolution", F.when(stop, "stop").when(F.col("ti") > 0, "target").otherwise("none"))


def events(rolled: DataFrame) -> DataFrame:
    """Events with fwd20, fwd60, mech_score and resolution. Only history goes into the levels, only later bars into outcomes.

    The bars of a ticker are one array; only the sampled ones are given the stretch of bars after them.
    """
    kept = [c for c in ("d", "bar", "n", "c", "h", "l", "atr14", "sma50", "sma200") if c in rolled.columns]
    arrays = rolled.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("bar", *[c for c in kept if c != "bar"]))).alias("a"))
    size = F.size("a")
    at = F.when(size >= HISTORY + WINDOW, F.sequence(F.lit(HISTORY), size - WINDOW, F.lit(STEP)))
    close = lambda i, k: F.element_at("a", i + k)["c"]
    found = F.transform(at, lambda i: F.struct(F.element_at("a", i).alias("e"), F.slice("a", i + 1, WINDOW).alias("after"), close(i, 20).alias("c20"), close(i, 60).alias("c60")))
    out = arrays.select("ticker", F.explode(found).alias("x")).select("ticker", "x.e.*", "x.after", "x.c20", "x.c60").where("atr14 IS NOT NULL")
    out = out.withColumns({
        "fwd20": F.col("c20") / F.col("c") - 1, "fwd60": F.col("c60") / F.col("c") - 1, "lows": F.transform("after", lambda x: x["l"]), "highs": F.transform("after", lambda x: x["h"]),
        "stop": F.col("c") - 2 * F.col("atr14"), "target": F.col("c") + 1.5 * F.col("atr14"),
    })
    side = lambda a, b: F.when(F.col(a) > F.col(b), 10).otherwise(-10)
    return first_touch(out.drop("after", "c20", "c60")).withColumn("mech_score", side("c", "sma50") + side("c", "sma200") + side("sma50", "sma200"))


def edges(found: DataFrame, least: int = 30) -> DataFrame:
    """Per stance of at least ``least`` events: mean forward returns, edge over all events, win rate."""
    base = found.agg(F.avg("fwd60").alias("base60"))
    per = found.groupBy("stance").agg(F.count("*").alias("n"), F.avg("fwd60").alias("mean60"), F.avg("fwd20").alias("mean20"), F.avg((F.col("fwd60") > 0).cast("double")).alias("win")).where(F.col("n") >= least)
    joined = per.join(F.broadcast(base))  # one line
    return joined.select("stance", "n", (F.col("mean60") * 100).alias("fwd60_pct"), ((F.col("mean60") - F.col("base60")) * 100).alias("edge60_pct"), (F.col("mean20") * 100).alias("fwd20_pct"), F.col("win").alias("win_rate"))


def quintiles(found: DataFrame) -> DataFrame:
    """Mean forward return by score between the score's quintile values; equal scores stay together."""
    cut = found.agg(F.percentile("mech_score", F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)])).alias("e"))
    s = F.col("mech_score")
    q = F.when(s <= F.col("e")[0], 1).when(s <= F.col("e")[1], 2).when(s <= F.col("e")[2], 3).when(s <= F.col("e")[3], 4).otherwise(5)
    return found.join(F.broadcast(cut)).groupBy(q.alias("q")).agg(F.count("*").alias("n"), (F.avg("fwd60") * 100).alias("fwd60_pct"))
