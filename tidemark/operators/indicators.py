"""Technical indicators as window aggregates, and recursive ones as folds over an array of closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import over_full


def rolling(bars: DataFrame) -> DataFrame:
    """Adds the indicators that are plain window aggregates, for every bar, with one shuffle by ticker."""
    day = Window.partitionBy("ticker").orderBy("d")
    prev = F.lag("c").over(day)
    out = bars.withColumn("tr", F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - prev), F.abs(F.col("l") - prev))).withColumn("tr", F.when(prev.isNotNull(), F.col("tr")))
    twenty, fourteen = day.rowsBetween(-19, 0), day.rowsBetween(-13, 0)
    out = out.withColumns(
        {
            "sma20": over_full(F.avg("c"), 20), "sma50": over_full(F.avg("c"), 50), "sma200": over_full(F.avg("c"), 200), "sd20": over_full(F.stddev_pop("c"), 20),
            "atr14": F.when(F.count("tr").over(fourteen) == 14, F.avg("tr").over(fourteen)), "avg_volume_20": over_full(F.avg("v"), 20), "high_20": over_full(F.max("h"), 20), "high_252": over_full(F.max("h"), 252),
            "ret": F.try_divide(F.col("c"), F.when(prev != 0, prev)) - 1, "bar": F.row_number().over(day), "n": F.count("*").over(Window.partitionBy("ticker")),
        }
    )
    upper, lower = F.col("sma20") + 2 * F.col("sd20"), F.col("sma20") - 2 * F.col("sd20")
    width = F.when(F.col("sma20") == 0, 0.0).otherwise((upper - lower) / F.col("sma20") * 100)
    return out.withColumns({"bb_upper": upper, "bb_lower": lower, "bb_width": width, "vol20": F.when(F.count("ret").over(twenty) == 20, F.stddev_pop("ret").over(twenty))})


def ema(closes: Column, n: int) -> Column:
    """Seeded with the mean of the first n of the array given; null for fewer."""
    k = 2.0 / (n + 1)
    seed = F.aggregate(F.slice(closes, 1, n), F.lit(0.0), lambda a, x: a + x) / n
    return F.when(F.size(closes) >= n, F.aggregate(F.slice(closes, n + 1, F.greatest(F.size(closes) - n, F.lit(0))), seed, lambda e, x: x * k + e * (1 - k)))


def rsi(closes: Column, n: int = 14) -> Column:
    """Wilder's, seeded with the means of the first n changes of the array given; 100 without losses."""
    size = F.size(closes)
    moves = F.zip_with(F.slice(closes, 2, F.greatest(size - 1, F.lit(0))), F.slice(closes, 1, F.greatest(size - 1, F.lit(0))), lambda b, a: b - a)
    first = F.slice(moves, 1, n)
    mean = lambda sign: F.aggregate(first, F.lit(0.0), lambda a, x: a + F.greatest(x * sign, F.lit(0.0))) / n
    step = lambda s, x: F.struct(((s["g"] * (n - 1) + F.greatest(x, F.lit(0.0))) / n).alias("g"), ((s["l"] * (n - 1) + F.greatest(-x, F.lit(0.0))) / n).alias("l"))
    done = lambda s: F.when(s["l"] == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + s["g"] / s["l"]))
    rest = F.slice(moves, n + 1, F.greatest(size - 1 - n, F.lit(0)))
    return F.when(size > n, F.aggregate(rest, F.struct(mean(1.0).alias("g"), mean(-1.0).alias("l")), step, done))


#: Bars of a block of ``wilder``: what came before the block before last weighs less than a double can tell.
BLOCK = 512


def wilder(frame: DataFrame, columns: dict[str, str], n: int = 14) -> DataFrame:
    """Adds Wilder's average of each column (given as name: column) for every bar, over all of the ticker's bars so far.

    ``frame`` has ticker, d and bar (from 1); bar 1 has no move, the mean of the moves of bars 2 to n + 1 is the first
    value. A running average is a sum with weights that fall by the bar. It is taken from the start of a block of bars, so
    that no weight overflows, and what the blocks before leave is added: window sums only, no arrays.
    """
    decay = 1 - 1 / n
    day = Window.partitionBy("ticker").orderBy("d")
    at = (F.col("bar") - 1).cast("long")
    place = F.pmod(at, F.lit(BLOCK))
    within = Window.partitionBy("ticker", "_block").orderBy("d")
    earlier = day.rowsBetween(Window.unboundedPreceding, -1)
    out = frame.withColumns({"_block": F.floor(at / BLOCK), "_place": place.cast("double"), "_ends": place == BLOCK - 1})
    for name, column in columns.items():
        first = F.avg(column).over(day.rowsBetween(1 - n, 0))
        moved = F.when(F.col("bar") == n + 1, first).when(F.col("bar") > n + 1, F.col(column) / n).otherwise(0.0)
        out = out.withColumn("_x", moved)
        out = out.withColumn("_own", F.sum(F.col("_x") * F.pow(F.lit(1 / decay), "_place")).over(within) * F.pow(F.lit(decay), "_place"))
        out = out.withColumn("_last", F.coalesce(F.last(F.when(F.col("_ends"), F.col("_own")), ignorenulls=True).over(earlier), F.lit(0.0)))
        out = out.withColumn("_left", F.coalesce(F.last(F.when(F.col("_ends"), F.col("_own") + F.col("_last") * decay**BLOCK), ignorenulls=True).over(earlier), F.lit(0.0)))
        out = out.withColumn(name, F.when(F.col("bar") > n, F.col("_own") + F.col("_left") * F.pow(F.lit(decay), F.col("_place") + 1)))
    return out.drop("_block", "_place", "_ends", "_x", "_own", "_last", "_left")


def rsi_series(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds rsi14 for every bar from the n-th change on, over all of the ticker's bars so far; 100 without losses."""
    day = Window.partitionBy("ticker").orderBy("d")
    move = F.coalesce(F.col("c") - F.lag("c").over(day), F.lit(0.0))
    moves = bars.withColumns({"bar": F.row_number().over(day), "_up": F.greatest(move, F.lit(0.0)), "_down": F.greatest(-move, F.lit(0.0))})
    out = wilder(moves, {"_g": "_up", "_l": "_down"}, n)
    return out.withColumn("rsi14", F.when(F.col("_l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("_g") / F.col("_l")))).drop("_up", "_down", "_g", "_l")


def macd(closes: Column) -> Column:
    """struct(macd, signal, hist) of the last bar in one fold; null for fewer than 35 closes."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("fast"), F.lit(0.0).alias("slow"), F.lit(0.0).alias("sig"))

    def step(s, x):
        i = s["i"]
        fast = F.when(i < 12, s["fast"] + x / 12).otherwise(x * (2 / 13) + s["fast"] * (1 - 2 / 13))
        slow = F.when(i < 26, s["slow"] + x / 26).otherwise(x * (2 / 27) + s["slow"] * (1 - 2 / 27))
        line = fast - slow
        sig = F.when(i < 25, 0.0).when(i < 34, s["sig"] + line / 9).otherwise(line * 0.2 + s["sig"] * 0.8)
        return F.struct((i + 1).alias("i"), fast.alias("fast"), slow.alias("slow"), sig.alias("sig"))

    done = lambda s: F.struct((s["fast"] - s["slow"]).alias("macd"), s["sig"].alias("signal"), (s["fast"] - s["slow"] - s["sig"]).alias("hist"))
    return F.when(F.size(closes) >= 35, F.aggregate(closes, zero, step, done))


def recursive(frame: DataFrame, closes: str = "closes") -> DataFrame:
    """Adds ema20, rsi14, macd, macd_signal and macd_hist from an array of closes."""
    c = F.col(closes)
    out = frame.withColumns({"ema20": ema(c, 20), "rsi14": rsi(c), "_m": macd(c)})
    return out.withColumns({"macd": F.col("_m.macd"), "macd_signal": F.col("_m.signal"), "macd_hist": F.col("_m.hist")}).drop("_m")


def trend_of(higher: Column) -> Column:
    """Up, down or flat from an array of closes of a longer period: mean of the last 10 against the last 30."""
    n = F.size(higher)
    tail = lambda k: F.aggregate(F.slice(higher, n - k + 1, k), F.lit(0.0), lambda a, x: a + x) / k
    ten, thirty = tail(F.lit(10)), tail(F.least(n, F.lit(30)))
    return F.when(n < 10, "Data unavailable").when(ten > thirty, "Uptrend").when(ten < thirty, "Downtrend").otherwise("Flat")


def week_ends(bars: Column) -> Column:
    """The closes of the last bar of each calendar week, the last 30 of them, from an array of structs (d, c) by day."""
    week = lambda x: F.date_trunc("week", x["d"])
    ends = F.filter(bars, lambda x, i: (i == F.size(bars) - 1) | (week(F.get(bars, i + 1)) != week(x)))
    return F.transform(F.slice(ends, F.greatest(F.size(ends) - 29, F.lit(1)), 30), lambda x: x["c"])


def weekly_trend(bars: DataFrame) -> DataFrame:
    """(ticker, trend) from the last closes of calendar weeks."""
    weeks = bars.groupBy("ticker", F.date_trunc("week", "d").alias("wk")).agg(F.max_by("c", "d").alias("wc"))
    rows = weeks.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("wk")))).where("k <= 30")
    arrays = rows.groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("wk", "wc"))), lambda s: s["wc"]).alias("hc"))
    return arrays.select("ticker", trend_of(F.col("hc")).alias("trend"))


def volume_profile(bars: DataFrame, lookback: int = 260, bins: int = 24, share: float = 0.7) -> DataFrame:
    """(ticker, poc, vah, val) of the last bars: the bin of most volume and the bounds of the fewest bins that hold the share.

    Bins of equal volume rank by number, the higher first, as the reverse of an ascending sort does.
    """
    last = bars.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d")))).where(F.col("k") <= lookback)
    by = Window.partitionBy("ticker")
    ranged = last.withColumns({"lo": F.min("l").over(by), "hi": F.max("h").over(by)}).where("hi > lo")
    at = F.floor(((F.col("h") + F.col("l") + F.col("c")) / 3 - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))
    filled = ranged.groupBy("ticker", "lo", "hi", F.least(F.greatest(at, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.sum("v").alias("bv"))
    order = Window.partitionBy("ticker").orderBy(F.desc("bv"), F.desc("bin"))
    ranked = filled.withColumns({"before": F.sum("bv").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bv"), "total": F.sum("bv").over(by)})
    first = Window.partitionBy("ticker").orderBy(F.desc("bv"), F.asc("bin"))
    kept = ranked.withColumn("place", F.row_number().over(first)).where((F.col("before") < F.col("total") * share) | (F.col("place") == 1))
    step = (F.col("hi") - F.col("lo")) / bins
    inside = F.col("before") < F.col("total") * share
    return kept.groupBy("ticker").agg(
        F.max(F.when(F.col("place") == 1, F.col("lo") + (F.col("bin") + 0.5) * step)).alias("poc"),
        F.max(F.when(inside, F.col("lo") + (F.col("bin") + 1) * step)).alias("vah"), F.min(F.when(inside, F.col("lo") + F.col("bin") * step)).alias("val"),
    )
