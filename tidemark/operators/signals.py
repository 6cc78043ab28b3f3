"""Scores, verdicts and recommendation blocks as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp, present_weight, weighted_present

#: What each part of the composite counts.
COMPOSITE = {"technical": 0.45, "fundamental": 0.25, "news": 0.15, "risk": 0.15}


def mechanical_score(frame: DataFrame) -> DataFrame:
    """Adds score, label and reasons from rsi14, c, sma50, sma200, macd_hist and trend. Equality is the bearish branch."""
    rsi, c, s50, s200, hist, trend = (F.col(x) for x in ("rsi14", "c", "sma50", "sma200", "macd_hist", "trend"))
    steps: list[tuple[Column, int, Column]] = [
        (rsi < 30, 30, F.lit("oversold")), ((rsi >= 30) & (rsi < 45), 10, F.lit("below neutral")), (rsi > 70, -10, F.lit("overbought")), ((rsi <= 70) & (rsi > 60), -5, F.lit("elevated")),
        (c > s50, 10, F.lit("above 50-day SMA")), (c <= s50, -10, F.lit("below 50-day SMA")), (c > s200, 10, F.lit("above 200-day SMA")), (c <= s200, -10, F.lit("below 200-day SMA")),
        (s50 > s200, 10, F.lit("golden alignment")), (s50 <= s200, -10, F.lit("dead alignment")), (hist > 0, 5, F.lit("MACD histogram positive")), (hist <= 0, -5, F.lit("MACD histogram negative")),
        (trend == "Uptrend", 10, F.lit("weekly uptrend")), (trend == "Downtrend", -10, F.lit("weekly downtrend")),
    ]
    total = sum((F.when(test, F.lit(points)).otherwise(0) for test, points, _ in steps), F.lit(0))
    reasons = F.array_compact(F.array(*[F.when(test, F.concat(text, F.lit(f" ({points:+d})"))) for test, points, text in steps]))
    out = frame.withColumn("score", clamp(total, -100, 100)).withColumn("reasons", reasons)
    label = F.when(F.col("score") >= 60, "strong buy").when(F.col("score") >= 25, "buy").when(F.col("score") <= -60, "strong sell").when(F.col("score") <= -25, "sell").otherwise("hold")
    return out.withColumn("label", label)


def fundamental_score(frame: DataFrame) -> Column:
    """From n_flags, rev_yoy, net_margin, price and target_mean, within -100 and 100."""
    rev, net = F.col("rev_yoy"), F.col("net_margin")
    upside = F.when((F.col("target_mean") != 0) & (F.col("price") != 0), F.col("target_mean") / F.col("price") - 1)
    points = -20 * F.col("n_flags") + F.when(rev > 0.15, 25).when(rev > 0.05, 10).otherwise(0) + F.when(net > 0.15, 20).when(net > 0.05, 10).otherwise(0)
    return clamp(points + F.when(upside > 0.2, 25).when(upside > 0.05, 10).when(upside < -0.05, -15).otherwise(0), -100, 100)


def news_score(average: Column) -> Column:
    return clamp((average * 200).cast("int"), -100, 100)


def risk_score(weight: Column, correlated: Column) -> Column:
    return F.when(weight > 0.2, -50).when(weight > 0.1, -20).otherwise(0) + F.when(correlated, -15).otherwise(0)


def composite(frame: DataFrame) -> DataFrame:
    """Adds composite, coverage and conviction from the columns of COMPOSITE; missing parts drop out."""
    out = frame.withColumns({"composite": weighted_present(COMPOSITE), "coverage": present_weight(COMPOSITE)})
    size = F.abs(F.col("composite"))
    high, medium = (size >= 50) & (F.col("coverage") >= 0.75), (size >= 30) & (F.col("coverage") >= 0.5)
    return out.withColumn("conviction", F.when(high, "high").when(medium, "medium").otherwise("low"))


def size_tier(conviction: Column, rr: Column) -> Column:
    """Full, Half, Starter or Pass from conviction and reward over risk."""
    rr = F.coalesce(rr, F.lit(0.0))
    half = (conviction == "high") | ((conviction == "medium") & (rr >= 2))
    return F.when((conviction == "high") & (rr >= 1.5), "Full").when(half, "Half").when(conviction == "medium", "Starter").otherwise("Pass")


def tier_weight(tier: Column) -> Column:
    return F.when(tier == "Full", 5.0).when(tier == "Half", 3.0).when(tier == "Starter", 1.5).otherwise(0.0)


def red_lines(fcf: Column, net: Column, debt_equity: Column, rev: Column, short: Column) -> Column:
    """The vetoes that hold, as an array of names."""
    burning = (fcf < 0) & (net < 0) & (debt_equity > 200)
    shrinking = (rev < 0) & (net < 0) & (short > 0.15)
    return F.array_compact(F.array(F.when(burning, F.lit("burning cash with heavy debt")), F.when(shrinking, F.lit("shrinking, unprofitable and shorted"))))


def recommendation(frame: DataFrame) -> DataFrame:
    """Adds entry_low, entry_high, base_target, bull_target, bear_stop, rr, tier and weight_pct.

    From price, atr14, target_mean, atr_stop, conviction and red_lines; rows without price or ATR go.
    """
    price, atr = F.col("price"), F.col("atr14")
    out = frame.where(price.isNotNull() & atr.isNotNull())
    bull = F.when(F.col("target_mean") != 0, F.bround("target_mean", 2)).otherwise(F.bround(price + 3 * atr, 2))
    out = out.withColumns({"bull_target": bull, "bear_stop": F.coalesce("atr_stop", F.bround(price - 2 * atr, 2)), "entry_low": F.bround(price - 0.5 * atr, 2), "entry_high": F.bround(price + 0.5 * atr, 2)})
    out = out.withColumn("base_target", F.bround((price + F.col("bull_target")) / 2, 2))
    out = out.withColumn("rr", F.when(price > F.col("bear_stop"), F.bround((F.col("base_target") - price) / (price - F.col("bear_stop")), 2)))
    tier = F.when(F.size("red_lines") > 0, "Pass").otherwise(size_tier(F.col("conviction"), F.col("rr")))
    return out.withColumn("tier", tier).withColumn("weight_pct", tier_weight(F.col("tier")))
