"""Strategy verdicts: a registry of column builders, one line per ticker and strategy that speaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name to score column; a null score is no verdict. Add a strategy by adding a line.
REGISTRY: dict[str, Callable[[], Column]] = {
    "MA Crossover": lambda: F.when(F.col("sma50") > F.col("sma200"), 40).when(F.col("sma50").isNotNull() & F.col("sma200").isNotNull(), -40),
    "RSI Reversion": lambda: F.when(F.col("rsi14") < 30, 35).when(F.col("rsi14") > 70, -35),
    "MACD Momentum": lambda: F.when(F.col("macd_hist") > 0, 30).when(F.col("macd_hist").isNotNull(), -30),
    "Trend Following": lambda: F.when((F.col("c") > F.col("sma200")) & (F.col("trend") == "Uptrend"), 45)
    .when((F.col("c") <= F.col("sma200")) & (F.col("trend") == "Downtrend"), -45).when(F.col("c") > F.col("sma200"), 20).when(F.col("sma200").isNotNull(), -20),
    "Bollinger Breakout": lambda: F.when(F.col("c") > F.col("bb_upper"), 30).when(F.col("c") < F.col("bb_lower"), -30),
    "Volume Surge": lambda: F.when((F.col("avg_volume_20") > 0) & (F.col("v") >= 2 * F.col("avg_volume_20")), F.when(F.coalesce("macd_hist", F.lit(0.0)) > 0, 25).otherwise(-25)),
    "Value + Quality": lambda: F.when((F.col("pe_ttm") > 0) & (F.col("pe_ttm") < 20) & (F.col("rev_yoy") > 0.1), 35).when((F.col("pe_ttm") > 40) & (F.col("rev_yoy") < 0.05), -25),
}


def verdicts(snapshots: DataFrame, registry: dict[str, Callable[[], Column]] = REGISTRY) -> DataFrame:
    """(ticker, strategy, stance, score) in one pass over the snapshots."""
    rows = F.array(*[F.struct(F.lit(name).alias("strategy"), score().cast("int").alias("score")) for name, score in registry.items()])
    lines = snapshots.select("ticker", F.explode(F.filter(rows, lambda r: r["score"].isNotNull())).alias("r"))
    return lines.select("ticker", "r.strategy", F.when(F.col("r.score") > 0, "bullish").otherwise("bearish").alias("stance"), "r.score")


def panel(found: DataFrame) -> DataFrame:
    """Mean score and counts of bulls and bears per ticker."""
    return found.groupBy("ticker").agg(F.avg("score").alias("net_score"), F.count_if(F.col("score") > 0).alias("bull"), F.count_if(F.col("score") < 0).alias("bear"), F.count("*").alias("n"))
