"""Candle patterns from the bar, the two before it and the trend into them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The five bars of a trend, a doji's body, a shadow's length, a trend's move.
TREND_BARS, DOJI_BODY, SHADOW, MOVE = 5, 0.1, 2.0, 0.02


def patterns(bars: DataFrame) -> DataFrame:
    """Adds ``patterns``, an array of names, to every bar; empty for the first seven bars and without opens."""
    day = Window.partitionBy("ticker").orderBy("d")
    back = lambda c, k: F.lag(c, k).over(day)
    cols = {"_i": F.row_number().over(day)}
    for k in range(3):
        o, c, h, low = ((F.col(x) if k == 0 else back(x, k)) for x in ("o", "c", "h", "l"))
        cols |= {f"_o{k}": o, f"_c{k}": c, f"_h{k}": h, f"_l{k}": low, f"_b{k}": F.abs(c - o), f"_u{k}": c > o}
    for k in (1, 2):
        then = back("c", k + TREND_BARS)
        move = F.try_divide(back("c", k) - then, then)
        cols[f"_t{k}"] = F.when(move < -MOVE, "down").when(move > MOVE, "up").otherwise("flat")
    x = bars.withColumns(cols)
    o0, c0, h0, l0, b0, u0, o1, c1, b1, u1, o2, c2, b2, u2 = (F.col(f"_{n}") for n in "o0 c0 h0 l0 b0 u0 o1 c1 b1 u1 o2 c2 b2 u2".split())
    top, low = F.greatest(o0, c0), F.least(o0, c0)
    rules = {
        "doji": (h0 - l0 > 0) & (b0 < DOJI_BODY * (h0 - l0)),
        "bullish_engulfing": u0 & ~u1 & (o0 <= c1) & (c0 >= o1) & (b0 > b1),
        "bearish_engulfing": ~u0 & u1 & (o0 >= c1) & (c0 <= o1) & (b0 > b1),
        "hammer": (b0 > 0) & (F.col("_t1") == "down") & (low - l0 >= SHADOW * b0) & (h0 - top <= b0),
        "shooting_star": (b0 > 0) & (F.col("_t1") == "up") & (h0 - top >= SHADOW * b0) & (low - l0 <= b0),
    }
    inside = (b1 > 0) & (b0 < b1 * 0.5) & (top <= F.greatest(o1, c1)) & (low >= F.least(o1, c1))
    rules |= {"bullish_harami": inside & ~u1, "bearish_harami": inside & u1}
    star = (b1 < b2 * 0.5) & (b2 > 0)
    rules |= {
        "morning_star": ~u2 & star & u0 & (c0 > (o2 + c2) / 2) & (F.col("_t2") == "down"),
        "evening_star": u2 & star & ~u0 & (c0 < (o2 + c2) / 2) & (F.col("_t2") == "up"),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    out = x.withColumn("patterns", F.when(F.col("_i") >= TREND_BARS + 3, found).otherwise(F.array().cast("array<string>")))
    return out.drop(*cols)
