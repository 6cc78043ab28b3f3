"""Bars, indicators, candles, strategies and the backtest: queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import backtest, candles, indicators, signals, strategies
from tidemark.plans.sql import SCORE, define, twin
from tidemark.sources import tables as T

QUERIES, ORACLE_SQL = {}, {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = twin(sql)
        return f

    return keep


def rounded(df, digits=6, **other):
    """All doubles rounded for comparison."""
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def last_bars(spark, sf_dir, ticker="p_brand"):
    return indicators.rolling(T.bars(spark, sf_dir, ticker)).where("bar = n")


def snapshot(spark, sf_dir, ticker="p_brand"):
    """One line per ticker with every indicator, the candles of the last bar and the mechanical signal."""
    rolled = candles.patterns(indicators.rolling(T.bars(spark, sf_dir, ticker)))
    # The bars stay where the windows have put them: the last one and the closes before it are one aggregation.
    kept = [c for c in rolled.columns if c != "ticker"]
    recent = F.array_sort(F.collect_list(F.when(F.col("bar") > F.col("n") - 260, F.struct("d", "c"))))
    last = rolled.groupBy("ticker").agg(F.max_by(F.struct(*kept), "bar").alias("last"), recent.alias("recent"))
    wide = last.select("ticker", "last.*", F.transform("recent", lambda x: x["c"]).alias("closes"), indicators.trend_of(indicators.week_ends(F.col("recent"))).alias("trend"))
    return signals.mechanical_score(indicators.recursive(wide).drop("closes"))


@register("src01_bars", "SELECT ticker, d, round(o, 6) AS o, round(h, 6) AS h, round(l, 6) AS l, round(c, 6) AS c, v FROM t_bars")
def src01(spark, sf_dir):
    return rounded(T.bars(spark, sf_dir))


@register("src02_quotes", "SELECT ticker, round(price, 6) AS price, round(prev, 6) AS prev, round(change_pct, 6) AS change_pct FROM t_quotes")
def src02(spark, sf_dir):
    return rounded(T.quotes(spark, sf_dir))


@register("win01_sma", "SELECT ticker, d, round(sma20, 6) AS sma20, round(sma50, 6) AS sma50, round(sma200, 6) AS sma200 FROM t_roll")
def win01(spark, sf_dir):
    return rounded(indicators.rolling(T.bars(spark, sf_dir)).select("ticker", "d", "sma20", "sma50", "sma200"))


@register("win02_ema", "SELECT ticker, round(ema20, 6) AS ema20 FROM t_rec")
def win02(spark, sf_dir):
    return rounded(snapshot(spark, sf_dir).select("ticker", "ema20"))


# Wilder's average written out: the mean of the first 14 moves, and each later move over 14, weighted by its age.
RSI_ALL = """
    SELECT ticker, d, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 5) AS rsi14 FROM (
        SELECT ticker, d, rn, sum(CASE WHEN rn = 15 THEN up14 WHEN rn > 15 THEN up / 14 ELSE 0 END * pow(14.0 / 13, rn)) OVER w * pow(13.0 / 14, rn) AS g,
               sum(CASE WHEN rn = 15 THEN down14 WHEN rn > 15 THEN down / 14 ELSE 0 END * pow(14.0 / 13, rn)) OVER w * pow(13.0 / 14, rn) AS l FROM (
            SELECT ticker, d, rn, up, down, avg(up) OVER w14 AS up14, avg(down) OVER w14 AS down14 FROM (
                SELECT ticker, d, rn, greatest(c - lag(c) OVER w, 0) AS up, greatest(lag(c) OVER w - c, 0) AS down FROM t_num WINDOW w AS (PARTITION BY ticker ORDER BY d))
            WINDOW w14 AS (PARTITION BY ticker ORDER BY d ROWS 13 PRECEDING)) WINDOW w AS (PARTITION BY ticker ORDER BY d)) WHERE rn > 14"""


@register("win03_rsi", RSI_ALL)
def win03(spark, sf_dir):
    """For every bar, over all bars of its ticker so far."""
    return indicators.rsi_series(T.bars(spark, sf_dir)).where("bar > 14").select("ticker", "d", F.round("rsi14", 5).alias("rsi14"))


@register("flt03_rsi_reversion_history", f"SELECT ticker, d, CASE WHEN rsi14 < 30 THEN 35 ELSE -35 END AS score FROM ({RSI_ALL}) WHERE rsi14 < 30 OR rsi14 > 70")
def flt03_history(spark, sf_dir):
    """The bars on which the average of gains and losses says to turn."""
    r = win03(spark, sf_dir)
    return r.where("rsi14 < 30 OR rsi14 > 70").select("ticker", "d", F.when(F.col("rsi14") < 30, 35).otherwise(-35).alias("score"))


@register("flt06_bollinger_history", "SELECT ticker, d, CASE WHEN c > sma20 + 2 * sd20 THEN 30 ELSE -30 END AS score FROM t_roll WHERE c > sma20 + 2 * sd20 OR c < sma20 - 2 * sd20")
def flt06_history(spark, sf_dir):
    """The bars that close outside their bands."""
    r = indicators.rolling(T.bars(spark, sf_dir)).where("c > bb_upper OR c < bb_lower")
    return r.select("ticker", "d", F.when(F.col("c") > F.col("bb_upper"), 30).otherwise(-30).alias("score"))


@register("win04_macd", "SELECT ticker, round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(macd_hist, 6) AS macd_hist FROM t_rec")
def win04(spark, sf_dir):
    return rounded(snapshot(spark, sf_dir).select("ticker", "macd", "macd_signal", "macd_hist"))


@register("win05_bollinger", "SELECT ticker, d, round(sma20 + 2 * sd20, 6) AS bb_upper, round(sma20 - 2 * sd20, 6) AS bb_lower, round(CASE WHEN sma20 = 0 THEN 0 ELSE 4 * sd20 / sma20 * 100 END, 5) AS bb_width FROM t_roll")
def win05(spark, sf_dir):
    return rounded(indicators.rolling(T.bars(spark, sf_dir)).select("ticker", "d", "bb_upper", "bb_lower", "bb_width"), bb_width=5)


@register("win06_atr", "SELECT ticker, d, round(atr14, 6) AS atr14 FROM t_roll")
def win06(spark, sf_dir):
    return rounded(indicators.rolling(T.bars(spark, sf_dir)).select("ticker", "d", "atr14"))


@register("win07_rolling_max", "SELECT ticker, d, round(high_20, 6) AS high_20, round(high_252, 6) AS high_252 FROM t_roll")
def win07(spark, sf_dir):
    return rounded(indicators.rolling(T.bars(spark, sf_dir)).select("ticker", "d", "high_20", "high_252"))


@register("win08_weekly_trend", "SELECT ticker, trend FROM t_trend")
def win08(spark, sf_dir):
    return indicators.weekly_trend(T.bars(spark, sf_dir))


@register("win09_every_fifth", "SELECT ticker, CAST(len(f) AS INTEGER) AS n, round(list_sum(f), 4) AS total FROM (SELECT ticker, [a[i] FOR i IN range(1, len(a) + 1) IF (i - 1) % 5 = 0] AS f FROM t_arr)")
def win09(spark, sf_dir):
    last = T.numbered(T.bars(spark, sf_dir)).where("rn_desc <= 260").groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda s: s["c"]).alias("a"))
    fifth = F.filter("a", lambda x, i: i % 5 == 0)
    return last.select("ticker", F.size(fifth).alias("n"), F.round(F.aggregate(fifth, F.lit(0.0), lambda t, x: t + x), 4).alias("total"))


@register("win10_snapshot", """
    SELECT ticker, round(c, 6) AS c, round(sma50, 6) AS sma50, round(sma200, 6) AS sma200, round(rsi14, 5) AS rsi14, round(macd_hist, 6) AS macd_hist, round(atr14, 6) AS atr14, trend, patterns, CAST(score AS INTEGER) AS score,
           CASE WHEN score >= 60 THEN 'strong buy' WHEN score >= 25 THEN 'buy' WHEN score <= -60 THEN 'strong sell' WHEN score <= -25 THEN 'sell' ELSE 'hold' END AS label FROM t_snap""")
def win10(spark, sf_dir):
    s = snapshot(spark, sf_dir)
    return rounded(s.select("ticker", "c", "sma50", "sma200", "rsi14", "macd_hist", "atr14", "trend", F.array_join("patterns", ",").alias("patterns"), "score", "label"), rsi14=5)


@register("win11_candles", "SELECT ticker, d, patterns FROM t_cand WHERE patterns <> ''")
def win11(spark, sf_dir):
    found = candles.patterns(T.bars(spark, sf_dir)).where(F.size("patterns") > 0)
    return found.select("ticker", "d", F.array_join("patterns", ",").alias("patterns"))


@register("win12_returns", "SELECT ticker, d, round(r, 8) AS r, CAST(rn_desc AS INTEGER) AS rn_desc FROM t_ret")
def win12(spark, sf_dir):
    return rounded(T.returns(T.bars(spark, sf_dir)), 8)


@register("win13_momentum", """
    SELECT ticker, round((max(c) FILTER (rn = n) / max(c) FILTER (rn = 1) - 1) * 100, 6) AS total_pct, round((max(c) FILTER (rn = n) / max(c) FILTER (rn = greatest(n - 63, 1)) - 1) * 100, 6) AS mom_3m FROM t_num GROUP BY ticker""")
def win13(spark, sf_dir):
    return rounded(momentum(spark, sf_dir).select("ticker", "total_pct", "mom_3m"))


def momentum(spark, sf_dir):
    at = lambda test: F.max(F.when(test, F.col("c")))
    last = at(F.col("rn_desc") == 1)
    pct = lambda then: (F.try_divide(last, then) - 1) * 100
    return T.numbered(T.bars(spark, sf_dir)).groupBy("ticker").agg(
        last.alias("last"), F.max("n").alias("n"), pct(at(F.col("rn") == 1)).alias("total_pct"), pct(at(F.col("rn") == F.greatest(F.col("n") - 63, F.lit(1)))).alias("mom_3m"), pct(at(F.col("rn") == F.greatest(F.col("n") - 252, F.lit(1)))).alias("yoy")
    )


@register("win14_lag_returns", """
    SELECT ticker, d, round(c / lag(c, 20) OVER w - 1, 8) AS r20, round(c / lag(c, 60) OVER w - 1, 8) AS r60, round(c / lag(c, 120) OVER w - 1, 8) AS r120 FROM t_bars WINDOW w AS (PARTITION BY ticker ORDER BY d)""")
def win14(spark, sf_dir):
    day = Window.partitionBy("ticker").orderBy("d")
    return T.bars(spark, sf_dir).select("ticker", "d", *[F.round(F.try_divide("c", F.lag("c", k).over(day)) - 1, 8).alias(f"r{k}") for k in (20, 60, 120)])


@register("win15_features", """
    SELECT ticker, d, round(c / nullif(high_252, 0) - 1, 8) AS from_high, round(vol20 * sqrt(252), 8) AS vol_20, round(v / nullif(avg_volume_20, 0), 8) AS volume_ratio, round((c - (sma20 - 2 * sd20)) / nullif(4 * sd20, 0), 6) AS bb_position,
           round(atr14 / nullif(c, 0), 8) AS atr_pct FROM t_roll WHERE rn >= 252""")
def win15(spark, sf_dir):
    r = indicators.rolling(T.bars(spark, sf_dir)).where("bar >= 252")
    return r.select(
        "ticker", "d", F.round(F.try_divide("c", "high_252") - 1, 8).alias("from_high"), F.round(F.col("vol20") * F.sqrt(F.lit(252.0)), 8).alias("vol_20"), F.round(F.try_divide("v", "avg_volume_20"), 8).alias("volume_ratio"),
        F.round(F.try_divide(F.col("c") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")), 6).alias("bb_position"), F.round(F.try_divide("atr14", "c"), 8).alias("atr_pct"),
    )


@register("win16_forward_returns", "SELECT ticker, d, round(lead(c, 20) OVER w / nullif(c, 0) - 1, 8) AS fwd20, round(lead(c, 60) OVER w / nullif(c, 0) - 1, 8) AS fwd60 FROM t_bars WINDOW w AS (PARTITION BY ticker ORDER BY d)")
def win16(spark, sf_dir):
    day = Window.partitionBy("ticker").orderBy("d")
    return T.bars(spark, sf_dir).select("ticker", "d", *[F.round(F.try_divide(F.lead("c", k).over(day), "c") - 1, 8).alias(f"fwd{k}") for k in (20, 60)])


@register("win17_event_sampling", "SELECT ticker, d, CAST(rn AS INTEGER) AS bar FROM t_num WHERE rn >= 200 AND (rn - 200) % 5 = 0 AND rn <= n - 60")
def win17(spark, sf_dir):
    return backtest.sampled(T.numbered(T.bars(spark, sf_dir))).select("ticker", "d", F.col("rn").alias("bar"))


@register("win27_volume_profile", """
    SELECT ticker, round(max(lo + (bin + 0.5) * step) FILTER (place = 1), 6) AS poc, round(max(lo + (bin + 1) * step) FILTER (inside), 6) AS vah, round(min(lo + bin * step) FILTER (inside), 6) AS val FROM (
        SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bv DESC, bin) AS place,
               sum(bv) OVER (PARTITION BY ticker ORDER BY bv DESC, bin DESC ROWS UNBOUNDED PRECEDING) - bv < 0.7 * sum(bv) OVER (PARTITION BY ticker) AS inside FROM (
            SELECT ticker, lo, (hi - lo) / 24 AS step, CAST(least(greatest(floor(((h + l + c) / 3 - lo) / ((hi - lo) / 24)), 0), 23) AS INTEGER) AS bin, sum(v) AS bv
            FROM (SELECT *, min(l) OVER (PARTITION BY ticker) AS lo, max(h) OVER (PARTITION BY ticker) AS hi FROM t_last) WHERE hi > lo GROUP BY ALL)) GROUP BY ticker""")
def win27(spark, sf_dir):
    return rounded(indicators.volume_profile(T.bars(spark, sf_dir)))


@register("flt01_mechanical_score", f"SELECT ticker, CAST({SCORE} AS INTEGER) AS score FROM t_snap0")
def flt01(spark, sf_dir):
    return snapshot(spark, sf_dir).select("ticker", "score")


define("t_val", """
    SELECT a.ticker, mc.price * a.shares / nullif(a.net_income, 0) AS pe_ttm, a.revenue / nullif(b.revenue, 0) - 1 AS rev_yoy, a.net_income / nullif(a.revenue, 0) AS net_margin, a.cfo + a.capex AS fcf, a.total_debt / nullif(a.total_assets - a.total_debt, 0) * 100 AS debt_to_equity,
           mc.price * a.shares AS market_cap, mc.price AS price
    FROM (SELECT * FROM t_stmt QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY y DESC) = 1) a
    JOIN (SELECT * FROM t_stmt QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY y DESC) = 2) b USING (ticker) JOIN t_quotes mc USING (ticker)""")
define("t_verdicts", """
    SELECT ticker, 'MA Crossover' AS strategy, CASE WHEN sma50 > sma200 THEN 40 ELSE -40 END AS score FROM t_snap WHERE sma50 IS NOT NULL AND sma200 IS NOT NULL
    UNION ALL SELECT ticker, 'RSI Reversion', CASE WHEN rsi14 < 30 THEN 35 ELSE -35 END FROM t_snap WHERE rsi14 < 30 OR rsi14 > 70
    UNION ALL SELECT ticker, 'MACD Momentum', CASE WHEN macd_hist > 0 THEN 30 ELSE -30 END FROM t_snap WHERE macd_hist IS NOT NULL
    UNION ALL SELECT ticker, 'Trend Following', CASE WHEN c > sma200 AND trend = 'Uptrend' THEN 45 WHEN c <= sma200 AND trend = 'Downtrend' THEN -45 WHEN c > sma200 THEN 20 ELSE -20 END FROM t_snap WHERE sma200 IS NOT NULL
    UNION ALL SELECT ticker, 'Bollinger Breakout', CASE WHEN c > bb_upper THEN 30 ELSE -30 END FROM t_snap WHERE c > bb_upper OR c < bb_lower
    UNION ALL SELECT ticker, 'Volume Surge', CASE WHEN coalesce(macd_hist, 0) > 0 THEN 25 ELSE -25 END FROM t_snap WHERE avg_volume_20 > 0 AND v >= 2 * avg_volume_20
    UNION ALL SELECT ticker, 'Value + Quality', CASE WHEN pe_ttm < 20 THEN 35 ELSE -25 END FROM t_val WHERE (pe_ttm > 0 AND pe_ttm < 20 AND rev_yoy > 0.1) OR (pe_ttm > 40 AND rev_yoy < 0.05)""")


def verdicts(spark, sf_dir):
    from tidemark.plans.fundamental import valuation

    value = valuation(spark, sf_dir).select("ticker", "pe_ttm", "rev_yoy")
    return strategies.verdicts(snapshot(spark, sf_dir).join(value, "ticker", "left"))


for _key, _name in {
    "flt02_ma_crossover": "MA Crossover", "flt03_rsi_reversion": "RSI Reversion", "flt04_macd_momentum": "MACD Momentum", "flt05_trend_following": "Trend Following",
    "flt06_bollinger_breakout": "Bollinger Breakout", "flt07_volume_surge": "Volume Surge", "flt08_value_quality": "Value + Quality",
}.items():

    @register(_key, f"SELECT ticker, CASE WHEN score > 0 THEN 'bullish' ELSE 'bearish' END AS stance, CAST(score AS INTEGER) AS score FROM t_verdicts WHERE strategy = '{_name}'")
    def _one(spark, sf_dir, name=_name):
        return verdicts(spark, sf_dir).where(F.col("strategy") == name).select("ticker", "stance", "score")


@register("agg22_strategy_panel", """
    SELECT ticker, round(avg(score), 1) AS net_score, count(*) FILTER (score > 0) AS bull, count(*) FILTER (score < 0) AS bear, count(*) AS n FROM t_verdicts GROUP BY ticker""")
def agg22(spark, sf_dir):
    with T.bars_once(spark, sf_dir):
        found = verdicts(spark, sf_dir)
    return strategies.panel(found).withColumn("net_score", F.round("net_score", 1))


define("t_events0", """
    SELECT ticker, d, rn, n, c, sma50, sma200, sma20, sd20, atr14, v, avg_volume_20, lead(c, 20) OVER w / c - 1 AS fwd20, lead(c, 60) OVER w / c - 1 AS fwd60,
           list(l) OVER f AS lows, list(h) OVER f AS highs FROM t_roll WINDOW w AS (PARTITION BY ticker ORDER BY d), f AS (PARTITION BY ticker ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING)""")
define("t_events1", "SELECT *, c - 2 * atr14 AS stop, c + 1.5 * atr14 AS target FROM t_events0 WHERE rn >= 200 AND (rn - 200) % 5 = 0 AND rn <= n - 60 AND atr14 IS NOT NULL")
define("t_events2", """
    SELECT *, coalesce(list_position(list_transform(lows, lambda x: x <= stop), true), 0) AS si, coalesce(list_position(list_transform(highs, lambda x: x >= target), true), 0) AS ti FROM t_events1""")
define("t_events", """
    SELECT *, CASE WHEN si > 0 AND (ti = 0 OR si <= ti) THEN 'stop' WHEN ti > 0 THEN 'target' ELSE 'none' END AS resolution,
           CASE WHEN c > sma50 THEN 10 ELSE -10 END + CASE WHEN c > sma200 THEN 10 ELSE -10 END + CASE WHEN sma50 > sma200 THEN 10 ELSE -10 END AS mech_score FROM t_events2""")


def events(spark, sf_dir):
    return backtest.events(indicators.rolling(T.bars(spark, sf_dir)))


@register("win18_first_touch", "SELECT ticker, d, resolution, CAST(si AS BIGINT) AS si, CAST(ti AS BIGINT) AS ti FROM t_events")
def win18(spark, sf_dir):
    return events(spark, sf_dir).select("ticker", "d", "resolution", "si", "ti")


@register("jon15_interval_resolution", "SELECT resolution, count(*) AS n, round(avg(fwd60), 8) AS fwd60 FROM t_events GROUP BY resolution")
def jon15(spark, sf_dir):
    return events(spark, sf_dir).groupBy("resolution").agg(F.count("*").alias("n"), F.round(F.avg("fwd60"), 8).alias("fwd60"))


@register("agg24_backtest", """
    SELECT stance, n, round(mean60 * 100, 6) AS fwd60_pct, round((mean60 - base60) * 100, 6) AS edge60_pct, round(mean20 * 100, 6) AS fwd20_pct, round(win, 6) AS win_rate FROM (
        SELECT CASE WHEN sma50 > sma200 THEN 'bullish' ELSE 'bearish' END AS stance, count(*) AS n, avg(fwd60) AS mean60, avg(fwd20) AS mean20, avg(CASE WHEN fwd60 > 0 THEN 1.0 ELSE 0.0 END) AS win FROM t_events GROUP BY 1 HAVING count(*) >= 30),
        (SELECT avg(fwd60) AS base60 FROM t_events)""")
def agg24(spark, sf_dir):
    return rounded(backtest.edges(events(spark, sf_dir).withColumn("stance", F.when(F.col("sma50") > F.col("sma200"), "bullish").otherwise("bearish"))))


BACKTEST_JSON = """
    SELECT *, (SELECT count(DISTINCT ticker) FROM t_bars) AS universe_size, 5 AS step_days FROM (
        SELECT stance, n, round((mean60 - base60) * 100, 6) AS edge60_pct, round(win, 6) AS win_rate FROM (
            SELECT CASE WHEN sma50 > sma200 THEN 'bullish' ELSE 'bearish' END AS stance, count(*) AS n, avg(fwd60) AS mean60, avg(CASE WHEN fwd60 > 0 THEN 1.0 ELSE 0.0 END) AS win FROM t_events GROUP BY 1 HAVING count(*) >= 30),
            (SELECT avg(fwd60) AS base60 FROM t_events))"""


@register("agg24_score_quintiles", """
    SELECT q, count(*) AS n, round(avg(fwd60) * 100, 6) AS fwd60_pct FROM (
        SELECT fwd60, CASE WHEN mech_score <= e1 THEN 1 WHEN mech_score <= e2 THEN 2 WHEN mech_score <= e3 THEN 3 WHEN mech_score <= e4 THEN 4 ELSE 5 END AS q FROM t_events,
            (SELECT quantile_cont(mech_score, 0.2) AS e1, quantile_cont(mech_score, 0.4) AS e2, quantile_cont(mech_score, 0.6) AS e3, quantile_cont(mech_score, 0.8) AS e4 FROM t_events)) GROUP BY q""")
def agg24q(spark, sf_dir):
    return rounded(backtest.quintiles(events(spark, sf_dir)))


@register("top14_edges", """
    SELECT stance, n, round(edge, 6) AS edge60_pct FROM (SELECT CASE WHEN sma50 > sma200 THEN 'bullish' ELSE 'bearish' END AS stance, count(*) AS n, (avg(fwd60) - (SELECT avg(fwd60) FROM t_events)) * 100 AS edge FROM t_events GROUP BY 1 HAVING count(*) >= 30) ORDER BY edge DESC""")
def top14(spark, sf_dir):
    return agg24(spark, sf_dir).select("stance", "n", "edge60_pct").orderBy(F.desc("edge60_pct"), "stance")
