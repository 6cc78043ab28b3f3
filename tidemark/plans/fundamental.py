"""Statements, scores, stages, signals and sizing: queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import fundamentals as O
from tidemark.operators import signals
from tidemark.operators.portfolio import in_close_pairs
from tidemark.plans.portfolio import correlations
from tidemark.plans.sql import define, twin
from tidemark.plans.technical import rounded, snapshot
from tidemark.sources import tables as T

QUERIES, ORACLE_SQL = {}, {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = twin(sql)
        return f

    return keep


def valuation(spark, sf_dir):
    """(ticker, pe_ttm, rev_yoy, net_margin, fcf, debt_to_equity, short_pct, market_cap, price, target_mean) of the newest year."""
    beside = O.years_beside(T.statements(spark, sf_dir)).where("years >= 2").join(T.quotes(spark, sf_dir), "ticker")
    c = F.col
    return beside.select(
        "ticker", F.try_divide(c("price") * c("shares0"), c("net_income0")).alias("pe_ttm"), (F.try_divide("revenue0", "revenue1") - 1).alias("rev_yoy"), F.try_divide("net_income0", "revenue0").alias("net_margin"),
        (c("cfo0") + c("capex0")).alias("fcf"), (F.try_divide(c("total_debt0"), c("total_assets0") - c("total_debt0")) * 100).alias("debt_to_equity"), (c("y0") % 3 / 10).alias("short_pct"), (c("price") * c("shares0")).alias("market_cap"),
        "price", (c("price") * (F.lit(1.0) + (c("shares0") % 7 - 3) / 10)).alias("target_mean"),
    )


define("t_years", """
    SELECT ticker, count(*) AS years, max(y) AS y0, avg(net_income) FILTER (k <= 5) AS ni_mean, sum(net_income) FILTER (k <= 5) AS ni_sum,
           """ + ", ".join(f"max({m}) FILTER (k = {k + 1}) AS {m}{k}" for m in O.MEASURES for k in range(3)) + """
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY y DESC) AS k FROM t_stmt) GROUP BY ticker""")
define("t_valuation", """
    SELECT ticker, price * shares0 / nullif(net_income0, 0) AS pe_ttm, revenue0 / nullif(revenue1, 0) - 1 AS rev_yoy, net_income0 / nullif(revenue0, 0) AS net_margin, cfo0 + capex0 AS fcf,
           total_debt0 / nullif(total_assets0 - total_debt0, 0) * 100 AS debt_to_equity, (y0 % 3) / 10 AS short_pct, price * shares0 AS market_cap, price, price * (1.0 + (shares0 % 7 - 3) / 10) AS target_mean
    FROM t_years JOIN t_quotes USING (ticker) WHERE years >= 2""")


@register("src13_statements", "SELECT ticker, y, " + ", ".join(f"round({m}, 4) AS {m}" for m in O.MEASURES) + " FROM t_stmt")
def src13(spark, sf_dir):
    return rounded(T.statements(spark, sf_dir), 4)


@register("jon21_statement_periods", """
    SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.y, b.y) AS y, round(a.revenue, 4) AS revenue, round(b.total_assets, 4) AS total_assets
    FROM (SELECT * FROM t_stmt WHERE y % 3 <> 0) a FULL JOIN (SELECT * FROM t_stmt WHERE y % 3 <> 1) b ON a.ticker = b.ticker AND a.y = b.y""")
def jon21(spark, sf_dir):
    """Income and balance sheets of different periods, merged by period."""
    s = T.statements(spark, sf_dir)
    income, balance = s.where("y % 3 <> 0").select("ticker", "y", "revenue"), s.where("y % 3 <> 1").select("ticker", "y", "total_assets")
    return rounded(income.join(balance, ["ticker", "y"], "full"), 4)


@register("src12_statement_pivot", "PIVOT (SELECT ticker, y, round(revenue, 4) AS revenue FROM (SELECT p_brand AS ticker, CAST(year(l_shipdate) AS INTEGER) AS y, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) ON y IN (1996, 1997, 1998, 1999) USING max(revenue) GROUP BY ticker")
def src12(spark, sf_dir):
    return rounded(T.statements(spark, sf_dir).groupBy("ticker").pivot("y", [1996, 1997, 1998, 1999]).agg(F.max("revenue")), 4)


_CRITERIA = {
    "roa_positive": "net_income0 / nullif(total_assets0, 0) > 0", "cfo_positive": "cfo0 > 0", "roa_improving": "net_income0 / nullif(total_assets0, 0) > net_income1 / nullif(total_assets1, 0)", "accruals_ok": "cfo0 > net_income0",
    "leverage_down": "total_debt1 / nullif(total_assets1, 0) > total_debt0 / nullif(total_assets0, 0)", "liquidity_up": "current_assets0 / nullif(current_liabilities0, 0) > current_assets1 / nullif(current_liabilities1, 0)",
    "no_dilution": "shares0 <= shares1", "margin_up": "(revenue0 - cogs0) / nullif(revenue0, 0) > (revenue1 - cogs1) / nullif(revenue1, 0)", "turnover_up": "revenue0 / nullif(total_assets0, 0) > revenue1 / nullif(total_assets1, 0)",
}


@register("agg28_f_score", "SELECT ticker, CAST(" + " + ".join(f"coalesce(CAST({t} AS INTEGER), 0)" for t in _CRITERIA.values()) + " AS INTEGER) AS score, CAST(" + " + ".join(f"CAST(({t}) IS NOT NULL AS INTEGER)" for t in _CRITERIA.values()) + " AS INTEGER) AS known, "
          + ", ".join(f"{t} AS {n}" for n, t in _CRITERIA.items()) + " FROM t_years WHERE years >= 2")
def agg28(spark, sf_dir):
    return O.f_score(O.years_beside(T.statements(spark, sf_dir)))


_FLAGS = """concat_ws(',', CASE WHEN pe_ttm < 0 THEN 'negative trailing earnings' END, CASE WHEN pe_ttm > 60 THEN 'priced for high growth' END, CASE WHEN debt_to_equity > 200 THEN 'heavily levered' END,
    CASE WHEN net_margin < 0 THEN 'unprofitable' END, CASE WHEN rev_yoy < 0 THEN 'revenue shrinking' END, CASE WHEN fcf < 0 THEN 'negative free cash flow' END, CASE WHEN short_pct > 0.10 THEN 'heavily shorted' END)"""


@register("flt09_quality_flags", f"SELECT ticker, {_FLAGS} AS flags FROM t_valuation")
def flt09(spark, sf_dir):
    v = valuation(spark, sf_dir)
    return v.select("ticker", F.array_join(O.quality_flags(v), ",").alias("flags"))


@register("flt10_cash_flags", "SELECT ticker, concat_ws(',', CASE WHEN cfo0 < 0 THEN 'negative operating cash flow' END, CASE WHEN abs(capex0) > cfo0 AND abs(capex1) > cfo1 THEN 'capex exceeds operating cash flow' END) AS flags FROM t_years")
def flt10(spark, sf_dir):
    return O.years_beside(T.statements(spark, sf_dir)).select("ticker", F.array_join(O.cash_flags(), ",").alias("flags"))


_FUND = f"""greatest(-100, least(100, -20 * (CASE WHEN {_FLAGS} = '' THEN 0 ELSE len(string_split({_FLAGS}, ',')) END) + CASE WHEN rev_yoy > 0.15 THEN 25 WHEN rev_yoy > 0.05 THEN 10 ELSE 0 END
    + CASE WHEN net_margin > 0.15 THEN 20 WHEN net_margin > 0.05 THEN 10 ELSE 0 END + CASE WHEN target_mean / price - 1 > 0.2 THEN 25 WHEN target_mean / price - 1 > 0.05 THEN 10 WHEN target_mean / price - 1 < -0.05 THEN -15 ELSE 0 END))"""
define("t_fund", f"SELECT *, {_FUND} AS fundamental FROM t_valuation")


def fund_scored(spark, sf_dir):
    v = valuation(spark, sf_dir)
    v = v.withColumn("n_flags", F.size(O.quality_flags(v)))
    return v.withColumn("fundamental", signals.fundamental_score(v))


@register("flt11_fundamental_score", "SELECT ticker, CAST(fundamental AS INTEGER) AS fundamental FROM t_fund")
def flt11(spark, sf_dir):
    return fund_scored(spark, sf_dir).select("ticker", F.col("fundamental").cast("int").alias("fundamental"))


define("t_news1", "SELECT CAST(regexp_extract(ticker, '([0-9]+)', 1) AS INTEGER) AS num, avg(score) AS s FROM t_articles WHERE score IS NOT NULL GROUP BY 1")


def news_average(spark, sf_dir):
    return T.articles(spark, sf_dir).where("score IS NOT NULL").groupBy(F.regexp_extract("ticker", "([0-9]+)", 1).cast("int").alias("num")).agg(F.avg("score").alias("s"))


@register("flt12_news_score", "SELECT num, CAST(greatest(-100, least(100, trunc(round(s * 200, 9)))) AS INTEGER) AS news FROM t_news1")
def flt12(spark, sf_dir):
    return news_average(spark, sf_dir).select("num", signals.news_score(F.round("s", 9)).cast("int").alias("news"))


define("t_comp0", """
    SELECT b.ticker, s.score AS technical, f.fundamental, CASE WHEN n.s IS NOT NULL THEN greatest(-100, least(100, trunc(round(n.s * 200, 9)))) END AS news, CASE WHEN b.weight > 0.2 THEN -50 WHEN b.weight > 0.1 THEN -20 ELSE 0 END - CASE WHEN b.ticker IN (SELECT unnest([a, b]) FROM t_corr WHERE corr > 0.8) THEN 15 ELSE 0 END AS risk, b.weight
    FROM t_book b LEFT JOIN t_snap s USING (ticker) LEFT JOIN t_fund f USING (ticker) JOIN t_tickers k USING (ticker) LEFT JOIN t_news1 n ON n.num = k.num""")
define("t_comp1", """
    SELECT *, (coalesce(technical * 0.45, 0) + coalesce(fundamental * 0.25, 0) + coalesce(news * 0.15, 0) + coalesce(risk * 0.15, 0)) / nullif(cov, 0) AS composite, cov AS coverage FROM (
        SELECT *, CASE WHEN technical IS NULL THEN 0 ELSE 0.45::DOUBLE END + CASE WHEN fundamental IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN news IS NULL THEN 0 ELSE 0.15::DOUBLE END + CASE WHEN risk IS NULL THEN 0 ELSE 0.15::DOUBLE END AS cov FROM t_comp0)""")
define("t_comp", """
    SELECT *, CASE WHEN abs(composite) >= 50 AND coverage >= 0.75 THEN 'high' WHEN abs(composite) >= 30 AND coverage >= 0.5 THEN 'medium' ELSE 'low' END AS conviction FROM t_comp1""")


def composites(spark, sf_dir):
    """The composite of each name of the book; left joins, so that missing parts drop out."""
    book = T.book(spark, sf_dir).join(T.tickers(spark, sf_dir).select("ticker", "num"), "ticker")
    technical = snapshot(spark, sf_dir).select("ticker", F.col("score").alias("technical"), "atr14", F.col("c").alias("last"))
    fundamental = fund_scored(spark, sf_dir).select("ticker", "fundamental", "target_mean", "fcf", "net_margin", "debt_to_equity", "rev_yoy", "short_pct")
    news = news_average(spark, sf_dir).select("num", signals.news_score(F.round("s", 9)).alias("news"))
    joined = book.join(technical, "ticker", "left").join(fundamental, "ticker", "left").join(news, "num", "left")
    joined = joined.join(in_close_pairs(correlations(spark, sf_dir)), "ticker", "left")
    return signals.composite(joined.withColumn("risk", signals.risk_score(F.col("weight"), F.col("paired").isNotNull())))


@register("agg23_composite", "SELECT ticker, CAST(technical AS INTEGER) AS technical, CAST(fundamental AS INTEGER) AS fundamental, CAST(news AS INTEGER) AS news, CAST(risk AS INTEGER) AS risk, round(composite, 6) AS composite, round(coverage, 6) AS coverage, conviction FROM t_comp")
def agg23(spark, sf_dir):
    with T.bars_once(spark, sf_dir):
        c = composites(spark, sf_dir)
    return rounded(c.select("ticker", *[F.col(x).cast("int").alias(x) for x in signals.COMPOSITE], "composite", "coverage", "conviction"))


QUERIES["jon04_multi_way_left"] = lambda spark, sf_dir: composites(spark, sf_dir).agg(F.count("*").alias("n"), F.count("technical").alias("with_technical"), F.count("fundamental").alias("with_fundamental"), F.count("news").alias("with_news"))
ORACLE_SQL["jon04_multi_way_left"] = twin("SELECT count(*) AS n, count(technical) AS with_technical, count(fundamental) AS with_fundamental, count(news) AS with_news FROM t_comp0")

define("t_reds", """
    SELECT ticker, concat_ws(',', CASE WHEN fcf < 0 AND net_margin < 0 AND debt_to_equity > 200 THEN 'burning cash with heavy debt' END, CASE WHEN rev_yoy < 0 AND net_margin < 0 AND short_pct > 0.15 THEN 'shrinking, unprofitable and shorted' END) AS red_lines FROM t_valuation""")


@register("flt14_red_lines", "SELECT ticker, red_lines FROM t_reds")
def flt14(spark, sf_dir):
    c = F.col
    return valuation(spark, sf_dir).select("ticker", F.array_join(signals.red_lines(c("fcf"), c("net_margin"), c("debt_to_equity"), c("rev_yoy"), c("short_pct")), ",").alias("red_lines"))


@register("flt15_size_tiers", """
    SELECT conviction, rr, CASE WHEN conviction = 'high' AND rr >= 1.5 THEN 'Full' WHEN conviction = 'high' OR (conviction = 'medium' AND rr >= 2) THEN 'Half' WHEN conviction = 'medium' THEN 'Starter' ELSE 'Pass' END AS tier
    FROM (SELECT unnest(['high', 'medium', 'low']) AS conviction), (SELECT CAST(unnest([0.5, 1.0, 1.5, 2.0, 2.5]) AS DOUBLE) AS rr)""")
def flt15(spark, sf_dir):
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("high", "medium", "low")])).alias("conviction")).select("conviction", F.explode(F.array(*[F.lit(x) for x in (0.5, 1.0, 1.5, 2.0, 2.5)])).alias("rr"))
    return grid.withColumn("tier", signals.size_tier(F.col("conviction"), F.col("rr")))


def recommendations(spark, sf_dir):
    c = composites(spark, sf_dir)
    col = F.col
    reds = signals.red_lines(col("fcf"), col("net_margin"), col("debt_to_equity"), col("rev_yoy"), col("short_pct"))
    return signals.recommendation(c.withColumns({"price": col("last"), "atr_stop": F.lit(None).cast("double"), "red_lines": F.coalesce(reds, F.array().cast("array<string>"))}))


# Prices have few decimals after rounding; both sides round half to even on the decimal text.
_R = "round_even({}, 2)"
define("t_block0", f"""
    SELECT c.ticker, s.c AS price, s.atr14, {_R.format('f.target_mean')} AS bull_target, {_R.format('s.c - 2 * s.atr14')} AS bear_stop, {_R.format('s.c - 0.5 * s.atr14')} AS entry_low, {_R.format('s.c + 0.5 * s.atr14')} AS entry_high, conviction
    FROM t_comp c JOIN t_snap s USING (ticker) JOIN t_fund f USING (ticker) WHERE s.atr14 IS NOT NULL""")
define("t_block1", f"SELECT *, {_R.format('(price + bull_target) / 2')} AS base_target FROM t_block0")
define("t_block", f"SELECT *, CASE WHEN price > bear_stop THEN {_R.format('(base_target - price) / (price - bear_stop)')} END AS rr FROM t_block1")


@register("flt16_recommendation", """
    SELECT ticker, round(bull_target, 2) AS bull_target, round(bear_stop, 2) AS bear_stop, round(base_target, 1) AS base_target, round(rr, 1) AS rr, conviction,
           CASE WHEN red_lines <> '' THEN 'Pass' WHEN conviction = 'high' AND coalesce(rr, 0) >= 1.5 THEN 'Full' WHEN conviction = 'high' OR (conviction = 'medium' AND rr >= 2) THEN 'Half' WHEN conviction = 'medium' THEN 'Starter' ELSE 'Pass' END AS tier
    FROM t_block JOIN t_reds USING (ticker)""")
def flt16(spark, sf_dir):
    return recommendations(spark, sf_dir).select("ticker", F.round("bull_target", 2).alias("bull_target"), F.round("bear_stop", 2).alias("bear_stop"), F.round("base_target", 1).alias("base_target"), F.round("rr", 1).alias("rr"), "conviction", "tier")


define("t_metrics", """
    SELECT y.*, k.sector, k.industry, q.price * y.shares0 AS market_cap, (k.num % 7) / 100 AS div_yield, (revenue0 - cogs0) / nullif(revenue0, 0) AS gross_margin, (revenue0 - cogs0) / nullif(revenue0, 0) - (revenue1 - cogs1) / nullif(revenue1, 0) AS gm_delta,
           revenue0 / nullif(revenue1, 0) - 1 AS rev_growth_1y, CASE WHEN revenue0 > 0 AND revenue2 > 0 THEN sqrt(revenue0 / revenue2) - 1 END AS rev_cagr_3y, CASE WHEN cfo0 > 0 THEN abs(capex0) / cfo0 END AS capex_to_cfo, abs(capex0) / nullif(revenue0, 0) AS capex_to_rev,
           cfo0 / nullif(q.price * y.shares0, 0) AS cfo_yield, (cfo0 - abs(capex0)) / nullif(q.price * y.shares0, 0) AS fcf_yield, cfo0 > cfo1 AS burn_shrinking, shares0 / nullif(shares1, 0) - 1 AS dilution_1y, net_income0 / nullif(total_assets0, 0) AS roa,
           total_debt0 / nullif(total_assets0, 0) AS debt_to_assets, CASE WHEN cfo0 > 0 THEN total_debt0 / cfo0 END AS debt_to_cfo, cfo0 - net_income0 AS accrual_gap, net_income0 > net_income1 AS ni_improving,
           CASE WHEN ni_sum > 0 THEN q.price * y.shares0 / ni_mean END AS norm_pe, CASE WHEN k.num % 7 <> 0 AND cfo0 > 0 THEN (k.num % 7) / 100 * q.price * y.shares0 / cfo0 END AS payout_of_cfo
    FROM t_years y JOIN t_quotes q USING (ticker) JOIN t_tickers k USING (ticker)""")
_YOUNG = "coalesce((rev_growth_1y IS NULL OR rev_growth_1y >= 0) AND revenue0 > 0 AND market_cap / nullif(revenue0, 0) > 8, false)"
define("t_distress", f"""
    SELECT *, concat_ws(',', CASE WHEN rev_growth_1y < -0.05 THEN 'revenue falling' END, CASE WHEN NOT {_YOUNG} AND gm_delta <= -0.03 THEN 'margin collapsing' END, CASE WHEN NOT {_YOUNG} AND gross_margin < 0.05 THEN 'selling near cost' END,
        CASE WHEN cfo0 < 0 AND NOT burn_shrinking THEN 'cash burn deepening' END, CASE WHEN dilution_1y > 0.15 THEN 'dilution' END, CASE WHEN coalesce(debt_to_assets, 0) > 0.6 OR coalesce(debt_to_cfo, 0) > 8 THEN 'balance-sheet stress' END) AS distress FROM t_metrics""")
define("t_stage", """
    SELECT *, CASE WHEN years < 2 AND net_income0 IS NULL THEN 'unknown'
        WHEN (sector = 'Financial Services' OR regexp_matches(industry, 'bank|insurance|capital markets|credit services|mortgage')) AND NOT contains(industry, 'financial data') THEN 'financial'
        WHEN sector IN ('Utilities', 'Real Estate') OR regexp_matches(industry, 'reit|utilities|telecom|midstream|pipeline|railroad|airport|waste management') THEN 'regulated_infra'
        WHEN distress <> '' AND len(string_split(distress, ',')) >= 3 THEN 'distress'
        WHEN (coalesce(net_income0 <= 0, false) OR coalesce(cfo0 <= 0, false)) AND (coalesce(rev_cagr_3y, 0) >= 0.2 OR coalesce(rev_growth_1y, 0) >= 0.2 OR revenue0 = 0 OR (revenue0 < 2e9 AND market_cap / revenue0 > 8)) AND (revenue0 IS NULL OR revenue0 < 2e9) THEN 'early_stage'
        WHEN regexp_matches(industry, 'semiconductor|auto|airline|steel|shipping|marine|homebuilding|chemicals|aluminum|copper|mining|luxury goods|travel') OR (sector IN ('Energy', 'Basic Materials', 'Industrials', 'Consumer Cyclical')
             AND (coalesce(gross_margin < 0.35, false) OR coalesce(gm_delta <= -0.03, false) OR coalesce(rev_growth_1y < 0.05, false))) THEN 'cyclical'
        WHEN coalesce(capex_to_cfo, 0) >= 0.4 OR coalesce(rev_cagr_3y, 0) >= 0.1 OR coalesce(rev_growth_1y, 0) >= 0.1 THEN 'compounder' ELSE 'mature_cash' END AS stage FROM t_distress""")


def staged(spark, sf_dir):
    dims = T.tickers(spark, sf_dir).select("ticker", "num", "sector", "industry")
    beside = O.years_beside(T.statements(spark, sf_dir)).join(T.quotes(spark, sf_dir), "ticker").join(dims, "ticker")
    priced = beside.withColumns({"market_cap": F.col("price") * F.col("shares0"), "dividend_yield": (F.col("num") % 7) / F.lit(100.0)})
    return O.classify(O.metrics(priced))


_METRICS = ("gross_margin", "gm_delta", "rev_growth_1y", "rev_cagr_3y", "capex_to_cfo", "capex_to_rev", "cfo_yield", "fcf_yield", "dilution_1y", "roa", "debt_to_assets", "debt_to_cfo", "norm_pe", "payout_of_cfo")


@register("flt19_statement_metrics", "SELECT ticker, " + ", ".join(f"round({m}, 6) AS {m}" for m in _METRICS) + ", burn_shrinking, ni_improving FROM t_metrics")
def flt19(spark, sf_dir):
    return rounded(staged(spark, sf_dir).select("ticker", *_METRICS, "burn_shrinking", "ni_improving"))


@register("flt20_distress_markers", "SELECT ticker, distress FROM t_distress")
def flt20(spark, sf_dir):
    return staged(spark, sf_dir).select("ticker", F.array_join("distress", ",").alias("distress"))


@register("flt18_business_stage", "SELECT ticker, sector, industry, stage FROM t_stage")
def flt18(spark, sf_dir):
    return staged(spark, sf_dir).select("ticker", "sector", "industry", "stage")


_CHECKS_SQL = """
    SELECT ticker, stage, k.name AS "check", k.ok AS passed FROM (SELECT ticker, stage, unnest(CASE stage
        WHEN 'mature_cash' THEN [{'name': 'fcf_yield_ok', 'ok': fcf_yield >= 0.05}, {'name': 'cash_conversion', 'ok': accrual_gap > 0}, {'name': 'not_shrinking', 'ok': rev_growth_1y > -0.03}, {'name': 'margin_stable', 'ok': gm_delta > -0.02},
            {'name': 'buyback_or_div', 'ok': CASE WHEN dilution_1y IS NULL AND div_yield = 0 THEN NULL ELSE coalesce(dilution_1y, 0) <= 0.005 OR div_yield > 0.01 END}, {'name': 'leverage_ok', 'ok': debt_to_cfo <= 4}, {'name': 'returns_ok', 'ok': roa >= 0.05}]
        WHEN 'compounder' THEN [{'name': 'cfo_yield_ok', 'ok': cfo_yield >= 0.03}, {'name': 'growing', 'ok': rev_cagr_3y >= 0.08}, {'name': 'margin_holding', 'ok': gm_delta > -0.02}, {'name': 'cash_conversion', 'ok': accrual_gap > 0}, {'name': 'reinvestment_paying_off', 'ok': ni_improving}, {'name': 'no_dilution', 'ok': dilution_1y <= 0.02}, {'name': 'leverage_ok', 'ok': debt_to_cfo <= 4}]
        WHEN 'regulated_infra' THEN [{'name': 'cfo_positive', 'ok': cfo0 > 0}, {'name': 'distribution_covered', 'ok': payout_of_cfo <= 0.8}, {'name': 'leverage_ok', 'ok': debt_to_cfo <= 8}, {'name': 'rate_base_growing', 'ok': rev_growth_1y >= 0}, {'name': 'no_equity_raid', 'ok': dilution_1y <= 0.05}, {'name': 'yield_real', 'ok': div_yield >= 0.02}]
        WHEN 'financial' THEN [{'name': 'roa_ok', 'ok': roa >= 0.008}, {'name': 'profitable', 'ok': net_income0 > 0}, {'name': 'revenue_growing', 'ok': rev_growth_1y >= 0}, {'name': 'no_dilution', 'ok': dilution_1y <= 0.02}, {'name': 'payout_covered', 'ok': CASE WHEN payout_of_cfo <> 0 THEN payout_of_cfo <= 0.9 END}, {'name': 'earnings_improving', 'ok': ni_improving}]
        WHEN 'cyclical' THEN [{'name': 'not_peak_priced', 'ok': norm_pe <= 18}, {'name': 'profitable_through_cycle', 'ok': CASE WHEN norm_pe <> 0 THEN true END}, {'name': 'balance_sheet_survives_trough', 'ok': debt_to_assets <= 0.4}, {'name': 'no_dilution', 'ok': dilution_1y <= 0.03}, {'name': 'cash_generative', 'ok': cfo0 > 0}]
        WHEN 'early_stage' THEN [{'name': 'growth_intact', 'ok': rev_growth_1y >= 0.2}, {'name': 'gross_margin_viable', 'ok': gross_margin >= 0.3}, {'name': 'margin_improving', 'ok': gm_delta > -0.01}, {'name': 'burn_shrinking', 'ok': burn_shrinking}, {'name': 'dilution_tolerable', 'ok': dilution_1y <= 0.1}] END) AS k FROM t_stage) WHERE k.ok IS NOT NULL"""


@register("flt21_stage_checks", _CHECKS_SQL)
def flt21(spark, sf_dir):
    return staged(spark, sf_dir).withColumn("k", O.stage_checks()).select("ticker", "stage", F.explode("k").alias("k")).select("ticker", "stage", "k.check", "k.passed")


@register("flt22_size_cap", """
    SELECT ticker, stage, cap, round(CASE WHEN cap = 0 OR beta <= 0 THEN cap ELSE cap * least(1.5, 1 / greatest(beta, 0.5)) END, 2) AS size_cap FROM (
        SELECT ticker, stage, (CASE stage WHEN 'mature_cash' THEN 8 WHEN 'compounder' THEN 8 WHEN 'regulated_infra' THEN 6 WHEN 'financial' THEN 6 WHEN 'cyclical' THEN 4 WHEN 'early_stage' THEN 2 ELSE 0 END)::DOUBLE AS cap,
               (CAST(regexp_extract(ticker, '([0-9]+)', 1) AS INTEGER) % 9)::DOUBLE / 4 AS beta FROM t_stage)""")
def flt22(spark, sf_dir):
    caps = spark.createDataFrame([(s, cap) for s, (_, _, cap, _) in O.STAGES.items()], "stage string, cap double")
    s = staged(spark, sf_dir).select("ticker", "stage", "num").join(F.broadcast(caps), "stage")
    return s.select("ticker", "stage", "cap", O.size_cap(F.col("cap"), (F.col("num") % 9) / F.lit(4.0)).alias("size_cap"))


@register("agg37_sizing", """
    SELECT ticker, round(weight, 6) AS current_wt, round(target, 6) AS suggested_wt, CASE WHEN weight > 0.15 THEN 'trim' WHEN abs(target - weight) < 0.02 THEN 'hold' WHEN target > weight THEN 'accumulate' ELSE 'reduce' END AS action FROM (
        SELECT ticker, weight, raw / sum(raw) OVER () AS target FROM (SELECT ticker, weight, greatest(0, least(0.15, weight + coalesce(composite / 100 * 0.05, 0))) AS raw FROM t_comp))""")
def agg37(spark, sf_dir):
    return rounded(sizing(spark, sf_dir).select("ticker", "current_wt", "suggested_wt", "action"))


def sizing(spark, sf_dir):
    c = composites(spark, sf_dir).withColumn("raw", F.greatest(F.lit(0.0), F.least(F.lit(0.15), F.col("weight") + F.coalesce(F.col("composite") / 100 * 0.05, F.lit(0.0)))))
    c = c.withColumn("target", F.col("raw") / F.sum("raw").over(Window.partitionBy()))
    drift = F.col("target") - F.col("weight")
    action = F.when(F.col("weight") > 0.15, "trim").when(F.abs(drift) < 0.02, "hold").when(drift > 0, "accumulate").otherwise("reduce")
    return c.select("ticker", F.col("weight").alias("current_wt"), F.col("target").alias("suggested_wt"), action.alias("action"))


@register("top11_sizing_by_drift", """
    SELECT ticker, round(abs(target - weight), 6) AS drift FROM (SELECT ticker, weight, raw / sum(raw) OVER () AS target FROM (SELECT ticker, weight, greatest(0, least(0.15, weight + coalesce(composite / 100 * 0.05, 0))) AS raw FROM t_comp)) ORDER BY abs(target - weight) DESC LIMIT 10""")
def top11(spark, sf_dir):
    return sizing(spark, sf_dir).select("ticker", F.abs(F.col("suggested_wt") - F.col("current_wt")).alias("drift")).orderBy(F.desc("drift"), "ticker").limit(10).withColumn("drift", F.round("drift", 6))
