"""Statements to ratios, scores, flags, stages and checks. Three-valued logic carries what is unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEASURES = ("revenue", "cogs", "net_income", "cfo", "capex", "shares", "total_assets", "total_debt", "current_assets", "current_liabilities")

#: Terms of industries, sectors, and the sleeve, caps and eligibility of each stage.
FINANCIAL_TERMS = ("bank", "insurance", "reinsurance", "capital markets", "credit services", "mortgage")
FINANCIAL_NOT = ("financial data",)
INFRA_TERMS = ("reit", "utilities", "telecom", "midstream", "pipeline", "railroad", "airport", "waste management")
INFRA_SECTORS = ("Utilities", "Real Estate")
CYCLICAL_SECTORS = ("Energy", "Basic Materials", "Industrials", "Consumer Cyclical")
CYCLICAL_TERMS = ("semiconductor", "auto", "airline", "steel", "shipping", "marine", "homebuilding", "chemicals", "aluminum", "copper", "mining", "luxury goods", "travel")
STAGES = {
    "mature_cash": (True, "core", 8.0, 60.0), "compounder": (True, "core", 8.0, 60.0), "regulated_infra": (True, "ballast", 6.0, 30.0), "financial": (True, "ballast", 6.0, 25.0),
    "cyclical": (True, "tactical", 4.0, 20.0), "early_stage": (True, "speculative", 2.0, 12.0), "distress": (False, "veto", 0.0, 0.0), "unknown": (False, "watch", 0.0, 0.0),
}


def years_beside(statements: DataFrame) -> DataFrame:
    """One line per ticker with each measure of the newest year and the two before it (suffix 0, 1, 2), and ni_mean over
    up to five years. One shuffle by ticker."""
    ranked = statements.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("y"))))
    picks = [F.max(F.when(F.col("k") == k + 1, F.col(m))).alias(f"{m}{k}") for m in MEASURES for k in range(3)]
    return ranked.groupBy("ticker").agg(
        F.count("*").alias("years"), F.max("y").alias("y0"), F.avg(F.when(F.col("k") <= 5, F.col("net_income"))).alias("ni_mean"), F.sum(F.when(F.col("k") <= 5, F.col("net_income"))).alias("ni_sum"), *picks
    )


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.when(b != 0, b))


def f_score(beside: DataFrame) -> DataFrame:
    """Nine criteria, each true, false or unknown: (ticker, score, known, criteria...). Fewer than two years: no line."""
    c = F.col
    roa0, roa1 = _div(c("net_income0"), c("total_assets0")), _div(c("net_income1"), c("total_assets1"))
    margin = lambda k: _div(c(f"revenue{k}") - c(f"cogs{k}"), c(f"revenue{k}"))
    ratio = lambda a, b, k: _div(c(f"{a}{k}"), c(f"{b}{k}"))
    criteria = {
        "roa_positive": roa0 > 0, "cfo_positive": c("cfo0") > 0, "roa_improving": roa0 > roa1, "accruals_ok": c("cfo0") > c("net_income0"),
        "leverage_down": ratio("total_debt", "total_assets", 1) > ratio("total_debt", "total_assets", 0), "liquidity_up": ratio("current_assets", "current_liabilities", 0) > ratio("current_assets", "current_liabilities", 1),
        "no_dilution": c("shares0") <= c("shares1"), "margin_up": margin(0) > margin(1), "turnover_up": ratio("revenue", "total_assets", 0) > ratio("revenue", "total_assets", 1),
    }
    out = beside.where("years >= 2").withColumns(criteria)
    total = lambda f: reduce(lambda a, b: a + b, [f(F.col(k)) for k in criteria])
    score, known = total(lambda x: F.coalesce(x.cast("int"), F.lit(0))), total(lambda x: x.isNotNull().cast("int"))
    return out.select("ticker", score.alias("score"), known.alias("known"), *criteria).where("known > 0")


def quality_flags(frame: DataFrame) -> Column:
    """From pe_ttm, debt_to_equity, net_margin, rev_yoy, fcf and short_pct: an array of names."""
    c = F.col
    tests = {
        "negative trailing earnings": c("pe_ttm") < 0, "priced for high growth": c("pe_ttm") > 60, "heavily levered": c("debt_to_equity") > 200, "unprofitable": c("net_margin") < 0, "revenue shrinking": c("rev_yoy") < 0,
        "negative free cash flow": c("fcf") < 0, "heavily shorted": c("short_pct") > 0.10,
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))


def cash_flags() -> Column:
    """From two years beside each other: negative operating cash flow, and two years of investing more than it."""
    over = lambda k: F.abs(F.col(f"capex{k}")) > F.col(f"cfo{k}")
    return F.array_compact(F.array(F.when(F.col("cfo0") < 0, F.lit("negative operating cash flow")), F.when(over(0) & over(1), F.lit("capex exceeds operating cash flow"))))


def metrics(beside: DataFrame) -> DataFrame:
    """Adds the derived metrics; needs market_cap, sector, industry and dividend_yield (fraction or percent)."""
    c = F.col
    gm = lambda k: _div(c(f"revenue{k}") - c(f"cogs{k}"), c(f"revenue{k}"))
    capex = F.abs("capex0")
    positive = F.when(c("cfo0") > 0, c("cfo0"))
    dy = F.when(c("dividend_yield") > 1, c("dividend_yield") / 100).otherwise(c("dividend_yield"))
    grown = (c("revenue0") > 0) & (c("revenue2") > 0)
    return beside.withColumns({
        "gross_margin": gm(0), "gm_delta": gm(0) - gm(1), "rev_growth_1y": _div(c("revenue0"), c("revenue1")) - 1, "rev_cagr_3y": F.when(grown, F.sqrt(c("revenue0") / c("revenue2")) - 1),
        "capex_to_cfo": _div(capex, positive), "capex_to_rev": _div(capex, c("revenue0")), "cfo_yield": _div(c("cfo0"), c("market_cap")), "fcf_yield": _div(c("cfo0") - capex, c("market_cap")), "burn_shrinking": c("cfo0") > c("cfo1"),
        "dilution_1y": _div(c("shares0"), c("shares1")) - 1, "roa": _div(c("net_income0"), c("total_assets0")), "debt_to_assets": _div(c("total_debt0"), c("total_assets0")), "debt_to_cfo": _div(c("total_debt0"), positive),
        "accrual_gap": c("cfo0") - c("net_income0"), "ni_improving": c("net_income0") > c("net_income1"), "norm_pe": F.when((c("ni_sum") > 0) & (c("market_cap") != 0), c("market_cap") / c("ni_mean")), "div_yield": dy,
        "payout_of_cfo": F.when((dy != 0) & (c("market_cap") != 0), _div(dy * c("market_cap"), positive)),
    })


def distress_markers() -> Column:
    """The names of the markers that hold. Margins do not count against a growing firm priced above eight times its sales."""
    c = F.col
    young = F.coalesce((c("rev_growth_1y").isNull() | (c("rev_growth_1y") >= 0)) & (c("revenue0") > 0) & (c("market_cap") / F.when(c("revenue0") != 0, c("revenue0")) > 8), F.lit(False))
    stress = (F.coalesce("debt_to_assets", F.lit(0.0)) > 0.6) | (F.coalesce("debt_to_cfo", F.lit(0.0)) > 8)
    tests = {
        "revenue falling": c("rev_growth_1y") < -0.05, "margin collapsing": ~young & (c("gm_delta") <= -0.03), "selling near cost": ~young & (c("gross_margin") < 0.05),
        "cash burn deepening": (c("cfo0") < 0) & ~c("burn_shrinking"), "dilution": c("dilution_1y") > 0.15, "balance-sheet stress": stress,
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))


def _mentions(terms) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.coalesce(F.lower("industry"), F.lit("")), F.lit(t)) for t in terms])


def classify(frame: DataFrame) -> DataFrame:
    """Adds distress (names) and stage: the first that fits of unknown, financial, regulated_infra, distress, early_stage,
    cyclical, compounder and mature_cash."""
    c, zero = F.col, lambda x: F.coalesce(F.col(x), F.lit(0.0))
    out = frame.withColumn("distress", distress_markers())
    small = c("revenue0").isNull() | (c("revenue0") < 2e9)
    priced = F.coalesce((c("revenue0") == 0) | ((c("revenue0") < 2e9) & (zero("market_cap") / F.when(c("revenue0") != 0, c("revenue0")).otherwise(1) > 8)), F.lit(False))
    losing = F.coalesce(c("net_income0") <= 0, F.lit(False)) | F.coalesce(c("cfo0") <= 0, F.lit(False))
    fast = (zero("rev_cagr_3y") >= 0.2) | (zero("rev_growth_1y") >= 0.2)
    evidence = F.coalesce(c("gross_margin") < 0.35, F.lit(False)) | F.coalesce(c("gm_delta") <= -0.03, F.lit(False)) | F.coalesce(c("rev_growth_1y") < 0.05, F.lit(False))
    investing = (zero("capex_to_cfo") >= 0.4) | (zero("rev_cagr_3y") >= 0.1) | (zero("rev_growth_1y") >= 0.1)
    sector = F.coalesce("sector", F.lit(""))
    stage = (
        F.when((c("years") < 2) & c("net_income0").isNull(), "unknown").when(((sector == "Financial Services") | _mentions(FINANCIAL_TERMS)) & ~_mentions(FINANCIAL_NOT), "financial")
        .when(sector.isin(*INFRA_SECTORS) | _mentions(INFRA_TERMS), "regulated_infra").when(F.size("distress") >= 3, "distress").when(losing & (fast | priced) & (small | priced), "early_stage")
        .when(_mentions(CYCLICAL_TERMS) | (sector.isin(*CYCLICAL_SECTORS) & evidence), "cyclical").when(investing, "compounder").otherwise("mature_cash")
    )
    return out.withColumn("stage", stage)


def stage_checks() -> Column:
    """The checks of the line's stage as an array of (name, passed), without the unknown ones."""
    c = F.col
    paid = F.when(c("dilution_1y").isNull() & (F.coalesce("div_yield", F.lit(0.0)) == 0), None).otherwise((F.coalesce("dilution_1y", F.lit(0.0)) <= 0.005) | (F.coalesce("div_yield", F.lit(0.0)) > 0.01))
    of = {
        "mature_cash": {"fcf_yield_ok": c("fcf_yield") >= 0.05, "cash_conversion": c("accrual_gap") > 0, "not_shrinking": c("rev_growth_1y") > -0.03, "margin_stable": c("gm_delta") > -0.02, "buyback_or_div": paid, "leverage_ok": c("debt_to_cfo") <= 4, "returns_ok": c("roa") >= 0.05},
        "compounder": {"cfo_yield_ok": c("cfo_yield") >= 0.03, "growing": c("rev_cagr_3y") >= 0.08, "margin_holding": c("gm_delta") > -0.02, "cash_conversion": c("accrual_gap") > 0, "reinvestment_paying_off": c("ni_improving"), "no_dilution": c("dilution_1y") <= 0.02, "leverage_ok": c("debt_to_cfo") <= 4},
        "regulated_infra": {"cfo_positive": c("cfo0") > 0, "distribution_covered": c("payout_of_cfo") <= 0.8, "leverage_ok": c("debt_to_cfo") <= 8, "rate_base_growing": c("rev_growth_1y") >= 0, "no_equity_raid": c("dilution_1y") <= 0.05, "yield_real": c("div_yield") >= 0.02},
        "financial": {"roa_ok": c("roa") >= 0.008, "profitable": c("net_income0") > 0, "revenue_growing": c("rev_growth_1y") >= 0, "no_dilution": c("dilution_1y") <= 0.02, "payout_covered": F.when(c("payout_of_cfo") != 0, c("payout_of_cfo") <= 0.9), "earnings_improving": c("ni_improving")},
        "cyclical": {"not_peak_priced": c("norm_pe") <= 18, "profitable_through_cycle": F.when(c("norm_pe") != 0, True), "balance_sheet_survives_trough": c("debt_to_assets") <= 0.4, "no_dilution": c("dilution_1y") <= 0.03, "cash_generative": c("cfo0") > 0},
        "early_stage": {"growth_intact": c("rev_growth_1y") >= 0.2, "gross_margin_viable": c("gross_margin") >= 0.3, "margin_improving": c("gm_delta") > -0.01, "burn_shrinking": c("burn_shrinking"), "dilution_tolerable": c("dilution_1y") <= 0.1},
    }
    arrays = F.when(F.lit(False), None)
    for stage, checks in of.items():
        rows = F.array(*[F.struct(F.lit(n).alias("check"), t.cast("boolean").alias("passed")) for n, t in checks.items()])
        arrays = arrays.when(c("stage") == stage, rows)
    return F.filter(arrays, lambda r: r["passed"].isNotNull())


def size_cap(stage_cap: Column, beta: Column) -> Column:
    """The cap of a stage by beta: half at two, one and a half times at a half and below; unchanged without a beta."""
    scaled = F.round(stage_cap * F.least(F.lit(1.5), 1 / F.greatest(beta, F.lit(0.5))), 2)
    return F.when((stage_cap == 0) | beta.isNull() | (beta <= 0), stage_cap).otherwise(scaled)
