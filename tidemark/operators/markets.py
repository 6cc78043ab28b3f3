"""News, filings, options, order books, macro series, screens and the ledger."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.sources.shared import checkpointed

#: How many names of a region a scan of all regions takes.
REGION_CAPS = {"US": 6, "SG": 5, "HK": 5, "JP": 2, "KR": 2}


def capped(articles: DataFrame, per_ticker: int = 5) -> DataFrame:
    """The first articles of each ticker as its feed gives them, the newest first."""
    w = Window.partitionBy("ticker").orderBy(F.desc("epoch"), "doc_id")
    return articles.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_ticker).drop("k")


def digest(articles: DataFrame, per_ticker: int = 5, limit: int = 20) -> DataFrame:
    """The capped articles without repeats, those with a sentiment first, then the newest."""
    return without_repeats(capped(articles, per_ticker)).orderBy((F.col("sentiment") == "neutral").cast("int"), F.desc("epoch"), "doc_id").limit(limit)


def without_repeats(articles: DataFrame, title_chars: int = 80) -> DataFrame:
    """Articles whose url and title no earlier article that is *kept* has: ticker by ticker, each one's newest first.

    An article counts as seen only if it is kept, so this is a fold in order, done here in rounds: those that come first
    both for their url and for their title are kept, those that share one with them go, and the rest are asked again. Each
    round settles the first of the rest at least; in most tables there are a few. Blank urls are never kept; titles are
    compared by their first ``title_chars`` characters in lower case, a null one as empty.
    """
    key = F.lower(F.substring(F.coalesce("title", F.lit("")), 1, title_chars))
    rows = articles.where("url <> ''").select(F.struct(*articles.columns).alias("row"), "url", F.xxhash64("url").alias("u"), F.xxhash64(key).alias("t"), F.struct("ticker", (-F.col("epoch")).alias("age"), "doc_id").alias("at"))
    rest, kept = checkpointed(rows.drop("url")), []
    while True:
        first_u = rest.groupBy("u").agg(F.min("at").alias("first_u"))
        first_t = rest.groupBy("t").agg(F.min("at").alias("first_t"))
        asked = checkpointed(rest.join(first_u, "u").join(first_t, "t"))
        taken = asked.where("at = first_u AND at = first_t")
        kept.append(taken.select("row"))
        gone = lambda c: taken.select(F.col(c).alias(f"of_{c}"))
        left = asked.where("NOT (at = first_u AND at = first_t)").drop("first_u", "first_t")
        rest = checkpointed(left.join(gone("u"), F.col("u") == F.col("of_u"), "left_anti").join(gone("t"), F.col("t") == F.col("of_t"), "left_anti"))
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, kept).select("row.*")


def sentiment(articles: DataFrame) -> DataFrame:
    return articles.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("score").alias("avg_score"), F.count_if(F.col("sentiment") == "bullish").alias("bullish"), F.count_if(F.col("sentiment") == "bearish").alias("bearish"))


def insiders(filings: DataFrame, days: int = 20) -> DataFrame:
    """Purchases and sales of the last days per ticker: counts, distinct buyers, net of absolute amounts, cluster of three."""
    until = filings.agg(F.max("d").alias("until"))
    recent = filings.where(F.col("code").isin("P", "S")).join(F.broadcast(until)).where(F.col("d") >= F.date_sub("until", days))
    buy, sell = F.col("code") == "P", F.col("code") == "S"
    out = recent.groupBy("ticker").agg(
        F.count_if(buy).alias("buys"), F.count_if(sell).alias("sells"), F.countDistinct(F.when(buy, F.col("name"))).alias("buyers"), F.sum(F.when(buy, F.abs("change")).otherwise(-F.abs("change"))).alias("net"), F.max(F.when(buy, F.col("d"))).alias("last_buy")
    )
    return out.withColumn("cluster", F.col("buyers") >= 3)


def chain_summary(options: DataFrame, spots: DataFrame) -> DataFrame:
    """Per ticker: implied volatility and straddle at the nearest strikes, strikes of most open interest, put over call."""
    rows = options.join(spots, "ticker").withColumn("dist", F.abs(F.col("strike") - F.col("spot")))
    near, most = F.struct("dist", "ord"), F.struct(-F.col("oi"), "ord")
    pick = lambda kind, by, known: F.min_by(F.struct("strike", "iv", "last", "bid", "ask"), F.when((F.col("kind") == kind) & known, by))
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("oi")))
    known, open_ = F.col("dist").isNotNull(), F.col("oi").isNotNull()
    # Sums and smallest rows only, so all of it is done before the shuffle too and nothing is sorted.
    best = rows.groupBy("ticker").agg(
        F.max("spot").alias("spot"), pick("call", near, known).alias("c"), pick("put", near, known).alias("p"), pick("call", most, open_).alias("co"), pick("put", most, open_).alias("po"), total("put").alias("puts"), total("call").alias("calls")
    )
    price = lambda s: F.coalesce(F.when(F.col(f"{s}.last") != 0, F.col(f"{s}.last")), (F.col(f"{s}.bid") + F.col(f"{s}.ask")) / 2)
    civ, piv = F.col("c.iv"), F.col("p.iv")
    return best.select(
        "ticker", "spot", F.when((civ != 0) & (piv != 0), (civ + piv) / 2).otherwise(F.greatest(civ, piv)).alias("atm_iv"), ((price("c") + price("p")) / F.col("spot") * 100).alias("move_pct"),
        F.col("co.strike").alias("max_oi_call"), F.col("po.strike").alias("max_oi_put"), F.try_divide("puts", "calls").alias("put_call"),
    )


def pains(options: DataFrame) -> DataFrame:
    """(ticker, strike, pain): what the holders of all options of a ticker get if it ends at each of its strikes.

    Running sums over the sorted strikes say it; no strike meets every option.
    """
    per = options.groupBy("ticker", "strike").agg(F.sum(F.when(F.col("kind") == "call", F.col("oi")).otherwise(0)).alias("co"), F.sum(F.when(F.col("kind") == "put", F.col("oi")).otherwise(0)).alias("po"))
    below = Window.partitionBy("ticker").orderBy("strike").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("ticker").orderBy("strike").rowsBetween(0, Window.unboundedFollowing)
    calls = F.col("strike") * F.sum("co").over(below) - F.sum(F.col("co") * F.col("strike")).over(below)
    puts = F.sum(F.col("po") * F.col("strike")).over(above) - F.col("strike") * F.sum("po").over(above)
    return per.select("ticker", "strike", F.round(calls + puts, 4).alias("pain"))


def max_pain(options: DataFrame) -> DataFrame:
    """(ticker, strike, pain): the strike at which the holders get least, the lowest of ties."""
    ranked = pains(options).withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy("pain", "strike")))
    return ranked.where("k = 1").select("ticker", "strike", "pain")


#: The coefficients of Hart's rational approximation of the normal distribution in double precision.
NORMAL_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
NORMAL_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal(x: Column) -> Column:
    """The standard normal distribution function, right to about 1e-14."""
    size = F.abs(x)
    ratio = lambda numbers: reduce(lambda sum_, c: sum_ * size + c, numbers[1:], F.lit(numbers[0]))
    bell = F.exp(-size * size / 2)
    far = reduce(lambda below, k: size + F.lit(float(k)) / below, (4, 3, 2, 1), size + 0.65)
    tail = F.when(size > 37, 0.0).when(size < 7.07106781186547, bell * ratio(NORMAL_TOP) / ratio(NORMAL_BOTTOM)).otherwise(bell / far / 2.506628274631)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def black_scholes(rows: DataFrame) -> DataFrame:
    """Adds price, delta, gamma, vega, theta and rho from s, k, t, r, sigma and kind; without time, volatility or prices the
    price is what exercise pays and the rest zero."""
    s, k, t, r, v = (F.col(c) for c in ("s", "k", "t", "r", "sigma"))
    sign = F.when(F.col("kind") == "call", 1.0).otherwise(-1.0)
    usable = (t > 0) & (v > 0) & (s > 0) & (k > 0)
    out = rows.withColumn("_root", F.when(usable, v * F.sqrt(t)))
    out = out.withColumn("_d1", (F.log(s / k) + (r + v * v / 2) * t) / F.col("_root"))
    out = out.withColumns({"_n1": normal(sign * F.col("_d1")), "_n2": normal(sign * (F.col("_d1") - F.col("_root"))), "_disc": F.exp(-r * t), "_pdf": F.exp(-F.col("_d1") * F.col("_d1") / 2) / math.sqrt(2 * math.pi)})
    n1, n2, disc, pdf = (F.col(c) for c in ("_n1", "_n2", "_disc", "_pdf"))
    of = lambda x, other=0.0: F.when(F.col("_root").isNotNull(), x).otherwise(other)
    greeks = {
        "price": of(sign * (s * n1 - k * disc * n2), F.greatest(sign * (s - k), F.lit(0.0))), "delta": of(sign * n1), "gamma": of(pdf / (s * F.col("_root"))), "vega": of(s * pdf * F.sqrt(t)),
        "theta": of(-s * pdf * v / (2 * F.sqrt(t)) - sign * r * k * disc * n2), "rho": of(sign * k * t * disc * n2),
    }
    return out.withColumns(greeks).drop("_root", "_d1", "_n1", "_n2", "_disc", "_pdf")


def depth(levels: DataFrame) -> DataFrame:
    """Best prices, spread, depth and imbalance of each book that has both sides."""
    side = lambda s, c, f: f(F.when(F.col("side") == s, F.col(c)))
    best = lambda s: F.max(F.when((F.col("side") == s) & (F.col("level") == 1), F.col("price")))
    out = levels.groupBy("ticker").agg(best("bid").alias("best_bid"), best("ask").alias("best_ask"), side("bid", "volume", F.sum).alias("bid_depth"), side("ask", "volume", F.sum).alias("ask_depth"), F.least(side("bid", "level", F.count), side("ask", "level", F.count)).alias("levels"))
    mid = (F.col("best_bid") + F.col("best_ask")) / 2
    spread = F.col("best_ask") - F.col("best_bid")
    return out.where("best_bid <> 0 AND best_ask <> 0").withColumns({"spread": spread, "spread_bps": F.try_divide(spread, mid) * 10_000, "imbalance": F.try_divide("bid_depth", F.col("bid_depth") + F.col("ask_depth"))})


def screen(momentum: DataFrame, top: int = 2) -> DataFrame:
    """Leaders by momentum per market, then oversold names that do not lead: (market, ticker, channel, rank)."""
    usable = momentum.where("n >= 20 AND NOT (market = 'US' AND yoy > 100)")
    lead = usable.withColumn("rank", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("mom_3m"), "ticker"))).where(F.col("rank") <= top)
    weak = usable.where("rsi14 < 50").join(lead.select("ticker"), "ticker", "left_anti")
    weak = weak.withColumn("k", F.row_number().over(Window.partitionBy("market").orderBy("rsi14", "ticker"))).where(F.col("k") <= top)
    return lead.select("market", "ticker", F.lit("leader").alias("channel"), "rank").unionByName(weak.select("market", "ticker", F.lit("oversold").alias("channel"), F.lit(None).cast("int").alias("rank")))


def year_on_year(series: DataFrame, back: int = 12) -> DataFrame:
    """Adds the change on the observation ``back`` places before, by place and not by date."""
    w = Window.partitionBy("series_id").orderBy("d")
    return series.withColumns({"yoy_pct": (F.try_divide("value", F.lag("value", back).over(w)) - 1) * 100, "change": F.col("value") - F.lag("value", back).over(w), "last": F.lead("d").over(w).isNull()})


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, value: str, lag_days: int = 0) -> DataFrame:
    """Adds the newest ``value`` of the right that was known ``lag_days`` after its date at the left's date."""
    facts = right.select(key, F.date_add(F.col(right_time), lag_days).alias("_known"), value)
    found = asof.as_of(left, facts, [key], left_time, "_known", value, "_found", asof.month)
    return found.select(*left.columns, F.col("_found.v").alias(value))


def score_ledger(entries: DataFrame, max_age: int = 90) -> DataFrame:
    """Status of recommendations from price, target, stop, action and age: the target first, then the stop, then age."""
    buy = F.col("action") == "buy"
    status = F.when(buy & (F.col("price") >= F.col("target")), "target").when(buy & (F.col("price") <= F.col("stop")), "stopped").when(F.col("age") > max_age, "expired").otherwise("open")
    return entries.withColumn("status", status)


def calibration(scored: DataFrame) -> DataFrame:
    resolved, hit = F.col("status") != "open", F.col("status") == "target"
    out = scored.groupBy("conviction").agg(F.count("*").alias("n"), F.count_if(resolved).alias("resolved"), F.count_if(hit).alias("hits"), F.avg(F.when(resolved, F.col("price") / F.col("rec_price") - 1)).alias("avg_return"))
    return out.withColumn("hit_rate", F.try_divide("hits", "resolved"))


def session_open(ts: Column, zone: str, opens: int, closes: int) -> Column:
    """Whether a UTC time lies within the local hours (minutes of the day) of a weekday."""
    local = F.from_utc_timestamp(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return F.dayofweek(local).between(2, 6) & (minute >= opens) & (minute < closes)
