"""News, filings, options, macro, screens, ledger, as-of joins and ML features: queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof as A
from tidemark.operators import indicators
from tidemark.operators import markets as O
from tidemark.plans.sql import define, twin
from tidemark.plans.technical import momentum, rounded, snapshot
from tidemark.sources import tables as T
from tidemark.sources.shared import checkpointed, removed, scratch
from tidemark.streaming import events as S
from tidemark.streaming import state as K

QUERIES, ORACLE_SQL = {}, {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = twin(sql)
        return f

    return keep


define("t_cap", "SELECT * FROM t_articles QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY epoch DESC, doc_id) <= 5")
# The fold in order, article by article: what is kept is seen.
_FOLD = """
    , ordered AS MATERIALIZED (SELECT *, lower(substr(coalesce(title, ''), 1, 80)) AS tk, row_number() OVER (ORDER BY ticker, epoch DESC, doc_id) AS i FROM {} WHERE url <> ''),
    fold AS (
        SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS titles, false AS keep
        UNION ALL
        SELECT o.i, CASE WHEN new THEN list_append(urls, url) ELSE urls END, CASE WHEN new THEN list_append(titles, tk) ELSE titles END, new
        FROM (SELECT o.i, o.url, o.tk, f.urls, f.titles, NOT list_contains(f.urls, o.url) AND NOT list_contains(f.titles, o.tk) AS new FROM fold f JOIN ordered o ON o.i = f.i + 1) o),
    kept AS (SELECT o.* FROM ordered o JOIN fold USING (i) WHERE keep)
    """


def folded(table: str, body: str) -> str:
    """A twin over the articles of a common table that the fold keeps."""
    head, tail = twin(f"SELECT 1 FROM {table} --split").rsplit(f"SELECT 1 FROM {table} --split", 1)
    return head.rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + _FOLD.format(table) + body + tail


@register("top03_news_digest")
def top03(spark, sf_dir):
    return O.digest(T.articles(spark, sf_dir)).select("doc_id", "ticker", "title", "sentiment")


ORACLE_SQL["top03_news_digest"] = folded("t_cap", "SELECT doc_id, ticker, title, sentiment FROM kept ORDER BY CASE WHEN sentiment = 'neutral' THEN 1 ELSE 0 END, epoch DESC, doc_id LIMIT 20")


@register("top04_article_cap", "SELECT ticker, count(*) AS n, min(epoch) AS oldest FROM t_cap GROUP BY ticker")
def top04(spark, sf_dir):
    return O.capped(T.articles(spark, sf_dir)).groupBy("ticker").agg(F.count("*").alias("n"), F.min("epoch").alias("oldest"))


@register("set06_two_key_dedupe")
def set06(spark, sf_dir):
    """All articles, without the cap per ticker."""
    return O.without_repeats(T.articles(spark, sf_dir)).select("doc_id", "url")


ORACLE_SQL["set06_two_key_dedupe"] = folded("t_articles", "SELECT doc_id, url FROM kept")


@register("agg14_sentiment", "SELECT ticker, count(*) AS n, round(avg(score), 8) AS avg_score, count(*) FILTER (sentiment = 'bullish') AS bullish, count(*) FILTER (sentiment = 'bearish') AS bearish FROM t_articles GROUP BY ticker")
def agg14(spark, sf_dir):
    return rounded(O.sentiment(T.articles(spark, sf_dir)), 8)


define("t_insider", "SELECT * FROM t_filings WHERE code IN ('P', 'S') AND d >= (SELECT max(d) FROM t_filings) - 20")


@register("flt26_insider_filter", "SELECT event_id, ticker, code, d FROM t_insider")
def flt26(spark, sf_dir):
    f = T.filings(spark, sf_dir)
    return f.where(F.col("code").isin("P", "S")).join(F.broadcast(f.agg(F.max("d").alias("until")))).where(F.col("d") >= F.date_sub("until", 20)).select("event_id", "ticker", "code", "d")


@register("agg15_insiders", """
    SELECT ticker, count(*) FILTER (code = 'P') AS buys, count(*) FILTER (code = 'S') AS sells, count(DISTINCT name) FILTER (code = 'P') AS buyers, round(sum(CASE code WHEN 'P' THEN abs(change) ELSE -abs(change) END), 4) AS net,
           max(d) FILTER (code = 'P') AS last_buy, count(DISTINCT name) FILTER (code = 'P') >= 3 AS "cluster" FROM t_insider GROUP BY ticker""")
def agg15(spark, sf_dir):
    return rounded(O.insiders(T.filings(spark, sf_dir)), 4)


@register("flt27_congress_filter", """
    SELECT event_id, ticker, filed FROM (SELECT event_id, ticker, coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%m/%d/%Y'))::DATE AS filed FROM (
        SELECT event_id, ticker, CASE event_id % 3 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%m/%d/%Y') ELSE 'unknown' END AS raw FROM t_filings)) WHERE filed >= DATE '2024-01-15' AND ticker IN ('Brand#1', 'Brand#2', 'Brand#3')""")
def flt27(spark, sf_dir):
    """Two date formats, anything else is no date; the wanted tickers are a short list."""
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("d", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("d", "MM/dd/yyyy")).otherwise("unknown")
    filed = F.coalesce(F.try_to_date(raw, "yyyy-MM-dd"), F.try_to_date(raw, "MM/dd/yyyy"))
    wanted = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#3",)], "ticker string")
    return T.filings(spark, sf_dir).join(F.broadcast(wanted), "ticker", "left_semi").select("event_id", "ticker", filed.alias("filed")).where("filed >= DATE'2024-01-15'")


QUERIES["dat01_two_formats"], ORACLE_SQL["dat01_two_formats"] = flt27, ORACLE_SQL["flt27_congress_filter"]


@register("jon07_calendar_semi", "SELECT event_id, ticker FROM t_filings WHERE replace(ticker, '#', '') IN (SELECT replace(ticker, '#', '') FROM t_tickers WHERE market = 'SG') AND code = 'M'")
def jon07(spark, sf_dir):
    key = F.replace(F.col("ticker"), F.lit("#"), F.lit(""))
    wanted = T.tickers(spark, sf_dir).where("market = 'SG'").select(key.alias("key"))
    return T.filings(spark, sf_dir).where("code = 'M'").withColumn("key", key).join(wanted, "key", "left_semi").select("event_id", "ticker")


@register("set03_calendar_union", "SELECT d, what, count(*) AS n FROM (SELECT d, 'earnings' AS what FROM t_filings WHERE code = 'M' UNION ALL SELECT d, 'ipo' FROM t_filings WHERE code = 'G') GROUP BY ALL ORDER BY d, what")
def set03(spark, sf_dir):
    f = T.filings(spark, sf_dir)
    rows = f.where("code = 'M'").select("d", F.lit("earnings").alias("what")).unionByName(f.where("code = 'G'").select("d", F.lit("ipo").alias("what")))
    return rows.groupBy("d", "what").agg(F.count("*").alias("n")).orderBy("d", "what")


QUERIES["top12_calendar_order"], ORACLE_SQL["top12_calendar_order"] = set03, ORACLE_SQL["set03_calendar_union"]

define("t_opt", "SELECT o.*, 950.0::DOUBLE AS spot FROM t_options o")
define("t_opt2", "SELECT *, row_number() OVER (PARTITION BY ticker, kind ORDER BY abs(strike - spot), ord) AS near, row_number() OVER (PARTITION BY ticker, kind ORDER BY oi DESC, ord) AS most FROM t_opt")


def chain(spark, sf_dir):
    return T.options(spark, sf_dir)


@register("agg18_option_chain", """
    SELECT ticker, round((civ + piv) / 2, 6) AS atm_iv, round((cl + pl) / spot * 100, 6) AS move_pct, mc AS max_oi_call, mp AS max_oi_put, round(po / nullif(co, 0), 6) AS put_call FROM (
        SELECT ticker, max(spot) AS spot, max(iv) FILTER (kind = 'call' AND near = 1) AS civ, max(iv) FILTER (kind = 'put' AND near = 1) AS piv, max(last) FILTER (kind = 'call' AND near = 1) AS cl, max(last) FILTER (kind = 'put' AND near = 1) AS pl,
               max(strike) FILTER (kind = 'call' AND most = 1) AS mc, max(strike) FILTER (kind = 'put' AND most = 1) AS mp, sum(oi) FILTER (kind = 'put') AS po, sum(oi) FILTER (kind = 'call') AS co FROM t_opt2 GROUP BY ticker)""")
def agg18(spark, sf_dir):
    spots = T.tickers(spark, sf_dir).select("ticker", F.lit(950.0).alias("spot"))
    return rounded(O.chain_summary(chain(spark, sf_dir), spots).drop("spot"))


QUERIES["top15_nearest_strike"] = lambda spark, sf_dir: agg18(spark, sf_dir).select("ticker", "atm_iv")
ORACLE_SQL["top15_nearest_strike"] = twin("SELECT ticker, round((max(iv) FILTER (kind = 'call' AND near = 1) + max(iv) FILTER (kind = 'put' AND near = 1)) / 2, 6) AS atm_iv FROM t_opt2 GROUP BY ticker")


@register("agg19_max_pain", """
    SELECT ticker, strike, round(pain, 2) AS pain FROM (
        SELECT s.ticker, s.strike, round(sum(oi * CASE WHEN kind = 'call' THEN greatest(s.strike - o.strike, 0) ELSE greatest(o.strike - s.strike, 0) END), 4) AS pain
        FROM (SELECT DISTINCT ticker, strike FROM t_options) s JOIN t_options o USING (ticker) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY pain, strike) = 1""")
def agg19(spark, sf_dir):
    return rounded(O.max_pain(chain(spark, sf_dir)), 2)


@register("jon16_strikes_by_options", """
    SELECT s.ticker, s.strike, round(sum(oi * CASE WHEN kind = 'call' THEN greatest(s.strike - o.strike, 0) ELSE greatest(o.strike - s.strike, 0) END), 2) AS pain
    FROM (SELECT DISTINCT ticker, strike FROM t_options) s JOIN t_options o USING (ticker) GROUP BY 1, 2""")
def jon16(spark, sf_dir):
    """What every strike costs the holders of every option of its ticker."""
    return rounded(O.pains(chain(spark, sf_dir)), 2)


def _normal(x: str) -> str:
    """The same approximation of the normal distribution as SQL text."""
    ratio = lambda numbers: "(" * (len(numbers) - 1) + f"{numbers[0]!r}::DOUBLE" + "".join(f" * abs({x}) + {c!r})" for c in numbers[1:])
    return f"(CASE WHEN {x} > 0 THEN 1 - exp(-({x}) * ({x}) / 2) * {ratio(O.NORMAL_TOP)} / {ratio(O.NORMAL_BOTTOM)} ELSE exp(-({x}) * ({x}) / 2) * {ratio(O.NORMAL_TOP)} / {ratio(O.NORMAL_BOTTOM)} END)"


@register("mth04_black_scholes", f"""
    SELECT ord, kind, s, k, t, r, sigma, round(CASE WHEN sigma > 0 THEN sg * (s * n1 - k * disc * n2) ELSE greatest(sg * (s - k), 0) END, 6) AS price, round(CASE WHEN sigma > 0 THEN sg * n1 ELSE 0 END, 6) AS delta, round(CASE WHEN sigma > 0 THEN pdf / (s * root) ELSE 0 END, 6) AS gamma,
           round(CASE WHEN sigma > 0 THEN s * pdf * sqrt(t) ELSE 0 END, 6) AS vega, round(CASE WHEN sigma > 0 THEN -s * pdf * sigma / (2 * sqrt(t)) - sg * r * k * disc * n2 ELSE 0 END, 6) AS theta, round(CASE WHEN sigma > 0 THEN sg * k * t * disc * n2 ELSE 0 END, 6) AS rho FROM (
        SELECT *, {_normal("x1")} AS n1, {_normal("x2")} AS n2, exp(-r * t) AS disc, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS pdf FROM (
            SELECT *, sg * d1 AS x1, sg * (d1 - root) AS x2 FROM (SELECT *, (ln(s / k) + (r + sigma * sigma / 2) * t) / root AS d1 FROM (
                SELECT *, CASE WHEN kind = 'call' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sg, nullif(sigma * sqrt(t), 0) AS root FROM (
                    SELECT ord, kind, 950.0::DOUBLE AS s, strike AS k, 0.25::DOUBLE AS t, 0.05::DOUBLE AS r, iv AS sigma FROM t_options)))))""")
def mth04(spark, sf_dir):
    rows = T.options(spark, sf_dir).select("ord", "kind", F.lit(950.0).alias("s"), F.col("strike").alias("k"), F.lit(0.25).alias("t"), F.lit(0.05).alias("r"), F.col("iv").alias("sigma"))
    return rounded(O.black_scholes(rows))


QUERIES["udf02_black_scholes"], ORACLE_SQL["udf02_black_scholes"] = mth04, ORACLE_SQL["mth04_black_scholes"]


@register("agg20_order_book", """
    SELECT ticker, round(best_bid, 4) AS best_bid, round(best_ask, 4) AS best_ask, bid_depth, ask_depth, levels, round(best_ask - best_bid, 4) AS spread, round((best_ask - best_bid) / ((best_ask + best_bid) / 2) * 10000, 4) AS spread_bps, round(bid_depth / (bid_depth + ask_depth), 6) AS imbalance FROM (
        SELECT ticker, max(price) FILTER (side = 'bid' AND level = 1) AS best_bid, max(price) FILTER (side = 'ask' AND level = 1) AS best_ask, CAST(sum(volume) FILTER (side = 'bid') AS BIGINT) AS bid_depth, CAST(sum(volume) FILTER (side = 'ask') AS BIGINT) AS ask_depth,
               least(count(*) FILTER (side = 'bid'), count(*) FILTER (side = 'ask')) AS levels FROM t_levels GROUP BY ticker)""")
def agg20(spark, sf_dir):
    return rounded(O.depth(T.levels(spark, sf_dir)), 4, imbalance=6)


# ------------------------------------------------------------------ screens, universes, sets

define("t_mom", """
    SELECT ticker, market, (max(c) FILTER (rn = n) / max(c) FILTER (rn = greatest(n - 63, 1)) - 1) * 100 AS mom_3m, (max(c) FILTER (rn = n) / max(c) FILTER (rn = greatest(n - 252, 1)) - 1) * 100 AS yoy, max(n) AS n, any_value(rsi14) AS rsi14
    FROM t_num JOIN t_tickers USING (ticker) JOIN t_rec USING (ticker) GROUP BY ticker, market""")
define("t_usable", "SELECT * FROM t_mom WHERE n >= 20 AND NOT (market = 'US' AND yoy > 100)")
define("t_lead", "SELECT *, row_number() OVER (PARTITION BY market ORDER BY mom_3m DESC, ticker) AS rank FROM t_usable QUALIFY rank <= 2")
define("t_weak", "SELECT * FROM t_usable WHERE rsi14 < 50 AND ticker NOT IN (SELECT ticker FROM t_lead) QUALIFY row_number() OVER (PARTITION BY market ORDER BY rsi14, ticker) <= 2")


def movers(spark, sf_dir):
    rsi = snapshot(spark, sf_dir).select("ticker", "rsi14")
    return momentum(spark, sf_dir).join(rsi, "ticker").join(T.tickers(spark, sf_dir).select("ticker", "market"), "ticker")


@register("flt25_screener", "SELECT market, ticker, 'leader' AS channel, CAST(rank AS INTEGER) AS rank FROM t_lead UNION ALL SELECT market, ticker, 'oversold', NULL FROM t_weak")
def flt25(spark, sf_dir):
    return O.screen(movers(spark, sf_dir))


@register("top01_leaders", "SELECT market, ticker, CAST(rank AS INTEGER) AS rank, round(mom_3m, 6) AS mom_3m FROM t_lead")
def top01(spark, sf_dir):
    m = movers(spark, sf_dir).where("n >= 20 AND NOT (market = 'US' AND yoy > 100)")
    ranked = m.withColumn("rank", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("mom_3m"), "ticker"))).where("rank <= 2")
    return rounded(ranked.select("market", "ticker", "rank", "mom_3m"))


QUERIES["win25_momentum_rank"], ORACLE_SQL["win25_momentum_rank"] = top01, ORACLE_SQL["top01_leaders"]


@register("top02_oversold", "SELECT market, ticker FROM t_weak")
def top02(spark, sf_dir):
    return O.screen(movers(spark, sf_dir)).where("channel = 'oversold'").select("market", "ticker")


QUERIES["jon08_oversold_minus_leaders"], ORACLE_SQL["jon08_oversold_minus_leaders"] = top02, ORACLE_SQL["top02_oversold"]


@register("top16_region_caps", "SELECT market, ticker FROM (SELECT ticker, market, row_number() OVER (PARTITION BY market ORDER BY mom_3m DESC, ticker) AS k FROM t_mom) JOIN (VALUES ('US', 6), ('SG', 5), ('HK', 5), ('JP', 2), ('KR', 2)) c(m, cap) ON market = m WHERE k <= cap")
def top16(spark, sf_dir):
    caps = spark.createDataFrame(list(O.REGION_CAPS.items()), "m string, cap int")
    m = movers(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("market").orderBy(F.desc("mom_3m"), "ticker")))
    return m.join(F.broadcast(caps), F.col("market") == F.col("m")).where("k <= cap").select("market", "ticker")


@register("top05_largest_shifts", "SELECT ticker, round(change_pct, 6) AS change_pct FROM t_quotes WHERE abs(change_pct) >= 2 ORDER BY abs(change_pct) DESC, ticker LIMIT 8")
def top05(spark, sf_dir):
    q = T.quotes(spark, sf_dir).where(F.abs("change_pct") >= 2)
    return rounded(q.orderBy(F.desc(F.abs("change_pct")), "ticker").limit(8).select("ticker", "change_pct"))


@register("top08_priority_order", "SELECT ticker, priority FROM (SELECT ticker, CASE WHEN abs(change_pct) > 50 THEN 'high' WHEN abs(change_pct) > 20 THEN 'medium' ELSE 'low' END AS priority FROM t_quotes) ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, ticker")
def top08(spark, sf_dir):
    size = F.abs("change_pct")
    rows = T.quotes(spark, sf_dir).select("ticker", F.when(size > 50, "high").when(size > 20, "medium").otherwise("low").alias("priority"))
    return rows.orderBy(F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2), "ticker")


@register("top13_tail", "SELECT ticker, count(*) AS n, min(d) AS first FROM t_last GROUP BY ticker")
def top13(spark, sf_dir):
    return T.numbered(T.bars(spark, sf_dir)).where("rn_desc <= 260").groupBy("ticker").agg(F.count("*").alias("n"), F.min("d").alias("first"))


@register("set01_ordered_union", "SELECT ticker, min(o) AS ord FROM (SELECT ticker, num AS o FROM t_tickers WHERE market = 'US' UNION ALL SELECT ticker, num + 100 FROM t_tickers WHERE num > 10) GROUP BY ticker")
def set01(spark, sf_dir):
    t = T.tickers(spark, sf_dir)
    both = t.where("market = 'US'").select("ticker", F.col("num").alias("o")).unionByName(t.where("num > 10").select("ticker", (F.col("num") + 100).alias("o")))
    return both.groupBy("ticker").agg(F.min("o").alias("ord"))


@register("set02_union_distinct", "SELECT ticker FROM t_tickers WHERE market = 'US' UNION SELECT ticker FROM t_tickers WHERE num > 10 ORDER BY ticker")
def set02(spark, sf_dir):
    t = T.tickers(spark, sf_dir)
    return t.where("market = 'US'").select("ticker").union(t.where("num > 10").select("ticker")).distinct().orderBy("ticker")


@register("set04_except", "SELECT ticker FROM t_tickers EXCEPT SELECT ticker FROM t_lead")
def set04(spark, sf_dir):
    leaders = O.screen(movers(spark, sf_dir)).where("channel = 'leader'").select("ticker")
    return T.tickers(spark, sf_dir).select("ticker").exceptAll(leaders)


@register("set05_intersect", "SELECT ticker FROM t_tickers WHERE num % 2 = 0 INTERSECT SELECT ticker FROM t_quotes WHERE change_pct > 0")
def set05(spark, sf_dir):
    return T.tickers(spark, sf_dir).where("num % 2 = 0").select("ticker").intersect(T.quotes(spark, sf_dir).where("change_pct > 0").select("ticker"))


@register("set07_clean_tickers", "SELECT list_distinct(list_transform(list(' ' || lower(ticker) || ' ' ORDER BY num), lambda x: upper(trim(x)))) IS NOT NULL AS ok, count(DISTINCT upper(trim(' ' || lower(ticker)))) AS n FROM t_tickers")
def set07(spark, sf_dir):
    dirty = T.tickers(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("num", F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ")).alias("t")))).alias("a"))
    clean = F.array_distinct(F.filter(F.transform("a", lambda x: F.upper(F.trim(x["t"]))), lambda x: x != ""))
    return dirty.select(clean.isNotNull().alias("ok"), F.size(clean).cast("long").alias("n"))


@register("src21_universe_audit", "SELECT ticker, ticker IN (SELECT ticker FROM t_quotes WHERE price > 1500) AS resolved FROM t_tickers")
def src21(spark, sf_dir):
    t, q = T.tickers(spark, sf_dir).select("ticker"), T.quotes(spark, sf_dir).where("price > 1500").select("ticker")
    return t.join(q, "ticker", "left_semi").withColumn("resolved", F.lit(True)).unionByName(t.join(q, "ticker", "left_anti").withColumn("resolved", F.lit(False)))


@register("src32_fallback_chain", """
    SELECT ticker, source, price FROM (SELECT ticker, 'broker' AS source, 0 AS k, round(price, 4) AS price FROM t_quotes WHERE change_pct > 5 UNION ALL SELECT ticker, 'web', 1, round(prev, 4) FROM t_quotes WHERE change_pct < 0 UNION ALL SELECT ticker, 'static', 2, 1.0 FROM t_tickers)
    QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY k) = 1""")
def src32(spark, sf_dir):
    """The first source that knows a ticker wins."""
    q = T.quotes(spark, sf_dir)
    rows = q.where("change_pct > 5").select("ticker", F.lit("broker").alias("source"), F.lit(0).alias("k"), F.round("price", 4).alias("price"))
    rows = rows.unionByName(q.where("change_pct < 0").select("ticker", F.lit("web").alias("source"), F.lit(1).alias("k"), F.round("prev", 4).alias("price")))
    rows = rows.unionByName(T.tickers(spark, sf_dir).select("ticker", F.lit("static").alias("source"), F.lit(2).alias("k"), F.lit(1.0).alias("price")))
    return rows.withColumn("first", F.row_number().over(Window.partitionBy("ticker").orderBy("k"))).where("first = 1").select("ticker", "source", "price")


# ------------------------------------------------------------------ supply chain

define("t_chain", "SELECT ticker, ['chips', 'energy', 'autos'][num % 3 + 1] AS chain, ['up', 'mid', 'down'][num % 4 % 3 + 1] AS tier FROM t_tickers")


def tiers(spark, sf_dir):
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), at + 1)
    dim = T.tickers(spark, sf_dir).select("ticker", pick(("chips", "energy", "autos"), F.col("num") % 3).alias("chain"), pick(("up", "mid", "down"), F.col("num") % 4 % 3).alias("tier"))
    return dim.join(momentum(spark, sf_dir).select("ticker", "mom_3m"), "ticker", "left")


define("t_tier", "SELECT chain, tier, median(mom_3m) AS med, count(mom_3m) AS covered, count(*) AS members FROM t_chain LEFT JOIN t_mom USING (ticker) GROUP BY chain, tier")


@register("agg16_tier_median", "SELECT chain, tier, round(med, 6) AS med, covered, members FROM t_tier")
def agg16(spark, sf_dir):
    return rounded(tiers(spark, sf_dir).groupBy("chain", "tier").agg(F.median("mom_3m").alias("med"), F.count("mom_3m").alias("covered"), F.count("*").alias("members")))


QUERIES["jon19_tier_membership"], ORACLE_SQL["jon19_tier_membership"] = agg16, ORACLE_SQL["agg16_tier_median"]


@register("agg17_chain_divergence", """
    SELECT chain, round(u - w, 6) AS divergence, CASE WHEN u - w >= 8 THEN 'upstream leads' WHEN u - w <= -8 THEN 'downstream leads' ELSE 'aligned' END AS reading FROM (SELECT chain, max(med) FILTER (tier = 'up') AS u, max(med) FILTER (tier = 'down') AS w FROM t_tier GROUP BY chain)""")
def agg17(spark, sf_dir):
    wide = tiers(spark, sf_dir).groupBy("chain").pivot("tier", ["up", "down"]).agg(F.median("mom_3m"))
    gap = F.col("up") - F.col("down")
    return rounded(wide.select("chain", gap.alias("divergence"), F.when(gap >= 8, "upstream leads").when(gap <= -8, "downstream leads").otherwise("aligned").alias("reading")))


# ------------------------------------------------------------------ macro, as-of, ledger

define("t_yoy", """
    SELECT series_id, d, value, (value / nullif(lag(value, 12) OVER w, 0) - 1) * 100 AS yoy_pct, value - lag(value, 12) OVER w AS change, lead(d) OVER w IS NULL AS last FROM t_macro WINDOW w AS (PARTITION BY series_id ORDER BY d)""")


@register("win20_year_on_year", "SELECT series_id, d, round(yoy_pct, 6) AS yoy_pct, round(change, 2) AS change FROM t_yoy")
def win20(spark, sf_dir):
    return rounded(O.year_on_year(T.macro(spark, sf_dir)).select("series_id", "d", "yoy_pct", "change"), 6, change=2)


@register("win21_latest", "SELECT series_id, arg_max(value, d) AS v, max(d) AS d FROM (SELECT series_id, d, round(value, 2) AS value FROM t_macro) GROUP BY series_id")
def win21(spark, sf_dir):
    return rounded(T.macro(spark, sf_dir).groupBy("series_id").agg(F.max_by("value", "d").alias("v"), F.max("d").alias("d")), 2)


@register("flt24_regime_flags", "SELECT series_id, coalesce(yoy_pct > 3, false) AS hot, coalesce(change < 0, false) AS shrinking FROM t_yoy WHERE last")
def flt24(spark, sf_dir):
    y = O.year_on_year(T.macro(spark, sf_dir)).where("last")
    return y.select("series_id", F.coalesce(F.col("yoy_pct") > 3, F.lit(False)).alias("hot"), F.coalesce(F.col("change") < 0, F.lit(False)).alias("shrinking"))


@register("jon09_as_of_backward", """
    SELECT ticker, a.d, a.series_id, round(m.value, 2) AS value FROM (SELECT ticker, d, series_id FROM t_bars, (SELECT DISTINCT series_id FROM t_macro)) a
    ASOF JOIN (SELECT series_id, d + 45 AS known, value FROM t_macro) m ON a.series_id = m.series_id AND a.d >= m.known""")
def jon09(spark, sf_dir):
    """What was known of each monthly series, 45 days after its date, on every day of every ticker."""
    facts = T.macro(spark, sf_dir).select("series_id", F.date_add("d", 45).alias("known"), "value")
    return rounded(A.valid_at(T.bars(spark, sf_dir).select("ticker", "d"), facts, "series_id", "d", "known", "value"), 2)


@register("jon09_latest_price", "SELECT id, a.d, round(b.c, 8) AS c FROM (SELECT l_orderkey * 8 + l_linenumber AS id, p_brand AS ticker, CAST(l_shipdate AS DATE) - 7 AS d FROM lineitem JOIN part ON l_partkey = p_partkey) a ASOF LEFT JOIN t_bars b ON a.ticker = b.ticker AND a.d >= b.d")
def jon09_latest_price(spark, sf_dir):
    """The newest close of its ticker a week before each line item ships: few keys, many rows each."""
    part = T.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    lines = T.read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), "ticker", F.date_sub(F.to_date("l_shipdate"), 7).alias("d"))
    found = A.as_of(lines, T.bars(spark, sf_dir).select("ticker", F.col("d").alias("day"), "c"), ["ticker"], "d", "day", "c", "bar", A.month)
    return rounded(found.select("id", "d", F.col("bar.v").alias("c")), 8)


@register("jon10_as_of_forward", "SELECT series_id, m.d, b.d AS next FROM t_macro m ASOF LEFT JOIN (SELECT d FROM t_bench) b ON b.d >= m.d")
def jon10(spark, sf_dir):
    """The first day of the index on or after each date."""
    days = T.benchmark(spark, sf_dir).select(F.col("d").alias("day"), F.col("d").alias("of"))
    found = A.as_of(T.macro(spark, sf_dir).select("series_id", "d"), days, [], "d", "day", "of", "next", A.month, forward=True)
    return found.select("series_id", "d", F.col("next.at").alias("next"))


@register("jon18_date_range", "SELECT ticker, count(*) AS n, round(sum(v), 2) AS v FROM t_bars WHERE d BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY ticker")
def jon18(spark, sf_dir):
    return rounded(T.bars(spark, sf_dir).where("d BETWEEN DATE'1997-01-01' AND DATE'1997-12-31'").groupBy("ticker").agg(F.count("*").alias("n"), F.sum("v").alias("v")), 2)


define("t_led", """
    SELECT ticker || '@' || CAST(rn AS VARCHAR) AS id, ticker, d, c AS rec_price, lead(c, 30) OVER w AS price, c * 1.2 AS target, c * 0.9 AS stop, lead(d, 30) OVER w - d AS age, CASE WHEN rn // 20 % 4 = 0 THEN 'sell' ELSE 'buy' END AS action, ['low', 'medium', 'high'][rn % 3 + 1] AS conviction, rn
    FROM t_num WINDOW w AS (PARTITION BY ticker ORDER BY d)""")
define("t_entries", "SELECT *, CASE WHEN action = 'buy' AND price >= target THEN 'target' WHEN action = 'buy' AND price <= stop THEN 'stopped' WHEN age > 40 THEN 'expired' ELSE 'open' END AS status FROM t_led WHERE rn % 20 = 0 AND price IS NOT NULL")


def entries(spark, sf_dir):
    day = Window.partitionBy("ticker").orderBy("d")
    b = T.numbered(T.bars(spark, sf_dir))
    rows = b.withColumns({
        "id": F.concat("ticker", F.lit("@"), F.col("rn").cast("string")), "rec_price": F.col("c"), "price": F.lead("c", 30).over(day), "target": F.col("c") * 1.2, "stop": F.col("c") * 0.9, "age": F.datediff(F.lead("d", 30).over(day), "d"),
        "action": F.when(F.floor(F.col("rn") / 20) % 4 == 0, "sell").otherwise("buy"), "conviction": F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("rn") % 3 + 1),
    })
    return O.score_ledger(rows.where("rn % 20 = 0 AND price IS NOT NULL"), 40)


@register("stm04_ledger_states", """
    SELECT e.id, action, coalesce(min(x), {'d': NULL, 's': 'open', 'c': NULL}).s AS status, min(x).d AS resolved, round((coalesce(min(x).c, arg_max(c, p.d)) / rec_price - 1) * 100, 6) AS return_pct FROM
        (SELECT * FROM t_led WHERE rn % 20 = 0) e LEFT JOIN (SELECT ticker, d, c FROM t_num) p ON p.ticker = e.ticker AND p.d > e.d,
        LATERAL (SELECT CASE WHEN action = 'buy' AND c >= target THEN 'target' WHEN action = 'buy' AND c <= stop THEN 'stopped' WHEN p.d - e.d > 90 THEN 'expired' END AS s) o,
        LATERAL (SELECT CASE WHEN s IS NOT NULL THEN {'d': p.d, 's': s, 'c': c} END AS x) y
    GROUP BY e.id, action, rec_price""")
def stm04(spark, sf_dir):
    """Every twentieth bar is a recommendation; the stream of the following closes resolves it."""
    folder = scratch(spark, "ledger")
    b = T.numbered(T.bars(spark, sf_dir)).withColumn("t", F.unix_date("d").cast("long") * 86_400_000_000)
    led = {"id": F.concat("ticker", F.lit("@"), F.col("rn").cast("string")), "rec_price": F.col("c"), "target": F.col("c") * 1.2, "stop": F.col("c") * 0.9, "action": F.when(F.floor(F.col("rn") / 20) % 4 == 0, "sell").otherwise("buy")}
    b.where("rn % 20 = 0").withColumns(led).select("ticker", "t", *led).write.parquet(f"{folder}/entries")
    b.select("ticker", "t", F.col("c").alias("value")).repartitionByRange("t").write.parquet(f"{folder}/prices")
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{folder}/{name}").schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/{name}")
    last = K.newest(S.drain(spark, K.ledger(read("entries"), read("prices")), "update"), "id")
    removed(spark, folder)
    day = F.date_from_unix_date((F.col("resolved") / 86_400_000_000).cast("int")).alias("resolved")
    return rounded(last.select("id", "action", "status", day, "return_pct"), 6)


@register("agg25_calibration", """
    SELECT conviction, count(*) AS n, count(*) FILTER (status <> 'open') AS resolved, count(*) FILTER (status = 'target') AS hits, round(avg(price / rec_price - 1) FILTER (status <> 'open'), 8) AS avg_return, round(count(*) FILTER (status = 'target') / nullif(count(*) FILTER (status <> 'open'), 0), 8) AS hit_rate FROM t_entries GROUP BY conviction""")
def agg25(spark, sf_dir):
    return rounded(O.calibration(entries(spark, sf_dir)), 8)


@register("jon05_recs_with_blocks", "SELECT e.id, round(s.c, 4) AS last FROM t_entries e JOIN (SELECT ticker, c FROM t_num WHERE rn = n) s USING (ticker) WHERE action = 'buy'")
def jon05(spark, sf_dir):
    last = T.numbered(T.bars(spark, sf_dir)).where("rn_desc = 1").select("ticker", F.col("c").alias("last"))
    return rounded(entries(spark, sf_dir).where("action = 'buy'").select("id", "ticker").join(last, "ticker").select("id", "last"), 4)


@register("jon06_idempotent_append", "SELECT id FROM t_entries WHERE id NOT IN (SELECT id FROM t_entries WHERE conviction = 'low')")
def jon06(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.select("id").dropDuplicates(["id"]).join(e.where("conviction = 'low'").select("id"), "id", "left_anti")


@register("stm05_latest_levels", "SELECT ticker, arg_max(id, d) AS id, round(arg_max(stop, d), 4) AS stop FROM t_entries GROUP BY ticker")
def stm05(spark, sf_dir):
    return rounded(entries(spark, sf_dir).groupBy("ticker").agg(F.max_by("id", "d").alias("id"), F.max_by("stop", "d").alias("stop")), 4)


# ------------------------------------------------------------------ halves, calendars

@register("win26_halves", "SELECT event_type, count(*) FILTER (d > DATE '2024-01-15') AS last_half, count(*) FILTER (d <= DATE '2024-01-15') AS first_half, round((count(*) FILTER (d > DATE '2024-01-15') / count(*) FILTER (d <= DATE '2024-01-15') - 1) * 100, 6) AS growth FROM (SELECT event_type, CAST(ts AS DATE) AS d FROM events) GROUP BY event_type")
def win26(spark, sf_dir):
    d = F.to_date("ts")
    late, early = F.count_if(d > F.lit("2024-01-15").cast("date")), F.count_if(d <= F.lit("2024-01-15").cast("date"))
    return rounded(T.read(spark, sf_dir, "events").groupBy("event_type").agg(late.alias("last_half"), early.alias("first_half"), ((F.try_divide(late, early) - 1) * 100).alias("growth")))


@register("win29_sessions", """
    SELECT market, count(*) AS n FROM events, (VALUES ('US', 'America/New_York', 570, 960), ('SG', 'Asia/Singapore', 540, 1020), ('JP', 'Asia/Tokyo', 540, 900)) z(market, zone, o, c)
    WHERE isodow(timezone(zone, timezone('UTC', ts))) BETWEEN 1 AND 5 AND hour(timezone(zone, timezone('UTC', ts))) * 60 + minute(timezone(zone, timezone('UTC', ts))) BETWEEN o AND c - 1 GROUP BY market""")
def win29(spark, sf_dir):
    zones = (("US", "America/New_York", 570, 960), ("SG", "Asia/Singapore", 540, 1020), ("JP", "Asia/Tokyo", 540, 900))
    ts = F.col("ts").cast("timestamp")
    hits = F.filter(F.array(*[F.when(O.session_open(ts, zone, o, c), F.lit(m)) for m, zone, o, c in zones]), lambda m: m.isNotNull())
    return T.read(spark, sf_dir, "events").select(F.explode(hits).alias("market")).groupBy("market").agg(F.count("*").alias("n"))


QUERIES["dat04_time_zones"], ORACLE_SQL["dat04_time_zones"] = win29, ORACLE_SQL["win29_sessions"]

# ------------------------------------------------------------------ ML samples

define("t_sample", """
    SELECT ticker, d, rn, c / lag(c, 20) OVER w - 1 AS r20, c / lag(c, 60) OVER w - 1 AS r60, c / nullif(high_252, 0) - 1 AS from_high, vol20, v / nullif(avg_volume_20, 0) AS volume_ratio, lead(c, 60) OVER w / c - 1 AS fwd
    FROM t_roll WINDOW w AS (PARTITION BY ticker ORDER BY d)""")
define("t_samples", "SELECT *, fwd - avg(fwd) OVER (PARTITION BY d) AS rel FROM t_sample WHERE rn >= 252 AND fwd IS NOT NULL")


def samples(spark, sf_dir):
    day = Window.partitionBy("ticker").orderBy("d")
    r = indicators.rolling(T.bars(spark, sf_dir))
    rows = r.select(
        "ticker", "d", "bar", (F.try_divide("c", F.lag("c", 20).over(day)) - 1).alias("r20"), (F.try_divide("c", F.lag("c", 60).over(day)) - 1).alias("r60"), (F.try_divide("c", "high_252") - 1).alias("from_high"), "vol20",
        F.try_divide("v", "avg_volume_20").alias("volume_ratio"), (F.try_divide(F.lead("c", 60).over(day), "c") - 1).alias("fwd"),
    ).where("bar >= 252 AND fwd IS NOT NULL")
    return rows.withColumn("rel", F.col("fwd") - F.avg("fwd").over(Window.partitionBy("d")))


@register("flt31_dead_zone", "SELECT ticker, d, round(rel, 8) AS rel, rel > 0 AS up FROM t_samples WHERE abs(rel) >= 0.02")
def flt31(spark, sf_dir):
    return rounded(samples(spark, sf_dir).where(F.abs("rel") >= 0.02).select("ticker", "d", "rel", (F.col("rel") > 0).alias("up")), 8)


QUERIES["mlp02_sample_builder"], ORACLE_SQL["mlp02_sample_builder"] = flt31, ORACLE_SQL["flt31_dead_zone"]


@register("flt32_degenerate_columns", "SELECT count(DISTINCT r20) >= 2 AS r20, count(DISTINCT volume_ratio) >= 2 AS volume_ratio, count(DISTINCT 1) >= 2 AS constant FROM t_samples")
def flt32(spark, sf_dir):
    s = samples(spark, sf_dir).withColumn("constant", F.lit(1))
    return s.agg(*[(F.countDistinct(c) >= 2).alias(c) for c in ("r20", "volume_ratio", "constant")])


@register("win28_time_folds", "SELECT fold, count(*) AS n, min(d) AS first, max(d) AS last FROM (SELECT d, ntile(6) OVER (ORDER BY d) AS fold FROM (SELECT DISTINCT d FROM t_samples)) GROUP BY fold")
def win28(spark, sf_dir):
    """Folds over distinct days; a day is a row, so the one window is small."""
    days = samples(spark, sf_dir).select("d").distinct().withColumn("one", F.lit(1))
    return days.withColumn("fold", F.ntile(6).over(Window.partitionBy("one").orderBy("d"))).groupBy("fold").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"))


_FEATURES = ["r20", "r60", "from_high", "vol20", "volume_ratio"]
#: Trees of the registered queries: each takes four passes over the samples, a job each.
_TREES = 25


def labelled(spark, sf_dir):
    return samples(spark, sf_dir).where(F.abs("rel") >= 0.02)


@register("mlp01_boosted_trees")
def mlp01(spark, sf_dir):
    """What each feature is worth to boosted trees, trained on the days before the newest fifth and asked on these."""
    from tidemark.operators import ml

    rows = checkpointed(labelled(spark, sf_dir))
    found = ml.importances(rows, ml.usable(rows, _FEATURES), _TREES)
    return spark.createDataFrame(list(found.items()), "feature string, importance double")


@register("agg38_validation_metrics")
def agg38(spark, sf_dir):
    """Accuracy and area under the curve of five folds, each trained on the days before it, and their means as fold 0."""
    from tidemark.operators import ml

    rows = checkpointed(labelled(spark, sf_dir))
    return rounded(ml.validate(rows, ml.usable(rows, _FEATURES), most_trees=_TREES), 4)


_ARTIFACTS: dict[tuple[str, str], str] = {}


def artifact_folder(spark, sf_dir):
    """Where this application has written its model of the tables, trained when it is first asked for."""
    from tidemark.operators import ml

    key = spark.sparkContext.applicationId, sf_dir
    if key not in _ARTIFACTS:
        folder = scratch(spark, "model")
        ml.save(ml.train(checkpointed(labelled(spark, sf_dir)), _FEATURES, label="beats the mean of its day over 60 bars", report=False, most_trees=_TREES), folder)
        _ARTIFACTS[key] = folder
    return _ARTIFACTS[key]


@register("snk11_model_artifact")
def snk11(spark, sf_dir):
    """What is written beside a model, read back: one line for each of its features."""
    about = spark.read.text(f"{artifact_folder(spark, sf_dir)}/about")
    fields = F.from_json("value", "features array<string>, label string")
    return about.select(fields.alias("a")).select(F.explode("a.features").alias("feature"), "a.label")


@register("src33_model_load")
def src33(spark, sf_dir):
    """The model that was written, and that one with a feature nobody knows is refused."""
    from tidemark.operators import ml

    folder = artifact_folder(spark, sf_dir)
    usable, foreign = ml.load(spark, folder, _FEATURES), ml.load(spark, folder, _FEATURES[:1])
    return spark.createDataFrame([(len(usable.features), foreign is None)], "features int, refused boolean")


def newest(spark, sf_dir):
    """The newest bar of each ticker with the features of the samples, whose outcome is not known yet."""
    day = Window.partitionBy("ticker").orderBy("d")
    r = indicators.rolling(T.bars(spark, sf_dir))
    rows = r.select(
        "ticker", "d", "bar", "n", (F.try_divide("c", F.lag("c", 20).over(day)) - 1).alias("r20"), (F.try_divide("c", F.lag("c", 60).over(day)) - 1).alias("r60"), (F.try_divide("c", "high_252") - 1).alias("from_high"), "vol20",
        F.try_divide("v", "avg_volume_20").alias("volume_ratio"),
    )
    return rows.where("bar = n AND bar >= 252").drop("bar", "n")


@register("mlp03_predictions")
def mlp03(spark, sf_dir):
    """The saved model on each ticker's newest bar."""
    from tidemark.operators import ml

    return ml.predict(ml.load(spark, artifact_folder(spark, sf_dir), _FEATURES), newest(spark, sf_dir))


@register("udf03_model_predict")
def udf03(spark, sf_dir):
    """The saved model on all samples: how many of each prediction there are."""
    from tidemark.operators import ml

    told = ml.predict(ml.load(spark, artifact_folder(spark, sf_dir), _FEATURES), samples(spark, sf_dir))
    return told.groupBy("prediction").agg(F.count("*").alias("n"))
