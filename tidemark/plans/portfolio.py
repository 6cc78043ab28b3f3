"""Books, risk, health and returns: queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import band_score, cap_score
from tidemark.operators import portfolio as O
from tidemark.plans.sql import define, twin
from tidemark.plans.technical import rounded
from tidemark.sources import tables as T

QUERIES, ORACLE_SQL = {}, {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = twin(sql)
        return f

    return keep


@register("agg01_position_merge", "SELECT account, ticker, currency, quantity, round(cost_price, 9) AS cost_price FROM t_holdings")
def agg01(spark, sf_dir):
    return rounded(T.holdings(spark, sf_dir).select("account", "ticker", "currency", "quantity", "cost_price"), 9)


define("t_valued", """
    SELECT h.*, price, change_pct, quantity * price * coalesce(usd_per, 1) AS value, quantity * cost_price * coalesce(usd_per, 1) AS cost, quantity * price * coalesce(usd_per, 1) * coalesce(change_pct, 0) / 100 AS day
    FROM t_holdings h LEFT JOIN t_fx ON currency = ccy JOIN t_quotes USING (ticker)""")


def lines(spark, sf_dir):
    return O.valued(T.holdings(spark, sf_dir), T.quotes(spark, sf_dir), T.fx(spark))


@register("agg02_performance", "SELECT account, count(*) AS n, round(sum(value), 2) AS value, round(sum(cost), 2) AS cost, round(sum(value - cost), 2) AS pnl, round(sum(day), 2) AS day FROM t_valued GROUP BY account")
def agg02(spark, sf_dir):
    return rounded(O.summary(lines(spark, sf_dir)), 2)


@register("jon01_quote_lookup", "SELECT account, ticker, value FROM t_valued")
def jon01(spark, sf_dir):
    return lines(spark, sf_dir).select("account", "ticker", "value")


@register("jon01_quote_errors", "SELECT account, ticker FROM t_holdings WHERE ticker NOT IN (SELECT ticker FROM t_quotes WHERE change_pct > 0)")
def jon01e(spark, sf_dir):
    """Holdings whose ticker has no quote among those that rose."""
    return O.unquoted(T.holdings(spark, sf_dir), T.quotes(spark, sf_dir).where("change_pct > 0")).select("account", "ticker")


@register("jon02_sector_default", "SELECT coalesce(sector, 'Unknown') AS sector, count(*) AS n FROM t_holdings h LEFT JOIN (SELECT * FROM t_tickers WHERE num % 4 <> 0) k USING (ticker) GROUP BY 1")
def jon02(spark, sf_dir):
    known = T.tickers(spark, sf_dir).where("num % 4 <> 0").select("ticker", "sector")
    return T.holdings(spark, sf_dir).join(known, "ticker", "left").groupBy(F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.count("*").alias("n"))


@register("jon03_fx_fallback", "SELECT currency, CASE currency WHEN 'SGD' THEN 0.75::DOUBLE ELSE coalesce(usd_per, 1.0) END AS rate, count(*) AS n FROM t_holdings LEFT JOIN t_fx ON currency = ccy GROUP BY ALL")
def jon03(spark, sf_dir):
    """Live rate, else the static one, else one."""
    live = spark.createDataFrame([("SGD", 0.75)], "live_ccy string, live double")
    h = T.holdings(spark, sf_dir)
    h = h.join(F.broadcast(live), h.currency == F.col("live_ccy"), "left").join(F.broadcast(T.fx(spark)), h.currency == F.col("ccy"), "left")
    return h.groupBy("currency", F.coalesce("live", "usd_per", F.lit(1.0)).alias("rate")).agg(F.count("*").alias("n"))


@register("mth06_fx_convert", "SELECT currency, round(sum(quantity * cost_price * coalesce(usd_per, 1)), 2) AS usd FROM t_holdings LEFT JOIN t_fx ON currency = ccy GROUP BY 1")
def mth06(spark, sf_dir):
    return rounded(lines(spark, sf_dir).groupBy("currency").agg(F.sum("cost").alias("usd")), 2)


@register("agg03_exposures", """
    SELECT ticker, sector, market, round(sum(weight), 8) AS weight FROM t_book GROUP BY GROUPING SETS ((ticker), (sector), (market), ())""")
def agg03(spark, sf_dir):
    """By name, sector, market and in all, in one aggregation."""
    by = ["ticker", "sector", "market"]
    sets = [*([F.col(c)] for c in by), []]
    return rounded(T.book(spark, sf_dir).groupingSets(sets, *by).agg(F.sum("weight").alias("weight")), 8)


define("t_weights", "SELECT account, ticker, value / sum(value) OVER (PARTITION BY account) AS weight FROM t_valued")
define("t_conc", """
    SELECT account, sum(weight * weight) AS hhi, sum(weight) FILTER (k <= 5) AS top5, max(weight) AS top, count(*) AS n, 1 / nullif(sum(weight * weight), 0) AS effective_n
    FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY weight DESC, ticker) AS k FROM t_weights) GROUP BY account""")


def concentration(spark, sf_dir):
    return O.concentration(lines(spark, sf_dir), "account", "value")


@register("agg04_concentration", "SELECT account, round(hhi, 8) AS hhi, round(effective_n, 6) AS effective_n, round(top5, 8) AS top5, n FROM t_conc")
def agg04(spark, sf_dir):
    return rounded(concentration(spark, sf_dir).select("account", "hhi", "effective_n", "top5", "n"), 8, effective_n=6)


@register("agg30_health_concentration", """
    SELECT account, round(score, 4) AS score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 55 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM (
        SELECT account, least(greatest(0, 100 * (1 - greatest(top - 0.2, 0) / 0.2)), greatest(0, 100 * (1 - greatest(top5 - 0.6, 0) / 0.25)), greatest(0, 100 * (1 - greatest(8 - effective_n, effective_n - 100, 0) / 8))) AS score FROM t_conc)""")
def agg30(spark, sf_dir):
    scored = O.health_scores(concentration(spark, sf_dir))
    return rounded(scored.select("account", "score", O.grade(F.col("score")).alias("grade")), 4)


# ------------------------------------------------------------------ risk of the whole book

define("t_bret", """
    SELECT row_number() OVER (ORDER BY d DESC) AS rn_desc, b FROM (SELECT d, c / lag(c) OVER (ORDER BY d) - 1 AS b FROM t_bench) WHERE b IS NOT NULL""")
define("t_cov", "SELECT ticker, weight, sector, market, value, len FROM t_book JOIN (SELECT ticker, max(rn_desc) AS len FROM t_year GROUP BY ticker) USING (ticker)")
define("t_bookret", """
    SELECT rn_desc, sum(weight * r) / (SELECT sum(weight) FROM t_cov) AS r FROM t_year JOIN t_cov USING (ticker) WHERE rn_desc <= (SELECT min(len) FROM t_cov) GROUP BY rn_desc""")


def year_returns(spark, sf_dir):
    return T.returns(T.bars(spark, sf_dir)).where("rn_desc <= 252")


def bench_returns(spark, sf_dir):
    """The index is one series of days: a window over all of it is a few thousand rows."""
    b = T.benchmark(spark, sf_dir).withColumn("one", F.lit(1))
    w = Window.partitionBy("one").orderBy("d")
    moves = b.withColumn("b", F.col("c") / F.lag("c").over(w) - 1).where("b IS NOT NULL")
    return moves.select(F.row_number().over(Window.partitionBy("one").orderBy(F.desc("d"))).alias("rn_desc"), "b")


@register("agg05_book_returns", "SELECT CAST(rn_desc AS INTEGER) AS rn_desc, round(r, 8) AS r FROM t_bookret")
def agg05(spark, sf_dir):
    return rounded(O.book_returns(T.book(spark, sf_dir), year_returns(spark, sf_dir)), 8)


@register("agg06_var_cvar", """
    SELECT round(v * 100, 6) AS var95, round((SELECT avg(r) FROM t_bookret WHERE r <= v) * 100, 6) AS cvar95, round(s * sqrt(252) * 100, 6) AS vol, n FROM (SELECT quantile_cont(r, 0.05) AS v, stddev_pop(r) AS s, count(*) AS n FROM t_bookret)""")
def agg06(spark, sf_dir):
    return rounded(O.tail_risk(O.book_returns(T.book(spark, sf_dir), year_returns(spark, sf_dir))))


@register("agg07_volatility", "SELECT ticker, round(stddev_pop(r) * sqrt(252) * 100, 6) AS vol FROM t_year GROUP BY ticker")
def agg07(spark, sf_dir):
    return rounded(year_returns(spark, sf_dir).groupBy("ticker").agg((F.stddev_pop("r") * F.sqrt(F.lit(252.0)) * 100).alias("vol")))


define("t_beta", "SELECT ticker, covar_samp(r, b) / var_samp(b) AS beta, count(*) AS n FROM t_year JOIN t_bret USING (rn_desc) GROUP BY ticker HAVING count(*) >= 20")


def betas(spark, sf_dir):
    return O.beta(year_returns(spark, sf_dir), bench_returns(spark, sf_dir))


@register("agg08_beta", "SELECT ticker, n, round(beta, 6) AS beta FROM t_beta")
def agg08(spark, sf_dir):
    return rounded(betas(spark, sf_dir))


@register("jon11_positional_join", "SELECT ticker, CAST(rn_desc AS INTEGER) AS rn_desc, round(r - b, 8) AS excess FROM t_year JOIN t_bret USING (rn_desc)")
def jon11(spark, sf_dir):
    return year_returns(spark, sf_dir).join(bench_returns(spark, sf_dir), "rn_desc").select("ticker", "rn_desc", F.round(F.col("r") - F.col("b"), 8).alias("excess"))


define("t_wk", """
    SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) AS wk_desc FROM (
        SELECT ticker, wk, product(1 + r) - 1 AS r FROM (SELECT ticker, r, (row_number() OVER (PARTITION BY ticker ORDER BY rn_desc DESC) - 1) // 5 AS wk FROM t_ret) GROUP BY ticker, wk HAVING count(*) = 5)""")
define("t_bwk", """
    SELECT b, row_number() OVER (ORDER BY wk DESC) AS wk_desc FROM (
        SELECT wk, product(1 + b) - 1 AS b FROM (SELECT b, (row_number() OVER (ORDER BY rn_desc DESC) - 1) // 5 AS wk FROM t_bret) GROUP BY wk HAVING count(*) = 5)""")


@register("win22_weekly_compounding", "SELECT ticker, wk, round(r, 6) AS r FROM t_wk")
def win22(spark, sf_dir):
    return rounded(O.weekly(T.returns(T.bars(spark, sf_dir)), ["ticker"]).select("ticker", "wk", "r"))


@register("agg09_weekly_beta", "SELECT ticker, round(covar_samp(t_wk.r, b) / var_samp(b), 4) AS beta FROM t_wk JOIN t_bwk USING (wk_desc) GROUP BY ticker HAVING count(*) >= 40")
def agg09(spark, sf_dir):
    names = O.weekly(T.returns(T.bars(spark, sf_dir)), ["ticker"]).select("ticker", F.col("wk_desc").alias("rn_desc"), "r")
    index = O.weekly(bench_returns(spark, sf_dir).select(F.lit("index").alias("ticker"), "rn_desc", F.col("b").alias("r")), ["ticker"]).select(F.col("wk_desc").alias("rn_desc"), F.col("r").alias("b"))
    return rounded(O.beta(names, index, 40).select("ticker", "beta"), 4)




def correlations(spark, sf_dir):
    return O.correlations(year_returns(spark, sf_dir))


@register("agg10_correlation", "SELECT a, b, round(corr, 6) AS corr, n FROM t_corr")
def agg10(spark, sf_dir):
    return rounded(correlations(spark, sf_dir))


QUERIES["jon12_self_join_pairs"], ORACLE_SQL["jon12_self_join_pairs"] = agg10, ORACLE_SQL["agg10_correlation"]


@register("jon13_symmetric_lookup", "SELECT name, other, round(corr, 6) AS corr FROM (SELECT a AS name, b AS other, corr FROM t_corr UNION ALL SELECT b, a, corr FROM t_corr) WHERE name IN ('Brand#1', 'Brand#7')")
def jon13(spark, sf_dir):
    c = correlations(spark, sf_dir)
    both = c.select(F.col("a").alias("name"), F.col("b").alias("other"), "corr").unionByName(c.select(F.col("b").alias("name"), F.col("a").alias("other"), "corr"))
    return rounded(both.where(F.col("name").isin("Brand#1", "Brand#7")))


@register("agg11_diversification", """
    SELECT round((SELECT avg(corr) FROM t_corr), 6) AS avg_corr, (SELECT count(*) FROM t_corr WHERE corr > 0.8) AS pairs_high,
           round((SELECT sum(weight * s) / sum(weight) FROM (SELECT ticker, stddev_samp(r) AS s FROM t_year WHERE rn_desc <= (SELECT min(len) FROM t_cov) GROUP BY ticker) JOIN t_cov USING (ticker)) / (SELECT stddev_samp(r) FROM t_bookret), 6) AS ratio""")
def agg11(spark, sf_dir):
    book, r, c = T.book(spark, sf_dir), year_returns(spark, sf_dir), correlations(spark, sf_dir)
    shortest = r.groupBy("ticker").agg(F.max("rn_desc").alias("len")).agg(F.min("len").alias("shortest"))
    own = r.join(F.broadcast(shortest)).where("rn_desc <= shortest").groupBy("ticker").agg(F.stddev_samp("r").alias("s")).join(book, "ticker").agg((F.sum(F.col("weight") * F.col("s")) / F.sum("weight")).alias("own"))
    whole = O.book_returns(book, r).agg(F.stddev_samp("r").alias("whole"))
    pairs = c.agg(F.avg("corr").alias("avg_corr"), F.count_if(F.col("corr") > 0.8).alias("pairs_high"))
    return rounded(pairs.join(F.broadcast(own)).join(F.broadcast(whole)).select("avg_corr", "pairs_high", (F.col("own") / F.col("whole")).alias("ratio")))


@register("agg12_liquidity", "SELECT ticker, round(value / nullif(0.1 * avg_volume_20 * c, 0), 4) AS days, value / nullif(0.1 * avg_volume_20 * c, 0) > 5 AS slow FROM t_book JOIN (SELECT ticker, c, avg_volume_20 FROM t_roll WHERE rn = n) USING (ticker)")
def agg12(spark, sf_dir):
    from tidemark.plans.technical import last_bars

    days = F.try_divide("value", 0.1 * F.col("avg_volume_20") * F.col("c"))
    joined = T.book(spark, sf_dir).join(last_bars(spark, sf_dir).select("ticker", "c", "avg_volume_20"), "ticker")
    return joined.select("ticker", F.round(days, 4).alias("days"), (days > 5).alias("slow"))


@register("flt23_concentration_flags", """
    SELECT 'name' AS kind, ticker AS what, round(weight, 6) AS weight FROM t_book WHERE weight > 0.05 UNION ALL SELECT 'sector', sector, round(sum(weight), 6) FROM t_book GROUP BY sector HAVING sum(weight) > 0.1
    UNION ALL SELECT 'market', market, round(sum(weight), 6) FROM t_book WHERE market <> 'US' GROUP BY market HAVING sum(weight) > 0.2""")
def flt23(spark, sf_dir):
    book = T.book(spark, sf_dir)
    by = lambda kind, c, cap, rows: rows.groupBy(F.col(c).alias("what")).agg(F.sum("weight").alias("weight")).where(F.col("weight") > cap).select(F.lit(kind).alias("kind"), "what", "weight")
    return rounded(by("name", "ticker", 0.05, book).unionByName(by("sector", "sector", 0.1, book)).unionByName(by("market", "market", 0.2, book.where("market <> 'US'"))))


@register("jon17_stress", """
    SELECT scenario, round(sum(weight * (beta * market_shock + CASE WHEN market <> 'US' THEN fx_shock ELSE 0 END)) * 100, 6) AS impact_pct
    FROM t_book JOIN t_beta USING (ticker), (VALUES ('market -20%', -0.20::DOUBLE, 0.0::DOUBLE), ('USD +5%', 0.0, -0.05), ('risk-off', -0.10, -0.03)) s(scenario, market_shock, fx_shock) GROUP BY scenario""")
def jon17(spark, sf_dir):
    shocks = spark.createDataFrame(list(O.SCENARIOS), "scenario string, market_shock double, fx_shock double")
    book = T.book(spark, sf_dir).join(betas(spark, sf_dir), "ticker").crossJoin(F.broadcast(shocks))  # three lines
    hit = F.col("beta") * F.col("market_shock") + F.when(F.col("market") != "US", F.col("fx_shock")).otherwise(0.0)
    return rounded(book.groupBy("scenario").agg((F.sum(F.col("weight") * hit) * 100).alias("impact_pct")))


@register("agg13_breadth", "SELECT market, count(*) FILTER (change_pct > 0) AS up, count(*) FILTER (change_pct < 0) AS down, count(*) FILTER (change_pct = 0) AS flat, round(count(*) FILTER (change_pct > 0) / nullif(count(*) FILTER (change_pct < 0), 0), 6) AS ratio, round(avg(change_pct), 6) AS avg_change FROM t_quotes JOIN t_tickers USING (ticker) GROUP BY market")
def agg13(spark, sf_dir):
    q = T.quotes(spark, sf_dir).join(T.tickers(spark, sf_dir), "ticker")
    c = F.col("change_pct")
    up, down = F.count_if(c > 0), F.count_if(c < 0)
    return rounded(q.groupBy("market").agg(up.alias("up"), down.alias("down"), F.count_if(c == 0).alias("flat"), F.try_divide(up, down).alias("ratio"), F.avg(c).alias("avg_change")))


@register("agg33_book_context", """
    SELECT round(sum(weight * beta) / sum(weight), 6) AS book_beta, round(sum(weight), 6) AS covered, round((sum(weight * beta) + 0.05 * (SELECT beta FROM t_beta WHERE ticker = 'Brand#5')) / (sum(weight) + 0.05), 6) AS after FROM t_book JOIN t_beta USING (ticker)""")
def agg33(spark, sf_dir):
    b = betas(spark, sf_dir)
    added = b.where("ticker = 'Brand#5'").agg(F.max("beta").alias("candidate"))
    book = T.book(spark, sf_dir).join(b, "ticker").agg(F.sum(F.col("weight") * F.col("beta")).alias("wb"), F.sum("weight").alias("w")).join(F.broadcast(added))
    return rounded(book.select((F.col("wb") / F.col("w")).alias("book_beta"), F.col("w").alias("covered"), ((F.col("wb") + 0.05 * F.col("candidate")) / (F.col("w") + 0.05)).alias("after")))


@register("top06_overlaps", "SELECT other, round(corr, 6) AS corr FROM (SELECT CASE WHEN a = 'Brand#5' THEN b ELSE a END AS other, corr FROM t_corr WHERE a = 'Brand#5' OR b = 'Brand#5') ORDER BY corr DESC, other LIMIT 3")
def top06(spark, sf_dir):
    c = correlations(spark, sf_dir).where("a = 'Brand#5' OR b = 'Brand#5'")
    return rounded(c.select(F.when(F.col("a") == "Brand#5", F.col("b")).otherwise(F.col("a")).alias("other"), "corr").orderBy(F.desc("corr"), "other").limit(3))


@register("jon14_root_key_join", "SELECT t.symbol, t.ticker, round(b.weight, 6) AS weight FROM t_tickers t JOIN t_book b ON upper(ltrim(string_split(t.symbol, '.')[1], '0')) = upper(ltrim(regexp_extract(b.ticker, '([0-9]+)', 1), '0'))")
def jon14(spark, sf_dir):
    root = F.upper(F.ltrim(F.split("symbol", r"\.")[0], F.lit("0")))
    held = T.book(spark, sf_dir).select(F.upper(F.ltrim(F.regexp_extract("ticker", "([0-9]+)", 1), F.lit("0"))).alias("root"), "weight")
    return rounded(T.tickers(spark, sf_dir).select("symbol", "ticker", root.alias("root")).join(held, "root").select("symbol", "ticker", "weight"))


# The groups in order of the names: each seed takes the names near it that no group has yet.
_GREEDY = """
    , named AS MATERIALIZED (SELECT k.ticker, k.weight, row_number() OVER (ORDER BY k.ticker) AS i, near FROM t_book k LEFT JOIN (
        SELECT a, list(b ORDER BY b) AS near FROM (SELECT a, b FROM t_corr WHERE corr >= 0.1 UNION ALL SELECT b, a FROM t_corr WHERE corr >= 0.1) p WHERE b IN (SELECT ticker FROM t_book) GROUP BY a) n ON n.a = k.ticker),
    fold AS (
        SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR) AS seed, CAST([] AS VARCHAR[]) AS taken
        UNION ALL
        SELECT g.i, CASE WHEN len(g.taken) > 1 THEN list_concat(g.seen, g.taken) ELSE g.seen END, g.ticker, g.taken FROM (
            SELECT n.i, n.ticker, f.seen, CASE WHEN list_contains(f.seen, n.ticker) THEN [] ELSE list_concat([n.ticker], list_filter(coalesce(n.near, []), lambda x: NOT list_contains(f.seen, x))) END AS taken FROM fold f JOIN named n ON n.i = f.i + 1) g),
    groups AS (SELECT seed, array_to_string(taken, ',') AS names, round((SELECT sum(weight) FROM named WHERE list_contains(taken, ticker)), 6) AS weight FROM fold WHERE len(taken) > 1)
    """


def recursive(names: str, body: str) -> str:
    """A recursive query that begins with the common tables of these names."""
    return twin(f"SELECT 1 FROM {names}").rsplit("SELECT 1 FROM", 1)[0].rstrip().replace("WITH ", "WITH RECURSIVE ", 1) + body


_GREEDY_TABLES = _GREEDY
_GREEDY = recursive("t_book, t_corr", _GREEDY)


@register("agg31_correlated_clusters")
def agg31(spark, sf_dir):
    return rounded(O.clusters(T.book(spark, sf_dir).select("ticker", "weight"), correlations(spark, sf_dir), 0.1))


QUERIES["uda03_greedy_clusters"] = agg31
QUERIES["top07_largest_clusters"] = lambda spark, sf_dir: agg31(spark, sf_dir).orderBy(F.desc("weight"), "seed").limit(3)
ORACLE_SQL["agg31_correlated_clusters"] = ORACLE_SQL["uda03_greedy_clusters"] = _GREEDY + "SELECT seed, names, weight FROM groups"
ORACLE_SQL["top07_largest_clusters"] = _GREEDY + "SELECT seed, names, weight FROM groups ORDER BY weight DESC, seed LIMIT 3"


define("t_cov_n", "SELECT ticker, count(*) AS n FROM t_year GROUP BY ticker HAVING count(*) >= 60")
define("t_cov_x", "SELECT ticker, rn_desc, r - avg(r) OVER (PARTITION BY ticker) AS x FROM (SELECT * FROM t_year WHERE ticker IN (SELECT ticker FROM t_cov_n) AND rn_desc <= (SELECT min(n) FROM t_cov_n) AND (SELECT count(*) FROM t_cov_n) >= 3)")
define("t_cov_raw", "SELECT a.ticker AS a, b.ticker AS b, sum(a.x * b.x) / count(*) AS s FROM t_cov_x a JOIN t_cov_x b USING (rn_desc) GROUP BY 1, 2")
define("t_cov_shrunk", """
    SELECT a, b, (1 - shrink) * s + CASE WHEN a = b THEN shrink * mu ELSE 0 END AS cov FROM t_cov_raw, (
        SELECT mu, CASE WHEN spread > 0 THEN least(noise, spread) / spread ELSE 1 END AS shrink FROM (
            SELECT trace / names AS mu, squares - trace * trace / names AS spread, (fourth - squares) / t AS noise FROM
                (SELECT sum(s * s) AS squares, sum(s) FILTER (a = b) AS trace, count(DISTINCT a) AS names FROM t_cov_raw), (SELECT sum(q * q) / count(*) AS fourth, count(*) AS t FROM (SELECT rn_desc, sum(x * x) AS q FROM t_cov_x GROUP BY rn_desc))))""")


# The inverse times ones by elimination, a column of the matrix a step; then weights above the cap are set to it, a round a step.
ORACLE_SQL["agg36_minimum_variance"] = recursive("t_cov_shrunk", """
    , names AS MATERIALIZED (SELECT a, row_number() OVER (ORDER BY a) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT a FROM t_cov_shrunk)),
    system AS MATERIALIZED (SELECT x.i, y.i AS j, cov AS v FROM t_cov_shrunk c JOIN names x ON x.a = c.a JOIN names y ON y.a = c.b UNION ALL SELECT i, n + 1, 1.0 FROM names),
    steps AS (
        SELECT CAST(0 AS BIGINT) AS k, i, j, v FROM system
        UNION ALL
        SELECT s.k + 1, s.i, s.j, CASE WHEN s.i = s.k + 1 THEN s.v / corner.v ELSE s.v - own.v * top.v / corner.v END
        FROM steps s JOIN steps own ON own.i = s.i AND own.j = s.k + 1 JOIN steps top ON top.i = s.k + 1 AND top.j = s.j JOIN steps corner ON corner.i = s.k + 1 AND corner.j = s.k + 1
        WHERE s.k < (SELECT max(n) FROM names)),
    raw AS (SELECT i, greatest(v, 0) AS w FROM steps WHERE k = (SELECT max(n) FROM names) AND j = k + 1),
    rounds AS (
        SELECT CAST(0 AS BIGINT) AS k, i, w / (SELECT sum(w) FROM raw) AS w FROM raw WHERE (SELECT sum(w) FROM raw) > 0 AND 0.3 * (SELECT count(*) FROM raw) >= 1
        UNION ALL
        SELECT k + 1, i, CASE WHEN w > 0.3 + 1e-12 THEN 0.3 WHEN w < 0.3 - 1e-12 THEN w + extra * CASE WHEN room > 0 THEN w / room ELSE 1 / below END ELSE w END
        FROM (SELECT *, sum(w - 0.3) FILTER (w > 0.3 + 1e-12) OVER () AS extra, sum(w) FILTER (w < 0.3 - 1e-12) OVER () AS room, count(*) FILTER (w < 0.3 - 1e-12) OVER () AS below FROM rounds) r
        WHERE extra > 0)
    SELECT a AS ticker, round(w, 6) AS weight FROM rounds JOIN names USING (i) WHERE k = (SELECT max(k) FROM rounds)""")


@register("agg36_minimum_variance")
def agg36(spark, sf_dir):
    return rounded(O.minimum_variance(year_returns(spark, sf_dir)))


@register("uda02_ledoit_wolf", "SELECT a, b, round(cov * 1000000, 4) AS cov FROM t_cov_shrunk")
def uda02(spark, sf_dir):
    """The covariance of the year's returns, in millionths, shrunk as its noise says."""
    cov = O.shrunk_covariance(year_returns(spark, sf_dir).select(F.lit(0).alias("book"), "ticker", "rn_desc", "r"))
    return cov.select("a", "b", F.round(F.col("cov") * 1_000_000, 4).alias("cov"))


# The same in each account.
ORACLE_SQL["agg31_clusters_by_account"] = recursive("t_weights, t_corr", """
    , near_of AS MATERIALIZED (SELECT a, list(b ORDER BY b) AS near FROM (SELECT a, b FROM t_corr WHERE corr >= 0.1 UNION ALL SELECT b, a FROM t_corr WHERE corr >= 0.1) GROUP BY a),
    held AS MATERIALIZED (SELECT account, ticker, sum(weight) AS weight FROM t_weights GROUP BY account, ticker),
    own AS (SELECT account, list(ticker) AS names FROM held GROUP BY account),
    named AS MATERIALIZED (SELECT account, ticker, row_number() OVER (PARTITION BY account ORDER BY ticker) AS i, list_filter(coalesce(near, []), lambda x: list_contains(names, x)) AS near FROM held JOIN own USING (account) LEFT JOIN near_of ON a = ticker),
    fold AS (
        SELECT account, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR) AS seed, CAST([] AS VARCHAR[]) AS taken FROM own
        UNION ALL
        SELECT account, i, CASE WHEN len(taken) > 1 THEN list_concat(seen, taken) ELSE seen END, ticker, taken FROM (
            SELECT n.account, n.i, n.ticker, f.seen, CASE WHEN list_contains(f.seen, n.ticker) THEN [] ELSE list_concat([n.ticker], list_filter(n.near, lambda x: NOT list_contains(f.seen, x))) END AS taken
            FROM fold f JOIN named n ON n.account = f.account AND n.i = f.i + 1) g),
    members AS (SELECT account, seed, taken, unnest(taken) AS ticker FROM fold WHERE len(taken) > 1)
    SELECT account, seed, array_to_string(any_value(taken), ',') AS names, round(sum(weight), 6) AS weight FROM members JOIN held USING (account, ticker) GROUP BY account, seed""")


@register("agg31_clusters_by_account")
def agg31_accounts(spark, sf_dir):
    """The greedy groups within each account."""
    held = lines(spark, sf_dir).select(F.col("account").alias("book"), "ticker", (F.col("value") / F.sum("value").over(Window.partitionBy("account"))).alias("weight"))
    return rounded(O.clusters(held, correlations(spark, sf_dir), 0.1).withColumnRenamed("book", "account"))


@register("agg32_quality", """
    SELECT round(sum(weight * s) / sum(weight), 6) AS quality, count(*) FILTER (s < 50) AS weak, count(*) FILTER (s < 40 AND weight >= 0.05) AS review FROM (SELECT weight, (num * 17) % 100 AS s FROM t_book JOIN t_tickers USING (ticker) WHERE num % 6 <> 0)""")
def agg32(spark, sf_dir):
    scored = T.book(spark, sf_dir).join(T.tickers(spark, sf_dir).select("ticker", "num"), "ticker").where("num % 6 <> 0").withColumn("s", (F.col("num") * 17) % 100)
    return rounded(scored.agg((F.sum(F.col("weight") * F.col("s")) / F.sum("weight")).alias("quality"), F.count_if(F.col("s") < 50).alias("weak"), F.count_if((F.col("s") < 40) & (F.col("weight") >= 0.05)).alias("review")))


_SECTOR_SQL = """SELECT least(greatest(0, 100 * (1 - greatest(max(w) - 0.3, 0) / 0.3)), 100) AS sector_score, max(w) AS largest, coalesce(sum(w) FILTER (sector IN ('Consumer Defensive', 'Healthcare', 'Utilities')), 0) AS defensive FROM (SELECT sector, sum(weight) AS w FROM t_book GROUP BY sector)"""


@register("agg30_health_report", f"""
    SELECT dimension, round(score, 4) AS score FROM (
        SELECT 'sector_balance' AS dimension, sector_score AS score FROM ({_SECTOR_SQL})
        UNION ALL SELECT 'risk_posture', greatest(0, 100 * (1 - greatest(0.7 - b, b - 1.05, 0) / 0.5)) FROM (SELECT sum(weight * beta) / sum(weight) AS b FROM t_book JOIN t_beta USING (ticker))
        UNION ALL SELECT 'concentration', least(greatest(0, 100 * (1 - greatest(top - 0.2, 0) / 0.2)), greatest(0, 100 * (1 - greatest(top5 - 0.6, 0) / 0.25)), greatest(0, 100 * (1 - greatest(8 - e, e - 100, 0) / 8)))
            FROM (SELECT max(weight) AS top, sum(weight) FILTER (k <= 5) AS top5, 1 / sum(weight * weight) AS e FROM (SELECT weight, row_number() OVER (ORDER BY weight DESC, ticker) AS k FROM t_book)))""")
def agg30r(spark, sf_dir):
    """The dimensions of the book's health, one line each; the composite is the mean of those that have a score."""
    with T.bars_once(spark, sf_dir):
        book = T.book(spark, sf_dir)
        sectors = book.groupBy("sector").agg(F.sum("weight").alias("w")).agg(F.max("w").alias("largest")).select(F.lit("sector_balance").alias("dimension"), cap_score(F.col("largest"), O.MAX_SECTOR, 0.3).alias("score"))
        posture = book.join(betas(spark, sf_dir), "ticker").agg((F.sum(F.col("weight") * F.col("beta")) / F.sum("weight")).alias("b")).select(F.lit("risk_posture").alias("dimension"), band_score(F.col("b"), 0.7, 1.05, 0.5).alias("score"))
        conc = O.health_scores(O.concentration(book.withColumn("of", F.lit("book")), "of")).select(F.lit("concentration").alias("dimension"), "score")
    return rounded(sectors.unionByName(posture).unionByName(conc), 4)


define("t_health", """
    SELECT ticker, weight, CASE WHEN num % 10 <> 3 THEN sector END AS sector, ['core', 'ballast', 'tactical', 'speculative'][num % 4 + 1] AS sleeve, CASE WHEN num % 6 <> 0 THEN num * 17 % 100 END AS fund_score FROM t_book b JOIN (SELECT ticker, num FROM t_tickers) USING (ticker)""")
define("t_sleeves", "SELECT s AS sleeve, lo, hi, coalesce((SELECT sum(weight) FROM t_health h WHERE h.sleeve = s), 0) AS w FROM (VALUES ('core', 0.45::DOUBLE, 0.75::DOUBLE), ('ballast', 0.1, 0.35), ('tactical', 0.0, 0.25), ('speculative', 0.0, 0.1)) v(s, lo, hi)")
define("t_sectors", "SELECT sector, sum(weight) AS w FROM t_health WHERE sector IS NOT NULL GROUP BY sector")
define("t_health_in", """
    SELECT (SELECT arg_max(ticker, weight) FROM t_health) AS top_name, (SELECT max(weight) FROM t_health) AS top, (SELECT sum(weight) FROM (SELECT weight FROM t_health ORDER BY weight DESC, ticker LIMIT 5)) AS top5, (SELECT 1 / sum(weight * weight) FROM t_health) AS e,
           (SELECT arg_max(sector, w) FROM t_sectors) AS sector, (SELECT max(w) FROM t_sectors) AS sw, (SELECT coalesce(sum(weight), 0) FROM t_health WHERE sector IS NULL) AS unclassified,
           (SELECT coalesce(sum(w), 0) FROM t_sectors WHERE sector IN ('Consumer Defensive', 'Healthcare', 'Utilities', 'Cash & Equivalents')) AS defensive, (SELECT sum(weight * beta) / sum(weight) FROM t_book JOIN t_beta USING (ticker)) AS beta,
           (SELECT sum(weight * fund_score) / sum(weight) FROM t_health WHERE fund_score IS NOT NULL) AS quality""")
define("t_defensive", "SELECT n, o, coalesce((SELECT w FROM t_sectors WHERE sector = n), 0) AS w FROM (VALUES ('Consumer Defensive', 0), ('Healthcare', 1), ('Utilities', 2), ('Cash & Equivalents', 3)) v(n, o)")
define("t_dims", """
    SELECT 'concentration' AS dimension, least(greatest(0, 100 * (1 - greatest(top - 0.2, 0) / 0.2)), greatest(0, 100 * (1 - greatest(top5 - 0.6, 0) / 0.25)), greatest(0, 100 * (1 - greatest(8 - e, e - 100, 0) / 8))) AS score FROM t_health_in
    UNION ALL SELECT 'sector_balance', least(greatest(0, 100 * (1 - greatest(coalesce(sw, 0) - 0.3, 0) / 0.3)), greatest(0, 100 * (1 - greatest(unclassified - 0.25, 0) / 0.4))) FROM t_health_in
    UNION ALL SELECT 'sleeve_discipline', avg(greatest(0, 100 * (1 - greatest(lo - w, w - hi, 0) / 0.2))) FROM t_sleeves
    UNION ALL SELECT 'risk_posture', greatest(0, 100 * (1 - greatest(0.7 - beta, beta - 1.05, 0) / 0.5)) FROM t_health_in
    UNION ALL SELECT 'quality', quality FROM t_health_in""")


def health(spark, sf_dir):
    """The positions of the book with sectors (some unknown), sleeves and scores, and what its health is judged by."""
    num = F.col("num")
    known = T.tickers(spark, sf_dir).select("ticker", "num")
    sleeve = F.element_at(F.array(*[F.lit(n) for n in O.SLEEVES]), num % 4 + 1)
    held = T.book(spark, sf_dir).join(known, "ticker").select(F.lit("all").alias("book"), "ticker", "weight", F.when(num % 10 != 3, F.col("sector")).alias("sector"), sleeve.alias("sleeve"), F.when(num % 6 != 0, num * 17 % 100).alias("fund_score"))
    beta = held.join(betas(spark, sf_dir), "ticker").groupBy("book").agg((F.sum(F.col("weight") * F.col("beta")) / F.sum("weight")).alias("beta"))
    return held, beta


@register("agg30_health_dimensions", """
    SELECT dimension, round_even(score, 1) AS score, CAST(NULL AS VARCHAR) AS grade FROM t_dims
    UNION ALL SELECT 'correlation', NULL, NULL
    UNION ALL SELECT 'composite', s, CASE WHEN s >= 85 THEN 'A' WHEN s >= 70 THEN 'B' WHEN s >= 55 THEN 'C' WHEN s >= 40 THEN 'D' ELSE 'F' END FROM (SELECT round_even(avg(round_even(score, 1)), 1) AS s FROM t_dims)""")
def agg30_dimensions(spark, sf_dir):
    """Without correlations that dimension has no score, and drops out of the mean."""
    held, beta = health(spark, sf_dir)
    return O.health_dimensions(O.health_inputs(held, beta, None)).select("dimension", "score", "grade")


ORACLE_SQL["agg30_health_with_clusters"] = recursive("t_dims, t_book, t_corr", _GREEDY_TABLES + """
    , worst AS (SELECT coalesce(max(weight), 0) AS w FROM (SELECT (SELECT sum(weight) FROM named WHERE list_contains(taken, ticker)) AS weight FROM fold WHERE len(taken) > 1)),
    scores AS (SELECT dimension, round_even(score, 1) AS score FROM t_dims UNION ALL SELECT 'correlation', round_even(greatest(0, 100 * (1 - greatest(w - 0.35, 0) / 0.35)), 1) FROM worst),
    mean AS (SELECT round_even(avg(score), 1) AS s FROM scores)
    SELECT dimension, score, CAST(NULL AS VARCHAR) AS grade FROM scores
    UNION ALL SELECT 'composite', s, CASE WHEN s >= 85 THEN 'A' WHEN s >= 70 THEN 'B' WHEN s >= 55 THEN 'C' WHEN s >= 40 THEN 'D' ELSE 'F' END FROM mean""")


@register("agg30_health_with_clusters")
def agg30_clusters(spark, sf_dir):
    """With the groups that move together: all six dimensions."""
    held, beta = health(spark, sf_dir)
    groups = O.clusters(held.select("book", "ticker", "weight"), correlations(spark, sf_dir), 0.1)
    return O.health_dimensions(O.health_inputs(held, beta, groups)).select("dimension", "score", "grade")


@register("agg30_health_recommendations", """
    SELECT priority, action, target, round("from", 6) AS "from", "to" FROM (
        SELECT 'high' AS priority, 'trim' AS action, top_name AS target, top AS "from", 0.2::DOUBLE AS "to" FROM t_health_in WHERE top > 0.2
        UNION ALL SELECT 'medium', 'diversify', NULL, NULL, NULL FROM t_health_in WHERE e < 8 UNION ALL SELECT 'high', 'reduce_sector', sector, sw, 0.3 FROM t_health_in WHERE sw > 0.3
        UNION ALL SELECT CASE WHEN 0.15 - defensive > 0.05 THEN 'medium' ELSE 'low' END, 'add_defensive', coalesce(
            (SELECT string_agg(n, ',' ORDER BY o) FROM t_defensive WHERE w < 0.02), (SELECT string_agg(n, ',' ORDER BY w, o) FROM (SELECT * FROM t_defensive ORDER BY w, o LIMIT 2))), defensive, 0.15 FROM t_health_in WHERE defensive < 0.15
        UNION ALL SELECT 'low', 'classify', NULL, unclassified, NULL FROM t_health_in WHERE unclassified > 0.25 UNION ALL SELECT 'medium', 'reduce_beta', NULL, beta, 1.05 FROM t_health_in WHERE beta > 1.05
        UNION ALL SELECT CASE WHEN sleeve = 'speculative' THEN 'high' ELSE 'medium' END, 'reduce_sleeve', sleeve, w, hi FROM t_sleeves WHERE w > hi UNION ALL SELECT 'medium', 'increase_sleeve', sleeve, w, lo FROM t_sleeves WHERE w < lo
        UNION ALL SELECT 'high', 'review_holding', ticker, weight, NULL FROM t_health WHERE fund_score < 40 AND weight >= 0.05)""")
def agg30_recommendations(spark, sf_dir):
    held, beta = health(spark, sf_dir)
    return rounded(O.health_recommendations(O.health_inputs(held, beta, None), held).drop("book"))


@register("top10_lightest_sectors", "SELECT sector, round(sum(weight), 6) AS weight FROM t_book GROUP BY sector ORDER BY sum(weight), sector LIMIT 2")
def top10(spark, sf_dir):
    return rounded(T.book(spark, sf_dir).groupBy("sector").agg(F.sum("weight").alias("weight")).orderBy("weight", "sector").limit(2))


@register("top09_largest_position", "SELECT ticker, round(weight, 6) AS weight FROM t_book ORDER BY weight DESC, ticker LIMIT 1")
def top09(spark, sf_dir):
    return rounded(T.book(spark, sf_dir).select("ticker", "weight").orderBy(F.desc("weight"), "ticker").limit(1))


# ------------------------------------------------------------------ equity, flows, dividends

define("t_diff", """
    SELECT book, d, (value - lag(value) OVER w - (cost - lag(cost) OVER w)) / nullif(lag(value) OVER w, 0) AS r, d - lag(d) OVER w AS gap, cost - lag(cost) OVER w AS flow, cost - lag(cost) OVER w < -0.005 * lag(value) OVER w AS sale, lag(value) OVER w AS prev
    FROM t_eq WINDOW w AS (PARTITION BY book ORDER BY d)""")
define("t_chg", "SELECT * FROM t_diff WHERE prev IS NOT NULL")


@register("win23_snapshot_diffs", "SELECT book, d, round(r, 6) AS r, CAST(gap AS INTEGER) AS gap, round(flow, 2) AS flow, sale FROM t_chg")
def win23(spark, sf_dir):
    return rounded(O.snapshot_changes(T.snapshots(spark, sf_dir)).select("book", "d", "r", "gap", "flow", "sale"), 6, flow=2)


define("t_dd0", "SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY book ORDER BY d)) AS equity FROM t_chg WHERE NOT sale")
define("t_dd", "SELECT *, equity / max(equity) OVER (PARTITION BY book ORDER BY d) - 1 AS drawdown FROM t_dd0")


@register("win19_drawdown", "SELECT book, d, round(equity, 6) AS equity, round(drawdown, 6) AS drawdown FROM t_dd")
def win19(spark, sf_dir):
    return rounded(O.drawdown(O.snapshot_changes(T.snapshots(spark, sf_dir)).where("NOT sale"), "book", "d").select("book", "d", "equity", "drawdown"))


@register("agg26_equity_metrics", """
    SELECT book, n_snapshots, round((last - 1) * 100, 4) AS twr_pct, round(dd * 100, 4) AS max_drawdown_pct, round(CASE WHEN sd > 0 THEN mean / sd * sqrt(365.25 / gap) END, 4) AS sharpe, round(CASE WHEN down > 0 THEN mean / down * sqrt(365.25 / gap) END, 4) AS sortino, excluded, round(gap, 4) AS mean_gap
    FROM (SELECT book, count(*) AS n, arg_max(equity, d) AS last, min(drawdown) AS dd, avg(r) AS mean, stddev_samp(r) AS sd, stddev_samp(r) FILTER (r < 0) AS down, avg(gap) AS gap FROM t_dd GROUP BY book)
    JOIN (SELECT book, count(*) + 1 AS n_snapshots, count(*) FILTER (sale) AS excluded FROM t_chg GROUP BY book) USING (book) WHERE n_snapshots >= 5 AND n >= 4""")
def agg26(spark, sf_dir):
    return rounded(O.equity_metrics(T.snapshots(spark, sf_dir)), 4)


define("t_flows", """
    SELECT book, d, amount FROM (SELECT book, d, CASE WHEN k = 1 THEN -value WHEN abs(step) > 0.005 * value THEN -step END AS amount FROM (SELECT *, row_number() OVER w AS k, cost - lag(cost) OVER w AS step FROM t_eq WINDOW w AS (PARTITION BY book ORDER BY d))) WHERE amount IS NOT NULL
    UNION ALL SELECT book, d, value FROM t_eq QUALIFY row_number() OVER (PARTITION BY book ORDER BY d DESC) = 1""")


@register("win24_flows", "SELECT book, d, round(amount, 2) AS amount FROM t_flows")
def win24(spark, sf_dir):
    return rounded(O.flows_from_snapshots(T.snapshots(spark, sf_dir)), 2)


QUERIES["flt30_materiality"], ORACLE_SQL["flt30_materiality"] = win24, ORACLE_SQL["win24_flows"]

_XIRR = """
    SELECT book, round(rate, 6) AS rate FROM (
        SELECT book, (s.lo + s.hi) / 2 AS rate FROM (
            SELECT book, list_reduce(list_transform(range(61), lambda i: {'lo': -0.9999999::DOUBLE, 'hi': 1000000.0::DOUBLE}), lambda p, q:
                CASE WHEN sign(list_sum(list_transform(f, lambda x: x.a / pow(1 + (p.lo + p.hi) / 2, x.t)))) = sl THEN {'lo': (p.lo + p.hi) / 2, 'hi': p.hi} ELSE {'lo': p.lo, 'hi': (p.lo + p.hi) / 2} END) AS s
            FROM (SELECT *, sign(list_sum(list_transform(f, lambda x: x.a / pow(1e-7, x.t)))) AS sl, sign(list_sum(list_transform(f, lambda x: x.a / pow(1000001.0, x.t)))) AS sh FROM (
                SELECT book, list({'t': (d - d0) / 365, 'a': amount} ORDER BY d, amount) AS f FROM t_flows JOIN (SELECT book, min(d) AS d0 FROM t_flows GROUP BY book) USING (book) WHERE amount <> 0 GROUP BY book))
            WHERE sl * sh < 0 AND len(f) >= 2))"""


@register("agg27_money_weighted", _XIRR)
def agg27(spark, sf_dir):
    return rounded(O.xirr(O.flows_from_snapshots(T.snapshots(spark, sf_dir))))


QUERIES["uda01_xirr"], ORACLE_SQL["uda01_xirr"] = agg27, ORACLE_SQL["agg27_money_weighted"]


@register("agg35_dividends", """
    SELECT ticker, round(dps, 6) AS ttm, round(dps / price * 100, 6) AS yield_pct FROM (
        SELECT p_brand AS ticker, sum(l_tax) / 100 AS dps FROM lineitem JOIN part ON l_partkey = p_partkey WHERE CAST(l_shipdate AS DATE) > (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem) - 365 GROUP BY 1) JOIN t_quotes USING (ticker)""")
def agg35(spark, sf_dir):
    """Twelve months of distributions over the price; the taxes of trades stand for distributions."""
    part = T.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    lines_ = T.read(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("d"), "l_tax")
    until = lines_.agg(F.max("d").alias("until"))
    paid = lines_.join(F.broadcast(until)).where(F.col("d") > F.date_sub("until", 365)).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("ticker").agg((F.sum("l_tax") / 100).alias("ttm"))
    return rounded(paid.join(T.quotes(spark, sf_dir), "ticker").select("ticker", "ttm", (F.col("ttm") / F.col("price") * 100).alias("yield_pct")))
