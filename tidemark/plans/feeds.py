"""Feeds, stores and registries: what comes in as JSON, CSV or Markdown lines, what goes out, and their SQL twins.

The lines are made from the star schema here, so that parsing runs on whole tables; ``sources.files`` reads the same from files.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import numeric, text
from tidemark.operators import backtest
from tidemark.operators import requests as R
from tidemark.plans import scalars, technical
from tidemark.plans.sql import define, twin
from tidemark.plans.technical import rounded
from tidemark.sources import files
from tidemark.sources import paged as P
from tidemark.sources import tables as T
from tidemark.sources.shared import checkpointed, removed, scratch
from tidemark.sources.store import KeyedStore
from tidemark.streaming import events as S

QUERIES, ORACLE_SQL = {}, {}


def register(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = twin(sql)
        return f

    return keep


def same(name, other):
    """The operator that another query shows already, under the name of this one."""
    QUERIES[name] = technical.QUERIES[other]
    ORACLE_SQL[name] = technical.ORACLE_SQL[other]


same("agg21_volume_profile", "win27_volume_profile")
same("udf01_strategy_registry", "agg22_strategy_panel")


# ------------------------------------------------------------------ sources

@register("src03_symbol_search", "SELECT p_partkey, p_name, p_type FROM part WHERE p_type IN ('ECONOMY', 'STANDARD') AND contains(lower(p_name), 'red') ORDER BY p_partkey LIMIT 6")
def src03(spark, sf_dir):
    found = T.read(spark, sf_dir, "part").where(F.col("p_type").isin("ECONOMY", "STANDARD") & F.contains(F.lower("p_name"), F.lit("red")))
    return found.orderBy("p_partkey").limit(6).select("p_partkey", "p_name", "p_type")


@register("src04_fx_rates", "SELECT n_nationkey, round(CASE WHEN n_regionkey = 0 THEN 1.0 ELSE 1 / ((n_nationkey + 1) / 4.0) END, 8) AS usd_per_unit FROM nation")
def src04(spark, sf_dir):
    """Quotes in units per dollar, inverted; the dollar is one."""
    per_usd = (F.col("n_nationkey") + 1) / F.lit(4.0)
    return T.read(spark, sf_dir, "nation").select("n_nationkey", F.round(F.when(F.col("n_regionkey") == 0, F.lit(1.0)).otherwise(F.try_divide(F.lit(1.0), per_usd)), 8).alias("usd_per_unit"))


define("t_feed", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS k FROM t_bars WHERE dayofmonth(d) % 7 <> 0")


@register("src06_price_csv", "SELECT ticker, count(*) AS n, min(d) AS first, round(sum(c), 4) AS closes, CAST(sum(CASE WHEN dayofmonth(d) % 5 = 0 THEN 0 ELSE v END) AS DOUBLE) AS volume FROM t_feed WHERE k <= 260 GROUP BY ticker")
def src06(spark, sf_dir):
    """Lines of CSV: without a close a line goes, without a volume it has none; the newest 260 stay."""
    day = F.dayofmonth("d")
    close, volume = F.when(day % 7 != 0, F.col("c").cast("string")).otherwise(""), F.when(day % 5 != 0, F.col("v").cast("string")).otherwise("")
    line = F.concat_ws(",", F.date_format("d", "yyyy-MM-dd"), *[F.col(x).cast("string") for x in "ohl"], close, volume)
    rows = T.bars(spark, sf_dir).select("ticker", F.from_csv(line, files.PRICES).alias("r")).select("ticker", F.try_to_date("r.Date", "yyyy-MM-dd").alias("d"), F.col("r.Close").alias("c"), F.coalesce("r.Volume", F.lit(0.0)).alias("v"))
    newest = rows.where("d IS NOT NULL AND c IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d")))).where("k <= 260")
    return rounded(newest.groupBy("ticker").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.sum("c").alias("closes"), F.sum("v").alias("volume")), 4)


define("t_obs", "SELECT series_id, d, value FROM t_macro WHERE month(d) <> 6 QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY d DESC) <= 400")


@register("src07_series_json", "SELECT series_id, count(*) AS n, max(d) AS last, round(sum(value), 2) AS total FROM t_obs GROUP BY series_id")
def src07(spark, sf_dir):
    """Observations from JSON lines; a point stands for no value."""
    value = F.when(F.month("d") != 6, F.col("value").cast("string")).otherwise(".")
    line = F.to_json(F.struct(F.date_format("d", "yyyy-MM-dd").alias("date"), value.alias("value")))
    return _series(T.macro(spark, sf_dir).select("series_id", F.from_json(line, "date string, value string").alias("r")).select("series_id", "r.date", "r.value"))


@register("src08_series_csv", "SELECT series_id, count(*) AS n, max(d) AS last, round(sum(value), 2) AS total FROM t_obs GROUP BY series_id")
def src08(spark, sf_dir):
    line = F.concat_ws(",", F.date_format("d", "yyyy-MM-dd"), F.when(F.month("d") != 6, F.col("value").cast("string")).otherwise("n/a"))
    return _series(T.macro(spark, sf_dir).select("series_id", F.from_csv(line, "date string, value string").alias("r")).select("series_id", "r.date", "r.value"))


def _series(raw):
    rows = raw.select("series_id", F.try_to_date("date", "yyyy-MM-dd").alias("d"), numeric.number(F.col("value")).alias("value")).where("d IS NOT NULL AND value IS NOT NULL")
    newest = rows.withColumn("k", F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("d")))).where("k <= 400")
    return rounded(newest.groupBy("series_id").agg(F.count("*").alias("n"), F.max("d").alias("last"), F.sum("value").alias("total")), 2)


@register("src09_news_feed", "SELECT ticker, doc_id, CAST(len(summary) AS INTEGER) AS n FROM (SELECT a.ticker, a.doc_id, substr(text, 1, 300) AS summary, row_number() OVER (PARTITION BY a.ticker ORDER BY epoch DESC, a.doc_id) AS k FROM t_articles a JOIN documents d USING (doc_id) WHERE trim(title) <> '') WHERE k <= 30")
def src09(spark, sf_dir):
    """The thirty newest articles of each ticker that have a headline, with the head of their texts as a summary."""
    a = T.articles(spark, sf_dir).where(F.trim("title") != "").withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("epoch"), "doc_id"))).where("k <= 30")
    texts = T.read(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 300).alias("summary"))
    return a.join(texts, "doc_id").select("ticker", "doc_id", F.length("summary").alias("n"))


@register("src10_calendar_range", "SELECT event_type, count(*) AS n, min(event_id) AS first FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('purchase', 'signup') GROUP BY event_type")
def src10(spark, sf_dir):
    """The range of dates and the kinds reach the scan."""
    e = T.read(spark, sf_dir, "events").where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")) & F.col("event_type").isin("purchase", "signup"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


PAGED = "event_id long, event_type string, value double"


def paged(spark, sf_dir):
    """The events as the pages of a feed; the folder."""
    folder = scratch(spark, "feed")
    e = T.read(spark, sf_dir, "events").select(F.to_date("ts").alias("on"), "event_id", "event_type", "value")
    P.record(e, folder, "on", ["event_id"])
    return folder


@register("src10_paged_range", "SELECT event_type, count(*) AS n, min(event_id) AS first, CAST(min(ts) AS DATE) AS from_day FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-19' AND event_type IN ('purchase', 'signup') GROUP BY event_type")
def src10_paged(spark, sf_dir):
    """A range of days of a feed in pages: no page of another day is opened."""
    folder = paged(spark, sf_dir)
    rows = P.read(spark, folder, PAGED, date(2024, 1, 5), date(2024, 1, 19)).where("event_type IN ('purchase', 'signup')")
    return settled(spark, rows.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.min("day").alias("from_day")), folder)


@register("src09_paged_stream", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def src09_paged(spark, sf_dir):
    """The same feed as a stream of its pages."""
    folder = paged(spark, sf_dir)
    daily = P.stream(spark, folder, PAGED).groupBy("day", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    done = S.drain(spark, daily)
    removed(spark, folder)
    return rounded(done, 4)


@register("src11_nested_sentiment", "SELECT doc_id, round(score, 4) AS score, sentiment FROM t_articles WHERE score IS NOT NULL")
def src11(spark, sf_dir):
    """A list of sentiments per article is searched for the article's own ticker; five labels become three."""
    entry = lambda ticker, score: F.struct(ticker.alias("t"), score.alias("s"), F.when(score > 0.35, "Bullish").when(score > 0, "Somewhat-Bullish").when(score < -0.35, "Bearish").when(score < 0, "Somewhat-Bearish").otherwise("Neutral").alias("l"))
    listed = T.articles(spark, sf_dir).where("score IS NOT NULL").withColumn("all", F.array(entry(F.lit("other"), F.lit(0.9)), entry(F.col("ticker"), F.col("score").cast("double"))))
    own = F.filter("all", lambda x: x["t"] == F.col("ticker"))[0]
    label = F.when(own["l"].endswith("Bullish"), "bullish").when(own["l"].endswith("Bearish"), "bearish").otherwise("neutral")
    return listed.select("doc_id", F.round(own["s"], 4).alias("score"), label.alias("sentiment"))


define("t_paid", "SELECT p_brand AS ticker, epoch(l_shipdate)::BIGINT AS sec, l_tax AS dps FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R'")


@register("src14_trailing_dividends", "SELECT ticker, round(sum(dps), 6) AS ttm, make_timestamp(max(sec) * 1000000)::DATE AS ex_date FROM (SELECT *, max(sec) OVER (PARTITION BY ticker) AS until FROM t_paid) WHERE sec > until - 365 * 86400 GROUP BY ticker")
def src14(spark, sf_dir):
    part = T.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    lines = T.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").join(part, F.col("l_partkey") == F.col("p_partkey"))
    daily = lines.groupBy("ticker", F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("at")).agg(F.sum("l_tax").alias("dps"))
    last = daily.withColumn("until", F.max("at").over(Window.partitionBy("ticker"))).where("at > until - 365 * 86400")
    return rounded(last.groupBy("ticker").agg(F.sum("dps").alias("ttm"), F.to_date(F.timestamp_seconds(F.max("at"))).alias("ex_date")))


@register("src15_nearest_expiry", "SELECT p_brand AS ticker, p_size AS expiry, p_partkey AS ord, CAST(coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 500 END, 0) AS BIGINT) AS oi FROM part QUALIFY p_size = min(p_size) OVER (PARTITION BY p_brand)")
def src15(spark, sf_dir):
    raw = T.read(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker"), F.col("p_size").alias("expiry"), F.col("p_partkey").alias("ord"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 500).alias("oi"))
    nearest = raw.groupBy("ticker").agg(F.min("expiry").alias("expiry"))
    return raw.join(nearest, ["ticker", "expiry"], "left_semi").select("ticker", "expiry", "ord", F.coalesce("oi", F.lit(0)).cast("long").alias("oi"))


@register("src16_market_quotes", "SELECT ticker, round(price, 4) AS price, round(change_pct, 4) AS change_pct FROM t_quotes JOIN t_tickers USING (ticker) WHERE market IN ('HK', 'SG')")
def src16(spark, sf_dir):
    """Quotes of the markets that the provider serves, under its names; a quote is the last two closes."""
    names = {"price": "latest", "change_pct": "change"}
    served = T.tickers(spark, sf_dir).where(F.col("market").isin("HK", "SG")).select("ticker")
    own = T.quotes(spark, sf_dir).join(served, "ticker", "left_semi").withColumnsRenamed(names)
    return rounded(own.withColumnsRenamed({v: k for k, v in names.items()}).select("ticker", "price", "change_pct"), 4)


@register("src17_popularity_rank", "SELECT lpad(CAST(user_id AS VARCHAR), 5, '0') AS code, CAST(row_number() OVER (ORDER BY n DESC, user_id) AS INTEGER) AS rank FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 100")
def src17(spark, sf_dir):
    """The hundred most seen; only those hundred rows are ranked in one task."""
    seen = T.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(100)
    return seen.select(F.lpad(F.col("user_id").cast("string"), 5, "0").alias("code"), F.row_number().over(Window.orderBy(F.desc("n"), "user_id")).alias("rank"))


@register("src18_derived_statements", """
    SELECT ticker, y, round(ni / nullif(roa / 100, 0), 2) AS assets, round(eps, 6) AS eps, round(CASE WHEN before <> 0 THEN eps / before - 1 END, 6) AS eps_yoy FROM (
        SELECT ticker, y, net_income AS ni, net_income / total_assets * 100 AS roa, net_income / shares AS eps, lag(net_income / shares) OVER (PARTITION BY ticker ORDER BY y) AS before FROM t_stmt)""")
def src18(spark, sf_dir):
    """Ratios in percent come in; assets follow from income and return on assets, growth from the year before."""
    raw = T.statements(spark, sf_dir).select("ticker", "y", "net_income", (F.col("net_income") / F.col("total_assets") * 100).alias("roa"), (F.col("net_income") / F.col("shares")).alias("eps"))
    before = F.lag("eps").over(Window.partitionBy("ticker").orderBy("y"))
    return rounded(raw.select("ticker", "y", F.try_divide("net_income", F.col("roa") / 100).alias("assets"), "eps", (F.try_divide("eps", before) - 1).alias("eps_yoy")), assets=2)


@register("src23_first_result", "SELECT conv_id, CAST(count(*) AS INTEGER) AS results, arg_min(role, turn) AS first FROM conversations GROUP BY conv_id")
def src23(spark, sf_dir):
    """The first of a list of results in a JSON answer, and how many there are."""
    answer = T.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("turn", "role")))).alias("j"))
    parsed = F.from_json("j", "array<struct<turn: bigint, role: string>>")
    return answer.select("conv_id", F.size(parsed).alias("results"), F.get(parsed, F.lit(0))["role"].alias("first"))


@register("src25_disclosure_dumps", "SELECT CASE event_id % 2 WHEN 0 THEN 'senate' ELSE 'house' END AS chamber, ticker, count(*) AS n, max(d) AS last FROM t_filings GROUP BY ALL")
def src25(spark, sf_dir):
    """Two dumps with different names and dates, read as one."""
    f = T.filings(spark, sf_dir)
    senate = f.where("event_id % 2 = 0").select(F.lit("senate").alias("chamber"), "ticker", F.date_format("d", "MM/dd/yyyy").alias("raw"))
    house = f.where("event_id % 2 = 1").select(F.lit("house").alias("chamber"), F.col("ticker").alias("symbol"), F.date_format("d", "yyyy-MM-dd").alias("raw")).withColumnRenamed("symbol", "ticker")
    d = F.coalesce(F.try_to_date("raw", "yyyy-MM-dd"), F.try_to_date("raw", "MM/dd/yyyy"))
    return senate.unionByName(house).groupBy("chamber", "ticker").agg(F.count("*").alias("n"), F.max(d).alias("last"))


@register("src26_broker_assets", "SELECT broker, currency, count(DISTINCT account) AS accounts, round(sum(paid), 2) AS paid FROM t_positions GROUP BY broker, currency")
def src26(spark, sf_dir):
    return rounded(T.positions(spark, sf_dir).groupBy("broker", "currency").agg(F.count_distinct("account").alias("accounts"), F.sum("paid").alias("paid")), 2)


@register("src29_portfolio_markdown", "SELECT account, ticker, round(quantity, 4) AS quantity, round(quantity * cost_price, 2) AS cost, currency FROM t_holdings")
def src29(spark, sf_dir):
    """Markdown lines of every account are parsed again: the heading gives the currency of the rows below it."""
    rows = T.holdings(spark, sf_dir)
    body = rows.select("account", F.lit(2).alias("part"), "ticker", F.concat(F.lit("| **"), "ticker", F.lit(" Ltd** | "), "ticker", F.lit(" | "), F.format_number("quantity", 10), F.lit(" | "), F.format_number("cost_price", 10), F.lit(" |")).alias("line"))
    head = rows.select("account", "currency").distinct().select("account", F.lit(0).alias("part"), F.lit("").alias("ticker"), F.concat(F.lit("## Held in "), "currency").alias("line"))
    titles = head.select("account", F.lit(1).alias("part"), "ticker", F.lit("| Company | Ticker | Quantity | Cost |").alias("line"))
    lines = head.unionByName(titles).unionByName(body).select(F.col("account").alias("file"), F.struct("part", "ticker").alias("at"), "line")
    return rounded(files.holdings_in(lines).select(F.col("file").alias("account"), "ticker", "quantity", (F.col("quantity") * F.col("cost_price")).alias("cost"), "currency"), 4, cost=2)


@register("src30_external_holdings", "SELECT account, ticker, quantity, currency FROM t_holdings")
def src30(spark, sf_dir):
    """One JSON map of ticker to holding per account, made rows again."""
    entries = F.map_from_entries(F.collect_list(F.struct("ticker", F.struct("quantity", "currency"))))
    maps = T.holdings(spark, sf_dir).groupBy("account").agg(F.to_json(entries).alias("j"))
    return maps.select("account", F.explode(F.from_json("j", "map<string, struct<quantity: double, currency: string>>")).alias("ticker", "h")).select("account", "ticker", "h.quantity", "h.currency")


@register("src31_cache_read_through", """
    WITH RECURSIVE e AS MATERIALIZED (
        SELECT event_id, user_id, epoch_us(ts) AS t, CASE WHEN event_type <> 'error' THEN value END AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
    ),
    r AS (
        SELECT user_id, i, event_id, true AS missed, payload AS value, CASE WHEN payload IS NOT NULL THEN t END AS since, payload AS stored FROM e WHERE i = 1
        UNION ALL
        SELECT user_id, i, event_id, missed, CASE WHEN missed THEN payload ELSE stored END, CASE WHEN missed AND payload IS NOT NULL THEN t ELSE since END, CASE WHEN missed AND payload IS NOT NULL THEN payload ELSE stored END FROM (
            SELECT e.*, r.since, r.stored, r.since IS NULL OR e.t - r.since > 43200000000 AS missed FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    )
    SELECT event_id, user_id, CASE WHEN missed THEN 'fetch' ELSE 'cache' END AS origin, round(value, 4) AS value FROM r""")
def src31(spark, sf_dir):
    """A log of requests through a cache of half a day: what is stored and young enough is taken, anything else fetched; the
    answer to an error is null and is not stored."""
    payload = F.when(F.col("event_type") != "error", F.col("value")).alias("payload")
    log = T.read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), payload)
    return rounded(R.read_through(log, ["user_id"], "t", "event_id", "payload", 43_200_000_000).select("event_id", "user_id", "origin", "value"), 4)


@register("src34_candidate_lists", "SELECT market, CAST(row_number() OVER (PARTITION BY market ORDER BY num DESC, ticker) AS INTEGER) AS ord, ticker FROM t_tickers")
def src34(spark, sf_dir):
    """The candidates of each market as a dimension: market, place in the list, ticker."""
    w = Window.partitionBy("market").orderBy(F.desc("num"), "ticker")
    return T.tickers(spark, sf_dir).select("market", F.row_number().over(w).alias("ord"), "ticker")


# ------------------------------------------------------------------ sinks

@register("snk02_report_index", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS run FROM orders WHERE o_orderstatus <> 'F'")
def snk02(spark, sf_dir):
    """The index of reports after some were deleted: an anti-join on the deleted ids."""
    index = T.read(spark, sf_dir, "orders")
    deleted = index.where("o_orderstatus = 'F'").select("o_orderkey")
    return index.join(deleted, "o_orderkey", "left_anti").select("o_orderkey", F.to_date("o_orderdate").alias("run"))


define("t_recs", "SELECT ticker, 'run-' || CAST(num % 3 AS VARCHAR) || ':' || ticker AS id, CASE num % 4 WHEN 0 THEN 'hold' WHEN 1 THEN 'sell' ELSE 'buy' END AS action, num FROM t_tickers")


@register("snk04_ledger_record", "SELECT id, ticker, action, round(price, 4) AS price FROM t_recs JOIN t_quotes USING (ticker) WHERE action <> 'hold' AND num % 5 <> 0")
def snk04(spark, sf_dir):
    """Recommendations that are actions, with their price, as far as the ledger has no such id yet."""
    t = T.tickers(spark, sf_dir)
    rec = F.concat(F.lit("run-"), (F.col("num") % 3).cast("string"), F.lit(":"), "ticker")
    recs = t.select("ticker", "num", rec.alias("id"), F.when(F.col("num") % 4 == 0, "hold").when(F.col("num") % 4 == 1, "sell").otherwise("buy").alias("action")).where("action <> 'hold'")
    known = t.where("num % 5 = 0").select(rec.alias("id"))
    fresh = recs.join(T.quotes(spark, sf_dir).select("ticker", "price"), "ticker").join(known, "id", "left_anti")
    return rounded(fresh.select("id", "ticker", "action", "price"), 4)


@register("snk06_holdings_writer", "SELECT user_id, event_type, round(arg_max(value, event_id), 4) AS value FROM events GROUP BY user_id, event_type")
def snk06(spark, sf_dir):
    """Of several rows for a name the last one is written, as a JSON map per book; read again here."""
    last = T.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))
    books = last.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "value")))).alias("j"))
    return rounded(books.select("user_id", F.explode(F.from_json("j", "map<string, double>")).alias("event_type", "value")), 4)


def settled(spark, result, folder):
    """The result as a checkpoint; the folder that it was read from goes."""
    out = checkpointed(result)
    removed(spark, folder)
    return out


@register("snk07_cost_log", "SELECT conv_id, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens FROM t_calls GROUP BY conv_id")
def snk07(spark, sf_dir):
    """A log that each batch of calls is appended to, read again."""
    log = scratch(spark, "cost-log")
    calls = scalars.calls(spark, sf_dir).select("conv_id", "turn", "tokens")
    for batch in (calls.where("turn % 2 = 0"), calls.where("turn % 2 <> 0 OR turn IS NULL")):
        batch.write.mode("append").parquet(log)
    return settled(spark, spark.read.parquet(log).groupBy("conv_id").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens")), log)


@register("snk01_report_store", """
    SELECT run_id, CAST(place AS INTEGER) AS place, ticker, price FROM (
        SELECT 'run-1' AS run_id, 2 AS place, ticker, prev AS price FROM t_quotes UNION ALL SELECT 'run-2', 1, ticker, price FROM t_quotes)""")
def snk01(spark, sf_dir):
    """Two runs of a report written to the store, the first one twice, and read back, each with its place in the index, the
    newest first."""
    store = KeyedStore(spark, scratch(spark, "reports"), "run_id string, ticker string, price double", ["run_id", "ticker"])
    quotes = T.quotes(spark, sf_dir)
    for run, price in (("run-1", "prev"), ("run-1", "prev"), ("run-2", "price")):
        store.upsert(quotes.select(F.lit(run).alias("run_id"), "ticker", F.col(price).alias("price")), "ticker")
    lines = store.read()
    return settled(spark, lines.join(files.report_index(lines).select("run_id", "place"), "run_id").select("run_id", "place", "ticker", "price"), store.folder)


@register("snk10_backtest_results", technical.BACKTEST_JSON)
def snk10(spark, sf_dir):
    """The outcome of the backtest with what it was run on, written as JSON and read back."""
    results = scratch(spark, "backtest")
    edges = technical.agg24(spark, sf_dir)
    universe = T.bars(spark, sf_dir).agg(F.countDistinct("ticker").alias("universe_size"))
    edges.join(F.broadcast(universe)).withColumn("step_days", F.lit(backtest.STEP)).write.json(results)
    return settled(spark, spark.read.schema("stance string, n long, edge60_pct double, win_rate double, universe_size long, step_days int").json(results), results)


@register("snk08_watchlist_store", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name FROM customer WHERE c_custkey % 7 <> 0")
def snk08(spark, sf_dir):
    """Updates by id win over what is stored, deleted ids go."""
    stored = T.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    store = KeyedStore(spark, scratch(spark, "watchlist"), "c_custkey long, name string", ["c_custkey"])
    store.upsert(stored, "c_custkey")
    store.upsert(stored.where("c_custkey % 3 = 0").select("c_custkey", F.upper("name").alias("name")), "c_custkey", deleted=stored.where("c_custkey % 7 = 0 AND c_custkey % 3 <> 0").select("c_custkey"))
    store.upsert(stored.limit(0), "c_custkey", deleted=stored.where("c_custkey % 21 = 0").select("c_custkey"))
    return settled(spark, store.read(), store.folder)


@register("snk09_settings_merge", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'USD' END AS base, '5' AS depth FROM nation")
def snk09(spark, sf_dir):
    defaults = F.create_map(F.lit("base"), F.lit("USD"), F.lit("depth"), F.lit("5"))
    own = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("base"), F.col("n_name"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.map_zip_with(defaults, own, lambda k, d, o: F.coalesce(o, d))
    return T.read(spark, sf_dir, "nation").select("n_nationkey", merged["base"].alias("base"), merged["depth"].alias("depth"))


@register("snk12_text_lines", "SELECT ticker, ticker || ' closed at ' || printf('%.2f', price) || ' (' || printf('%+.1f%%', change_pct) || ')' AS line FROM t_quotes WHERE change_pct IS NOT NULL")
def snk12(spark, sf_dir):
    line = text.printf("%s closed at %.2f (%+.1f%%)", F.col("ticker"), F.col("price"), F.col("change_pct"))
    return T.quotes(spark, sf_dir).where("change_pct IS NOT NULL").select("ticker", line.alias("line"))


# ------------------------------------------------------------------ text, state, registries

@register("str04_html_escape", """
    SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM documents""")
def str04(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").select("doc_id", F.md5(text.html_escaped(F.col("text")).cast("binary")).alias("digest"))


@register("stm03_daily_last_write", "SELECT user_id, CAST(ts AS DATE) AS day, round(arg_max(value, event_id), 4) AS value FROM events WHERE value > 0 GROUP BY ALL")
def stm03(spark, sf_dir):
    """One row per user and day, the last one written; what is not above zero is not recorded."""
    e = T.read(spark, sf_dir, "events").where("value > 0")
    return rounded(e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("value", "event_id").alias("value")), 4)


@register("stm07_connect_cooldown", """
    WITH RECURSIVE e AS MATERIALIZED (
        SELECT event_id, user_id, event_type, event_id % 7 AS topic, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
    ),
    r AS (
        SELECT user_id, i, event_id, 'tried' AS outcome, CASE WHEN event_type = 'error' THEN t END AS failure, CASE WHEN event_type = 'signup' THEN [topic] ELSE [] END AS refused FROM e WHERE i = 1
        UNION ALL
        SELECT user_id, i, event_id, outcome, CASE WHEN outcome = 'tried' AND event_type = 'error' THEN t ELSE failure END, CASE WHEN outcome = 'tried' AND event_type = 'signup' THEN list_append(refused, topic) ELSE refused END FROM (
            SELECT e.*, r.failure, r.refused, CASE WHEN list_contains(r.refused, e.topic) THEN 'denied' WHEN e.t - r.failure < 43200000000 THEN 'held' ELSE 'tried' END AS outcome
            FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    )
    SELECT event_id, outcome FROM r""")
def stm07(spark, sf_dir):
    """Attempts within half a day of the last one that was made and failed are held; a topic refused once is not asked for
    again. Errors are failures, signups refusals."""
    e = T.read(spark, sf_dir, "events").select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_id") % 7).alias("topic"), (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "signup").alias("refused")
    )
    return R.attempts(e, "user_id", "t", "event_id", "topic", "failed", "refused", 43_200_000_000)


#: Named sets of what to compute.
PRESETS = {"quick": ("technicals", "news"), "risk": ("concentration", "stress", "liquidity"), "income": ("dividends", "quality")}


@register("udf05_presets", "SELECT name, skill, count(ticker) AS tickers FROM (VALUES ('quick', 'technicals'), ('quick', 'news'), ('risk', 'concentration'), ('risk', 'stress'), ('risk', 'liquidity'), ('income', 'dividends'), ('income', 'quality')) p(name, skill), t_tickers GROUP BY ALL")
def udf05(spark, sf_dir):
    """Every skill of every preset with the number of tickers it is asked for."""
    sets = spark.createDataFrame([(k, list(v)) for k, v in PRESETS.items()], "name string, skills array<string>")
    asked = T.tickers(spark, sf_dir).agg(F.count("ticker").alias("tickers"))
    return sets.select("name", F.explode("skills").alias("skill")).join(F.broadcast(asked)).select("name", "skill", "tickers")


@register("udt01_bars_to_events", "SELECT ticker, d, rn FROM t_num WHERE rn >= 20 AND rn % 5 = 0")
def udt01(spark, sf_dir):
    """One ticker becomes many rows: every fifth bar from the twentieth on."""
    return T.numbered(T.bars(spark, sf_dir)).where("rn >= 20 AND rn % 5 = 0").select("ticker", "d", F.col("rn").cast("long").alias("rn"))


@register("stm08_order_book_stream", """
    SELECT ticker, round(max(price) FILTER (side = 'bid'), 4) AS best_bid, round(min(price) FILTER (side = 'ask'), 4) AS best_ask, CAST(coalesce(sum(volume) FILTER (side = 'bid'), 0) AS BIGINT) AS bid_depth, CAST(coalesce(sum(volume) FILTER (side = 'ask'), 0) AS BIGINT) AS ask_depth FROM (
        SELECT user_id % 20 AS ticker, CASE event_type WHEN 'view' THEN 'bid' ELSE 'ask' END AS side, CASE event_type WHEN 'view' THEN 100 - value / 100 ELSE 100.5 + value / 100 END AS price, event_id % 97 + 1 AS volume FROM events WHERE event_type IN ('view', 'click')) GROUP BY ticker""")
def stm08(spark, sf_dir):
    """The book of each ticker as the stream of its quotes goes on: best prices and depth of both sides."""
    return rounded(S.drain(spark, S.books(S.read(spark, sf_dir))), 4)
