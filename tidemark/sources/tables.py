"""Domain tables over the star schema: bars, quotes, holdings, statements and the rest, as DataFrames.

Every function takes (spark, dir) and returns a lazy DataFrame; Spark prunes columns and pushes filters to the scans.
"""

from __future__ import annotations

from contextlib import contextmanager
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.shared import checkpointed

#: USD for one unit of a currency, used where no live rate is known.
STATIC_FX = {"USD": 1.0, "SGD": 0.779, "HKD": 0.128, "JPY": 0.0065, "KRW": 0.00072, "CNY": 0.139, "EUR": 1.08, "GBP": 1.27}
#: Markets, their currencies and ticker suffixes.
MARKETS = ("US", "SG", "HK", "JP", "KR")
CURRENCIES = ("USD", "SGD", "HKD", "JPY", "KRW")
SUFFIXES = ("", ".SI", ".HK", ".T", ".KS")
SECTORS = (
    "Technology", "Financial Services", "Healthcare", "Energy", "Industrials", "Consumer Cyclical", "Consumer Defensive",
    "Utilities", "Real Estate", "Basic Materials", "Communication Services",
)
INDUSTRIES = ("software—application", "banks—regional", "semiconductors", "utilities—regulated electric", "drug manufacturers", "financial data & exchanges", "auto parts", "grocery stores", "telecom services")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, ticker: str = "p_brand") -> DataFrame:
    """Line items as trades: (ticker, d, px, v, key). The key orders the trades of a day: order, line, part and supplier
    (its last six digits) in one number, so that aggregates over it need no sort."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col(ticker).alias("ticker"))
    line = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("decimal(19,0)") * F.lit(Decimal(10**18))
    key = line + F.col("l_partkey").cast("decimal(12,0)") * F.lit(Decimal(10**6)) + F.pmod("l_suppkey", F.lit(10**6)).cast("decimal(6,0)")
    lines = read(spark, sf_dir, "lineitem").select(
        "l_partkey", F.to_date("l_shipdate").alias("d"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), F.col("l_quantity").alias("v"), key.cast("decimal(38,0)").alias("key")
    )
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("ticker", "d", "px", "v", "key")


#: Bars that the parts of one query share while it is put together.
_shared: dict[str, DataFrame] = {}


@contextmanager
def bars_once(spark: SparkSession, sf_dir: str):
    """Within, all that asks for the daily bars of a folder gets one checkpoint of them, so that a query of several branches
    reads the trades for its bars once."""
    outer = _shared.get(sf_dir)
    _shared[sf_dir] = outer if outer is not None else checkpointed(bars(spark, sf_dir))
    try:
        yield
    finally:
        if outer is None:
            del _shared[sf_dir]


def bars(spark: SparkSession, sf_dir: str, ticker: str = "p_brand", least: int = 5) -> DataFrame:
    """Daily bars (ticker, d, o, h, l, c, v), aggregated before the shuffle; tickers of fewer than ``least`` bars go."""
    if (ticker, least) == ("p_brand", 5) and sf_dir in _shared:
        return _shared[sf_dir]
    daily = trades(spark, sf_dir, ticker).groupBy("ticker", "d").agg(
        F.min_by("px", "key").alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", "key").alias("c"), F.sum("v").alias("v")
    )
    daily = daily.dropna(subset=["o", "h", "l", "c", "v"])
    # In the order of days, as what follows needs it too.
    whole = Window.partitionBy("ticker").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return daily.withColumn("n_bars", F.count("*").over(whole)).where(F.col("n_bars") >= least).drop("n_bars")


def numbered(frame: DataFrame) -> DataFrame:
    """Adds rn (from 1, oldest first), rn_desc (from 1, newest first) and n."""
    w = Window.partitionBy("ticker").orderBy("d")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return frame.withColumns({"rn": F.row_number().over(w), "n": F.count("*").over(whole)}).withColumn("rn_desc", F.col("n") - F.col("rn") + 1)


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index: bars over all trades (d, c)."""
    return trades(spark, sf_dir).groupBy("d").agg(F.max_by("px", "key").alias("c"))


def returns(frame: DataFrame) -> DataFrame:
    """Simple returns (ticker, d, r, rn_desc), of tickers with over 20 bars; days after a zero close are left out first."""
    w = Window.partitionBy("ticker").orderBy("d")
    moves = numbered(frame).where("n > 20").withColumn("p", F.lag("c").over(w)).where("p <> 0").select("ticker", "d", (F.col("c") / F.col("p") - 1).alias("r"))
    return moves.withColumn("rn_desc", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d"))))


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticker dimension (ticker, num, market, currency, sector, industry, symbol): a handful of rows per brand."""
    brands = read(spark, sf_dir, "part").select(F.col("p_brand").alias("ticker")).distinct().withColumn("num", F.regexp_extract("ticker", r"([0-9]+)", 1).cast("int"))
    pick = lambda values, of: F.element_at(F.array(*[F.lit(v) for v in values]), (of % len(values)) + 1)
    num = F.col("num")
    named = brands.select("ticker", "num", pick(MARKETS, num).alias("market"), pick(CURRENCIES, num).alias("currency"), pick(SECTORS, num).alias("sector"), pick(INDUSTRIES, num).alias("industry"), pick(SUFFIXES, num).alias("suffix"))
    return named.withColumn("symbol", F.concat(F.lpad(F.col("num").cast("string"), 4, "0"), "suffix")).drop("suffix")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last close and its change on the bar before: (ticker, price, prev, change_pct)."""
    last = numbered(bars(spark, sf_dir)).where("rn_desc <= 2").groupBy("ticker").agg(
        F.max(F.when(F.col("rn_desc") == 1, F.col("c"))).alias("price"), F.max(F.when(F.col("rn_desc") == 2, F.col("c"))).alias("prev")
    )
    return last.withColumn("change_pct", F.try_divide(F.col("price") - F.col("prev"), "prev") * 100)


def fx(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STATIC_FX.items()), "ccy string, usd_per double")


def held(spark: SparkSession, sf_dir: str, *by: str) -> DataFrame:
    """Quantity and sum paid of the line items by some of account, broker, ticker and currency, in one aggregation.

    The currency is that of the customer's region; it is put to the orders, which are fewer and narrower than what is held.
    """
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    currency = F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), F.col("n_regionkey") + 1)
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", currency.alias("currency"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("account")).join(customer, F.col("account") == F.col("c_custkey"))
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") % 3).alias("broker"), "l_quantity", "l_extendedprice")
    lines = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy(*by).agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("paid"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions (account, broker, ticker, quantity, paid, currency): line items by customer, brand and broker."""
    return held(spark, sf_dir, "account", "broker", "ticker", "currency").select("account", "broker", "ticker", "quantity", "paid", "currency")


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged positions (account, ticker, quantity, cost_price, currency): quantities summed, cost weighted by them."""
    merged = held(spark, sf_dir, "account", "ticker", "currency")
    return merged.select("account", "ticker", "quantity", F.coalesce(F.try_divide("paid", "quantity"), F.lit(0.0)).alias("cost_price"), "currency")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts as one book: (ticker, value, weight, sector, market), valued at the last close."""
    held = positions(spark, sf_dir).groupBy("ticker").agg(F.sum("quantity").alias("quantity"))
    valued = held.join(quotes(spark, sf_dir), "ticker").join(tickers(spark, sf_dir), "ticker").withColumn("value", F.col("quantity") * F.col("price"))
    return valued.select("ticker", "value", (F.col("value") / F.sum("value").over(Window.partitionBy())).alias("weight"), "sector", "market")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly statements per brand; current assets and liabilities are null where nothing is known."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    lines = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    x, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return lines.groupBy("ticker", F.year("l_shipdate").alias("y")).agg(
        F.sum(x * (1 - disc)).alias("revenue"), F.sum(x * (F.lit(0.6) - disc)).alias("cogs"), F.sum(x * (disc - F.lit(0.04))).alias("net_income"), F.sum(x * (tax - F.lit(0.03))).alias("cfo"),
        F.sum(-x * disc).alias("capex"), F.sum("l_quantity").alias("shares"), F.sum(x * (3 + tax)).alias("total_assets"), F.sum(x * disc * 20).alias("total_debt"),
        F.sum(F.when(F.col("l_returnflag") == "N", x)).alias("current_assets"), F.sum(F.when(F.col("l_linestatus") == "O", x)).alias("current_liabilities"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series (series_id, d, value): order totals by priority."""
    orders = read(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date(F.trunc(F.to_date("o_orderdate"), "MM")).alias("d")).agg(F.sum("o_totalprice").alias("value"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles (doc_id, ticker, title, url, epoch, sentiment, score): a title is the first line of the
    text."""
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("of"), "quality", "toxic")
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    score = F.when(F.col("toxic") == 1, -0.6).when(F.col("quality") == 1, 0.4).when(F.col("quality") == 0, 0.0)
    joined = docs.join(labels, F.col("doc_id") == F.col("of"), "left")
    return joined.select(
        "doc_id", F.col("source").alias("ticker"), "title", F.concat(F.lit("https://"), "source", F.lit(".example/"), (F.col("doc_id") % 900).cast("string")).alias("url"),
        (F.lit(1_700_000_000) + (F.col("doc_id") * 7919) % 864_000).alias("epoch"), score.alias("score"),
        F.when(score > 0, "bullish").when(score < 0, "bearish").otherwise("neutral").alias("sentiment"),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as insider filings (event_id, ticker, name, code, change, d)."""
    code = F.when(F.col("event_type") == "purchase", "P").when(F.col("event_type") == "signup", "S").when(F.col("event_type") == "click", "M").otherwise("G")
    return read(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("Brand#"), (F.col("user_id") % 25 + 1).cast("string")).alias("ticker"), F.concat(F.lit("person"), F.col("user_id").cast("string")).alias("name"), code.alias("code"),
        F.col("value").alias("change"), F.to_date("ts").alias("d"),
    )


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an option chain per brand (ticker, kind, strike, last, bid, ask, iv, oi, ord)."""
    part = read(spark, sf_dir, "part")
    half = F.col("p_size") / F.lit(100.0)
    return part.select(
        F.col("p_brand").alias("ticker"), F.when(F.col("p_partkey") % 2 == 0, "call").otherwise("put").alias("kind"), F.col("p_retailprice").alias("strike"), (F.col("p_size") / F.lit(4.0)).alias("last"),
        (F.col("p_size") / F.lit(5.0)).alias("bid"), (F.col("p_size") / F.lit(3.0)).alias("ask"), half.alias("iv"), (F.col("p_partkey") % 500).alias("oi"), F.col("p_partkey").alias("ord"),
    )


def levels(spark: SparkSession, sf_dir: str, depth: int = 10) -> DataFrame:
    """Events as an order book per ticker (ticker, side, level, price, volume): views bid, clicks ask, best first."""
    side = F.when(F.col("event_type") == "view", "bid").when(F.col("event_type") == "click", "ask")
    price = F.when(F.col("event_type") == "view", 100 - F.col("value") / 100).otherwise(100.5 + F.col("value") / 100)
    rows = read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("ticker"), side.alias("side"), price.alias("price"), (F.col("event_id") % 97 + 1).alias("volume"), "event_id").where("side IS NOT NULL")
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    return rows.withColumn("level", F.row_number().over(Window.partitionBy("ticker", "side").orderBy(best, "event_id"))).where(F.col("level") <= depth)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equity snapshots per market segment, one a month (book, d, value, cost): cost grows by what was ordered."""
    customer = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("book"))
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.to_date(F.trunc(F.to_date("o_orderdate"), "MM")).alias("d"), F.when(F.col("o_orderstatus") == "P", -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("flow"), F.col("o_totalprice").alias("total"))
    monthly = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("book", "d").agg(F.sum("flow").alias("flow"), F.sum("total").alias("total"))
    w = Window.partitionBy("book").orderBy("d")
    return monthly.withColumn("cost", F.sum("flow").over(w)).select("book", "d", (F.col("cost") * (1 + (F.month("d") % 5 - 2) / F.lit(100.0)) + F.col("total") * 0.1).alias("value"), "cost")
