"""File sources and sinks of the formats that the feeds use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import number

PRICES = "Date string, Open double, High double, Low double, Close double, Volume double"


def price_csv(spark: SparkSession, path: str, keep: int = 260) -> DataFrame:
    """Daily prices from CSV with a header, one ticker per file: rows without a close go, a missing volume is zero, the
    newest ``keep`` of each file stay. Files that are no such CSV give no rows."""
    raw = spark.read.schema(PRICES).csv(path, header=True, enforceSchema=True, mode="PERMISSIVE")
    rows = raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1).alias("ticker"), F.try_to_date("Date", "yyyy-MM-dd").alias("d"), F.col("Open").alias("o"), F.col("High").alias("h"), F.col("Low").alias("l"), F.col("Close").alias("c"), F.coalesce("Volume", F.lit(0.0)).alias("v"))
    rows = rows.where("d IS NOT NULL AND c IS NOT NULL")
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("d")))).where(F.col("k") <= keep).drop("k")


def series_csv(spark: SparkSession, path: str, keep: int = 400) -> DataFrame:
    """Observations (d, value) from CSV of a date and a number; what is no finite number goes, the newest ``keep`` stay."""
    raw = spark.read.schema("d string, value string").csv(path, header=True)
    rows = raw.select(F.try_to_date("d", "yyyy-MM-dd").alias("d"), number(F.col("value")).alias("value")).where("d IS NOT NULL AND value IS NOT NULL")
    return rows.orderBy(F.desc("d")).limit(keep)


def json_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from JSON documents of parallel arrays: rows with any null price go, tickers of fewer than five rows too."""
    kind = "ticker string, timestamps array<long>, opens array<double>, highs array<double>, lows array<double>, closes array<double>, volumes array<double>"
    docs = spark.read.schema(kind).json(path, multiLine=True)
    rows = docs.select("ticker", F.inline(F.arrays_zip("timestamps", "opens", "highs", "lows", "closes", "volumes")))
    rows = rows.select("ticker", F.to_date(F.timestamp_seconds("timestamps")).alias("d"), F.col("opens").alias("o"), F.col("highs").alias("h"), F.col("lows").alias("l"), F.col("closes").alias("c"), F.col("volumes").alias("v")).dropna()
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("ticker"))).where("n >= 5").drop("n")


def news_json(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """Articles from JSON with a nested list of sentiments per ticker: the one of ``ticker``, five classes made three."""
    kind = "title string, url string, time_published string, summary string, ticker_sentiment array<struct<ticker: string, ticker_sentiment_score: string, ticker_sentiment_label: string>>"
    own = F.filter("ticker_sentiment", lambda t: t["ticker"] == ticker)[0]
    label = own["ticker_sentiment_label"]
    return spark.read.schema(kind).json(path).where("title <> '' AND url <> ''").select(
        "title", "url", F.try_to_timestamp("time_published", F.lit("yyyyMMdd'T'HHmmss")).alias("published"), F.substring("summary", 1, 300).alias("summary"), number(own["ticker_sentiment_score"]).alias("score"),
        F.when(label.like("%Bullish"), "bullish").when(label.like("%Bearish"), "bearish").otherwise("neutral").alias("sentiment"),
    )


def disclosures(spark: SparkSession, senate: str, house: str) -> DataFrame:
    """Two dumps of transactions whose names differ, as one: (chamber, person, ticker, type, d)."""
    read = lambda path, chamber: spark.read.schema("senator string, representative string, ticker string, type string, transaction_date string").json(path, multiLine=True).withColumn("chamber", F.lit(chamber))
    both = read(senate, "senate").unionByName(read(house, "house"))
    d = F.coalesce(F.try_to_date("transaction_date", "yyyy-MM-dd"), F.try_to_date("transaction_date", "MM/dd/yyyy"))
    return both.select("chamber", F.coalesce("senator", "representative").alias("person"), F.upper("ticker").alias("ticker"), "type", d.alias("d"))


def portfolio_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Holdings (company, ticker, quantity, cost_price, currency) from Markdown tables under currency headings.

    A heading sets the currency of the rows after it, so the lines of one file are read in order, whole.
    """
    files = spark.read.text(path, wholetext=True)
    return holdings_in(files.select(F.posexplode(F.split("value", "\n")).alias("at", "line"), F.input_file_name().alias("file"))).drop("file")


def holdings_in(lines: DataFrame) -> DataFrame:
    """Holdings (file, company, ticker, quantity, cost_price, currency) of lines (file, at, line) of Markdown."""
    heading = F.regexp_extract("line", r"^#+ .*\b(USD|SGD|HKD|JPY|KRW|CNY|EUR|GBP)\b", 1)
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("currency", F.coalesce(F.last(F.when(heading != "", heading), ignorenulls=True).over(w), F.lit("USD")))
    cell = lambda i: F.trim(F.replace(F.replace(F.get(F.split("line", r"\|"), F.lit(i)), F.lit("**"), F.lit("")), F.lit(","), F.lit("")))
    out = rows.where(F.ltrim("line").startswith("|")).select("file", cell(1).alias("company"), cell(2).alias("ticker"), number(cell(3)).alias("quantity"), number(cell(4)).alias("cost_price"), "currency")
    return out.where("quantity IS NOT NULL AND cost_price IS NOT NULL AND lower(company) NOT LIKE 'total%'")


def external_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Holdings from a JSON map of ticker to (quantity, cost_price, currency)."""
    kind = "holdings map<string, struct<quantity: double, cost_price: double, currency: string>>"
    return spark.read.schema(kind).json(path, multiLine=True).select(F.explode("holdings").alias("ticker", "h")).select("ticker", "h.*")


# ------------------------------------------------------------------ sinks

def write_report(report: DataFrame, folder: str, run_id: str) -> None:
    """A report's rows as JSON under its run."""
    report.withColumn("run_id", F.lit(run_id)).write.partitionBy("run_id").mode("append").json(folder)


def reports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of all reports of a store, with run_id."""
    return spark.read.schema(f"{schema}, run_id string").json(folder)


def report_index(lines: DataFrame) -> DataFrame:
    """(run_id, rows, place): one line for each run, the newest first."""
    runs = lines.groupBy("run_id").agg(F.count("*").alias("rows"))
    # One line for each run.
    return runs.withColumn("place", F.row_number().over(Window.orderBy(F.desc("run_id"))))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The incoming rows, and the existing ones whose key is not among them; of equal incoming keys the last by ``seq`` stays."""
    newest = incoming.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))).where("_k = 1").drop("_k")
    return existing.join(newest, key, "left_anti").unionByName(newest)


def portfolio_lines(holdings: DataFrame) -> DataFrame:
    """Markdown rows per currency with a subtotal each: (currency, ord, line)."""
    sets = [[F.col("currency"), F.col("ticker")], [F.col("currency")]]
    grouped = holdings.groupingSets(sets, "currency", "ticker").agg(F.sum("quantity").alias("q"), F.sum(F.col("quantity") * F.col("cost_price")).alias("cost"), F.grouping("ticker").alias("ord"))
    return grouped.select("currency", F.col("ord").cast("int").alias("ord"), F.concat_ws(" | ", F.coalesce("ticker", F.lit("total")), F.format_number("q", 2), F.format_number("cost", 2)).alias("line"))
