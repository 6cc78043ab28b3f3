"""Scalar families, sources and streams: queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import html_tables as H
from tidemark.functions import numeric, text
from tidemark.operators import requests as R
from tidemark.plans.sql import define, twin
from tidemark.plans.technical import rounded
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


@register("str01_string_family", "SELECT p_partkey, upper(trim(p_name)) AS up, regexp_replace(p_brand, '#', '-') AS dashed, split_part(p_name, ' ', 1) AS head, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, substr(p_type, 1, 4) AS prefix FROM part")
def str01(spark, sf_dir):
    return T.read(spark, sf_dir, "part").select(
        "p_partkey", F.upper(F.trim("p_name")).alias("up"), F.regexp_replace("p_brand", "#", "-").alias("dashed"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.substring("p_type", 1, 4).alias("prefix")
    )


@register("str02_formatting", "SELECT p_partkey, format('{:,.2f}', p_retailprice) AS money, printf('%+.1f%%', p_size - 25.0) AS signed FROM part")
def str02(spark, sf_dir):
    return T.read(spark, sf_dir, "part").select("p_partkey", F.format_number("p_retailprice", 2).alias("money"), F.format_string("%+.1f%%", F.col("p_size") - F.lit(25.0)).alias("signed"))


@register("str03_regex_family", "SELECT p_partkey, regexp_matches(p_brand, '^Brand#[0-9]+$') AS ok, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '', 'g') AS bare FROM part")
def str03(spark, sf_dir):
    return T.read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").rlike("^Brand#[0-9]+$").alias("ok"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.regexp_replace("p_name", "[aeiou]", "").alias("bare"))


@register("src20_ticker_normalizers", """
    SELECT c_custkey, CASE WHEN regexp_matches(us, '^[A-Z]{1,5}([.-][A-Z])?$') THEN replace(us, '.', '-') END AS us, lpad(ltrim(CAST(c_custkey AS VARCHAR), '0'), CAST(greatest(4, len(ltrim(CAST(c_custkey AS VARCHAR), '0'))) AS INTEGER), '0') || '.HK' AS hk
    FROM (SELECT c_custkey, upper(substr(c_mktsegment, 1, 3)) || CASE WHEN c_custkey % 2 = 0 THEN '.B' ELSE '.BB' END AS us FROM customer WHERE c_custkey > 0)""")
def src20(spark, sf_dir):
    raw = F.concat(F.substring("c_mktsegment", 1, 3), F.when(F.col("c_custkey") % 2 == 0, ".B").otherwise(".BB"))
    digits = F.ltrim(F.col("c_custkey").cast("string"), F.lit("0"))
    hk = F.concat(F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0")), F.lit(".HK"))
    return T.read(spark, sf_dir, "customer").where("c_custkey > 0").select("c_custkey", text.us_ticker(raw).alias("us"), hk.alias("hk"))


@register("src05_symbol_resolution", """
    SELECT o_orderkey % 50 AS k, CASE WHEN typed = 'APPLE' THEN 'AAPL' WHEN regexp_matches(typed, '^[0-9]+$') THEN lpad(ltrim(typed, '0'), 4, '0') || '.HK' ELSE typed END AS symbol, count(*) AS n FROM (
        SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'APPLE' WHEN 1 THEN '0' || CAST(o_orderkey % 50 + 1 AS VARCHAR) ELSE upper(o_orderpriority) END AS typed FROM orders) GROUP BY ALL""")
def src05(spark, sf_dir):
    k = F.col("o_orderkey")
    typed = F.when(k % 3 == 0, "apple ").when(k % 3 == 1, F.concat(F.lit("0"), (k % 50 + 1).cast("string"))).otherwise(F.col("o_orderpriority"))
    return T.read(spark, sf_dir, "orders").groupBy((k % 50).alias("k"), text.resolve(typed, {"APPLE": "AAPL"}).alias("symbol")).agg(F.count("*").alias("n"))


@register("str05_hashing", "SELECT n_nationkey, sha1(n_name || '|' || CAST(n_regionkey AS VARCHAR)) AS key, sha256('{\"n\":\"' || n_name || '\",\"r\":' || CAST(n_regionkey AS VARCHAR) || '}') AS digest FROM nation")
def str05(spark, sf_dir):
    n = T.read(spark, sf_dir, "nation")
    return n.select("n_nationkey", text.cache_key(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("key"), text.canonical_hash(F.struct(F.col("n_name").alias("n"), F.col("n_regionkey").alias("r"))).alias("digest"))


@register("str06_contains_any", "SELECT p_partkey, regexp_matches(p_name, 'red|bolt') AS hit FROM part")
def str06(spark, sf_dir):
    terms = F.array(F.lit("red"), F.lit("bolt"))
    return T.read(spark, sf_dir, "part").select("p_partkey", F.exists(terms, lambda t: F.contains(F.col("p_name"), t)).alias("hit"))


@register("dat02_date_arithmetic", "SELECT o_orderkey, DATE '1999-01-01' - CAST(o_orderdate AS DATE) AS age, CAST(o_orderdate AS DATE) + 90 AS due FROM orders")
def dat02(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return T.read(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.lit("1999-01-01").cast("date"), d).cast("long").alias("age"), F.date_add(d, 90).alias("due"))


@register("dat03_relative_age", "SELECT event_id, CASE WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm ago' WHEN s < 86400 THEN CAST(s // 3600 AS VARCHAR) || 'h ago' ELSE CAST(s // 86400 AS VARCHAR) || 'd ago' END AS age FROM (SELECT event_id, event_id * 97 % 900000 AS s FROM events)")
def dat03(spark, sf_dir):
    return T.read(spark, sf_dir, "events").select("event_id", text.age_text(F.col("event_id") * 97 % 900_000).alias("age"))


@register("dat05_compact_parse", "SELECT event_id, date_trunc('second', ts) AS t FROM events")
def dat05(spark, sf_dir):
    e = T.read(spark, sf_dir, "events")
    return e.select("event_id", text.compact_date(F.date_format("ts", "yyyyMMdd'T'HHmmss")).cast("timestamp_ntz").alias("t"))


@register("mth01_safe_number", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice END AS x FROM orders")
def mth01(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, F.col("o_totalprice").cast("string")).when(k == 1, "Infinity").when(k == 2, "NaN").otherwise("NM")
    return T.read(spark, sf_dir, "orders").select("o_orderkey", numeric.number(raw).alias("x"))


@register("mth02_bands", "SELECT p_partkey, greatest(-10, least(10, p_size - 25)) AS clamped, round(greatest(0, 100 * (1 - greatest(10 - p_size, p_size - 30, 0) / 15)), 6) AS band, round(greatest(0, 100 * (1 - greatest(p_size - 20, 0) / 20)), 6) AS cap FROM part")
def mth02(spark, sf_dir):
    s = F.col("p_size")
    return rounded(T.read(spark, sf_dir, "part").select("p_partkey", numeric.clamp(s - 25, -10, 10).alias("clamped"), numeric.band_score(s.cast("double"), 10, 30, 15).alias("band"), numeric.cap_score(s.cast("double"), 20, 20).alias("cap")))


@register("mth03_guarded_division", "SELECT p_partkey, round(p_retailprice / nullif(p_size % 3, 0), 6) AS q, round(pow(p_retailprice / 900, 1 / 3) - 1, 8) AS cagr FROM part")
def mth03(spark, sf_dir):
    return T.read(spark, sf_dir, "part").select("p_partkey", F.round(F.try_divide("p_retailprice", F.col("p_size") % 3), 6).alias("q"), F.round(F.pow(F.col("p_retailprice") / 900, F.lit(1 / 3)) - 1, 8).alias("cagr"))


@register("mth05_math_family", "SELECT c_nationkey, round(ln(max(abs(c_acctbal)) + 1), 6) AS a, round(sqrt(avg(abs(c_acctbal))), 6) AS b, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(median(c_acctbal), 6) AS m FROM customer GROUP BY c_nationkey")
def mth05(spark, sf_dir):
    x = F.abs("c_acctbal")
    return rounded(T.read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.log(F.max(x) + 1).alias("a"), F.sqrt(F.avg(x)).alias("b"), F.percentile("c_acctbal", F.lit(0.25)).alias("q1"), F.median("c_acctbal").alias("m")))


define("t_calls", "SELECT conv_id, turn, role, len(text) // 4 AS tokens, CASE role WHEN 'user' THEN 0.5::DOUBLE WHEN 'assistant' THEN 1.5 END AS price FROM conversations")


@register("mth07_price_call", "SELECT conv_id, turn, round(coalesce(tokens * price / 1000000, 0), 9) AS usd, price IS NOT NULL AS priced FROM t_calls")
def mth07(spark, sf_dir):
    return rounded(calls(spark, sf_dir).select("conv_id", "turn", F.coalesce(F.col("tokens") * F.col("price") / 1_000_000, F.lit(0.0)).alias("usd"), F.col("price").isNotNull().alias("priced")), 9)


def calls(spark, sf_dir):
    """Turns as calls, with the price of their role."""
    prices = spark.createDataFrame([("user", 0.5), ("assistant", 1.5)], "role string, price double")
    c = T.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.floor(F.length("text") / 4).alias("tokens"))
    return c.join(F.broadcast(prices), "role", "left")


@register("agg34_cost_totals", "SELECT role, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(coalesce(tokens * price / 1000000, 0)), 9) AS usd FROM t_calls GROUP BY ROLLUP (role)")
def agg34(spark, sf_dir):
    usd = F.coalesce(F.col("tokens") * F.col("price") / 1_000_000, F.lit(0.0))
    return rounded(calls(spark, sf_dir).rollup("role").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum(usd).alias("usd")), 9)


@register("mth08_binning", "SELECT CAST(least(greatest(floor((p_retailprice - 900) / 5), 0), 19) AS INTEGER) AS bin, count(*) AS n FROM part GROUP BY 1")
def mth08(spark, sf_dir):
    return T.read(spark, sf_dir, "part").groupBy((F.least(F.greatest(F.width_bucket("p_retailprice", F.lit(900.0), F.lit(1000.0), F.lit(20)), F.lit(1)), F.lit(20)) - 1).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@register("arr01_array_family", "SELECT o_custkey, CAST(len(a) AS INTEGER) AS n, a[1] AS first, list_min(a) AS lo, list_max(a) AS hi, CAST(len(list_filter(a, lambda x: x > 100000)) AS INTEGER) AS big FROM (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS a FROM orders GROUP BY o_custkey)")
def arr01(spark, sf_dir):
    a = T.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda s: s["o_totalprice"]).alias("a"))
    return a.select("o_custkey", F.size("a").alias("n"), F.col("a")[0].alias("first"), F.array_min("a").alias("lo"), F.array_max("a").alias("hi"), F.size(F.filter("a", lambda x: x > 100_000)).alias("big"))


@register("arr02_conditional_flags", "SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_retailprice > 950 THEN 'dear' END, CASE WHEN p_type = 'ECONOMY' THEN 'economy' END) AS flags FROM part")
def arr02(spark, sf_dir):
    flags = F.array_compact(F.array(F.when(F.col("p_size") > 40, F.lit("large")), F.when(F.col("p_retailprice") > 950, F.lit("dear")), F.when(F.col("p_type") == "ECONOMY", F.lit("economy"))))
    return T.read(spark, sf_dir, "part").select("p_partkey", F.array_join(flags, ",").alias("flags"))


@register("map01_map_family", "SELECT n_nationkey, coalesce(CASE n_regionkey WHEN 0 THEN 10 WHEN 1 THEN 21 WHEN 2 THEN 30 END, -1) AS v FROM nation")
def map01(spark, sf_dir):
    base, over = F.create_map(F.lit(0), F.lit(10), F.lit(1), F.lit(20)), F.create_map(F.lit(1), F.lit(21), F.lit(2), F.lit(30))
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(over), k)), over)
    return T.read(spark, sf_dir, "nation").select("n_nationkey", F.coalesce(F.try_element_at(merged, F.col("n_regionkey")), F.lit(-1)).alias("v"))


@register("jsn01_tolerant_extraction", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 4 <> 3")
def jsn01(spark, sf_dir):
    k = F.col("event_id") % 4
    wrapped = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("see\n```json\n"), "props", F.lit("\n```"))).when(k == 2, F.concat(F.lit("so "), "props", F.lit(" it is"))).otherwise("no object")
    found = text.tolerant_json(wrapped)
    return T.read(spark, sf_dir, "events").select("event_id", F.get_json_object(found, "$.k").alias("k"), found.alias("f")).where("f IS NOT NULL").drop("f")


@register("jsn02_serialise", "SELECT r_regionkey, '{\"key\":' || CAST(r_regionkey AS VARCHAR) || ',\"name\":\"' || r_name || '\"}' AS j FROM region")
def jsn02(spark, sf_dir):
    return T.read(spark, sf_dir, "region").select("r_regionkey", F.to_json(F.struct(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))).alias("j"))


@register("jsn03_nested_paths", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k FROM events GROUP BY event_type")
def jsn03(spark, sf_dir):
    return T.read(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k"))


@register("src22_attention_growth", "SELECT user_id, count(*) FILTER (k <= 30) AS last30, count(*) FILTER (k > 30 AND k <= 60) AS prior30 FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 40 GROUP BY user_id")
def src22(spark, sf_dir):
    w = Window.partitionBy("user_id")
    e = T.read(spark, sf_dir, "events").select("user_id", F.row_number().over(w.orderBy(F.desc("ts"), "event_id")).alias("k"), F.count("*").over(w).alias("n"))
    return e.where("n >= 40").groupBy("user_id").agg(F.count_if(F.col("k") <= 30).alias("last30"), F.count_if((F.col("k") > 30) & (F.col("k") <= 60)).alias("prior30"))


@register("src24_slice_sums", "SELECT user_id, round(list_sum(a[-13:]), 4) AS recent, round(list_sum(a[-26:-14]), 4) AS before FROM (SELECT user_id, list(v ORDER BY d) AS a FROM (SELECT user_id, CAST(ts AS DATE) AS d, sum(value) AS v FROM events GROUP BY ALL) GROUP BY user_id) WHERE len(a) >= 26")
def src24(spark, sf_dir):
    daily = T.read(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.sum("value").alias("v"))
    a = daily.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda s: s["v"]).alias("a")).where(F.size("a") >= 26)
    total = lambda start: F.aggregate(F.slice("a", start, 13), F.lit(0.0), lambda t, x: t + x)
    return rounded(a.select("user_id", total(-13).alias("recent"), total(-26).alias("before")), 4)


@register("src27_external_flows", "SELECT event_id, value FROM events WHERE event_type NOT IN ('click', 'view') AND value > 1")
def src27(spark, sf_dir):
    return T.read(spark, sf_dir, "events").where(~F.col("event_type").isin("click", "view") & (F.col("value") > 1)).select("event_id", "value")


@register("src28_open_positions", "SELECT account, broker, ticker, quantity FROM t_positions WHERE quantity <> 0")
def src28(spark, sf_dir):
    return T.positions(spark, sf_dir).where("quantity <> 0").select("account", "broker", "ticker", "quantity")


@register("src19_html_links", "SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)) AS INTEGER) AS n, regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)[1] AS first FROM pages")
def src19(spark, sf_dir):
    """Cells of a page's lists by pattern, without leaving the JVM."""
    cells = F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), F.lit(1))
    return T.read(spark, sf_dir, "pages").select("page_id", F.size(cells).alias("n"), F.get(cells, F.lit(0)).alias("first"))


@register("src19_constituents", """
    SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY c_custkey) - 1 AS INTEGER) AS ord, lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') || '.HK' AS symbol
    FROM (SELECT c_custkey, c_custkey // 200 AS page, count(*) OVER (PARTITION BY c_custkey // 200) AS n FROM customer) WHERE n >= 10 AND length(CAST(c_custkey AS VARCHAR)) <= 5""")
def src19_constituents(spark, sf_dir):
    """Customers written as pages of HTML tables, a table of too few codes first, and their symbols read back."""
    c = T.read(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 200).alias("page"), "c_custkey", "c_name", "c_nationkey")
    line = F.concat(F.lit("<tr><td>"), text.html_escaped(F.col("c_name")), F.lit("<td> SEHK:&nbsp;"), F.col("c_custkey"), F.lit("<td>"), F.col("c_nationkey"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"]), "\n")
    few = F.lit("<h1>Index</h1><table><tr><th>Code<th>Change<tr><td>12<td>added<tr><td>13<td>gone</table>")
    head = F.lit("<table class=wide><thead><tr><th rowspan=2>Company<th colspan=2>Listing<tr><th>Ticker symbol<th>Nation</thead><tbody>")
    pages = c.groupBy("page").agg(F.concat(few, head, body, F.lit("</tbody></table>")).alias("html"))
    digits = F.regexp_replace("cell", r"[^0-9]", "")
    symbol = F.when(F.length(digits).between(1, 5), F.concat(F.lpad(digits, F.greatest(F.lit(4), F.length(digits)), F.lit("0")), F.lit(".HK")))
    return H.constituents(H.cells(pages), ["page"], ("symbol", "code"), symbol)


@register("udt01_html_tables", """
    SELECT page_id, CAST(k - 1 AS INTEGER) AS row, 'Link' AS header, trim(regexp_replace(a[k], '\\s+', ' ', 'g')) AS cell
    FROM (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1) AS a FROM pages))""")
def udt01_tables(spark, sf_dir):
    """The lists of all pages as tables without end tags, by lateral join to the rows of their tables."""
    html = F.col("html")
    for old, new in (("<ul>", "<table><tr><th>Link"), ("<li>", "<tr><td>"), ("</li>", ""), ("</ul>", "</table>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    found = H.cells(T.read(spark, sf_dir, "pages").select("page_id", html.alias("html")))
    return found.select("page_id", "row", "header", "cell")


@register("flt28_lens_gating", "SELECT n_nationkey, n_regionkey IN (0, 1) OR n_nationkey % 5 = 0 AS enabled FROM nation")
def flt28(spark, sf_dir):
    feeds = F.array(F.col("n_regionkey") == 0, F.col("n_regionkey") == 1, F.col("n_nationkey") % 5 == 0)
    return T.read(spark, sf_dir, "nation").select("n_nationkey", F.exists(feeds, lambda f: f).alias("enabled"))


@register("flt29_payload_projection", "SELECT ticker, '{\"sector\":\"' || sector || '\",\"market\":\"' || market || '\"}' AS payload FROM t_tickers")
def flt29(spark, sf_dir):
    return T.tickers(spark, sf_dir).select("ticker", F.to_json(F.struct("sector", "market")).alias("payload"))


@register("flt17_position_guidance", "SELECT account, ticker, round((price / nullif(cost_price, 0) - 1) * 100, 6) AS pnl_pct FROM t_holdings LEFT JOIN t_quotes USING (ticker)")
def flt17(spark, sf_dir):
    h = T.holdings(spark, sf_dir).join(T.quotes(spark, sf_dir), "ticker", "left")
    return rounded(h.select("account", "ticker", ((F.try_divide("price", "cost_price") - 1) * 100).alias("pnl_pct")))


@register("flt13_risk_score", "SELECT ticker, CASE WHEN weight > 0.2 THEN -50 WHEN weight > 0.04 THEN -20 ELSE 0 END AS risk FROM t_book")
def flt13(spark, sf_dir):
    w = F.col("weight")
    return T.book(spark, sf_dir).select("ticker", F.when(w > 0.2, -50).when(w > 0.04, -20).otherwise(0).alias("risk"))


@register("agg29_analyst_trend", "SELECT user_id % 10 AS k, CAST(max(net) FILTER (r = 1) AS BIGINT) AS now, CAST(max(net) FILTER (r = 4) AS BIGINT) AS before, CAST(max(net) FILTER (r = 1) - max(net) FILTER (r = 4) AS BIGINT) AS delta FROM (SELECT user_id, net, row_number() OVER (PARTITION BY user_id ORDER BY d DESC) AS r FROM (SELECT user_id % 10 AS user_id, CAST(ts AS DATE) AS d, sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) AS net FROM events GROUP BY ALL)) GROUP BY user_id")
def agg29(spark, sf_dir):
    k = (F.col("user_id") % 10).alias("k")
    daily = T.read(spark, sf_dir, "events").groupBy(k, F.to_date("ts").alias("d")).agg(F.sum(F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)).alias("net"))
    r = daily.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("d"))))
    now, before = F.max(F.when(F.col("r") == 1, F.col("net"))), F.max(F.when(F.col("r") == 4, F.col("net")))
    return r.groupBy("k").agg(now.alias("now"), before.alias("before"), (now - before).alias("delta"))


@register("jon20_coverage", "SELECT ticker, num % 3 = 0 AS covered FROM t_tickers")
def jon20(spark, sf_dir):
    t = T.tickers(spark, sf_dir)
    curated = t.where("num % 3 = 0").select("ticker", F.lit(True).alias("covered"))
    return t.select("ticker").join(curated, "ticker", "left").select("ticker", F.coalesce("covered", F.lit(False)).alias("covered"))


@register("snk03_snapshot_upsert", "SELECT user_id, CAST(ts AS DATE) AS day, max(event_id) AS event_id, round(arg_max(value, event_id), 4) AS value FROM events GROUP BY ALL")
def snk03(spark, sf_dir):
    """A snapshot for each user and day in a store that three runs write one after the other, the second one twice."""
    from tidemark.sources.store import KeyedStore

    e = T.read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "value")
    bounds = e.agg(F.min("event_id"), F.max("event_id")).first()
    store = KeyedStore(spark, scratch(spark, "snapshots"), "user_id long, day date, event_id long, value double", ["user_id", "day"])
    if bounds[0] is None:
        return store.read()
    width = (bounds[1] - bounds[0]) // 3 + 1
    for run in (0, 1, 1, 2):
        store.upsert(e.where(F.floor((F.col("event_id") - bounds[0]) / width) == run), "event_id")
    out = checkpointed(store.read())
    removed(spark, store.folder)
    return rounded(out, 4)


@register("snk05_portfolio_subtotals", "SELECT currency, CAST(CASE WHEN ticker IS NULL THEN 1 ELSE 0 END AS INTEGER) AS ord, coalesce(ticker, 'total') || ' | ' || format('{:,.2f}', q) || ' | ' || format('{:,.2f}', cost) AS line FROM (SELECT currency, ticker, sum(quantity) AS q, round(sum(quantity * cost_price), 2) AS cost FROM t_holdings GROUP BY GROUPING SETS ((currency, ticker), (currency)))")
def snk05(spark, sf_dir):
    from tidemark.sources import files

    return files.portfolio_lines(T.holdings(spark, sf_dir))


# ------------------------------------------------------------------ streams, beyond the original: event time and late data

@register("stm_tumbling_windows", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def stm_tumbling(spark, sf_dir):
    done = S.drain(spark, S.tumbling(S.read(spark, sf_dir)))
    return rounded(done.select(F.to_date("start").alias("day"), "event_type", "n", "value"), 4)


@register("stm_sliding_windows", "SELECT day, count(*) AS n FROM (SELECT unnest([CAST(ts AS DATE) - (epoch(ts)::BIGINT // 86400 % 1)::INTEGER, CAST(ts AS DATE) - 1]) AS day FROM events) GROUP BY day")
def stm_sliding(spark, sf_dir):
    return S.drain(spark, S.sliding(S.read(spark, sf_dir))).select(F.to_date("start").alias("day"), "n")


@register("stm_session_windows", """
    SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY user_id""")
def stm_sessions(spark, sf_dir):
    per_user = lambda batch: batch.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))
    return S.drain(spark, S.sessions(S.read(spark, sf_dir)), fold=per_user)


@register("stm_deduplication", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stm_dedup(spark, sf_dir):
    e = S.read(spark, sf_dir)
    counted = lambda batch: batch.groupBy("event_type").agg(F.count("*").alias("n"))
    done = S.drain(spark, S.deduplicated(e).select("event_id", "event_type"), "append", counted)
    return done.groupBy("event_type").agg(F.sum("n").alias("n"))


@register("stm01_state_with_ttl", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stm01(spark, sf_dir):
    done = S.drain(spark, K.running_totals(S.read(spark, sf_dir)), "update")
    epochs = done.groupBy("user_id", "epoch").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))
    return rounded(epochs.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), 4)


@register("stm01_cache_log", """
    WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id, epoch_us(ts) AS t, event_type <> 'error' AS storable, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    r AS (
        SELECT user_id, i, event_id, true AS fetched, CASE WHEN storable THEN t END AS since FROM e WHERE i = 1
        UNION ALL
        SELECT user_id, i, event_id, fetched, CASE WHEN fetched AND storable THEN t ELSE since END FROM (
            SELECT e.*, r.since, r.since IS NULL OR e.t - r.since > 21600000000 AS fetched FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
    )
    SELECT event_id, fetched FROM r""")
def stm01_cache(spark, sf_dir):
    """A stream of requests through a cache of six hours; answers to errors are not stored."""
    log = S.read(spark, sf_dir).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (F.col("event_type") != "error").alias("storable"))
    return K.newest(S.drain(spark, K.cache_log(log, "user_id", 21_600_000_000), "update"), "event_id")


def limiter_twin(key: str, most: int, per: int) -> str:
    """Call by call: stamps within the window are kept, and if there are enough of them the oldest must leave it first."""
    return f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, {key} AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events),
        r AS (
            SELECT event_id, k, i, t, t AS out, [t] AS stamps FROM e WHERE i = 1
            UNION ALL
            SELECT event_id, k, i, t, out, list_append(list_filter(stamps, lambda s: s > out - {per}), out) FROM (
                SELECT event_id, k, i, t, stamps, CASE WHEN len(young) >= {most} THEN greatest(now, young[1] + {per}) ELSE now END AS out FROM (
                    SELECT *, list_filter(stamps, lambda s: s > now - {per}) AS young FROM (SELECT e.*, r.stamps, greatest(e.t, r.out) AS now FROM r JOIN e ON e.k = r.k AND e.i = r.i + 1)))
        )
        SELECT event_id, out - t AS waited_us FROM r"""


def limited(spark, sf_dir, key, most, per):
    calls = T.read(spark, sf_dir, "events").select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return R.released(calls, [key], "t", "event_id", most, per).select("event_id", (F.col("released") - F.col("t")).alias("waited_us"))


HOUR_US = 3_600_000_000


@register("stm02_rate_limit", limiter_twin("user_id", 2, 24 * HOUR_US))
def stm02(spark, sf_dir):
    """How long each call waits if a user may make two a day."""
    return limited(spark, sf_dir, "user_id", 2, 24 * HOUR_US)


@register("stm02_rate_limit_by_type", limiter_twin("event_type", 3, HOUR_US))
def stm02_by_type(spark, sf_dir):
    """Few keys with many calls each: three an hour."""
    return limited(spark, sf_dir, "event_type", 3, HOUR_US)
