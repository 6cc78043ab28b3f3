"""The SQL twins' common tables: each named once, put together as a query needs them."""

from __future__ import annotations

import re

#: In order: later tables may name earlier ones.
TABLES: dict[str, str] = {}


def define(name: str, body: str) -> None:
    TABLES[name] = body.strip()


def twin(body: str) -> str:
    """A query with the common tables that it names, and those that they name."""
    wanted: list[str] = []
    text = body
    for name in reversed(TABLES):
        if re.search(rf"\b{name}\b", text):
            wanted.append(name)
            text += "\n" + TABLES[name]
    if not wanted:
        return body.strip()
    return "WITH " + ",\n".join(f"{n} AS ({TABLES[n]})" for n in reversed(wanted)) + "\n" + body.strip()


define("t_trades", """
    SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS px, l_quantity AS v,
           row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS key FROM lineitem JOIN part ON l_partkey = p_partkey""")
define("t_daily", "SELECT ticker, d, arg_min(px, key) AS o, max(px) AS h, min(px) AS l, arg_max(px, key) AS c, sum(v) AS v FROM t_trades GROUP BY ticker, d")
define("t_bars", "SELECT * FROM t_daily QUALIFY count(*) OVER (PARTITION BY ticker) >= 5")
define("t_num", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d) AS rn, count(*) OVER (PARTITION BY ticker) AS n FROM t_bars")
define("t_last", "SELECT * FROM t_num WHERE rn > n - 260")
define("t_bench", "SELECT d, arg_max(px, key) AS c FROM t_trades GROUP BY d")
define("t_ret", """
    SELECT ticker, d, r, row_number() OVER (PARTITION BY ticker ORDER BY d DESC) AS rn_desc FROM (
        SELECT ticker, d, c / p - 1 AS r FROM (SELECT *, lag(c) OVER (PARTITION BY ticker ORDER BY d) AS p FROM t_num WHERE n > 20) WHERE p <> 0)""")
define("t_year", "SELECT * FROM t_ret WHERE rn_desc <= 252")
define("t_corr", "SELECT a.ticker AS a, b.ticker AS b, corr(a.r, b.r) AS corr, count(*) AS n FROM t_year a JOIN t_year b ON a.rn_desc = b.rn_desc AND a.ticker < b.ticker GROUP BY 1, 2 HAVING count(*) >= 60")
define("t_roll0", """
    SELECT *, CASE WHEN lag(c) OVER w IS NOT NULL THEN greatest(h - l, abs(h - lag(c) OVER w), abs(l - lag(c) OVER w)) END AS tr,
           c / nullif(lag(c) OVER w, 0) - 1 AS ret FROM t_num WINDOW w AS (PARTITION BY ticker ORDER BY d)""")
define("t_roll", """
    SELECT *, CASE WHEN rn >= 20 THEN avg(c) OVER w20 END AS sma20, CASE WHEN rn >= 50 THEN avg(c) OVER w50 END AS sma50, CASE WHEN rn >= 200 THEN avg(c) OVER w200 END AS sma200,
           CASE WHEN rn >= 20 THEN stddev_pop(c) OVER w20 END AS sd20, CASE WHEN rn >= 15 THEN avg(tr) OVER w14 END AS atr14, CASE WHEN rn >= 20 THEN avg(v) OVER w20 END AS avg_volume_20,
           CASE WHEN rn >= 20 THEN max(h) OVER w20 END AS high_20, CASE WHEN rn >= 252 THEN max(h) OVER w252 END AS high_252, CASE WHEN count(ret) OVER w20 = 20 THEN stddev_pop(ret) OVER w20 END AS vol20
    FROM t_roll0 WINDOW w14 AS (PARTITION BY ticker ORDER BY d ROWS 13 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY d ROWS 19 PRECEDING), w50 AS (PARTITION BY ticker ORDER BY d ROWS 49 PRECEDING),
           w200 AS (PARTITION BY ticker ORDER BY d ROWS 199 PRECEDING), w252 AS (PARTITION BY ticker ORDER BY d ROWS 251 PRECEDING)""")
define("t_arr", "SELECT ticker, list(c ORDER BY d) AS a FROM t_last GROUP BY ticker")
MACD = """list_reduce(list_transform(a, lambda x: {'x': x, 'i': 0, 'f': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'g': 0.0::DOUBLE}), lambda p, q: {
        'x': q.x, 'i': p.i + 1, 'f': CASE WHEN p.i < 12 THEN p.f + q.x / 12 ELSE q.x * (2 / 13) + p.f * (1 - 2 / 13) END,
        's': CASE WHEN p.i < 26 THEN p.s + q.x / 26 ELSE q.x * (2 / 27) + p.s * (1 - 2 / 27) END,
        'g': CASE WHEN p.i < 25 THEN 0.0::DOUBLE WHEN p.i < 34
             THEN p.g + ((CASE WHEN p.i < 12 THEN p.f + q.x / 12 ELSE q.x * (2 / 13) + p.f * (1 - 2 / 13) END) - (CASE WHEN p.i < 26 THEN p.s + q.x / 26 ELSE q.x * (2 / 27) + p.s * (1 - 2 / 27) END)) / 9
             ELSE ((CASE WHEN p.i < 12 THEN p.f + q.x / 12 ELSE q.x * (2 / 13) + p.f * (1 - 2 / 13) END) - (CASE WHEN p.i < 26 THEN p.s + q.x / 26 ELSE q.x * (2 / 27) + p.s * (1 - 2 / 27) END)) * 0.2 + p.g * 0.8 END},
        {'x': 0.0::DOUBLE, 'i': 0, 'f': 0.0::DOUBLE, 's': 0.0::DOUBLE, 'g': 0.0::DOUBLE})"""
RSI = """CASE WHEN len(a) > 14 THEN list_reduce(list_transform(list_zip(a[16:], a[15:-2]), lambda z: {'g': greatest(z[1] - z[2], 0), 'l': greatest(z[2] - z[1], 0)}),
        lambda p, q: {'g': (p.g * 13 + q.g) / 14, 'l': (p.l * 13 + q.l) / 14},
        {'g': list_sum(list_transform(list_zip(a[2:15], a[1:14]), lambda z: greatest(z[1] - z[2], 0))) / 14, 'l': list_sum(list_transform(list_zip(a[2:15], a[1:14]), lambda z: greatest(z[2] - z[1], 0))) / 14}) END"""
define("t_rec0", f"""
    SELECT ticker, CASE WHEN len(a) >= 20 THEN list_reduce(a[21:], lambda e, x: x * (2 / 21) + e * (1 - 2 / 21), list_sum(a[1:20]) / 20) END AS ema20, {RSI} AS rs,
           CASE WHEN len(a) >= 35 THEN {MACD} END AS m FROM t_arr""")
define("t_rec", "SELECT ticker, ema20, CASE WHEN rs.l = 0 THEN 100 ELSE 100 - 100 / (1 + rs.g / rs.l) END AS rsi14, m.f - m.s AS macd, m.g AS macd_signal, m.f - m.s - m.g AS macd_hist FROM t_rec0")
define("t_weeks", "SELECT ticker, date_trunc('week', d) AS wk, arg_max(c, d) AS wc FROM t_bars GROUP BY ticker, date_trunc('week', d) QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date_trunc('week', d) DESC) <= 30")
define("t_trend", """
    SELECT ticker, CASE WHEN count(*) < 10 THEN 'Data unavailable' WHEN avg(wc) FILTER (k <= 10) > avg(wc) THEN 'Uptrend' WHEN avg(wc) FILTER (k <= 10) < avg(wc) THEN 'Downtrend' ELSE 'Flat' END AS trend
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY wk DESC) AS k FROM t_weeks) GROUP BY ticker""")
define("t_cand0", """
    SELECT *, lag(o, 1) OVER w AS o1, lag(c, 1) OVER w AS c1, lag(o, 2) OVER w AS o2, lag(c, 2) OVER w AS c2, lag(c, 6) OVER w AS then1, lag(c, 7) OVER w AS then2
    FROM t_num WINDOW w AS (PARTITION BY ticker ORDER BY d)""")
define("t_cand1", """
    SELECT *, abs(c - o) AS b0, abs(c1 - o1) AS b1, abs(c2 - o2) AS b2, c > o AS u0, c1 > o1 AS u1, c2 > o2 AS u2, greatest(o, c) AS top, least(o, c) AS low,
           coalesce((c1 - then1) / nullif(then1, 0), 0) AS m1, coalesce((c2 - then2) / nullif(then2, 0), 0) AS m2 FROM t_cand0""")
define("t_cand", """
    SELECT ticker, d, rn, n, CASE WHEN rn < 8 THEN '' ELSE concat_ws(',',
        CASE WHEN h - l > 0 AND b0 < 0.1 * (h - l) THEN 'doji' END,
        CASE WHEN u0 AND NOT u1 AND o <= c1 AND c >= o1 AND b0 > b1 THEN 'bullish_engulfing' END,
        CASE WHEN NOT u0 AND u1 AND o >= c1 AND c <= o1 AND b0 > b1 THEN 'bearish_engulfing' END,
        CASE WHEN b0 > 0 AND m1 < -0.02 AND low - l >= 2 * b0 AND h - top <= b0 THEN 'hammer' END,
        CASE WHEN b0 > 0 AND m1 > 0.02 AND h - top >= 2 * b0 AND low - l <= b0 THEN 'shooting_star' END,
        CASE WHEN b1 > 0 AND b0 < b1 * 0.5 AND top <= greatest(o1, c1) AND low >= least(o1, c1) THEN CASE WHEN u1 THEN 'bearish_harami' ELSE 'bullish_harami' END END,
        CASE WHEN NOT u2 AND b1 < b2 * 0.5 AND b2 > 0 AND u0 AND c > (o2 + c2) / 2 AND m2 < -0.02 THEN 'morning_star' END,
        CASE WHEN u2 AND b1 < b2 * 0.5 AND b2 > 0 AND NOT u0 AND c < (o2 + c2) / 2 AND m2 > 0.02 THEN 'evening_star' END) END AS patterns FROM t_cand1""")
define("t_snap0", """
    SELECT r.*, sma20 + 2 * sd20 AS bb_upper, sma20 - 2 * sd20 AS bb_lower, ema20, rsi14, macd, macd_signal, macd_hist, trend, patterns
    FROM t_roll r JOIN t_rec USING (ticker) JOIN t_trend USING (ticker) JOIN (SELECT ticker, d, patterns FROM t_cand) k ON k.ticker = r.ticker AND k.d = r.d WHERE r.rn = r.n""")
SCORE = """greatest(-100, least(100,
        CASE WHEN rsi14 < 30 THEN 30 WHEN rsi14 < 45 THEN 10 WHEN rsi14 > 70 THEN -10 WHEN rsi14 > 60 THEN -5 ELSE 0 END
        + CASE WHEN c > sma50 THEN 10 WHEN sma50 IS NOT NULL THEN -10 ELSE 0 END + CASE WHEN c > sma200 THEN 10 WHEN sma200 IS NOT NULL THEN -10 ELSE 0 END
        + CASE WHEN sma50 > sma200 THEN 10 WHEN sma50 IS NOT NULL AND sma200 IS NOT NULL THEN -10 ELSE 0 END
        + CASE WHEN macd_hist > 0 THEN 5 WHEN macd_hist IS NOT NULL THEN -5 ELSE 0 END + CASE trend WHEN 'Uptrend' THEN 10 WHEN 'Downtrend' THEN -10 ELSE 0 END))"""
define("t_snap", f"SELECT *, {SCORE} AS score FROM t_snap0")
define("t_quotes", "SELECT ticker, max(c) FILTER (rn = n) AS price, max(c) FILTER (rn = n - 1) AS prev, (max(c) FILTER (rn = n) - max(c) FILTER (rn = n - 1)) / nullif(max(c) FILTER (rn = n - 1), 0) * 100 AS change_pct FROM t_num GROUP BY ticker")
define("t_tickers", """
    SELECT *, lpad(CAST(num AS VARCHAR), 4, '0') || ['', '.SI', '.HK', '.T', '.KS'][num % 5 + 1] AS symbol, ['US', 'SG', 'HK', 'JP', 'KR'][num % 5 + 1] AS market, ['USD', 'SGD', 'HKD', 'JPY', 'KRW'][num % 5 + 1] AS currency,
           ['Technology', 'Financial Services', 'Healthcare', 'Energy', 'Industrials', 'Consumer Cyclical', 'Consumer Defensive', 'Utilities', 'Real Estate', 'Basic Materials', 'Communication Services'][num % 11 + 1] AS sector,
           ['software—application', 'banks—regional', 'semiconductors', 'utilities—regulated electric', 'drug manufacturers', 'financial data & exchanges', 'auto parts', 'grocery stores', 'telecom services'][num % 9 + 1] AS industry
    FROM (SELECT DISTINCT p_brand AS ticker, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS num FROM part)""")
define("t_positions", """
    SELECT o_custkey AS account, l_linenumber % 3 AS broker, p_brand AS ticker, ['USD', 'SGD', 'HKD', 'JPY', 'KRW'][n_regionkey + 1] AS currency, sum(l_quantity) AS quantity, sum(l_extendedprice) AS paid
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
define("t_holdings", "SELECT account, ticker, currency, sum(quantity) AS quantity, coalesce(sum(paid) / nullif(sum(quantity), 0), 0) AS cost_price FROM t_positions GROUP BY ALL")
define("t_book", """
    SELECT ticker, value, value / sum(value) OVER () AS weight, sector, market FROM (
        SELECT ticker, sum(quantity) * any_value(price) AS value, any_value(sector) AS sector, any_value(market) AS market FROM t_positions JOIN t_quotes USING (ticker) JOIN t_tickers USING (ticker) GROUP BY ticker)""")
define("t_fx", "SELECT * FROM (VALUES ('USD', 1.0::DOUBLE), ('SGD', 0.779), ('HKD', 0.128), ('JPY', 0.0065), ('KRW', 0.00072), ('CNY', 0.139), ('EUR', 1.08), ('GBP', 1.27)) f(ccy, usd_per)")
define("t_stmt", """
    SELECT p_brand AS ticker, CAST(year(l_shipdate) AS INTEGER) AS y, sum(l_extendedprice * (1 - l_discount)) AS revenue, sum(l_extendedprice * (0.6 - l_discount)) AS cogs, sum(l_extendedprice * (l_discount - 0.04)) AS net_income,
           sum(l_extendedprice * (l_tax - 0.03)) AS cfo, sum(-l_extendedprice * l_discount) AS capex, sum(l_quantity) AS shares, sum(l_extendedprice * (3 + l_tax)) AS total_assets, sum(l_extendedprice * l_discount * 20) AS total_debt,
           sum(l_extendedprice) FILTER (l_returnflag = 'N') AS current_assets, sum(l_extendedprice) FILTER (l_linestatus = 'O') AS current_liabilities
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
define("t_macro", "SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, sum(o_totalprice) AS value FROM orders GROUP BY ALL")
define("t_articles", """
    SELECT d.doc_id, source AS ticker, split_part(text, chr(10), 1) AS title, 'https://' || source || '.example/' || CAST(d.doc_id % 900 AS VARCHAR) AS url, 1700000000 + (d.doc_id * 7919) % 864000 AS epoch,
           CASE WHEN toxic = 1 THEN -0.6::DOUBLE WHEN quality = 1 THEN 0.4 WHEN quality = 0 THEN 0.0 END AS score,
           CASE WHEN toxic = 1 THEN 'bearish' WHEN quality = 1 THEN 'bullish' ELSE 'neutral' END AS sentiment
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
define("t_filings", """
    SELECT event_id, 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS ticker, 'person' || CAST(user_id AS VARCHAR) AS name,
           CASE event_type WHEN 'purchase' THEN 'P' WHEN 'signup' THEN 'S' WHEN 'click' THEN 'M' ELSE 'G' END AS code, value AS change, CAST(ts AS DATE) AS d FROM events""")
define("t_options", """
    SELECT p_brand AS ticker, CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS kind, p_retailprice AS strike, p_size / 4 AS last, p_size / 5 AS bid, p_size / 3 AS ask, p_size / 100 AS iv,
           p_partkey % 500 AS oi, p_partkey AS ord FROM part""")
define("t_levels", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END, event_id) AS level FROM (
        SELECT user_id % 20 AS ticker, CASE event_type WHEN 'view' THEN 'bid' WHEN 'click' THEN 'ask' END AS side, CASE event_type WHEN 'view' THEN 100 - value / 100 ELSE 100.5 + value / 100 END AS price,
               event_id % 97 + 1 AS volume, event_id FROM events WHERE event_type IN ('view', 'click'))) WHERE level <= 10""")
define("t_eq0", """
    SELECT c_mktsegment AS book, CAST(date_trunc('month', o_orderdate) AS DATE) AS d, sum(CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END) AS flow, sum(o_totalprice) AS total
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""")
define("t_eq", "SELECT book, d, cost * (1 + (month(d) % 5 - 2) / 100) + total * 0.1 AS value, cost FROM (SELECT *, sum(flow) OVER (PARTITION BY book ORDER BY d) AS cost FROM t_eq0)")
