"""Known answers of the operators, on literal rows."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric, text
from tidemark.operators import candles, fundamentals, indicators, markets, portfolio, signals
from tidemark.sources import files


def bars_of(spark, closes, opens=None, highs=None, lows=None, ticker="X"):
    opens, highs, lows = opens or closes, highs or [c + 1 for c in closes], lows or [c - 1 for c in closes]
    rows = [(ticker, date(2020, 1, 1) + timedelta(i), float(o), float(h), float(low), float(c), 1000.0) for i, (o, h, low, c) in enumerate(zip(opens, highs, lows, closes))]
    return spark.createDataFrame(rows, "ticker string, d date, o double, h double, l double, c double, v double")


def one(df):
    return df.collect()[0]


def test_sma_and_rsi(spark):
    r = one(spark.range(1).select(indicators.rsi(F.array(*[F.lit(float(i)) for i in range(1, 40)])).alias("up"), indicators.rsi(F.array(*[F.lit(float(i % 2)) for i in range(40)])).alias("mixed"), indicators.rsi(F.array(F.lit(1.0))).alias("none")))
    assert r["up"] == 100 and abs(r["mixed"] - 50) < 5 and r["none"] is None
    rolled = indicators.rolling(bars_of(spark, range(1, 26))).orderBy(F.desc("d"))
    assert one(rolled)["sma20"] == sum(range(6, 26)) / 20 and one(rolled)["sma50"] is None


def test_macd_matches_a_loop(spark):
    rng = random.Random(42)
    x = [100.0]
    for _ in range(259):
        x.append(x[-1] * (1 + rng.uniform(-0.03, 0.032)))

    def ema_series(values, n):
        out = [sum(values[:n]) / n]
        for v in values[n:]:
            out.append(v * 2 / (n + 1) + out[-1] * (1 - 2 / (n + 1)))
        return out

    fast, slow = ema_series(x, 12), ema_series(x, 26)
    line = [a - b for a, b in zip(fast[-len(slow):], slow)]
    signal = ema_series(line, 9)
    got = one(spark.range(1).select(indicators.macd(F.array(*[F.lit(v) for v in x])).alias("m")))["m"]
    assert got["macd"] == pytest.approx(line[-1]) and got["signal"] == pytest.approx(signal[-1])


def test_no_look_ahead(spark):
    closes = [100 + (i * 7) % 13 for i in range(60)]
    before = {r["d"]: r for r in indicators.rolling(candles.patterns(bars_of(spark, closes))).collect()}
    after = {r["d"]: r for r in indicators.rolling(candles.patterns(bars_of(spark, closes[:50] + [999] * 10))).collect()}
    for d in sorted(before)[:50]:
        assert [before[d][c] for c in ("sma20", "atr14", "patterns", "ret")] == [after[d][c] for c in ("sma20", "atr14", "patterns", "ret")]


def test_candles(spark):
    down = [110, 108, 106, 104, 102, 100, 98]
    opens, closes = [c + 1 for c in down] + [97.5], down + [99.5]
    got = candles.patterns(bars_of(spark, closes, opens, [max(o, c) + 0.2 for o, c in zip(opens, closes)], [min(o, c) - 0.2 for o, c in zip(opens, closes)])).orderBy(F.desc("d"))
    assert "bullish_engulfing" in one(got)["patterns"]
    assert candles.patterns(bars_of(spark, [1, 2, 3])).where(F.size("patterns") > 0).count() == 0


def test_weekly_trend(spark):
    assert one(indicators.weekly_trend(bars_of(spark, range(100, 400))))["trend"] == "Uptrend"
    assert one(indicators.weekly_trend(bars_of(spark, range(10))))["trend"] == "Data unavailable"


def test_portfolio_numbers(spark):
    w = spark.createDataFrame([("b", "AAA", 0.5), ("b", "BBB", 0.3), ("b", "CCC", 0.2)], "book string, ticker string, weight double")
    r = one(portfolio.concentration(w, "book"))
    assert r["hhi"] == pytest.approx(0.38) and r["top"] == 0.5
    h = spark.createDataFrame([("a", "X", 10.0, 55.0, "USD"), ("a", "Y", 8.0, 26.0, "USD"), ("a", "Z", 100.0, 5.0, "SGD"), ("a", "NOQ", 1.0, 1.0, "USD")], "account string, ticker string, quantity double, cost_price double, currency string")
    q = spark.createDataFrame([("X", 60.0, 1.0), ("Y", 25.0, -2.0), ("Z", 4.0, None)], "ticker string, price double, change_pct double")
    fx = spark.createDataFrame([("USD", 1.0), ("SGD", 0.75)], "ccy string, usd_per double")
    s = one(portfolio.summary(portfolio.valued(h, q, fx)))
    assert s["value"] == pytest.approx(600 + 200 + 300) and s["day"] == pytest.approx(6 - 4)
    assert [r["ticker"] for r in portfolio.unquoted(h, q).collect()] == ["NOQ"]


def test_beta_of_the_benchmark_is_one(spark):
    rows = [("B", i, math.sin(i) / 100) for i in range(1, 80)]
    r = spark.createDataFrame(rows, "ticker string, rn_desc int, r double")
    assert one(portfolio.beta(r, r.select("rn_desc", F.col("r").alias("b"))))["beta"] == pytest.approx(1)


@pytest.mark.parametrize(("flows", "rate"), [([(0, -1000), (365, 2000)], 1.0), ([(0, -1000), (365, 1000)], 0.0), ([(0, -1000), (365, 1100)], 0.1), ([(0, 1000), (365, -1100)], 0.1)])
def test_xirr(spark, flows, rate):
    df = spark.createDataFrame([("b", date(2020, 1, 1) + timedelta(d), float(a)) for d, a in flows], "book string, d date, amount double")
    assert one(portfolio.xirr(df))["rate"] == pytest.approx(rate, abs=1e-6)


def test_xirr_without_a_root(spark):
    df = spark.createDataFrame([("b", date(2020, 1, 1), -1.0), ("b", date(2021, 1, 1), -1.0), ("c", date(2020, 1, 1), -1.0)], "book string, d date, amount double")
    assert portfolio.xirr(df).count() == 0


def test_black_scholes(spark):
    rows = spark.createDataFrame([(100.0, 100.0, 1.0, 0.05, 0.2, "call"), (100.0, 100.0, 1.0, 0.05, 0.2, "put"), (100.0, 90.0, 0.0, 0.05, 0.2, "call")], "s double, k double, t double, r double, sigma double, kind string")
    assert [r["price"] for r in markets.black_scholes(rows).collect()] == [pytest.approx(10.4506, abs=1e-4), pytest.approx(5.5735, abs=1e-4), 10.0]


def test_order_book(spark):
    rows = [("X", "bid", 1, 100.0, 800), ("X", "bid", 2, 99.9, 500), ("X", "ask", 1, 100.2, 400), ("X", "ask", 2, 100.3, 300)]
    r = one(markets.depth(spark.createDataFrame(rows, "ticker string, side string, level int, price double, volume long")))
    assert (round(r["spread"], 4), r["bid_depth"], r["ask_depth"], round(r["imbalance"], 2)) == (0.2, 1300, 700, 0.65)


def test_size_tiers(spark):
    rows = spark.createDataFrame([("high", 2.0), ("high", 1.0), ("medium", 2.5), ("medium", 1.0), ("low", 5.0), ("high", None)], "c string, rr double")
    assert [r[0] for r in rows.select(signals.size_tier(F.col("c"), F.col("rr"))).collect()] == ["Full", "Half", "Half", "Starter", "Pass", "Half"]


def test_composite_reweights(spark):
    rows = spark.createDataFrame([(80.0, 70.0, 80.0, 0.0), (60.0, None, None, None)], "technical double, fundamental double, news double, risk double")
    a, b = signals.composite(rows).collect()
    assert a["composite"] == pytest.approx(0.45 * 80 + 0.25 * 70 + 0.15 * 80) and a["conviction"] == "high"
    assert b["composite"] == pytest.approx(60) and b["conviction"] == "low"


def test_f_score_of_an_improving_firm(spark):
    new = dict(ticker="X", y=2021, revenue=1200.0, cogs=600.0, net_income=150.0, cfo=200.0, capex=-20.0, shares=100.0, total_assets=1000.0, total_debt=200.0, current_assets=400.0, current_liabilities=200.0)
    old = new | dict(y=2020, revenue=1000.0, cogs=600.0, net_income=100.0, total_debt=300.0, current_assets=300.0)
    r = one(fundamentals.f_score(fundamentals.years_beside(spark.createDataFrame([new, old]))))
    assert r["score"] == 9 and r["known"] == 9
    bank = [x | dict(cogs=None, current_assets=None) for x in (new, old)]
    schema = ", ".join(f"{k} {'string' if k == 'ticker' else 'int' if k == 'y' else 'double'}" for k in new)
    assert one(fundamentals.f_score(fundamentals.years_beside(spark.createDataFrame([tuple(b.values()) for b in bank], schema))))["known"] == 7


def test_as_of_takes_what_was_known(spark):
    left = spark.createDataFrame([("k", date(2020, 2, 15)), ("k", date(2020, 3, 1)), ("k", date(2020, 1, 1))], "k string, t date")
    right = spark.createDataFrame([("k", date(2020, 1, 1), 1.0), ("k", date(2020, 1, 16), 2.0)], "k string, known date, v double")
    got = {r["t"]: r["v"] for r in markets.as_of(left, right, "k", "t", "known", "v", 45).collect()}
    assert got == {date(2020, 2, 15): 1.0, date(2020, 3, 1): 2.0, date(2020, 1, 1): None}


def test_numbers_and_bands(spark):
    rows = spark.createDataFrame([("1.5",), ("Infinity",), ("NaN",), ("NM",), (None,)], "x string")
    assert [r[0] for r in rows.select(numeric.number(F.col("x"))).collect()] == [1.5, None, None, None, None]
    r = one(spark.range(1).select(numeric.cap_score(F.lit(0.3), 0.2, 0.2).alias("a"), numeric.band_score(F.lit(1.3), 0.7, 1.05, 0.5).alias("b"), numeric.clamp(F.lit(None).cast("int"), 0, 1).alias("c")))
    assert r["a"] == pytest.approx(50) and r["b"] == pytest.approx(50) and r["c"] is None


def test_text_helpers(spark):
    r = one(spark.range(1).select(text.us_ticker(F.lit(" brk.b ")).alias("us"), text.hk_ticker(F.lit("01810")).alias("hk"), text.sg_ticker(F.lit("SGX: D05")).alias("sg"), text.resolve(F.lit("apple"), {"APPLE": "AAPL"}).alias("alias"), text.tolerant_json(F.lit('so {"a": 1} it')).alias("j")))
    assert (r["us"], r["hk"], r["sg"], r["alias"], r["j"]) == ("BRK-B", "1810.HK", "D05.SI", "AAPL", '{"a": 1}')


def test_price_csv_and_portfolio_markdown(spark, tmp_path):
    (tmp_path / "abc.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-01,1,2,0.5,1.5,10\n2020-01-02,1,2,0.5,,10\n2020-01-03,1,2,0.5,1.7,\n")
    got = files.price_csv(spark, str(tmp_path / "*.csv"), 2).orderBy("d").collect()
    assert [(r["ticker"], r["c"], r["v"]) for r in got] == [("abc", 1.5, 10.0), ("abc", 1.7, 0.0)]
    (tmp_path / "book.md").write_text("# Holdings (SGD)\n| Company | Ticker | Qty | Cost |\n|---|---|---|---|\n| **DBS** | D05 | 1,000 | 30.5 |\n| Total | | 1,000 | 30,500 |\n## Other USD\n| Apple | AAPL | 5 | 100 |\n")
    got = {r["ticker"]: (r["quantity"], r["cost_price"], r["currency"]) for r in files.portfolio_markdown(spark, str(tmp_path / "book.md")).collect()}
    assert got == {"D05": (1000.0, 30.5, "SGD"), "AAPL": (5.0, 100.0, "USD")}


def test_upsert_last_wins(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "k string, v int, seq int")
    assert {r["k"]: r["v"] for r in files.upsert(old, new, "k").collect()} == {"a": 1, "b": 4, "c": 5}


def test_ledger_states(spark):
    rows = [("buy", 121.0, 120.0, 90.0, 5), ("buy", 89.0, 120.0, 90.0, 5), ("buy", 100.0, 120.0, 90.0, 91), ("sell", 130.0, 120.0, 90.0, 91), ("buy", 100.0, 120.0, 90.0, 5)]
    df = spark.createDataFrame(rows, "action string, price double, target double, stop double, age int")
    assert [r["status"] for r in markets.score_ledger(df).collect()] == ["target", "stopped", "expired", "expired", "open"]


def test_max_pain_equals_the_full_comparison(spark):
    rng = random.Random(1)
    rows = [("X", rng.choice(["call", "put"]), float(rng.randint(80, 120)), rng.randint(0, 50)) for _ in range(60)]
    strikes = sorted({r[2] for r in rows})
    pain = {s: sum(oi * (max(s - k, 0) if kind == "call" else max(k - s, 0)) for _, kind, k, oi in rows) for s in strikes}
    got = one(markets.max_pain(spark.createDataFrame(rows, "ticker string, kind string, strike double, oi long")))
    assert got["strike"] == min(strikes, key=lambda s: (pain[s], s)) and got["pain"] == pytest.approx(min(pain.values()))


def test_json_sources(spark, tmp_path):
    import json

    n = 6
    bars = {"ticker": "X", "timestamps": [86_400 * i for i in range(n)], "opens": [1.0] * n, "highs": [2.0] * n, "lows": [0.5] * n, "closes": [1.0, None, 1.2, 1.3, 1.4, 1.5], "volumes": [10.0] * n}
    short = bars | {"ticker": "Y", "closes": [1.0, None, None, 1.3, 1.4, 1.5]}
    for b in (bars, short):
        (tmp_path / f"bars-{b['ticker']}.json").write_text(json.dumps(b))
    got = files.json_bars(spark, str(tmp_path / "bars-*.json")).collect()
    assert {r["ticker"] for r in got} == {"X"} and len(got) == 5
    article = {"title": "T", "url": "u", "time_published": "20240102T030405", "summary": "s" * 400, "ticker_sentiment": [{"ticker": "X", "ticker_sentiment_score": "0.4", "ticker_sentiment_label": "Somewhat-Bullish"}]}
    (tmp_path / "news.json").write_text(json.dumps(article) + "\n" + json.dumps(article | {"title": ""}))
    r = one(files.news_json(spark, str(tmp_path / "news.json"), "X"))
    assert (r["score"], r["sentiment"], len(r["summary"]), str(r["published"])) == (0.4, "bullish", 300, "2024-01-02 03:04:05")
    (tmp_path / "senate.json").write_text(json.dumps([{"senator": "A", "ticker": "x", "type": "buy", "transaction_date": "01/15/2024"}]))
    (tmp_path / "house.json").write_text(json.dumps([{"representative": "B", "ticker": "Y", "type": "sell", "transaction_date": "2024-01-16"}, {"representative": "C", "ticker": "Z", "type": "sell", "transaction_date": "soon"}]))
    got = {r["person"]: (r["chamber"], r["ticker"], str(r["d"])) for r in files.disclosures(spark, str(tmp_path / "senate.json"), str(tmp_path / "house.json")).collect()}
    assert got == {"A": ("senate", "X", "2024-01-15"), "B": ("house", "Y", "2024-01-16"), "C": ("house", "Z", "None")}
    (tmp_path / "external.json").write_text(json.dumps({"holdings": {"AAA": {"quantity": 2, "cost_price": 3.5, "currency": "USD"}}}))
    assert one(files.external_holdings(spark, str(tmp_path / "external.json"))).asDict() == {"ticker": "AAA", "quantity": 2.0, "cost_price": 3.5, "currency": "USD"}
    (tmp_path / "series.csv").write_text("DATE,X\n2020-01-01,1.5\n2020-02-01,.\n2020-03-01,2.5\n")
    assert [r["value"] for r in files.series_csv(spark, str(tmp_path / "series.csv"), 1).collect()] == [2.5]


def test_report_sink(spark, tmp_path):
    df = spark.createDataFrame([("X", 1)], "ticker string, score int")
    for run in ("r1", "r2"):
        files.write_report(df, str(tmp_path / "reports"), run)
    assert {r["run_id"] for r in spark.read.json(str(tmp_path / "reports")).collect()} == {"r1", "r2"}


def test_stream_into_table(spark, tmp_path):
    from tidemark.streaming import events

    query = events.into_table(events.read(spark, "/root/testdata/sf0.001"), str(tmp_path / "out"), str(tmp_path / "check"), "event_id")
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000


def test_streams_read_a_folder_of_part_files_in_batches(spark, tmp_path):
    import datetime
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidemark.plans import catalog

    (tmp_path / "events.parquet").mkdir()
    kind = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    for i in range(25):
        # Four batches, ten days apart. User 1 is in the first and in the last one only, when its state is long gone.
        ts = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=10 * (i // 8))
        rows = [{"event_id": 2 * i + j, "ts": ts, "user_id": u, "event_type": "view", "value": 1.5, "props": "{}"} for j, u in enumerate([2, 1] if i in (0, 1, 24) else [2])]
        pq.write_table(pa.Table.from_pylist(rows, kind), tmp_path / "events.parquet" / f"part-{i:05d}.parquet")
        os.utime(tmp_path / "events.parquet" / f"part-{i:05d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    collected = lambda name: sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))
    assert collected("stm01_state_with_ttl") == [(1, 3, 4.5), (2, 25, 37.5)]
    assert collected("stm_deduplication") == [("view", 28)]
    assert collected("stm_session_windows") == [(1, 2, 3), (2, 4, 25)]
    assert [r[1:] for r in collected("stm_tumbling_windows")] == [("view", 10, 15.0), ("view", 8, 12.0), ("view", 8, 12.0), ("view", 2, 3.0)]
    assert sorted(r[1] for r in collected("stm_sliding_windows")) == [2, 2, 8, 8, 8, 8, 10, 10]


def test_minimum_variance_respects_the_cap(spark):
    rng = random.Random(4)
    rows = [(f"T{k}", i, rng.gauss(0, 0.01 * (k + 1))) for k in range(6) for i in range(1, 121)]
    got = {r["ticker"]: r["weight"] for r in portfolio.minimum_variance(spark.createDataFrame(rows, "ticker string, rn_desc int, r double")).collect()}
    assert sum(got.values()) == pytest.approx(1) and max(got.values()) <= 0.3 + 1e-9 and got["T0"] > got["T5"]
    assert portfolio.minimum_variance(spark.createDataFrame(rows[:240], "ticker string, rn_desc int, r double")).count() == 0


def test_clusters_are_greedy(spark):
    book = spark.createDataFrame([(t, 0.2) for t in "ABCDE"], "ticker string, weight double")
    corr = spark.createDataFrame([("A", "B", 0.9), ("A", "C", 0.85), ("A", "D", 0.8), ("D", "E", 0.9)], "a string, b string, corr double")
    got = portfolio.clusters(book, corr).collect()
    assert [(r["seed"], r["names"]) for r in got] == [("A", "A,B,C,D")] and got[0]["weight"] == pytest.approx(0.8)


def test_html_escape(spark):
    rows = spark.createDataFrame([("a < b & \"c\" > 'd'",), ("",), (None,)], "t string").select(text.html_escaped(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["a &lt; b &amp; &quot;c&quot; &gt; &#x27;d&#x27;", "", None]


def test_xirr_beyond_a_thousandfold(spark):
    df = spark.createDataFrame([("b", date(2020, 1, 1), -100.0), ("b", date(2020, 1, 22), 160.0)], "book string, d date, amount double")
    assert one(portfolio.xirr(df))["rate"] == pytest.approx(1.6 ** (365 / 21) - 1, rel=1e-6)
