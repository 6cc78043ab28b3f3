"""More known answers: strategies, repeats in order, health, close pairs, running averages, the normal distribution, stores."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from test_known_answers import bars_of, one

from tidemark.operators import backtest, indicators, markets, portfolio, strategies
from tidemark.sources import files


def test_every_strategy_speaks_both_ways(spark):
    kind = "ticker string, c double, v double, sma50 double, sma200 double, rsi14 double, macd_hist double, trend string, bb_upper double, bb_lower double, avg_volume_20 double, pe_ttm double, rev_yoy double"
    rows = [
        ("UP", 110.0, 300.0, 100.0, 90.0, 25.0, 1.0, "Uptrend", 105.0, 80.0, 100.0, 15.0, 0.2),
        ("DOWN", 70.0, 300.0, 80.0, 90.0, 75.0, -1.0, "Downtrend", 105.0, 80.0, 100.0, 50.0, 0.0),
        ("FLAT", 95.0, 100.0, None, 90.0, 50.0, None, "Flat", 105.0, 80.0, 100.0, 30.0, 0.0),
        ("NONE", 95.0, 100.0, None, None, None, None, "Data unavailable", None, None, None, None, None),
    ]
    got = {(r["ticker"], r["strategy"]): (r["stance"], r["score"]) for r in strategies.verdicts(spark.createDataFrame(rows, kind)).collect()}
    bull = {"MA Crossover": 40, "RSI Reversion": 35, "MACD Momentum": 30, "Trend Following": 45, "Bollinger Breakout": 30, "Volume Surge": 25, "Value + Quality": 35}
    bear = {"MA Crossover": -40, "RSI Reversion": -35, "MACD Momentum": -30, "Trend Following": -45, "Bollinger Breakout": -30, "Volume Surge": -25, "Value + Quality": -25}
    assert got == {("UP", s): ("bullish", x) for s, x in bull.items()} | {("DOWN", s): ("bearish", x) for s, x in bear.items()} | {("FLAT", "Trend Following"): ("bullish", 20)}


def articles(spark, rows):
    return spark.createDataFrame([(i, t, title, url, 1000 - i, "neutral") for i, (t, title, url) in enumerate(rows)], "doc_id long, ticker string, title string, url string, epoch long, sentiment string")


def test_a_dropped_article_does_not_count_as_seen(spark):
    rows = [("A", "t1", "u1"), ("A", "t1", "u2"), ("A", "t3", "u2"), ("A", "T3", "u4"), ("A", "t5", ""), ("A", "t5", "u6"), ("B", "x" * 80 + "1", "u7"), ("B", "x" * 80 + "2", "u8"), ("B", None, "u9"), ("B", "", "u10")]
    assert sorted(r["doc_id"] for r in markets.without_repeats(articles(spark, rows)).collect()) == [0, 2, 5, 6, 8]
    assert markets.without_repeats(articles(spark, rows[:1]).limit(0)).count() == 0


def test_repeats_as_a_fold_in_order(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ABC"), f"t{rng.randint(0, 60)}", f"u{rng.randint(0, 60)}") for _ in range(400)]
    urls, titles, kept = set(), set(), []
    for i, (_, title, url) in sorted(enumerate(rows), key=lambda x: (x[1][0], x[0])):
        if url not in urls and title not in titles:
            urls.add(url)
            titles.add(title)
            kept.append(i)
    assert sorted(r["doc_id"] for r in markets.without_repeats(articles(spark, rows)).collect()) == sorted(kept)


def positions(spark, rows):
    return spark.createDataFrame([("b", *r) for r in rows], "book string, ticker string, weight double, sector string, sleeve string, fund_score int")


def test_a_concentrated_book(spark):
    held = positions(spark, [("BIG", 0.5, "Technology", "core", 30), ("MID", 0.3, "Technology", "speculative", 80), ("ODD", 0.2, None, None, None)])
    beta = spark.createDataFrame([("b", 1.3)], "book string, beta double")
    groups = spark.createDataFrame([("b", "BIG", "BIG,MID", 0.8)], "book string, seed string, names string, weight double")
    inputs = portfolio.health_inputs(held, beta, groups)
    got = {r["dimension"]: r["score"] for r in portfolio.health_dimensions(inputs).collect()}
    assert got["concentration"] == 0 and got["sector_balance"] == 0 and got["correlation"] == 0 and got["risk_posture"] == pytest.approx(50)
    # core 0.5 is within, ballast 0 is 0.1 under, tactical 0 within, speculative 0.3 is 0.2 over.
    assert got["sleeve_discipline"] == pytest.approx((100 + 50 + 100 + 0) / 4, abs=0.1)
    assert got["quality"] == pytest.approx((0.5 * 30 + 0.3 * 80) / 0.8, abs=0.1)
    whole = [r for r in portfolio.health_dimensions(inputs).collect() if r["dimension"] == "composite"][0]
    assert whole["grade"] == "F" and whole["score"] == pytest.approx(sum(got[d] for d in got if d != "composite") / 6, abs=0.1)
    advice = {(r["priority"], r["action"], r["target"]) for r in portfolio.health_recommendations(inputs, held).collect()}
    assert advice == {
        ("high", "trim", "BIG"), ("medium", "diversify", None), ("high", "reduce_sector", "Technology"), ("medium", "add_defensive", "Consumer Defensive,Healthcare,Utilities,Cash & Equivalents"),
        ("medium", "reduce_beta", None), ("high", "break_cluster", "BIG,MID"), ("high", "reduce_sleeve", "speculative"), ("medium", "increase_sleeve", "ballast"), ("high", "review_holding", "BIG"),
    }


def test_a_well_built_book(spark):
    sectors = ("Consumer Defensive", "Healthcare", "Technology", "Energy", "Financial Services")
    sleeves = ("core", "core", "core", "ballast", "tactical")
    held = positions(spark, [(f"T{i}", 0.05, sectors[i % 5], sleeves[i % 5], 90) for i in range(20)])
    beta = spark.createDataFrame([("b", 0.9)], "book string, beta double")
    inputs = portfolio.health_inputs(held, beta, None)
    got = {r["dimension"]: (r["score"], r["grade"]) for r in portfolio.health_dimensions(inputs).collect()}
    assert got["correlation"] == (None, None) and got["composite"] == (98.0, "A")
    assert portfolio.health_recommendations(inputs, held).count() == 0


def test_close_pairs(spark):
    corr = spark.createDataFrame([("A", "B", 0.9), ("B", "C", 0.8), ("D", "E", 0.81)], "a string, b string, corr double")
    assert sorted(r["ticker"] for r in portfolio.in_close_pairs(corr).collect()) == ["A", "B", "D", "E"]


def test_clusters_of_several_books(spark):
    book = spark.createDataFrame([("x", "A", 0.5), ("x", "C", 0.5), ("y", "A", 0.2), ("y", "B", 0.3), ("y", "C", 0.5), ("z", "A", 1.0)], "book string, ticker string, weight double")
    corr = spark.createDataFrame([("A", "B", 0.9), ("A", "C", 0.6), ("B", "C", 0.9)], "a string, b string, corr double")
    assert [tuple(r) for r in portfolio.clusters(book, corr).collect()] == [("y", "A", "A,B", 0.5)]


def test_shrunk_covariance_by_hand(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.02, (80, 4)) + rng.normal(0, 0.01, (80, 1))
    rows = [("b", f"T{k}", 80 - i, float(x[i, k])) for i in range(80) for k in range(4)] + [("b", "SHORT", i, 0.5) for i in range(1, 20)]
    y = x - x.mean(axis=0)
    s = y.T @ y / 80
    mu = np.trace(s) / 4
    spread = ((s - mu * np.eye(4)) ** 2).sum()
    shrink = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in y) / 80**2, spread) / spread
    wanted = (1 - shrink) * s + shrink * mu * np.eye(4)
    got = {(r["a"], r["b"]): r["cov"] for r in portfolio.shrunk_covariance(spark.createDataFrame(rows, "book string, ticker string, rn_desc int, r double")).collect()}
    assert got == {(f"T{i}", f"T{j}"): pytest.approx(wanted[i, j]) for i in range(4) for j in range(4)}


def test_wilder_over_many_blocks_is_the_loop(spark):
    rng = random.Random(9)
    closes = [100.0]
    for _ in range(2600):
        closes.append(max(1.0, closes[-1] + rng.gauss(0, 1)))
    got = {r["bar"]: r["rsi14"] for r in indicators.rsi_series(bars_of(spark, closes)).collect()}
    moves = [b - a for a, b in zip(closes, closes[1:])]
    g, low = sum(max(m, 0) for m in moves[:14]) / 14, sum(max(-m, 0) for m in moves[:14]) / 14
    wanted = {15: 100 - 100 / (1 + g / low)}
    for i, m in enumerate(moves[14:], 16):
        g, low = (g * 13 + max(m, 0)) / 14, (low * 13 + max(-m, 0)) / 14
        wanted[i] = 100 - 100 / (1 + g / low)
    assert all(got[i] == pytest.approx(x, rel=1e-9) for i, x in wanted.items()) and len(wanted) == 2587
    rising = {r["bar"]: r["rsi14"] for r in indicators.rsi_series(bars_of(spark, range(1, 40))).collect()}
    assert rising[15] == rising[39] == 100


def test_weekly_closes_of_an_array(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(0, 40, 3)]
    rows = spark.createDataFrame([([(d, float(i)) for i, d in enumerate(days)],)], "a array<struct<d: date, c: double>>")
    last = {}
    for i, d in enumerate(days):
        last[d.isocalendar()[:2]] = float(i)
    assert one(rows.select(indicators.week_ends(F.col("a")).alias("x")))["x"] == list(last.values())


def test_normal_distribution_and_greeks(spark):
    x = [-40.0, -8.0, -3.3, -1.0, 0.0, 0.5, 2.0, 7.2, 40.0]
    got = [r["p"] for r in spark.createDataFrame([(v,) for v in x], "x double").select("x", markets.normal(F.col("x")).alias("p")).orderBy("x").collect()]
    assert got == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in x], abs=1e-14)
    rows = spark.createDataFrame([("call", 100.0, 100.0, 1.0, 0.05, 0.2), ("put", 100.0, 100.0, 1.0, 0.05, 0.2), ("put", 90.0, 100.0, 0.0, 0.05, 0.2)], "kind string, s double, k double, t double, r double, sigma double")
    call, put, over = markets.black_scholes(rows).collect()
    assert [call[c] for c in ("delta", "gamma", "vega", "theta", "rho")] == pytest.approx([0.636831, 0.018762, 37.524035, -6.414028, 53.232482], abs=1e-5)
    assert [put[c] for c in ("delta", "gamma", "vega", "theta", "rho")] == pytest.approx([-0.363169, 0.018762, 37.524035, -1.657880, -41.890461], abs=1e-5)
    assert [over[c] for c in ("price", "delta", "gamma", "vega", "theta", "rho")] == [10, 0, 0, 0, 0, 0]


def test_events_are_the_sampled_bars(spark):
    rolled = indicators.rolling(bars_of(spark, [100 + (i * 7) % 13 for i in range(300)]))
    got = {r["bar"]: r for r in backtest.events(rolled).collect()}
    assert sorted(got) == list(range(200, 241, 5))
    closes = [100 + (i * 7) % 13 for i in range(300)]
    for b, r in got.items():
        assert r["fwd20"] == pytest.approx(closes[b + 19] / closes[b - 1] - 1) and r["fwd60"] == pytest.approx(closes[b + 59] / closes[b - 1] - 1)
        lows = [c - 1 for c in closes[b : b + 60]]
        assert r["si"] == next((i for i, x in enumerate(lows, 1) if x <= r["stop"]), 0)
    assert backtest.events(indicators.rolling(bars_of(spark, range(1, 250)))).count() == 0


def test_report_index(spark, tmp_path):
    df = spark.createDataFrame([("X", 1.0), ("Y", 2.0)], "ticker string, price double")
    for run, rows in (("r1", df), ("r2", df.limit(1))):
        files.write_report(rows, str(tmp_path / "store"), run)
    lines = files.reports(spark, str(tmp_path / "store"), "ticker string, price double")
    assert sorted(map(tuple, files.report_index(lines).collect())) == [("r1", 2, 2), ("r2", 1, 1)]


def test_clusters_of_many_books(spark):
    """Against the plain fold; a task takes books by the batch, so the groups of many come from few calls of Python."""
    rng, names = random.Random(9), [f"N{i:02d}" for i in range(12)]
    close = {(a, b) for a in names for b in names if a < b and rng.random() < 0.3}
    held = {k: {n: rng.randint(1, 9) / 8 for n in rng.sample(names, rng.randint(0, 12))} for k in range(3000)}
    wanted = []
    for k, own in held.items():
        seen = set()
        for seed in sorted(own):
            group = [] if seed in seen else [seed, *(n for n in sorted(own) if n != seed and n not in seen and ((seed, n) in close or (n, seed) in close))]
            if len(group) > 1:
                seen.update(group)
                wanted.append((k, seed, ",".join(group), sum(own[n] for n in group)))
    book = spark.createDataFrame([(k, n, w) for k, own in held.items() for n, w in own.items()], "book long, ticker string, weight double")
    # Pairs come in either order.
    corr = spark.createDataFrame([(a, b, 0.8) if i % 2 else (b, a, 0.8) for i, (a, b) in enumerate(sorted(close))], "a string, b string, corr double")
    found = portfolio.clusters(book, corr)
    assert sorted(tuple(r) for r in found.collect()) == sorted(wanted)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_clusters_of_names_held_twice(spark):
    book = spark.createDataFrame([(None, "A", 0.25), (None, "A", 0.25), (None, "B", 0.5), (2, "A", None), (2, "B", 0.5), (2, None, 0.5), (3, "A", None), (3, "B", None)], "book long, ticker string, weight double")
    corr = spark.createDataFrame([("A", "B", 0.9)], "a string, b string, corr double")
    got = {r["book"]: tuple(r)[1:] for r in portfolio.clusters(book, corr).collect()}
    assert got == {None: ("A", "A,B", 1.0), 2: ("A", "A,B", 0.5), 3: ("A", "A,B", None)}


def test_concentration_of_values(spark):
    """Shares are made on the way: also of a book that owes more than it has, of nulls and of ties; one sort, without the names."""
    rng = random.Random(5)
    books = {"long": [rng.randint(1, 9) for _ in range(30)], "ties": [2] * 9, "few": [1, 3], "short": [5, -7, -9, 2, -4, -1, 1, -8], "gaps": [4, None, 3, None, 2, 1, 1, 1]}
    rows = spark.createDataFrame([(b, f"T{i}", None if v is None else float(v)) for b, values in books.items() for i, v in enumerate(values)], "account string, ticker string, value double")
    found = portfolio.concentration(rows, "account", "value")
    got = {r["account"]: r for r in found.collect()}
    for b, values in books.items():
        known = [v for v in values if v is not None]
        shares = sorted((v / sum(known) for v in known), reverse=True)
        r = got[b]
        assert r["n"] == len(values) and r["hhi"] == pytest.approx(sum(s * s for s in shares)) and r["top"] == pytest.approx(shares[0])
        assert r["top5"] == pytest.approx(sum(shares[:5])) and r["effective_n"] == pytest.approx(1 / r["hhi"])
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 1 and "ticker" not in plan.split("LogicalRDD")[0].split("Scan")[0]


def test_holdings_are_aggregated_once(spark):
    """From the lines to the merged positions in one aggregation, customers joined to the orders."""
    from tidemark.sources import tables

    plan = tables.holdings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
