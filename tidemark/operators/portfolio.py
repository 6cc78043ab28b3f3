"""Books of positions: value, concentration, risk, returns of money and time, health."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import band_score, cap_score
from tidemark.operators.moments import pair_moments

#: Scenario, shock of the market, shock of the other currencies.
SCENARIOS = (("market -20%", -0.20, 0.0), ("USD +5%", 0.0, -0.05), ("risk-off", -0.10, -0.03))
#: What a book is held against.
BETA_TARGET, MAX_UNCLASSIFIED, MIN_DEFENSIVE = (0.70, 1.05), 0.25, 0.15
SLEEVES = {"core": (0.45, 0.75), "ballast": (0.10, 0.35), "tactical": (0.00, 0.25), "speculative": (0.00, 0.10)}
DEFENSIVE = ("Consumer Defensive", "Healthcare", "Utilities", "Cash & Equivalents")
MAX_NAME, MAX_SECTOR, MAX_TOP5, MIN_EFFECTIVE, MAX_CLUSTER, CLUSTER_CORR = 0.20, 0.30, 0.60, 8.0, 0.35, 0.70


def valued(holdings: DataFrame, quotes: DataFrame, fx: DataFrame) -> DataFrame:
    """Holdings with value, cost, P&L and the day's change in USD. Unknown currencies count one to one. Rows without a
    quote go; ``unquoted`` gives them. The rates are a handful of rows."""
    rated = holdings.join(F.broadcast(fx), holdings.currency == fx.ccy, "left").withColumn("rate", F.coalesce("usd_per", F.lit(1.0)))
    out = rated.join(quotes, "ticker").withColumns({"value": F.col("quantity") * F.col("price") * F.col("rate"), "cost": F.col("quantity") * F.col("cost_price") * F.col("rate")})
    return out.withColumns({"pnl": F.col("value") - F.col("cost"), "day": F.col("value") * F.coalesce(F.col("change_pct"), F.lit(0.0)) / 100})


def unquoted(holdings: DataFrame, quotes: DataFrame) -> DataFrame:
    return holdings.join(quotes, "ticker", "left_anti")


def summary(lines: DataFrame) -> DataFrame:
    """Totals per account."""
    return lines.groupBy("account").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.sum("cost").alias("cost"), F.sum("pnl").alias("pnl"), F.sum("day").alias("day"))


def concentration(weights: DataFrame, by: str, value: str | None = None) -> DataFrame:
    """Sum of squared weights, effective number and share of the five largest, per book; with ``value`` weights are the
    shares of that column in its sum over the book. One narrow sort of books and their values serves for all."""
    rows = weights.select(by, F.col(value or "weight").alias("x"))
    w = Window.partitionBy(by).orderBy(F.desc("x"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = rows.withColumn("k", F.row_number().over(w))
    if value:
        ranked = ranked.withColumns({"total": F.sum("x").over(whole), "known": F.count("x").over(whole)})
        # Where the sum is negative the largest weights are those of the smallest values.
        ranked = ranked.select(by, (F.col("x") / F.col("total")).alias("x"), F.when(F.col("total") < 0, F.col("known") - F.col("k") + 1).otherwise(F.col("k")).alias("k"))
    x = F.col("x")
    out = ranked.groupBy(by).agg(F.sum(x * x).alias("hhi"), F.sum(F.when(F.col("k") <= 5, x)).alias("top5"), F.max(x).alias("top"), F.count("*").alias("n"))
    return out.withColumn("effective_n", F.try_divide(F.lit(1.0), F.when(F.col("hhi") != 0, F.col("hhi"))))


def book_returns(book: DataFrame, returns: DataFrame) -> DataFrame:
    """(rn_desc, r) of the book, aligned by place from the end to the shortest series, over the covered weight."""
    covered = book.join(returns.groupBy("ticker").agg(F.max("rn_desc").alias("len")), "ticker")
    bounds = covered.agg(F.min("len").alias("shortest"), F.sum("weight").alias("covered"))
    joined = returns.join(covered.select("ticker", "weight"), "ticker").join(F.broadcast(bounds))  # one line
    return joined.where("rn_desc <= shortest").groupBy("rn_desc").agg((F.sum(F.col("weight") * F.col("r")) / F.max("covered")).alias("r"))


def tail_risk(series: DataFrame) -> DataFrame:
    """Historical 95 % value at risk, the mean beyond it, annual volatility (population), in percent."""
    var = series.agg(F.percentile("r", F.lit(0.05)).alias("var"))
    return series.join(F.broadcast(var)).agg((F.max("var") * 100).alias("var95"), (F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))) * 100).alias("cvar95"), (F.stddev_pop("r") * F.sqrt(F.lit(252.0)) * 100).alias("vol"), F.count("*").alias("n"))


def beta(returns: DataFrame, bench: DataFrame, least: int = 20) -> DataFrame:
    """Slope on the benchmark (rn_desc, b), matched by place from the end; null where the benchmark does not move."""
    out = returns.join(bench, "rn_desc").groupBy("ticker").agg(F.count("*").alias("n"), F.covar_samp("r", "b").alias("cov"), F.var_samp("b").alias("var"))
    return out.where(F.col("n") >= least).select("ticker", "n", F.when(F.col("var") > 0, F.col("cov") / F.col("var")).alias("beta"))


def weekly(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Five returns compounded, counted from the start; a ragged end is dropped. Adds wk_desc."""
    numbered = returns.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rn_desc"))) - 1)
    weeks = numbered.groupBy(*keys, F.floor(F.col("i") / 5).alias("wk")).agg(F.count("*").alias("n"), (F.product(1 + F.col("r")) - 1).alias("r")).where("n = 5")
    return weeks.withColumn("wk_desc", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("wk"))))


def correlations(returns: DataFrame, least: int = 60) -> DataFrame:
    """(a, b, corr, n) of all pairs of names with enough common places, a before b; null where one of the two does not move.

    The sums are those of matrix products, over returns less their name's mean so that nothing cancels.
    """
    mean = F.avg("r").over(Window.partitionBy("ticker"))
    centred = returns.select(F.lit(0).alias("book"), "ticker", F.col("rn_desc").alias("place"), (F.col("r") - mean).alias("x"))
    n = F.col("n")
    spread = lambda c: n * F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}")
    moves = (spread("x") > 1e-24 * n * n) & (spread("y") > 1e-24 * n * n)
    corr = F.when(moves, (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread("x") * spread("y")))
    pairs = pair_moments(centred).where((F.col("a") != F.col("b")) & (n >= least))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), corr.alias("corr"), n.cast("long").alias("n"))


def in_close_pairs(corr: DataFrame, above: float = 0.8) -> DataFrame:
    """(ticker, paired) of the names in a pair that moves together more closely."""
    both = corr.where(F.col("corr") > above).select(F.explode(F.array("a", "b")).alias("ticker"))
    return both.distinct().withColumn("paired", F.lit(True))


def drawdown(series: DataFrame, by: str, order: str) -> DataFrame:
    """Adds equity (compounded), peak and drawdown; the first equity is the first peak."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = series.withColumn("equity", F.exp(F.sum(F.log1p("r")).over(w)))
    return out.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Changes between snapshots of a book: (book, d, r, gap, flow, sale). Deposits are taken out of the return."""
    w = Window.partitionBy("book").orderBy("d")
    prev, paid = F.lag("value").over(w), F.lag("cost").over(w)
    flow = F.col("cost") - paid
    out = snapshots.select("book", "d", (F.try_divide(F.col("value") - prev - flow, prev)).alias("r"), F.datediff("d", F.lag("d").over(w)).alias("gap"), flow.alias("flow"), (flow < -0.005 * prev).alias("sale"), prev.alias("prev"))
    return out.where("prev IS NOT NULL")


def equity_metrics(snapshots: DataFrame) -> DataFrame:
    """Time-weighted return, worst drawdown, Sharpe and Sortino on the observed spacing, per book; periods with a sale are
    left out; fewer than five snapshots or four returns give no line."""
    counted = snapshot_changes(snapshots)
    kept = drawdown(counted.where("NOT sale"), "book", "d")
    stats = kept.groupBy("book").agg(
        F.count("*").alias("n"), F.max_by("equity", "d").alias("last"), F.min("drawdown").alias("dd"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"), F.avg("gap").alias("gap")
    )
    totals = counted.groupBy("book").agg((F.count("*") + 1).alias("n_snapshots"), F.count_if("sale").alias("excluded"))
    ann = F.sqrt(F.lit(365.25) / F.when(F.col("gap") > 0, F.col("gap")).otherwise(1.0))
    out = stats.join(totals, "book").where("n_snapshots >= 5 AND n >= 4")
    return out.select("book", "n_snapshots", ((F.col("last") - 1) * 100).alias("twr_pct"), (F.col("dd") * 100).alias("max_drawdown_pct"), F.when(F.col("sd") > 0, F.col("mean") / F.col("sd") * ann).alias("sharpe"), F.when(F.col("down") > 0, F.col("mean") / F.col("down") * ann).alias("sortino"), "excluded", F.col("gap").alias("mean_gap"))


def flows_from_snapshots(snapshots: DataFrame) -> DataFrame:
    """(book, d, amount): the first value paid in, then changes of cost above half a percent of the value, and the last value
    taken out. Money in is negative."""
    w = Window.partitionBy("book").orderBy("d")
    numbered = snapshots.withColumns({"k": F.row_number().over(w), "step": F.col("cost") - F.lag("cost").over(w), "last": F.lead("d").over(w).isNull()})
    paid = numbered.select("book", "d", F.when(F.col("k") == 1, -F.col("value")).when(F.abs("step") > 0.005 * F.col("value"), -F.col("step")).alias("amount"))
    return paid.where("amount IS NOT NULL").unionByName(numbered.where("last").select("book", "d", F.col("value").alias("amount")))


def xirr(flows: DataFrame, rounds: int = 60) -> DataFrame:
    """(book, rate): the yearly rate at which the flows of a book are worth nothing, by a fold that halves the bracket.

    No line for fewer than two flows, one sign only, no time between them or no change of sign in the bracket.
    """
    packed = flows.where("amount <> 0").groupBy("book").agg(F.array_sort(F.collect_list(F.struct("d", "amount"))).alias("f"))
    dated = packed.withColumn("f", F.transform("f", lambda x: F.struct((F.datediff(x["d"], F.col("f")[0]["d"]) / 365.0).alias("t"), x["amount"].alias("a"))))
    usable = dated.where((F.size("f") >= 2) & F.exists("f", lambda x: x["a"] < 0) & F.exists("f", lambda x: x["a"] > 0) & (F.element_at("f", -1)["t"] > 0))
    worth = lambda r: F.aggregate("f", F.lit(0.0), lambda s, x: s + x["a"] / F.pow(1.0 + r, x["t"]))
    low, high = F.lit(-0.9999999), F.lit(1e6)  # fixed values: the bracket of rates
    usable = usable.withColumns({"lo_sign": F.signum(worth(low)), "hi_sign": F.signum(worth(high))}).where("lo_sign * hi_sign < 0")

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        right = F.signum(worth(mid)) == F.col("lo_sign")
        return F.struct(F.when(right, mid).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(low.alias("lo"), high.alias("hi"))
    return usable.select("book", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2).alias("rate"))


def clusters(book: DataFrame, corr: DataFrame, threshold: float = CLUSTER_CORR) -> DataFrame:
    """Greedy groups of names that move with a seed, seeds in order of the names: (seed, names, weight), largest groups by
    weight; with a column ``book`` (an account, say) for each book apart, and that column first.

    The order matters, so the names of one book are one line: its size is that of a book, not of the data. A name that a book
    holds twice counts with both weights, a weight that is null with none.
    """
    many = "book" in book.columns
    held = book.select(F.col("book") if many else F.lit(0).alias("book"), "ticker", "weight")
    kind = held.schema["book"].dataType.simpleString()
    # A name that comes before a seed and is near it has a group by then, or took the seed into its own: only later ones count.
    later = corr.where(F.col("corr") >= threshold).groupBy(F.least("a", "b").alias("ticker")).agg(F.collect_set(F.greatest("a", "b")).alias("near"))
    names = held.join(later, "ticker", "left").groupBy("book").agg(F.collect_list(F.struct("ticker", "weight", "near")).alias("v"))
    rows = names.select("book", *(F.col(f"v.{c}").alias(c) for c in ("ticker", "weight", "near")))

    def greedy(tickers: list, weights: list, nears: list) -> Iterator[tuple[str, str, float | None]]:
        weight: dict[str, list[float]] = {}
        for t, w in zip(tickers, weights, strict=True):
            weight.setdefault(t, []).extend([] if w is None else [w])
        seen: set[str] = set()
        for seed, near in sorted((t, n) for t, n in zip(tickers, nears, strict=True) if n is not None):
            if seed in seen:
                continue
            group = [seed, *sorted(n for n in near if n in weight and n not in seen and n != seed)]
            if len(group) > 1:
                seen.update(group)
                known = [w for g in group for w in weight[g]]
                yield seed, ",".join(group), sum(known) if known else None

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch holds the books of many accounts, a line each."""
        for batch in batches:
            of, found = [], []
            for i, book in enumerate(zip(*(batch.column(c).to_pylist() for c in ("ticker", "weight", "near")), strict=True)):
                for group in greedy(*book):
                    of.append(i)
                    found.append(group)
            seeds, members, sums = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("book").take(pa.array(of, pa.int64())), pa.array(seeds, pa.string()), pa.array(members, pa.string()), pa.array(sums, pa.float64())], ["book", "seed", "names", "weight"])

    found = rows.mapInArrow(groups, f"book {kind}, seed string, names string, weight double")
    return found if many else found.drop("book")


def shrunk_covariance(returns: DataFrame, least: int = 60) -> DataFrame:
    """(book, a, b, cov): the covariance of the names of each book, shrunk to a scaled identity as far as its noise says.

    ``returns`` has book, ticker, rn_desc and r. Names of fewer than ``least`` returns go; the others are taken to the
    shortest. Products are those of blocks of the matrix; what is left per book are as many lines as it has pairs of names.
    """
    counted = returns.groupBy("book", "ticker").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    shortest = counted.groupBy("book").agg(F.min("n").alias("t"), F.count("*").alias("names")).where("names >= 3")
    used = returns.join(counted.select("book", "ticker"), ["book", "ticker"]).join(shortest, "book").where("rn_desc <= t")
    means = used.groupBy("book", "ticker").agg(F.avg("r").alias("m"))
    x = used.join(means, ["book", "ticker"]).select("book", "ticker", "rn_desc", "t", "names", (F.col("r") - F.col("m")).alias("x"))
    half = pair_moments(x.select("book", "ticker", F.col("rn_desc").alias("place"), "x")).select("book", "a", "b", (F.col("sxy") / F.col("n")).alias("s"))
    raw = half.unionByName(half.where("a <> b").select("book", F.col("b").alias("a"), F.col("a").alias("b"), "s"))
    size = x.groupBy("book", "rn_desc").agg(F.sum(F.col("x") * F.col("x")).alias("q"), F.max("t").alias("t"), F.max("names").alias("names"))
    size = size.groupBy("book").agg((F.sum(F.col("q") * F.col("q")) / F.max("t")).alias("fourth"), F.max("t").alias("t"), F.max("names").alias("names"))
    whole = raw.groupBy("book").agg(F.sum(F.col("s") * F.col("s")).alias("squares"), F.sum(F.when(F.col("a") == F.col("b"), F.col("s")).otherwise(0.0)).alias("trace"))
    mu = F.col("trace") / F.col("names")
    spread = F.col("squares") - F.col("names") * mu * mu
    noise = F.least((F.col("fourth") - F.col("squares")) / F.col("t"), spread)
    amount = size.join(whole, "book").select("book", F.when(spread > 0, noise / spread).otherwise(1.0).alias("shrink"), mu.alias("mu"))
    own = F.when(F.col("a") == F.col("b"), F.col("shrink") * F.col("mu")).otherwise(0.0)
    return raw.join(amount, "book").select("book", "a", "b", ((1 - F.col("shrink")) * F.col("s") + own).alias("cov"))


def minimum_variance(returns: DataFrame, cap: float = 0.3, least: int = 60) -> DataFrame:
    """(ticker, weight): long-only weights of least variance under a cap, from the shrunk covariance; with a column ``book``
    for each book apart, and that column first. For three names at least with enough bars and room under the cap.

    Weights above the cap are set to it and stay there, the others are scaled to the rest. Only the matrix of a book's names
    goes to one task.
    """
    many = "book" in returns.columns
    rows = returns.select(F.col("book") if many else F.lit(0).alias("book"), "ticker", "rn_desc", "r")
    cov = shrunk_covariance(rows, least)

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot(index="a", columns="b", values="cov").sort_index(axis=0).sort_index(axis=1)
        names, n = list(wide.columns), len(wide)
        w = np.maximum(np.linalg.pinv(wide.to_numpy()) @ np.ones(n), 0)
        if w.sum() <= 0 or cap * n < 1:
            return pd.DataFrame({"book": [], "ticker": [], "weight": []})
        w = w / w.sum()
        for _ in range(n):
            over = w > cap + 1e-12
            if not over.any():
                break
            extra = (w[over] - cap).sum()
            w[over] = cap
            room = w < cap - 1e-12
            w[room] += extra * (w[room] / w[room].sum() if w[room].sum() > 0 else 1 / room.sum())
        return pd.DataFrame({"book": key[0], "ticker": names, "weight": w})

    found = cov.groupBy("book").applyInPandas(solve, f"book {rows.schema['book'].dataType.simpleString()}, ticker string, weight double")
    return found if many else found.drop("book")


def health_scores(conc: DataFrame) -> DataFrame:
    """Adds the score of concentration from top, top5 and effective_n."""
    score = F.least(cap_score(F.col("top"), MAX_NAME, 0.20), cap_score(F.col("top5"), MAX_TOP5, 0.25), band_score(F.col("effective_n"), MIN_EFFECTIVE, 100, MIN_EFFECTIVE))
    return conc.withColumn("score", score)


def grade(score: Column) -> Column:
    return F.when(score >= 85, "A").when(score >= 70, "B").when(score >= 55, "C").when(score >= 40, "D").when(score.isNotNull(), "F")


def health_inputs(positions: DataFrame, beta: DataFrame, groups: DataFrame | None) -> DataFrame:
    """One line per book with what its health is judged by, from positions (book, ticker, weight, sector, sleeve,
    fund_score), beta (book, beta) and clusters (book, names, weight); what is not known is null."""
    by = Window.partitionBy("book").orderBy(F.desc("weight"), "ticker")
    ranked = positions.withColumn("k", F.row_number().over(by))
    w, known = F.col("weight"), F.col("fund_score").isNotNull()
    sleeve = [F.sum(F.when(F.col("sleeve") == name, w).otherwise(0.0)).alias(f"sleeve_{name}") for name in SLEEVES]
    base = ranked.groupBy("book").agg(
        F.max(F.when(F.col("k") == 1, F.col("ticker"))).alias("top_name"), F.max("weight").alias("top"), F.sum(F.when(F.col("k") <= 5, w)).alias("top5"), F.try_divide(F.lit(1.0), F.sum(w * w)).alias("effective_n"),
        F.count("sleeve").alias("sleeved"), *sleeve, F.try_divide(F.sum(F.when(known, w * F.col("fund_score"))), F.sum(F.when(known, w))).alias("quality"),
        F.sum(F.when(F.col("sector").isNull(), w).otherwise(0.0)).alias("unclassified"),
    )
    sectors = positions.where("sector IS NOT NULL").groupBy("book", "sector").agg(F.sum("weight").alias("w"))
    largest = F.max_by(F.col("sector"), F.struct(F.col("w"), F.col("sector")))
    light = [F.sum(F.when(F.col("sector") == name, F.col("w")).otherwise(0.0)) for name in DEFENSIVE]
    sectors = sectors.groupBy("book").agg(largest.alias("sector"), F.max("w").alias("sector_weight"), F.array(*light).alias("defensives"))
    out = base.join(sectors, "book", "left").join(beta.select("book", "beta"), "book", "left")
    out = out.withColumn("defensive", F.coalesce(F.aggregate("defensives", F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))
    if groups is None:
        return out.withColumns({"worst": F.lit(None).cast("double"), "worst_names": F.lit(None).cast("string")})
    worst = groups.groupBy("book").agg(F.max("weight").alias("worst"), F.max_by("names", F.struct(F.col("weight"), F.col("names"))).alias("worst_names"))
    return out.join(worst, "book", "left").withColumn("worst", F.coalesce("worst", F.lit(0.0)))


def health_dimensions(inputs: DataFrame) -> DataFrame:
    """(book, dimension, score, grade): the six dimensions, those that cannot be scored without a score, and the mean of the
    others with its grade."""
    least = lambda *parts: F.least(*parts)
    sleeves = sum((band_score(F.col(f"sleeve_{n}"), lo, hi, 0.20) for n, (lo, hi) in SLEEVES.items()), F.lit(0.0)) / len(SLEEVES)
    scores = {
        "concentration": least(cap_score(F.col("top"), MAX_NAME, 0.20), cap_score(F.col("top5"), MAX_TOP5, 0.25), band_score(F.col("effective_n"), MIN_EFFECTIVE, 100, MIN_EFFECTIVE)),
        "sector_balance": least(cap_score(F.coalesce("sector_weight", F.lit(0.0)), MAX_SECTOR, 0.30), cap_score(F.col("unclassified"), MAX_UNCLASSIFIED, 0.40)),
        "sleeve_discipline": F.when(F.col("sleeved") > 0, sleeves), "risk_posture": band_score(F.col("beta"), *BETA_TARGET, 0.50), "quality": F.col("quality"), "correlation": cap_score(F.col("worst"), MAX_CLUSTER, 0.35),
    }
    rows = F.array(*[F.struct(F.lit(name).alias("dimension"), F.bround(score, 1).alias("score")) for name, score in scores.items()])
    there = F.filter(F.transform("rows", lambda r: r["score"]), lambda x: x.isNotNull())
    mean = F.bround(F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there)), 1)
    whole = inputs.select("book", rows.alias("rows")).withColumn("mean", mean)
    composite = F.struct(F.lit("composite").alias("dimension"), F.col("mean").alias("score"))
    lines = whole.select("book", F.explode(F.concat("rows", F.array(composite))).alias("r")).select("book", "r.*")
    return lines.withColumn("grade", F.when(F.col("dimension") == "composite", grade(F.col("score"))))


def health_recommendations(inputs: DataFrame, positions: DataFrame) -> DataFrame:
    """(book, priority, action, target, from, to): what breaks a limit, high before medium before low."""
    def advice(test, priority, action, target, at, to) -> Column:
        line = F.struct((F.lit(priority) if isinstance(priority, str) else priority).alias("priority"), F.lit(action).alias("action"), target.cast("string").alias("target"), at.cast("double").alias("from"), F.lit(to).cast("double").alias("to"))
        return F.when(test, line)

    c, none = F.col, F.lit(None)
    gap = MIN_DEFENSIVE - c("defensive")
    held = F.coalesce("defensives", F.array(*[F.lit(0.0)] * len(DEFENSIVE)))
    pairs = F.arrays_zip(F.transform(held, lambda x: x).alias("w"), F.sequence(F.lit(0), F.lit(len(DEFENSIVE) - 1)).alias("i"))
    names = F.array(*[F.lit(n) for n in DEFENSIVE])
    named = lambda of: F.array_join(F.transform(of, lambda p: F.element_at(names, p["i"] + 1)), ",")
    absent, lightest = F.filter(pairs, lambda p: p["w"] < 0.02), F.slice(F.array_sort(pairs), 1, 2)
    rows = [
        advice(c("top") > MAX_NAME, "high", "trim", c("top_name"), c("top"), MAX_NAME), advice(c("effective_n") < MIN_EFFECTIVE, "medium", "diversify", none, none, None),
        advice(c("sector_weight") > MAX_SECTOR, "high", "reduce_sector", c("sector"), c("sector_weight"), MAX_SECTOR),
        advice(c("defensive") < MIN_DEFENSIVE, F.when(gap > 0.05, "medium").otherwise("low"), "add_defensive", F.when(F.size(absent) > 0, named(absent)).otherwise(named(lightest)), c("defensive"), MIN_DEFENSIVE),
        advice(c("unclassified") > MAX_UNCLASSIFIED, "low", "classify", none, c("unclassified"), None), advice(c("beta") > BETA_TARGET[1], "medium", "reduce_beta", none, c("beta"), BETA_TARGET[1]),
        advice(c("worst") > MAX_CLUSTER, "high", "break_cluster", c("worst_names"), c("worst"), MAX_CLUSTER),
    ]
    for name, (lo, hi) in SLEEVES.items():
        weight = c(f"sleeve_{name}")
        rows.append(advice((c("sleeved") > 0) & (weight > hi), "high" if name == "speculative" else "medium", "reduce_sleeve", F.lit(name), weight, hi))
        rows.append(advice((c("sleeved") > 0) & (weight < lo), "medium", "increase_sleeve", F.lit(name), weight, lo))
    limits = inputs.select("book", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("book", "r.*")
    weak = positions.where("fund_score < 40 AND weight >= 0.05").select("book", F.lit("high").alias("priority"), F.lit("review_holding").alias("action"), F.col("ticker").alias("target"), F.col("weight").alias("from"), F.lit(None).cast("double").alias("to"))
    return limits.unionByName(weak)
