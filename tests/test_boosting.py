"""The booster against one of plain Python loops, its metrics against DuckDB, and what rows in other partitions change: nothing."""

import bisect
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting, ml

UNIT = 1 << 26


def sample(n=260, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.choice([0.0, 1.0, 2.0]), rng.random()
        up = 1.0 if (a > 0.3) ^ (b == 1.0 and c > 0.5) ^ (rng.random() < 0.1) else 0.0
        rows.append((None if i % 7 == 0 else a, float("nan") if i % 11 == 0 and up else b, None if rng.random() < 0.3 * up else c, up, i % 6 == 0, i % 4))
    return rows


SCHEMA = "a double, b double, c double, label double, aside boolean, part int"


def plain_booster(rows, edges, roles, trees, least, depth):
    """Trees as nested tuples (feature, bin, missing left, left, right) or values."""
    bins = lambda r: [None if v is None or v != v else bisect.bisect_left(e, v) for v, e in zip(r[:3], edges)]
    data = [(bins(r), r[3]) for r in rows]
    train = [i for i, x in enumerate(roles) if x == 0]
    aside = [i for i, x in enumerate(roles) if x == 1]
    ones = sum(data[i][1] for i in train)
    base = math.log(ones / (len(train) - ones))
    raw, forest, losses = [base] * len(data), [], []

    def value(g, h):
        return -boosting.STEP * (g / UNIT) / (h / UNIT + 1.0)

    def grow(some, g, h, level):
        total_g, total_h = sum(g[i] for i in some), sum(h[i] for i in some)
        best, score = None, lambda a, b: (a / UNIT) ** 2 / (b / UNIT + 1.0)
        if level < depth:
            for f in range(3):
                lost = [i for i in some if data[i][0][f] is None]
                for side in ((False, True) if lost else (False,)):
                    for b in range(255):
                        left = [i for i in some if (data[i][0][f] is None and side) or (data[i][0][f] is not None and data[i][0][f] <= b)]
                        if min(len(left), len(some) - len(left)) >= least:
                            lg, lh = sum(g[i] for i in left), sum(h[i] for i in left)
                            gain = score(lg, lh) + score(total_g - lg, total_h - lh) - score(total_g, total_h)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = (gain, f, b, side, left)
                        if b > max((e for e in map(len, edges))):
                            break
        if best is None:
            return value(total_g, total_h)
        _, f, b, side, left = best
        return (f, b, side, grow(left, g, h, level + 1), grow(sorted(set(some) - set(left)), g, h, level + 1))

    def said(tree, x):
        while isinstance(tree, tuple):
            f, b, side, left, right = tree
            tree = left if (side if x[f] is None else x[f] <= b) else right
        return tree

    while len(forest) < trees:
        p = [1 / (1 + math.exp(-v)) for v in raw]
        if aside:
            losses.append(sum(-math.log(p[i] if data[i][1] else 1 - p[i]) for i in aside) / len(aside))
            if len(losses) > 10 and not any(v < losses[-11] - 1e-7 for v in losses[-10:]):
                break
        g = [round((q - y) * UNIT) for q, (_, y) in zip(p, data)]
        h = [round(q * (1 - q) * UNIT) for q in p]
        forest.append(grow(train, g, h, 0))
        raw = [v + said(forest[-1], x) for v, (x, _) in zip(raw, data)]
    return base, forest, [1 / (1 + math.exp(-v)) for v in raw]


def nested(tree, k=0):
    n = tree[k]
    return (n.feature, n.bin, n.missing_left, nested(tree, n.left), nested(tree, n.right)) if n.feature >= 0 else n.value


def same(a, b):
    if isinstance(a, tuple) or isinstance(b, tuple):
        return a[:3] == b[:3] and same(a[3], b[3]) and same(a[4], b[4])
    return a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize(("refresh", "trees", "few"), [(25, 6, 16), (2, 6, 0)])
def test_trees_as_the_loops_grow_them(spark, monkeypatch, refresh, trees, few):
    monkeypatch.setattr(boosting, "FEW_TASKS", few)
    monkeypatch.setattr(boosting, "REFRESH", refresh)
    monkeypatch.setattr(boosting, "LEAST_LEAF", 5)
    monkeypatch.setattr(boosting, "DEPTH", 3)
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA)
    edges = boosting.quantile_edges(df, ["a", "b", "c"])
    first, second = F.when(F.col("aside"), 1).otherwise(0), F.when(F.col("part") == 0, 2).otherwise(0)
    models = boosting.fit(df.repartition(5), ["a", "b", "c"], "label", [first, second], trees, edges)
    for model, roles in zip(models, ([int(r[4]) for r in rows], [2 if r[5] == 0 else 0 for r in rows])):
        base, forest, p = plain_booster(rows, edges, roles, trees, 5, 3)
        assert model.base == pytest.approx(base) and len(model.trees) == len(forest) == trees
        assert all(same(nested(t), w) for t, w in zip(model.trees, forest))
        keyed = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {SCHEMA}")
        assert [r.p for r in boosting.probability(model, keyed).orderBy("i").collect()] == pytest.approx(p, abs=1e-9)
        assert boosting.Forest.from_json(model.to_json()) == model
    again = boosting.fit(df.coalesce(1), ["a", "b", "c"], "label", [first, second], trees, edges)
    assert again == models


def test_growing_stops_without_gain(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.random(), 0.0, None, float(rng.random() < 0.5), i % 3 == 0, 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    (model,) = boosting.fit(df, ["a", "b", "c"], "label", [F.when(F.col("aside"), 1).otherwise(0)], 60)
    wanted = plain_booster(rows, boosting.quantile_edges(df, ["a", "b", "c"]), [int(r[4]) for r in rows], 60, boosting.LEAST_LEAF, boosting.DEPTH)
    assert len(model.trees) == len(wanted[1]) < 60


def test_models_without_two_labels_or_rows(spark):
    df = spark.createDataFrame([(1.0, 1.0, None, 1.0, False, 0)] * 50, SCHEMA)
    one, none = boosting.fit(df, ["a", "c"], "label", [F.lit(0), F.lit(2)], 3)
    assert not one.trees and not none.trees and boosting.probability(one, df).first()["p"] > 0.99
    assert boosting.probability(one, df.limit(0)).count() == 0


def test_metrics_as_duckdb_computes_them(spark):
    """Predictions are written; DuckDB counts what is right and compares all pairs of rows of different labels."""
    rng = random.Random(2)
    rows = [(k, f"T{i}", 0, float(rng.random() < 0.4 + 0.2 * (i % 2)), round(rng.random(), 1), 10 * k) for k in (1, 2, 3) for i in range(60)]
    rows += [(4, "T0", 0, 1.0, 0.7, 40), (4, "T1", 0, 1.0, 0.2, 40)]
    got = {r.fold: r for r in ml.metrics(spark.createDataFrame(rows, "fold int, ticker string, d int, label double, p double, n_train long")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t(fold INT, ticker VARCHAR, d INT, label DOUBLE, p DOUBLE, n_train BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", rows)
    wanted = con.execute("SELECT fold, count(*), avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0 ELSE 0 END) FROM t GROUP BY fold").fetchall()
    areas = dict(con.execute("SELECT a.fold, avg(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) FROM t a JOIN t b ON a.fold = b.fold AND a.label = 1 AND b.label = 0 GROUP BY a.fold").fetchall())
    for k, n, accuracy in wanted:
        assert (got[k].n_test, got[k].accuracy) == (n, pytest.approx(accuracy)) and (got[k].auc == pytest.approx(areas[k]) if k in areas else got[k].auc is None)
    assert got[0].auc == pytest.approx(sum(areas.values()) / 3) and got[0].accuracy == pytest.approx(sum(w[2] for w in wanted) / 4)
