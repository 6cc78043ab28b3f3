"""Product codes: the ball tree and the whole result against brute force in Python's numbers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import codes


@pytest.mark.parametrize(("size", "width", "entries"), [(5, 3, 256), (1000, 16, 256), (2**27, 16, 200), (2**40, 16, 60), (2**61, 4, 40), (1, 2, 256), (300, 16, 1), (0, 4, 40)])
def test_nearest_entry(size, width, entries):
    rng = np.random.default_rng(width + entries)
    book = rng.integers(-size, size + 1, (entries, width))
    x = np.concatenate([rng.integers(-size, size + 1, (300, width)), book[rng.integers(0, entries, 60)]])
    at, square = codes.nearest(codes.ball_tree(book.astype(float)), book, x)
    wanted = ((x[:, None].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
    assert np.array_equal(at, wanted.argmin(axis=1))
    assert [int(d) for d in square] == [int(d) for d in wanted.min(axis=1)]


def test_ball_tree_holds_every_entry_once():
    book = np.random.default_rng(0).normal(size=(200, 8)) * 1000

    def leaves(ball, within):
        within = [*within, ball]
        if ball.members is None:
            return leaves(ball.near, within) + leaves(ball.far, within)
        for b in within:
            assert (np.linalg.norm(book[ball.members] - b.centre, axis=1) <= b.radius).all()
        return list(ball.members)

    assert sorted(leaves(codes.ball_tree(book), [])) == list(range(200))


def plain(rows, parts, entries, rounds, scale):
    """rows: (vec_id, vector, label), all of one length and finite."""
    q = [[math.floor(scale * x) for x in v] for _, v, _ in rows]
    width = len(q[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in q]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, q[k]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[nearest(p, c[p])[1]].append(c[p])
            new.append([[sum(col) // len(own[i]) for col in zip(*own[i])] if i in own else e for i, e in enumerate(books[p])])
        books = new
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    totals = defaultdict(int)
    for (_, _, label), e in zip(rows, error):
        totals[label] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, totals[label], digest) for (i, _, label), f, e in zip(rows, found, error)), key=repr)


def vectors(n, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    return [(None if k == 5 else k // 2 if k % 9 == 0 else k, [rng.gauss(c, 0.2) for c in centres[k % 12]], None if k % 4 == 0 else k % 3) for k in range(n)]


@pytest.mark.parametrize(("n", "entries"), [(400, 32), (20, 32), (1, 4)])
def test_codes(spark, n, entries):
    good = vectors(n)
    bad = [(900, None, 1), (901, [], 1), (902, [1.0] * 7 + [None], 1), (903, [1.0] * 7 + [float("nan")], 1), (904, [float("-inf")] * 8, 2), (905, [1.0] * 4, 1), (906, [1.0] * 6, None)]
    bad = bad if n > 1 else bad[:5]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label int")
    for name in ("q", "v", "part", "code", "share", "of_label"):
        df = df.withColumn(name, F.lit("clash"))
    got = codes.product_codes(df.repartition(3), entries=entries)
    assert [t for _, t in got.dtypes] == ["bigint", "string", "bigint", "bigint", "string"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(good, 4, entries, 4, 1024.0)


def test_equal_vectors_and_large_components(spark):
    good = [(k, [float(2**20 * (k % 3)), -(2.0**21), 0.5, 1e5], 1) for k in range(30)]
    df = spark.createDataFrame(good, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, codes.product_codes(df, entries=8).collect()), key=repr) == plain(good, 4, 8, 4, 1024.0)
    huge = spark.createDataFrame([(1, [1e300] * 4, 1), (2, [-1e300] * 4, 1), (3, [0.0] * 4, 2)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in codes.product_codes(huge, entries=1).collect()}
    assert got[2].error == codes.LARGEST == got[2].label_error and got[1].code == "00000000"


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    got = codes.product_codes(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0
