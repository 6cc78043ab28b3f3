"""Searches against brute force: vectors of unlike lengths, queries that are sent and queries that are shuffled, the registered queries."""

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import ann, exact_search, queries, tiles


def clustered(n, seed, lengths):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, n)] + 0.3 * rng.normal(size=(n, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * (np.exp(rng.normal(size=(n, 1))) if lengths == "log-normal" else 1)


def recall_of(got, x, step, k):
    hits = total = 0
    for i in range(0, len(x), step):
        s = x @ x[i]
        s[i] = -np.inf
        mine = got[got.query_id == i].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(mine) + 1)) and i not in set(mine.vec_id)
        assert np.allclose(mine.score, s[mine.vec_id])
        hits, total = hits + (mine.score >= np.sort(s)[-k] - 1e-12).sum(), total + k
    return hits / total


@pytest.mark.parametrize("lengths", ["log-normal", "unit"])
@pytest.mark.parametrize("sent", [32 << 20, 0])
def test_recall(spark, monkeypatch, lengths, sent):
    monkeypatch.setattr(tiles, "SENT_BYTES", sent)
    x = clustered(4000, 5, lengths)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    got = ann.learned_partition_search(df, lambda i: i % 20 == 0, 10, rows_per_part=200, sample_rows=1500, held_rows=1000).toPandas()
    assert recall_of(got, x, 20, 10) >= 0.9


def test_index_is_of_several_parts_and_of_few_visits():
    for lengths in ("log-normal", "unit"):
        x = clustered(6000, 6, lengths)
        index = ann.fit_index(x[:3000], 30)
        assert index.parts == 30 and ann.visits_for(index, x[3000:], 6000, 10, 0.95) <= 15


@pytest.mark.parametrize("sent", [32 << 20, 0])
def test_exact_search_of_either_way(spark, monkeypatch, sent):
    monkeypatch.setattr(tiles, "SENT_BYTES", sent)
    monkeypatch.setattr(tiles, "ROW_TILE", 64)
    x = clustered(1500, 8, "log-normal")
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}))
    got = exact_search.exact_top_k(df, lambda i: i % 50 == 0, 5).toPandas()
    q = np.floor(256 * x).astype(int)
    for i in range(0, 1500, 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((np.arange(1500), -s)) if j != i][:5]
        mine = got[got.query_id == i].sort_values("rank")
        assert list(zip(mine.vec_id, mine.score)) == [(j, s[j]) for j in order]


def test_whole_products_are_exact_whatever_their_size():
    rng = np.random.default_rng(1)
    for scale in (1, 1e6, 1e9, 1e15, 1e30, 1e200):
        a, b = np.floor(rng.normal(size=(7, 33)) * scale), np.floor(rng.normal(size=(9, 33)) * rng.choice([1, 1e3, scale], size=(9, 1)))
        limit = 2**63 - 1
        exact = [[min(max(sum(int(x) * int(y) for x, y in zip(p, q)), -limit), limit) for q in b] for p in a]
        assert tiles.whole_inner(a, b).tolist() == exact


@pytest.mark.parametrize("name", ["op2_learned_partitions", "op7_exact_top_k"])
def test_registered_queries(spark, name):
    sf = "/root/testdata/sf0.01"
    table = pd.read_parquet(f"{sf}/embeddings.parquet").sort_values("vec_id")
    x = np.array(table.embedding.tolist(), dtype=float)
    assert list(table.vec_id) == list(range(len(x)))
    got = queries.QUERIES[name](spark, sf).toPandas()
    if name.startswith("op2"):
        assert recall_of(got, x, 20, 20) >= 0.9
    else:
        assert recall_of(got, np.floor(256 * x), 50, 5) == 1


def test_a_query_in_a_small_part_still_has_k_neighbours(spark, monkeypatch):
    """Every query visits one part only, and some parts hold fewer rows than are asked for."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.05, (n, 6)) + 3 * np.eye(6)[k] for k, n in enumerate((300, 250, 6, 5, 130))])
    monkeypatch.setattr(ann, "visits_for", lambda *args: 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = lambda i: (i % 20 == 0) | (i >= 550)
    got = ann.learned_partition_search(df, asked, 20, rows_per_part=16).toPandas()
    wanted = [i for i in range(len(x)) if i % 20 == 0 or i >= 550]
    assert sorted(set(got.query_id)) == wanted
    for q, lines in got.sort_values("rank").groupby("query_id"):
        assert list(lines["rank"]) == list(range(1, 21)) and q not in set(lines.vec_id) and lines.vec_id.is_unique
        assert np.allclose(lines.score, x[lines.vec_id] @ x[q]) and list(lines.score) == sorted(lines.score, reverse=True)
