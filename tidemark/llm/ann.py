"""Approximate nearest neighbours by learned partitions.

A bounded sample gives the graph of its neighbours by inner product; the graph is cut into balanced parts; small networks
learn to route by it. One network gives the part of a row, from its direction and its length, since long rows are near to
many; the other the parts in which the neighbours of a query lie, from its direction, since a query's length changes no
order. Every row is indexed under its most probable part, every query visits its several most probable parts, and the
candidates met there are ranked by their exact inner products.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, tiles


@dataclass
class Router:
    """A network of one hidden layer that gives the probability of each part; its size is fixed by parameters."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


@dataclass
class Index:
    """The networks for rows and for queries, and the mean and spread of the logarithms of the rows' lengths."""

    rows: Router
    queries: Router
    middle: float
    spread: float

    @property
    def parts(self) -> int:
        return self.rows.parts

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The part under which each row is indexed."""
        return self.rows.logits(self.features(x)).argmax(axis=1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """All parts for each query, the most probable first."""
        return np.argsort(-self.queries.logits(directions(x)), axis=1, kind="stable")

    def features(self, x: np.ndarray) -> np.ndarray:
        lengths = (np.log(_lengths(x)) - self.middle) / self.spread
        return np.concatenate([directions(x), lengths], axis=1)


def _lengths(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that no square overflows.
    top = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return top * np.linalg.norm(x / top, axis=1, keepdims=True)


def directions(x: np.ndarray) -> np.ndarray:
    return x / _lengths(x)


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    found = []
    x = x.astype(np.float32)
    for lo in range(0, len(x), 128):
        scores = x[lo : lo + 128] @ x.T
        scores[np.arange(len(scores)), np.arange(lo, lo + len(scores))] = -np.inf
        found.append(np.argpartition(-scores, k - 1, axis=1)[:, :k].copy())
    return np.concatenate(found)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, *, slack: float = 1.1, rounds: int = 12) -> np.ndarray:
    """Cut a neighbour graph into parts of bounded size: seeded by directions, then refined by neighbours' votes.

    In each round every vertex asks for the part where most of its neighbours are; requests are granted by gain while the
    part has room.
    """
    n, room = len(x), int(np.ceil(slack * len(x) / parts))
    rng = np.random.default_rng(7)
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, dtype=np.int64)

    def granted(gain: np.ndarray) -> np.ndarray:
        out, left = np.full(n, -1), np.full(parts, room)
        choice = np.argsort(-gain, axis=1)
        order = np.argsort(-(gain[np.arange(n), choice[:, 0]] - gain[np.arange(n), choice[:, min(1, parts - 1)]]), kind="stable")
        for v in order:
            for p in choice[v]:
                if left[p]:
                    out[v], left[p] = p, left[p] - 1
                    break
        return out

    for _ in range(4):
        part = granted(x @ centres.T)
        sums = np.zeros((parts, x.shape[1]))
        np.add.at(sums, part, x)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    rows = np.repeat(np.arange(n), graph.shape[1])
    both = np.concatenate([rows, graph.ravel()]), np.concatenate([graph.ravel(), rows])
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (both[0], part[both[1]]), 1)
        votes[np.arange(n), part] += 0.5
        votes += 0.01 * (x @ centres.T)
        after = granted(votes)
        if (after == part).all():
            break
        part = after
    return part


def _trained(x: np.ndarray, target: np.ndarray, hidden: int, epochs: int) -> Router:
    """A network from lines of features to distributions over the parts."""
    rng = np.random.default_rng(11)
    d, parts = x.shape[1], target.shape[1]
    router = Router(rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts))
    weights = [router.w1, router.b1, router.w2, router.b2]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 256):
            at = order[lo : lo + 256]
            a = x[at] @ router.w1 + router.b1
            h = np.maximum(a, 0)
            z = h @ router.w2 + router.b2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - target[at]) / len(at)
            dh = (dz @ router.w2.T) * (a > 0)
            grads, step = [x[at].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)], step + 1
            rate = 0.004 * (1 - epoch / epochs) + 2e-4
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                weights[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return router


def fit_index(x: np.ndarray, parts: int, *, neighbours: int = 12, hidden: int = 128, epochs: int = 30) -> Index:
    """Learn the parts from sample vectors (one line each), each of them a row and a query."""
    parts = max(1, min(parts, len(x) // 16))
    logs = np.log(_lengths(x))
    index = Index(None, None, float(logs.mean()), float(max(logs.std(), 1e-6)))
    unit = directions(x)
    if parts == 1:
        one = np.ones((len(x), 1))
        index.rows, index.queries = _trained(index.features(x), one, 1, 0), _trained(unit, one, 1, 0)
        return index
    # Divided by the longest, so that products stay finite.
    graph = _neighbours(x / _lengths(x).max(), min(neighbours, len(x) - 1))
    part = balanced_parts(unit, graph, parts)
    mine, near = np.arange(len(x)), np.repeat(np.arange(len(x)), graph.shape[1])
    target = np.zeros((len(x), parts))
    np.add.at(target, (mine, part), 2)
    np.add.at(target, (near, part[graph.ravel()]), 1)
    index.rows = _trained(index.features(x), target / target.sum(axis=1, keepdims=True), hidden, epochs)
    # A query is led to where its neighbours are indexed, which need not be where the cut has put them.
    home = index.homes(x)
    target = np.zeros((len(x), parts))
    np.add.at(target, (near, home[graph.ravel()]), 1)
    index.queries = _trained(unit, target / target.sum(axis=1, keepdims=True), hidden, epochs)
    return index


def visits_for(index: Index, held: np.ndarray, total: int, k: int, target: float) -> int:
    """The fewest parts a query must visit so that the wanted share of its neighbours is met, judged on held-out vectors.

    The k nearest of ``total`` rows lie about as near as the k * held / total nearest of the held-out ones.
    """
    near = min(len(held) - 1, max(1, round(k * len(held) / max(total, 1))))
    if index.parts == 1 or near < 1:
        return index.parts
    home, order = index.homes(held), index.order(held)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(index.parts)[None, :].repeat(len(held), axis=0), axis=1)
    met = place[np.arange(len(held))[:, None], home[_neighbours(held / _lengths(held).max(), near)]]
    shares = np.cumsum(np.bincount(met.ravel(), minlength=index.parts)) / met.size
    return int(np.searchsorted(shares, target) + 1)


def _route(indexes: dict[int, Index], visits: dict[int, int] | None):
    """Lines (g, vec_id, v): the part of each row, or the most probable parts of each query. Lengths without an index have
    the one part 0."""
    starts, at = {}, 0
    for dim in sorted(indexes):
        starts[dim], at = at, at + indexes[dim].parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0), batch.column(1)
            dims = np.diff(vectors.offsets.to_numpy())
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                index = indexes.get(int(dim))
                if index is None:
                    top = np.full((len(rows), 1), at)
                else:
                    x = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
                    top = starts[int(dim)] + (index.homes(x)[:, None] if visits is None else index.order(x)[:, : visits[int(dim)]])
                take = pa.array(np.repeat(rows, top.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(top.ravel().astype("i4")), ids.take(take), vectors.take(take)], ["g", "vec_id", "v"])

    return run


def learned_partition_search(
    embeddings: DataFrame, is_query, k: int = 20, *, rows_per_part: int = 1024, max_parts: int = 256, sample_rows: int = 8192,
    held_rows: int = 4096, target: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """For each row that satisfies ``is_query`` the k nearest rows found, by inner product in double precision.

    The networks are fitted on the driver from at most ``sample_rows`` vectors (by id hash); the next
    ``held_rows`` tell how many parts a query must visit to meet the ``target`` share of its neighbours. Every row is
    indexed. There are about rows / ``rows_per_part`` parts, ``max_parts`` and sample_rows / 16 at most. Parts of any size
    are searched tile by tile; a query whose parts hold fewer than k rows asks all rows. Returns (query_id, rank, vec_id, score).

    * null ids, null or empty vectors, null or non-finite components, zero vectors: the row takes no part;
    * vectors of different dimension never meet: each dimension with enough sampled rows has its own networks;
    * repeated ids count as one row, with the best of their scores; ties go to the smaller id; vectors of any dimension are
      compared whole;
    * an empty table gives an empty result; further columns are ignored.
    """
    common.ship(embeddings.sparkSession)
    rows = tiles.usable(embeddings, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    asked = F.coalesce(is_query(F.col("vec_id")), F.lit(False))
    total, asked_bytes = rows.agg(F.count("*"), F.sum(F.when(asked, 8.0 * F.size("v")))).first()
    # The hashes below a bound hold about a fifth more rows than are wanted; the limit is what bounds the sample.
    wanted = sample_rows + held_rows
    below = int(min(1.0, 1.2 * wanted / max(total, 1)) * 2**31)
    near = rows.where(F.shiftrightunsigned(F.xxhash64("vec_id"), 33) <= below).select(F.col("v").cast("array<float>").alias("v"), F.xxhash64("vec_id").alias("h"), "vec_id")
    sample = near.orderBy("h", "vec_id").limit(wanted).select("v").toPandas()["v"]
    indexes: dict[int, Index] = {}
    visits: dict[int, int] = {}
    sampled, kept = Counter(len(v) for v in sample), {}
    for dim in sorted(sampled):
        x = np.array([v for v in sample if len(v) == dim], dtype=np.float64)
        x = x[np.isfinite(x).all(axis=1) & x.any(axis=1)]  # what single precision can hold
        if len(x) >= 64:
            here = round(total * len(x) / len(sample))
            kept[dim], cut = x, max(len(x) * sample_rows // (sample_rows + held_rows), 1)
            indexes[dim] = fit_index(x[:cut], min(max_parts, round(here / rows_per_part)))
            visits[dim] = visits_for(indexes[dim], x[cut:], here, k, target)
    # About how many rows a part has, and all vectors of dimensions without networks, by the shares of the sample.
    sizes, most = {}, max([1, *visits.values()])
    for dim in sorted(indexes):
        start, here = len(sizes), total * sampled[dim] / max(len(sample), 1)
        shares = np.bincount(indexes[dim].homes(kept[dim]), minlength=indexes[dim].parts) / len(kept[dim])
        sizes |= {start + p: here * share for p, share in enumerate(shares)}
    sizes[len(sizes)] = total * (1 - sum(sampled[dim] for dim in indexes) / max(len(sample), 1))
    schema = "g int, vec_id long, v array<double>"
    placed = rows.mapInArrow(_route(indexes, None), schema)
    sought = rows.where(asked).mapInArrow(_route(indexes, visits), schema)
    found = common.checkpointed(tiles.tiled_top_k(placed, sought, k, sizes, (asked_bytes or 0) * most))
    # Queries whose parts held fewer than k rows are few, unless the table has no more: they ask all rows.
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = rows.where(asked).join(full, F.col("vec_id") == F.col("query_id"), "left_anti").select(F.lit(0).alias("g"), "vec_id", "v")
    short = common.checkpointed(short)
    size = short.agg(F.sum(8.0 * F.size("v"))).first()[0]
    if size is None:
        return found
    again = tiles.tiled_top_k(rows.select(F.lit(0).alias("g"), "vec_id", "v"), short, k, {0: total}, size)
    return found.join(full.select("query_id"), "query_id", "left_semi").select("query_id", "rank", "vec_id", "score").unionByName(again)
