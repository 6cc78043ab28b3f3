"""Exact top-k by tiles: query blocks against row blocks, selection per tile, merged in a tree.

Rows and queries carry a group number. Every query meets every row of its group. Rows of a group are dealt to buckets by
a hash of their id and packed into tiles of bounded size. Row tiles stay where they are and the query tiles of their group
come to them. So one task never holds a whole group, however large the group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROW_TILE, QUERY_TILE = 1024, 512


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, v) whose id is known and whose vector is neither null nor empty and has finite components only."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
        .where(F.coalesce(finite, F.lit(False)))
    )


def _pack(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pack rows (g, b, dim, vec_id, v) into tiles of at most ``most`` rows, sorted by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def tile(key: tuple, parts: list) -> pa.RecordBatch:
            ids = np.concatenate([p[0] for p in parts])
            order = np.argsort(ids, kind="stable")
            vectors = np.concatenate([p[1] for p in parts])[order]
            columns = [pa.array([x], pa.int32()) for x in key]
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (ids[order], vectors)]
            return pa.RecordBatch.from_arrays([*columns, *blobs], ["g", "b", "dim", "ids", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            g, b, dim, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dim)
            order = np.lexsort((dim, b, g))
            keys = np.stack([g[order], b[order], dim[order]])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), len(order)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key, at = tuple(int(x) for x in keys[:, lo]), order[lo:hi]
                rows = flat[(ends[at] - key[2])[:, None] + np.arange(key[2])]
                for k in range(0, len(at), most):
                    parts = held.setdefault(key, [])
                    parts.append((ids[at[k : k + most]].astype("i8"), rows[k : k + most]))
                    if sum(len(p[0]) for p in parts) >= most:
                        yield tile(key, held.pop(key))
        for key, parts in held.items():
            yield tile(key, parts)

    return run


def best(scores: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, row ids and scores of the k best of each line: by score, ties to the smaller id, own id left out.

    ``ids`` ascend. Of equal ids the best score counts. A score that is not a number ranks last.
    """
    lowest = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    if scores.dtype.kind == "f":
        scores = np.where(np.isnan(scores), lowest, scores)
    if (ids[1:] == ids[:-1]).any():
        ids, first = np.unique(ids, return_index=True)
        scores = np.maximum.reduceat(scores, first, axis=1)
    own = queries[:, None] == ids[None, :]
    wanted = ~own
    if len(ids) > k:
        floor = np.partition(np.where(own, lowest, scores), len(ids) - k, axis=1)[:, len(ids) - k]
        wanted &= scores >= floor[:, None]
    lines, columns = np.nonzero(wanted)
    picked = scores[lines, columns]
    order = np.lexsort((ids[columns], -picked, lines))
    lines, columns, picked = lines[order], columns[order], picked[order]
    keep = np.arange(len(lines)) - np.searchsorted(lines, np.arange(len(queries)))[lines] < k
    return queries[lines[keep]], ids[columns[keep]], picked[keep]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products in double precision."""
    return a @ b.T


#: Bits of the pieces into which large whole numbers are cut.
PIECE = 20


def _pieces(x: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as sums of PIECE-bit pieces, the lowest first."""
    out, base = [], float(1 << PIECE)
    while not out or x.any():
        low = np.fmod(x, base)
        out.append(low)
        x = (x - low) / base
    return out


def whole_inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held as doubles: exact, saturated at the range of a 64-bit integer.

    Only lines and columns with a product that doubles cannot hold go through pieces, whose matrix products they can.
    """
    top_a, top_b = np.abs(a).max(axis=1, initial=0), np.abs(b).max(axis=1, initial=0)
    unsafe = np.maximum(top_a, 1)[:, None] > 2.0**53 / a.shape[1] / np.maximum(top_b, 1)[None, :]
    if not unsafe.any():
        return a @ b.T
    lines, columns = np.flatnonzero(unsafe.any(axis=1)), np.flatnonzero(unsafe.any(axis=0))
    safe_a, safe_b = np.where(np.abs(a) < 2.0**53, a, 0), np.where(np.abs(b) < 2.0**53, b, 0)
    plain = np.where(unsafe, 0.0, safe_a @ safe_b.T).astype(np.int64)
    exact = np.zeros((len(lines), len(columns)), dtype=object)
    step = max(1, (1 << (53 - 2 * PIECE)) - 1)
    for lo in range(0, a.shape[1], step):  # so many products of pieces fit
        left, right = _pieces(a[lines, lo : lo + step]), _pieces(b[columns, lo : lo + step])
        for i, p in enumerate(left):
            for j, q in enumerate(right):
                exact += (p @ q.T).astype(np.int64).astype(object) * (1 << PIECE * (i + j))
    limit = 2**63 - 1
    plain[np.ix_(lines, columns)] = np.clip(exact, -limit, limit).astype(np.int64)
    return plain


#: Lines a task gathers before it cuts them to the best of each query.
GATHER = 200_000


def compact(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query from lists (queries, ids, scores), sorted by query and place; equal ids count once."""
    queries, ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((-scores, ids, queries))
    queries, ids, scores = queries[order], ids[order], scores[order]
    first = np.ones(len(ids), bool)
    first[1:] = (queries[1:] != queries[:-1]) | (ids[1:] != ids[:-1])
    queries, ids, scores = queries[first], ids[first], scores[first]
    order = np.lexsort((ids, -scores, queries))
    queries, ids, scores = queries[order], ids[order], scores[order]
    starts = np.flatnonzero(np.concatenate([[True], queries[1:] != queries[:-1]])) if len(queries) else np.zeros(0, int)
    place = np.arange(len(queries)) - np.repeat(starts, np.diff([*starts, len(queries)]))
    keep = place < k
    return queries[keep], ids[keep], scores[keep]


def _lists(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pa.RecordBatch:
    """One line per query: its list so far."""
    queries, ids, scores = found
    starts = np.flatnonzero(np.concatenate([[True], queries[1:] != queries[:-1]])) if len(queries) else np.zeros(0, int)
    offsets = pa.array(np.append(starts, len(queries)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(queries[starts]), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(scores))], ["query_id", "ids", "scores"]
    )


def _score(measure: Callable, k: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best of each tile, merged within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                ids, queries = (np.frombuffer(batch.column(c)[i].as_buffer(), "i8") for c in (1, 3))
                rows, asked = (np.frombuffer(batch.column(c)[i].as_buffer(), "f8").reshape(-1, dim) for c in (2, 4))
                query_id, vec_id, score = best(measure(asked, rows), ids, queries, k)
                held.append((query_id, vec_id, score.astype("i8") if whole else score))
                if sum(len(x[0]) for x in held) > GATHER:
                    held = [compact(held, k)]
                    if len(held[0][0]) > GATHER // 2:
                        yield _lists(held.pop())
        if held:
            yield _lists(compact(held, k))

    return run


def _merge(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The lists of a query, all of which are in this task, merged into lines (query_id, rank, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            flat = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
            held.append((np.repeat(batch.column(0).to_numpy(), lengths), *flat))
            if sum(len(x[0]) for x in held) > GATHER:
                held = [compact(held, k)]
        if held:
            queries, ids, scores = compact(held, k)
            starts = np.searchsorted(queries, queries, side="left")
            rank = (np.arange(len(queries)) - starts + 1).astype("i4")
            yield pa.RecordBatch.from_arrays([pa.array(queries), pa.array(rank), pa.array(ids), pa.array(scores)], ["query_id", "rank", "vec_id", "score"])

    return run


#: Bytes of query vectors that are sent to every executor at most; beyond it they are shuffled to the rows' buckets.
SENT_BYTES = 32 << 20
#: Row tiles of a bucket: few where its queries are sent, many where each bucket gets a copy of them.
BUCKET_TILES, SHUFFLED_BUCKET_TILES = 2, 64


def tiled_top_k(rows: DataFrame, queries: DataFrame, k: int, sizes: dict[int, float], asked_bytes: float, *, whole: bool = False) -> DataFrame:
    """The k rows of largest inner product for each query within its group.

    Both frames have (g int, vec_id long, v array<double>); vectors of different dimension never meet. ``sizes`` says about
    how many rows a group has: it decides the number of buckets only, and groups it lacks have one. ``asked_bytes`` is the
    size of the query vectors: up to SENT_BYTES they are sent to all executors, and the rows are shuffled once, into tiles.
    Beyond it each query tile is shuffled to every bucket of its group, and the row tiles are shuffled once more, however
    many queries there are. Returns (query_id, rank, vec_id, score). Repeated rows of one id and score count once. With
    ``whole`` the components are whole numbers and the scores exact 64-bit integers.
    """
    spark = rows.sparkSession
    few = asked_bytes <= SENT_BYTES
    # One line per group; groups are bounded by the caller.
    lines = [(int(g), max(1, -(-int(n) // ((BUCKET_TILES if few else SHUFFLED_BUCKET_TILES) * ROW_TILE)))) for g, n in sizes.items()]
    grid = F.broadcast(spark.createDataFrame(lines, "of int, rb int"))

    def dealt(df: DataFrame) -> DataFrame:
        known = df.join(grid, F.col("g") == F.col("of"), "left").withColumn("rb", F.coalesce("rb", F.lit(1)))
        return known.select("g", F.pmod(F.xxhash64("vec_id"), F.col("rb")).cast("int").alias("b"), F.size("v").alias("dim"), "vec_id", "v", "rb")

    cell = "g int, b int, dim int, ids binary, vectors binary"
    left = dealt(rows).drop("rb").repartition("g", "b").mapInArrow(_pack(ROW_TILE), cell)
    right = queries.select("g", F.pmod(F.xxhash64("vec_id"), F.lit(64)).cast("int").alias("b"), F.size("v").alias("dim"), "vec_id", "v")
    # Queries that are sent are few: those of a group are packed into full tiles.
    packed = (right.withColumn("b", F.lit(0)) if few else right).repartition("g", "b").mapInArrow(_pack(QUERY_TILE), cell)
    if few:
        asked = F.broadcast(packed.select("g", "dim", F.col("ids").alias("asked"), F.col("vectors").alias("asked_vectors")))
        pairs = left.join(asked, ["g", "dim"])
    else:
        spread = packed.join(grid, F.col("g") == F.col("of"), "left").withColumn("rb", F.coalesce("rb", F.lit(1)))
        asked = spread.select("g", "dim", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("b"), F.col("ids").alias("asked"), F.col("vectors").alias("asked_vectors"))
        pairs = left.join(asked, ["g", "dim", "b"])
    pairs = pairs.select("dim", "ids", "vectors", "asked", "asked_vectors")
    # Merged as a tree: the best of a tile, of a task, of all.
    kind = "long" if whole else "double"
    lists = pairs.mapInArrow(_score(whole_inner if whole else inner, k, whole), f"query_id long, ids array<long>, scores array<{kind}>")
    return lists.repartition("query_id").mapInArrow(_merge(k), f"query_id long, rank int, vec_id long, score {kind}")
