"""Boosted trees for two classes by histograms of gradients, several models in the same passes over the rows.

Features are cut into quantile bins once. A pass over the rows sums, in the tasks and then in Spark, the gradients of every
open node by feature and bin; the driver sees these sums only, and opens the next level by them. Missing values have a bin of
their own and go, at each split, to the side that gains more. Gradients are summed as whole numbers, so a model does not
depend on how the rows are partitioned.
"""

from __future__ import annotations

import json
import math
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import checkpointed

# What the workers run goes to them by value, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shallow trees, slow steps and a ridge; growing stops when rows set aside have not gained for so many trees.
DEPTH, STEP, MOST_TREES, RIDGE, LEAST_LEAF, PATIENCE, LEAST_GAIN = 4, 0.03, 600, 1.0, 20, 10, 1e-7
BINS, MISSING = 64, 255
#: Gradients are summed in units of 2^-26; after so many trees the rows are written with what the trees say so far.
UNIT, REFRESH = float(1 << 26), 25
#: Up to so many tasks their sums go to the driver as they are; those of more are summed by Spark first.
FEW_TASKS = 16
#: What a row is to a model.
TRAIN, ASIDE, UNUSED = 0, 1, 2


@dataclass
class Node:
    """A split (bins up to ``bin`` go left, missing ones left or right) or a leaf's value."""

    value: float = 0.0
    feature: int = -1
    bin: int = -1
    missing_left: bool = False
    left: int = -1
    right: int = -1


@dataclass
class Forest:
    """A fitted model: the upper edges of each feature's bins, the log odds at the start, and trees of nodes."""

    features: list[str]
    edges: list[list[float]]
    base: float = 0.0
    trees: list[list[Node]] = field(default_factory=list)

    def to_json(self) -> str:
        trees = [[[n.value, n.feature, n.bin, n.missing_left, n.left, n.right] for n in t] for t in self.trees]
        return json.dumps({"features": self.features, "edges": self.edges, "base": self.base, "trees": trees})

    @staticmethod
    def from_json(text: str) -> Forest:
        said = json.loads(text)
        return Forest(said["features"], said["edges"], said["base"], [[Node(*n) for n in t] for t in said["trees"]])


def quantile_edges(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """The upper edges of at most BINS bins of each feature, of about equally many rows."""
    at = [k / BINS for k in range(1, BINS)]
    value = lambda f: F.when(~F.isnan(f), F.col(f).cast("double"))
    found = rows.agg(*(F.percentile_approx(value(f), at, 10_000).alias(f"q{i}") for i, f in enumerate(features))).first()
    return [sorted(set(q or [])) for q in found]


def _binned(columns: list[np.ndarray], edges: list[list[float]]) -> np.ndarray:
    out = np.empty((len(columns[0]) if columns else 0, len(columns)), dtype=np.uint8)
    for i, (values, e) in enumerate(zip(columns, edges, strict=True)):
        out[:, i] = np.where(np.isnan(values), MISSING, np.searchsorted(np.array(e), values, side="left"))
    return out


def _leaf_of(tree: list[Node], x: np.ndarray) -> np.ndarray:
    """The node that each row of bins ends in, which may be one that is still to be split."""
    at, active = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    split = np.array([n.feature >= 0 for n in tree])
    feature, upto, missing, left, right = (np.array([getattr(n, c) for n in tree]) for c in ("feature", "bin", "missing_left", "left", "right"))
    while len(active := active[split[at[active]]]):
        node = at[active]
        b = x[active, feature[node]]
        go_left = np.where(b == MISSING, missing[node], b <= upto[node])
        at[active] = np.where(go_left, left[node], right[node])
    return at


def _values(tree: list[Node], x: np.ndarray) -> np.ndarray:
    return np.array([n.value for n in tree])[_leaf_of(tree, x)]


def _matrix(batch: pa.RecordBatch, name: str, dtype, n: int) -> np.ndarray:
    joined = b"".join(batch.column(name).to_pylist())
    return np.frombuffer(joined, dtype=dtype).reshape(batch.num_rows, n)


def _state(batch: pa.RecordBatch, width: int, models: int, pending: dict[int, list]) -> tuple:
    """Bins, labels, roles and raw scores of a batch, these with the trees that are not written yet."""
    x, role, raw = _matrix(batch, "x", np.uint8, width), _matrix(batch, "role", np.uint8, models), _matrix(batch, "raw", np.float64, models).copy()
    for m, trees in pending.items():
        for tree in trees:
            raw[:, m] += _values(tree, x)
    return x, batch.column("y").to_numpy(), role, raw


def _histograms(width: int, models: int, pending: dict[int, list], growing: dict[int, list[Node]], open_nodes: dict[int, list[int]], with_loss: bool, whole: bool):
    """For a task: sums (model, node, feature, bin, g, h, n) over its rows; node -1 holds the loss of the rows set aside. As
    ``whole`` (model, node, sums) with the bytes of all sums of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        lost: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, role, raw = _state(batch, width, models, pending)
            for m in growing:
                p = 1 / (1 + np.exp(-raw[:, m]))
                if with_loss and (out := role[:, m] == ASIDE).any():
                    sure = np.clip(np.where(y[out] > 0.5, p[out], 1 - p[out]), 1e-15, 1)
                    lost[m][0] += int(np.rint(-np.log(sure) * UNIT).astype(np.int64).sum())
                    lost[m][1] += int(out.sum())
                mine = np.flatnonzero(role[:, m] == TRAIN)
                node = _leaf_of(growing[m], x[mine])
                g, h = np.rint((p - y)[mine] * UNIT).astype(np.int64), np.rint((p * (1 - p))[mine] * UNIT).astype(np.int64)
                for k in open_nodes[m]:
                    rows = np.flatnonzero(node == k)
                    sums = total.setdefault((m, k), np.zeros((3, width, 256), dtype=np.int64))
                    for f in range(width):
                        b = x[mine[rows], f]
                        # Sums as exact whole numbers, bin by bin.
                        np.add.at(sums[0, f], b, g[rows])
                        np.add.at(sums[1, f], b, h[rows])
                        sums[2, f] += np.bincount(b, minlength=256)
        if whole:
            blobs = [(m, -1, np.array([loss, 0, n]).tobytes()) for m, (loss, n) in lost.items()] + [(m, k, sums.tobytes()) for (m, k), sums in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int64()), pa.array([b[1] for b in blobs], pa.int64()), pa.array([b[2] for b in blobs], pa.binary())], ["model", "node", "sums"])
            return
        lines = [(m, -1, 0, 0, loss, 0, n) for m, (loss, n) in lost.items()]
        for (m, k), sums in total.items():
            f, b = np.nonzero(sums[2])
            lines += zip([m] * len(f), [k] * len(f), f.tolist(), b.tolist(), *(sums[c][f, b].tolist() for c in range(3)), strict=True)
        columns = list(zip(*lines, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["model", "node", "feature", "bin", "g", "h", "n"])

    return run


def best_split(sums: np.ndarray) -> tuple[float, int, int, bool] | None:
    """(gain, feature, bin, missing goes left) of a node with sums (g, h, n; feature; bin): the largest gain, of equal ones
    the lowest feature and bin, missing values to the right before the left. None if no split gains."""
    best = None
    g_all, h_all, n_all = (sums[c, 0].sum() / (UNIT if c < 2 else 1) for c in range(3))
    of = lambda g, h: g * g / (h + RIDGE)
    for f in range(sums.shape[1]):
        there = sums[:, f, :MISSING].cumsum(axis=1)
        lost = sums[:, f, MISSING]
        for missing_left in ((False, True) if lost[2] else (False,)):
            left = there + lost[:, None] if missing_left else there
            g, h, n = left[0] / UNIT, left[1] / UNIT, left[2]
            fits = (n >= LEAST_LEAF) & (n_all - n >= LEAST_LEAF)
            if not fits.any():
                continue
            gain = np.where(fits, of(g, h) + of(g_all - g, h_all - h) - of(g_all, h_all), -np.inf)
            b = int(gain.argmax())
            if gain[b] > 1e-9 and (best is None or gain[b] > best[0]):
                best = (float(gain[b]), f, b, missing_left)
    return best


def _value(sums: np.ndarray) -> float:
    return -STEP * float(sums[0].sum() / UNIT) / (float(sums[1].sum() / UNIT) + RIDGE)


def fit(rows: DataFrame, features: list[str], label: str, roles: list[Column], most_trees: int = MOST_TREES, edges: list[list[float]] | None = None) -> list[Forest]:
    """One model for each of ``roles``, whose values say what a row is to it: TRAIN, ASIDE or UNUSED.

    ``label`` is 0 or 1. A model grows until the rows set aside (if it has any) have gained nothing for PATIENCE trees. Null
    and NaN features are missing. A model without rows of both labels to train on has no trees.
    """
    edges = quantile_edges(rows, features) if edges is None else edges
    width, models = len(features), len(roles)
    sure = F.array(*(r.cast("int") for r in roles))
    counts = rows.agg(*(F.count_if(r == TRAIN) for r in roles), *(F.sum(F.when(r == TRAIN, F.col(label))) for r in roles)).first()
    n, ones = counts[:models], [c or 0 for c in counts[models:]]
    forests = [Forest(features, edges, math.log(ones[m] / (n[m] - ones[m])) if 0 < ones[m] < n[m] else (0.0 if not n[m] else math.copysign(20.0, ones[m] - 0.5))) for m in range(models)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.array([f.base for f in forests])
        for batch in batches:
            x = _binned([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(width)], edges)
            role = batch.column(width + 1).values.to_numpy().astype(np.uint8).reshape(batch.num_rows, models)
            columns = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x, role)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(width).cast(pa.float64()), pa.array([base.tobytes()] * batch.num_rows, pa.binary())], ["x", "role", "y", "raw"])

    packed = "x binary, role binary, y double, raw binary"
    data = checkpointed(rows.select(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)), F.col(label).cast("double").alias("y"), sure.alias("role")).mapInArrow(pack, packed))
    tasks = data.rdd.getNumPartitions()
    pending: dict[int, list] = {m: [] for m in range(models)}
    losses: dict[int, list[float]] = {m: [] for m in range(models)}
    active = [m for m in range(models) if 0 < ones[m] < n[m]]

    def done(m: int) -> bool:
        past = losses[m]
        return len(past) > PATIENCE and not any(v < past[-PATIENCE - 1] - LEAST_GAIN for v in past[-PATIENCE:])

    def summed(growing: dict, open_nodes: dict, with_loss: bool) -> dict[tuple, np.ndarray]:
        few = tasks <= FEW_TASKS
        kind = "model long, node long, sums binary" if few else "model long, node long, feature long, bin long, g long, h long, n long"
        lines = data.mapInArrow(_histograms(width, models, pending, growing, open_nodes, with_loss, few), kind)
        found: dict[tuple, np.ndarray] = {}
        lost = np.zeros((models, 3), dtype=np.int64)
        if few:
            for m, k, blob in lines.collect():
                sums = np.frombuffer(blob, dtype=np.int64)
                if k < 0:
                    lost[m] += sums
                else:
                    found[m, k] = found.get((m, k), 0) + sums.reshape(3, width, 256)
        else:  # as many lines as there are open nodes, features and bins
            for m, k, f, b, *sums in lines.groupBy("model", "node", "feature", "bin").agg(*(F.sum(c) for c in "ghn")).collect():
                if k < 0:
                    lost[m] += np.array(sums)
                else:
                    found.setdefault((m, k), np.zeros((3, width, 256), dtype=np.int64))[:, f, b] = sums
        for m in np.flatnonzero(lost[:, 2]):
            losses[m].append(lost[m, 0] / UNIT / lost[m, 2])
        return found

    for grown in range(most_trees):
        growing, open_nodes = {m: [Node()] for m in active}, {m: [0] for m in active}
        for depth in range(DEPTH):
            # The first pass over a tree also says what the trees before it have done for the rows set aside.
            found = summed({m: growing[m] for m in growing if open_nodes[m]}, open_nodes, depth == 0)
            if depth == 0:
                active = [m for m in active if not done(m)]
                growing = {m: growing[m] for m in active}
            for m in growing:
                following = []
                for k in open_nodes[m]:
                    sums = found.get((m, k))
                    split = best_split(sums) if sums is not None else None
                    if depth == 0 and sums is not None:
                        growing[m][0].value = _value(sums[:, 0])
                    if split is None:
                        continue
                    _, f, b, missing_left = split
                    left = np.zeros((3, 256), dtype=np.int64)
                    left[:, : b + 1] = sums[:, f, : b + 1]
                    left[:, MISSING] = sums[:, f, MISSING] * missing_left
                    node = growing[m][k]
                    node.feature, node.bin, node.missing_left, node.left, node.right = f, b, missing_left, len(growing[m]), len(growing[m]) + 1
                    growing[m] += [Node(_value(left)), Node(_value(sums[:, f] - left))]
                    following += [node.left, node.right]
                open_nodes[m] = following
            if not any(open_nodes[m] for m in growing):
                break
        if not active:
            break
        for m in active:
            forests[m].trees.append(growing[m])
            pending[m].append(growing[m])
        if (grown + 1) % REFRESH == 0:
            data, pending = checkpointed(data.mapInArrow(_refreshed(width, models, pending), packed)), {m: [] for m in range(models)}
    return forests


def _refreshed(width: int, models: int, pending: dict[int, list]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _state(batch, width, models, pending)[3]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "role", "y")), pa.array([r.tobytes() for r in raw], pa.binary())], ["x", "role", "y", "raw"])

    return run


def probability(forest: Forest, rows: DataFrame, out: str = "p") -> DataFrame:
    """Adds ``out``, the probability of the label 1."""
    edges, trees, base, width = forest.edges, forest.trees, forest.base, len(forest.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _binned([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(width)], edges)
            raw = np.full(batch.num_rows, base)
            for tree in trees:
                raw += _values(tree, x)
            yield pa.RecordBatch.from_arrays([batch.column(width), pa.array(1 / (1 + np.exp(-raw)))], ["row", out])

    kind = rows.select(F.struct(*rows.columns).alias("row")).schema["row"].dataType.simpleString()
    given = rows.select(*(F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(forest.features)), F.struct(*rows.columns).alias("row"))
    return given.mapInArrow(run, f"row {kind}, {out} double").select("row.*", out)
