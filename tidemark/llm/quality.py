"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad, judged by features of itself and of the lines beside it and by the labels beside it. The
forward-backward marginals of a document, weighted by line length, make its quality, which a logistic curve turns to a
probability. Line labels for training come from document labels: lines of good documents are good; of bad documents those
are bad that look bad to a model of single lines, one at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

FEATURES = ("log_length", "upper", "digits", "symbols", "stops", "spaces", "bars", "shouts", "variety", "stutter", "word_length", "ends", "starts_upper", "empty", "as_before")
_CLASS = np.zeros((7, 256), np.uint8)
for _row, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"*$#%&~^_=+<>{}[]\\@`", b".,;:?-'\"()", b" \t\r\x0b\x0c", b"|", b"!")):
    _CLASS[_row, list(_chars)] = 1


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of some texts, the lines' lengths in bytes, and the number of lines of each text."""
    lines, counts = [], np.empty(len(texts), np.int64)
    for i, text in enumerate(texts):
        own = text.split("\n")
        counts[i] = len(own)
        lines += own
    raw = "\n".join(lines).encode("utf-8", "surrogatepass") + b"\n"
    octets = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(octets == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = (ends - starts).astype(np.float64)
    size = np.maximum(length, 1)
    out = np.zeros((len(lines), len(FEATURES)))
    out[:, 0] = np.log1p(length) / 5
    for row in range(7):
        out[:, row + 1] = np.add.reduceat(_CLASS[row][octets], starts, dtype=np.int64) / size
    # Capitals of Latin-1 are two bytes, the first of which is C3.
    second = np.zeros(len(octets), np.uint8)
    second[1:] = (octets[:-1] == 0xC3) & (octets[1:] >= 0x80) & (octets[1:] <= 0x9E)
    out[:, 1] += np.add.reduceat(second, starts, dtype=np.int64) / size
    first, final = octets[starts], octets[np.maximum(ends - 1, starts)]
    out[:, 11] = np.isin(final, np.frombuffer(b".?!:\"", np.uint8))
    out[:, 12] = ((first >= 65) & (first <= 90)) | (first == 0xC3)
    out[:, 13] = length == 0
    first_of = np.zeros(len(lines), bool)
    first_of[np.cumsum(counts) - counts] = True
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            out[i, 8], out[i, 9], out[i, 10] = len(set(words)) / n, sum(map(eq, words, words[1:])) / n, length[i] / n / 10
        if i and not first_of[i] and n and line == lines[i - 1]:
            out[i, 14] = 1
    out[:, 10] = np.minimum(out[:, 10], 5)
    return out, length, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features beside the mean of those of the lines before and after it in its text, and a constant."""
    ends = np.cumsum(counts)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[ends - counts] = own[ends - counts]
    after[ends - 1] = own[ends - 1]
    return np.concatenate([own, (before + after) / 2, np.ones((len(own), 1))], axis=1)


def forward_backward(unary: np.ndarray, steps: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals P(good) of each line and the expected label pairs (2 x 2), over chains of the given lengths.

    ``unary`` is the log odds of good; ``steps`` the 2 x 2 log weights from label to label (bad, good).
    """
    order = np.argsort(-counts, kind="stable")
    sizes, heads = counts[order], (np.cumsum(counts) - counts)[order]
    move = np.exp(steps - steps.max())
    odds = np.clip(unary, -30, 30)
    node = np.stack([1 / (1 + np.exp(odds)), 1 / (1 + np.exp(-odds))], axis=1)
    forward, backward = np.empty_like(node), np.ones_like(node)
    active = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right") if len(sizes) else []
    for t, n in enumerate(active):
        at = heads[:n] + t
        f = node[at] if t == 0 else node[at] * (forward[at - 1] @ move)
        forward[at] = f / f.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 2, -1, -1):
        at = heads[: active[t + 1]] + t
        coming = node[at + 1] * backward[at + 1]
        b = coming @ move.T
        joint = forward[at][:, :, None] * move[None] * coming[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[at] = b / b.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), pairs


@dataclass
class LineField:
    """The weights: all sizes are fixed by the features."""

    weights: np.ndarray
    steps: np.ndarray
    slope: float
    offset: float

    def document_quality(self, own: np.ndarray, length: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean P(good) of each document, weighted by line length, and P(good) of each line."""
        good, _ = forward_backward(with_neighbours(own, counts) @ self.weights, self.steps, counts)
        weight, heads = np.maximum(length, 1), np.cumsum(counts) - counts
        return np.add.reduceat(good * weight, heads) / np.add.reduceat(weight, heads), good

    def score(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * quality + self.offset, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(own: np.ndarray, length: np.ndarray, counts: np.ndarray, label: np.ndarray, *, rounds: int = 200, ridge: float = 1.0) -> LineField:
    """Learn from the lines of labelled documents."""
    if not len(counts) or label.min(initial=1) == label.max(initial=0):
        share = float(label.mean()) if len(counts) else 0.5
        odds = np.log((share + 1e-3) / (1 - share + 1e-3))
        return LineField(np.zeros(2 * len(FEATURES) + 1), np.zeros((2, 2)), 0.0, float(odds))
    of, heads = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    line_label = label[of].astype(float)
    alone = np.concatenate([own, np.ones((len(own), 1))], axis=1)
    balance = np.where(line_label == 1, 0.5 / max(line_label.mean(), 1e-9), 0.5 / max(1 - line_label.mean(), 1e-9))
    looks = alone @ _logistic(alone, line_label, balance, ridge)
    worst = np.minimum.reduceat(looks, heads)
    y = np.where(line_label == 1, 1.0, (looks > np.maximum(worst[of], 0)).astype(float))
    x = with_neighbours(own, counts)
    weights, steps = np.zeros(x.shape[1]), np.zeros((2, 2))
    inside = np.ones(len(y), bool)
    inside[heads] = False
    later = np.flatnonzero(inside)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[later - 1].astype(int), y[later].astype(int)), 1)
    theta, m, v = np.concatenate([weights, steps.ravel()]), 0.0, 0.0
    for i in range(1, rounds + 1):
        weights, steps = theta[:-4], theta[-4:].reshape(2, 2)
        good, pairs = forward_backward(x @ weights, steps, counts)
        grad = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) - ridge * theta
        grad /= len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + (0.15 * (1 - i / rounds) + 0.005) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    field = LineField(theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    quality, _ = field.document_quality(own, length, counts)
    curve = _logistic(np.stack([quality, np.ones(len(quality))], axis=1), label.astype(float), np.ones(len(label)), 0.01)
    field.slope, field.offset = float(curve[0]), float(curve[1])
    return field


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            own, length, _ = line_features([batch.column(1)[i].as_py()])
            features = pa.array([own.astype("<f4").tobytes()], pa.binary()), pa.array([length.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in (0, 2, 3)), *features], ["label", "of_id", "of_text", "own", "length"])


def held_out(doc_id="doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 6000, most_lines: int = 300) -> LineField:
    """Fit on the driver from a bounded sample: at most ``sample_rows`` labelled documents that are not held out (those of
    smallest id hash) with at most ``most_lines`` lines. Where ids repeat, at most twice as many rows by the hashes of id and
    text: the same rows whatever their order, so that the same input gives the same model.

    Null ids and labels other than 0 and 1 are not learned from; a null text is an empty one; without labelled rows, as of
    empty tables, the model is the one that knows nothing; further columns, of whatever names, are not read.
    """
    common.ship(docs.sparkSession)
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    chosen = usable.select(F.col("doc_id").cast("long").alias("labelled_id"), F.col("quality").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("labelled_id"), "labelled_id", "label").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.string_or_empty("text").alias("text"))
    texts = texts.where(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < most_lines)
    # Of bounded size: sample_rows lines of two numbers.
    joined = texts.join(F.broadcast(chosen), texts.doc_id == chosen.labelled_id).select("label", "text", F.xxhash64("doc_id").alias("of_id"), F.xxhash64("text").alias("of_text"))
    rows = joined.mapInArrow(_featured, "label int, of_id long, of_text long, own binary, length binary").orderBy("of_id", "of_text", "label").limit(2 * sample_rows).collect()
    own = [np.frombuffer(r["own"], "<f4").reshape(-1, len(FEATURES)) for r in rows]
    if not rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    length = np.concatenate([np.frombuffer(r["length"]) for r in rows])
    return fit(np.concatenate(own).astype(np.float64), length, np.array([len(x) for x in own]), np.array([r["label"] for r in rows]))


def _scored(field: LineField, with_lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                own, length, counts = line_features(part.column(part.num_columns - 1).to_pylist())
                quality, good = field.document_quality(own, length, counts)
                columns = [*part.columns[:-1], pa.array(field.score(quality))]  # all but the text, and the score
                names = [*part.schema.names[:-1], "score"]
                if with_lines:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(good)))
                    names.append("line_good")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def score(docs: DataFrame, field: LineField, *, with_lines: bool = False) -> DataFrame:
    """(doc_id, score) of each row, and with ``with_lines`` P(good) of each of its lines.

    * a null text counts as empty; an empty text is one empty line and is scored like any other; texts of any length are
      scored whole, line by line; equal texts have equal scores;
    * repeated rows stay repeated; a null doc_id stays null; an empty table gives an empty result;
    * further columns are ignored: only the text is an input.
    """
    common.ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.string_or_empty("text").alias("text"))
    return texts.mapInArrow(_scored(field, with_lines), "doc_id long, score double" + ", line_good array<double>" * with_lines)


def accepted(docs: DataFrame, field: LineField, keep_from: float) -> DataFrame:
    """The rows, with all their columns, whose text scores ``keep_from`` or more.

    * a null text counts as empty, and empty texts have a score like any other; null and repeated ids are nothing special;
    * texts of any length are scored whole; a score of just ``keep_from`` is kept; equal texts are kept or rejected alike;
    * an empty table gives an empty result; columns keep their names, whatever these are.
    """
    common.ship(docs.sparkSession)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), common.string_or_empty("text").alias("text"))
    kind = packed.select("row", F.lit(0.0).alias("score")).schema
    return packed.mapInArrow(_scored(field, False), kind).where(F.col("score") >= keep_from).select("row.*")
