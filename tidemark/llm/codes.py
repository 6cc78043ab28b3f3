"""Vectors as short codes: each of a few equal parts by its nearest entry of a codebook, in whole numbers throughout.

The nearest entry is found by branch and bound in a ball tree over the entries of a part's position. Balls are compared in
floating point, with radii and bounds rounded to the safe side and balls visited when their bound only equals the best
distance so far; what decides are squared distances of whole numbers, ties to the lower index. A task sends all vectors of
an Arrow batch down the tree together. Codebooks are a few hundred entries; sums for the next round are made in the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Entries of a ball that is not split any more.
LEAF = 16
#: Relative error that bounds allow for; that of double precision is a thousandth of it.
SLACK = 1e-12
LARGEST = 2**63 - 1


@dataclass
class Ball:
    """Entries within ``radius`` of ``centre``: two balls, or their indexes, ascending."""

    centre: np.ndarray
    radius: float
    members: np.ndarray | None = None
    near: Ball | None = None
    far: Ball | None = None


def _lengths(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centre) ** 2).sum(axis=1))


def ball_tree(entries: np.ndarray, members: np.ndarray | None = None) -> Ball:
    """The tree over the rows of ``entries`` (floats), halved along the line between two that lie far apart."""
    members = np.arange(len(entries)) if members is None else members
    own = entries[members]
    centre = own.mean(axis=0)
    away = _lengths(own, centre)
    reach = float(away.max())
    ball = Ball(centre, reach + SLACK * (reach + float(np.abs(own).max(initial=0.0)) + 1))
    if len(members) <= LEAF or reach == 0:
        ball.members = members
        return ball
    one = own[int(away.argmax())]
    other = own[int(_lengths(own, one).argmax())]
    order = np.argsort((own - one) @ (other - one), kind="stable")
    half = len(order) // 2
    ball.near, ball.far = (ball_tree(entries, np.sort(members[part])) for part in (order[:half], order[half:]))
    return ball


def _exact_in(x: np.ndarray, entries: np.ndarray) -> type:
    """What squared distances of these whole numbers are exact in: doubles, 64 bits or Python's numbers."""
    most = max(abs(int(v)) for a in (x, entries) for v in (a.min(initial=0), a.max(initial=0)))
    bound = 4 * most * most * max(1, x.shape[1])
    return np.float64 if bound < 2**52 else np.int64 if bound < 2**62 else object


def _squares(x: np.ndarray, entries: np.ndarray, kind: type) -> np.ndarray:
    """Exact squared distances of all rows, computed in ``kind``."""
    a, b = x.astype(kind), entries.astype(kind)
    if kind is np.float64:
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((a - e) ** 2).sum(axis=1) for e in b], axis=1)


def nearest(tree: Ball, entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x`` the index of the nearest entry, ties to the lower, and the squared distance (Python numbers if
    they are beyond 64 bits)."""
    at, kind = np.full(len(x), len(entries), dtype=np.int64), _exact_in(x, entries)
    best = np.full(len(x), 2**200, dtype=object) if kind is object else np.full(len(x), LARGEST, dtype=np.int64)
    floats = x.astype(np.float64)
    least = SLACK * (np.abs(floats).max(axis=1, initial=0.0) + 1)

    def may_hold(ball: Ball, who: np.ndarray, length: np.ndarray) -> np.ndarray:
        bound = length * (1 - SLACK) - ball.radius - least[who]
        return who[(bound <= 0) | (bound * bound * (1 - SLACK) <= best[who].astype(np.float64) * (1 + SLACK))]

    def visit(ball: Ball, who: np.ndarray) -> None:
        if not len(who):
            return
        if ball.members is not None:
            square = _squares(x[who], entries[ball.members], kind)
            first = square.argmin(axis=1)
            d, i = square[np.arange(len(who)), first], ball.members[first]
            better = (d < best[who]) | ((d == best[who]) & (i < at[who]))
            best[who[better]], at[who[better]] = d[better], i[better]
            return
        to_near, to_far = _lengths(floats[who], ball.near.centre), _lengths(floats[who], ball.far.centre)
        first = to_near <= to_far
        visit(ball.near, may_hold(ball.near, who[first], to_near[first]))
        visit(ball.far, may_hold(ball.far, who[~first], to_far[~first]))
        visit(ball.far, may_hold(ball.far, who[first], to_far[first]))
        visit(ball.near, may_hold(ball.near, who[~first], to_near[~first]))

    visit(tree, np.arange(len(x)))
    return at, best


def _parts(column: pa.ListArray, parts: int, width: int) -> np.ndarray:
    """(part, vector, position) of a column of lists of ``parts`` x ``width`` whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), parts, width).transpose(1, 0, 2)


def _sums(rows: DataFrame, books: list[np.ndarray], width: int) -> list:
    """(part, entry, position, high, low, n) summed over all rows: the sum of a component is high * 2^32 + low."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [ball_tree(b.astype(np.float64)) for b in books]
        high, low = (np.zeros((len(books), len(books[0]), width), dtype=np.int64) for _ in range(2))
        n = np.zeros((len(books), len(books[0])), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, x in enumerate(_parts(batch.column(0), len(books), width)):
                at = nearest(trees[p], books[p], x)[0]
                np.add.at(high[p], at, x >> 32)
                np.add.at(low[p], at, x & 0xFFFFFFFF)
                n[p] += np.bincount(at, minlength=len(books[p]))
        p, e = np.nonzero(n)
        each = [np.repeat(v, width) for v in (p, e, n[p, e])]
        columns = [each[0], each[1], np.tile(np.arange(width), len(p)), high[p, e].ravel(), low[p, e].ravel(), each[2]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["part", "entry", "position", "high", "low", "n"])

    found = rows.select("q").mapInArrow(collect, "part long, entry long, position long, high long, low long, n long")
    return found.groupBy("part", "entry", "position").agg(F.sum("high"), F.sum("low"), F.sum("n")).collect()  # bounded by the codebooks


def _encoded(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [ball_tree(b.astype(np.float64)) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            code = np.zeros((batch.num_rows, len(books)), dtype=np.uint8)
            error = [0] * batch.num_rows
            for p, x in enumerate(_parts(batch.column(2), len(books), width)):
                code[:, p], square = nearest(trees[p], books[p], x)
                error = [a + int(b) for a, b in zip(error, square, strict=True)]
            texts = [row.tobytes().hex() for row in code]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts), pa.array([min(e, LARGEST) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "q").mapInArrow(encode, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def whole_numbers(embeddings: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, q): vectors without nulls and of finite components only, each component floor(scale * x)."""
    v = F.col("embedding").cast("array<double>")
    fit = F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = embeddings.select("vec_id", "label", v.alias("v")).where(fit)
    return rows.select("vec_id", "label", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("q"))


def product_codes(embeddings: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> DataFrame:
    """Codes of all vectors by codebooks that ``rounds`` assignments have improved.

    Components become floor(scale * x); vectors are cut into ``parts`` equal parts; each part's codebook starts as that part
    of the vectors of the ``entries`` (at most 256) smallest vec_ids. Returns (vec_id, code, error, label_error,
    codebooks_sha256), two hex digits a part. The table is read ``rounds`` + 3 times: give one that is written.

    * vectors that are null or hold null or non-finite components have no line;
    * vectors of another length than the commonest that the parts divide (ties to the shorter), empty ones too, have none;
    * fewer vectors than ``entries``: so many entries; none: an empty result;
    * repeated vec_ids: a line each; at the start they are taken in order of their components; null vec_ids come last;
    * null labels are one label; labels, however common, are joined in 16 shares;
    * components are held within 64 bits; errors are held at 2^63 - 1; further columns are not read.
    """
    spark = embeddings.sparkSession
    common.ship(spark)
    rows = whole_numbers(embeddings, scale)
    length = F.size("q")
    usual = rows.where((length > 0) & (length % parts == 0)).groupBy(length.alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        empty = embeddings.select("vec_id").limit(0)
        return empty.select("vec_id", *(F.lit(None).cast(kind).alias(name) for name, kind in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    size = usual["size"]
    width, rows = size // parts, rows.where(length == size)
    start = rows.orderBy(F.asc_nulls_last("vec_id"), "q").select("q").limit(min(entries, 256)).collect()
    first = np.array([r["q"] for r in start], dtype=np.int64).reshape(len(start), parts, width)
    books = [first[:, p, :].copy() for p in range(parts)]
    for _ in range(rounds):
        for part, entry, position, high, low, n in _sums(rows, books, width):
            books[part][entry, position] = ((high << 32) + low) // n
    said = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    coded = common.checkpointed(_encoded(rows, books, width))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    shares = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("of_share")
    labels = coded.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error")).select("of_label", "label_error", shares)
    share = F.pmod(F.xxhash64("vec_id", "code"), F.lit(16)).cast("int")
    joined = coded.withColumn("share", share).join(labels, F.col("label").eqNullSafe(F.col("of_label")) & (F.col("share") == F.col("of_share")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
