"""Sums over all pairs of many series, by products of blocks of their matrix.

Series are dealt to tiles, their places to blocks. For each block and pair of tiles one matrix product gives the sums of all
pairs of their series, with a second matrix that says where there are values, so that missing places count on neither side.
Only pairs of tiles are joined, never the values of pairs of series.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import checkpointed

# What the workers run goes to them by value, so that they need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Series of a tile and places of a block.
TILE, BLOCK = 128, 512
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _matrix(names: list, places: np.ndarray, values: np.ndarray, base: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Names in order, and (place, name) matrices of values, zero where there is none, and of where there are some."""
    own, column = np.unique(np.array(names, dtype=object), return_inverse=True)
    x, there = np.zeros((BLOCK, len(own))), np.zeros((BLOCK, len(own)))
    x[places - base, column], there[places - base, column] = values, 1.0
    return list(own), x, there


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        book, block, names_a, places_a, values_a, names_b, places_b, values_b, same = (batch.column(i) for i in range(9))
        flat = lambda column, i: column[i].values.to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            base = block[i].as_py() * BLOCK
            a, x, in_x = _matrix(names_a[i].as_py(), flat(places_a, i), flat(values_a, i), base)
            b, y, in_y = (a, x, in_x) if same[i].as_py() else _matrix(names_b[i].as_py(), flat(places_b, i), flat(values_b, i), base)
            sums = {"n": in_x.T @ in_y, "sx": x.T @ in_y, "sy": in_x.T @ y, "sxx": (x * x).T @ in_y, "syy": in_x.T @ (y * y), "sxy": x.T @ y}
            met = sums["n"] > 0
            if same[i].as_py():
                met &= np.triu(np.ones_like(met))
            p, q = np.nonzero(met)
            columns = [pa.array([a[k] for k in p], pa.string()), pa.array([b[k] for k in q], pa.string()), *(pa.array(sums[s][p, q]) for s in SUMS)]
            books = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(p), dtype=np.int32)), book.slice(i, 1)).cast(book.type)
            yield pa.RecordBatch.from_arrays([books, *columns], ["book", "a", "b", *SUMS])


def pair_moments(rows: DataFrame) -> DataFrame:
    """(book, a, b, n, sx, sy, sxx, syy, sxy) of all pairs of names of a book that have places in common, a name with itself
    too, over those places. ``rows`` has book, ticker, place (a whole number from 0, once a name) and x, without nulls.

    Which of two names is a and which b is not said; pairs come once.
    """
    kind = rows.schema["book"].dataType.simpleString()
    rows = checkpointed(rows.select("book", "ticker", "place", "x"))
    names = rows.groupBy("book").agg(F.countDistinct("ticker").alias("n")).agg(F.max("n")).first()[0] or 1
    tile, block = F.pmod(F.xxhash64("ticker"), F.lit(-(-names // TILE))).cast("int"), F.floor(F.col("place") / BLOCK).cast("long")
    packed = rows.where("x IS NOT NULL").groupBy("book", tile.alias("tile"), block.alias("block")).agg(F.collect_list(F.struct("ticker", F.col("place").cast("long").alias("place"), "x")).alias("v"))
    side = lambda s: packed.select(F.col("book").alias(f"book_{s}"), F.col("tile").alias(f"tile_{s}"), F.col("block").alias(f"block_{s}"), F.col("v").alias(f"v_{s}"))
    met = side("a").join(side("b"), F.expr("book_a <=> book_b AND block_a = block_b AND tile_a <= tile_b"))
    tiles = met.select("book_a", "block_a", *(F.col(f"v_{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("ticker", "place", "x")), (F.col("tile_a") == F.col("tile_b")).alias("same"))
    sums = tiles.mapInArrow(_products, f"book {kind}, a string, b string, {', '.join(f'{s} double' for s in SUMS)}")
    return sums.groupBy("book", "a", "b").agg(*(F.sum(s).alias(s) for s in SUMS))
