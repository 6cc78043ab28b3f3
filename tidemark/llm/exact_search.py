"""Exact top-k search by inner product over quantised vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common, tiles


def exact_top_k(embeddings: DataFrame, is_query, k: int = 5, *, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row that satisfies ``is_query`` the k rows of largest integer inner product of floor(scale * x).

    Tiled matrix products of query blocks and row shards, partial selection in each tile, lists merged per query.
    Returns (query_id, rank, vec_id, score), ties to the smaller id.

    * null ids, null or empty vectors, null or non-finite components: the row takes no part;
    * vectors of different length never meet; a query without candidates has no lines;
    * repeated ids: they count as one row, with the best of their scores, and are never their own neighbours;
    * scores beyond 64 bits are saturated; an empty table gives an empty result; further columns are ignored.
    """
    common.ship(embeddings.sparkSession)
    rows = tiles.usable(embeddings, id_col, vector_col)
    rows = rows.select(F.lit(0).alias("g"), "vec_id", F.transform("v", lambda x: F.rint(F.floor(x * scale).cast("double"))).alias("v"))
    asked = F.coalesce(is_query(F.col("vec_id")), F.lit(False))
    total, components = rows.agg(F.count("*"), F.sum(F.when(asked, F.size("v")))).first()
    return tiles.tiled_top_k(rows, rows.where(asked), k, {0: total}, 8.0 * (components or 0), whole=True)
