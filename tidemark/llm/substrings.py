"""Removal of repeated passages: Rabin-Karp hashes of every window of words, counted in Spark, merged to intervals.

Most windows are unique. So each document first says the least hash of the word runs inside each of its windows: equal
windows have equal least runs, so a window whose least run is in one document only cannot repeat. The hashes of the other
windows are counted over all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: An odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A null id counts as this one: after all others.
LAST = (1 << 63) - 1
_KNOWN: dict[str, int] = {}
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _hashes(words: list[str]) -> np.ndarray:
    if len(_KNOWN) > 500_000:
        _KNOWN.clear()
    get, digest = _KNOWN.get, xxhash.xxh64_intdigest
    out = [get(w) for w in words]
    for i, h in enumerate(out):
        if h is None:
            out[i] = _KNOWN[words[i]] = digest(words[i].encode("utf-8", "surrogatepass"))
    return np.array(out, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, b in enumerate((BASE, INVERSE)):
            _POWERS[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]), dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def rolling(words: list[str], width: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``width`` words its hash and the least hash of its runs of ``run`` words."""
    n = len(words)
    power, inverse = _powers(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_hashes(words) * power, dtype=np.uint64)])
    windows = _mixed((sums[width:] - sums[:-width]) * inverse[: n - width + 1])
    least = _mixed((sums[run:] - sums[:-run]) * inverse[: n - run + 1])
    span, have = width - run + 1, 1
    while have < span:
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return windows, least


def _runs(width: int, run: int):
    """Lines (m, x, d): the least runs of each row, and two hashes of its whole sequence of words.

    ``x`` is the row's key, whose two lowest bits are free, with the line's kind in them: 0 a run, 1 and 2 the whole.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(common.WORD).findall
        for batch in batches:
            m, x, d = [], [], []
            for doc, text, key in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = split(text.as_py())
                if len(words) < width:
                    continue
                least = np.unique(rolling(words, width, run)[1])
                joined = " ".join(words).encode("utf-8", "surrogatepass")
                m += [least, np.array([xxhash.xxh64_intdigest(joined, 1), xxhash.xxh64_intdigest(joined, 2)], np.uint64)]
                x += [np.full(len(least), key, np.int64), np.array([key | 1, key | 2], np.int64)]
                d.append(np.full(len(least) + 2, doc, np.int64))
            if d:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(m).view("i8")), pa.array(np.concatenate(x)), pa.array(np.concatenate(d))], ["m", "x", "d"])

    return go


def _windows(width: int, run: int):
    """Lines (m, w, d, k): the distinct windows of a row whose least run is one of those given."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(common.WORD).findall
        for batch in batches:
            for i in range(batch.num_rows):
                words = split(batch.column(1)[i].as_py())
                if len(words) < width:
                    continue
                windows, least = rolling(words, width, run)
                wanted = np.asarray(batch.column(2)[i].values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                at = np.isin(least, wanted)
                windows, first = np.unique(windows[at], return_index=True)
                if len(windows):
                    row = (np.full(len(windows), batch.column(c)[i].as_py(), np.int64) for c in (0, 3))
                    columns = least[at][first].view("i8"), windows.view("i8"), *row
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["m", "w", "d", "k"])

    return go


def _kept(width: int, run: int):
    """Lines (d, n_words, removed, kept): the maximal removal intervals of a document and the words left."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(common.WORD).findall
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                counts, spans, kept = [], [], []
                for text, copy, known in zip(part.column(1), part.column(2), part.column(3), strict=True):
                    words = split(text.as_py())
                    n, found = len(words), []
                    if copy.as_py() and n >= width:
                        found, words = [(0, n)], []
                    elif known.is_valid and n >= width:
                        hashes = np.asarray(known.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                        hit = np.isin(rolling(words, width, run)[0], hashes).astype(np.int32)
                        edge = np.zeros(n + 1, np.int32)
                        edge[: n - width + 1] += hit
                        edge[width:] -= hit
                        covered = np.cumsum(edge)[:n] > 0
                        turns = np.flatnonzero(np.diff(np.concatenate([[0], covered, [0]]).astype(np.int8)))
                        found = list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))
                        words = [w for w, c in zip(words, covered, strict=True) if not c]
                    counts.append(n)
                    spans.append([{"start": a, "end": b} for a, b in found])
                    kept.append(" ".join(words))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], ["d", "n_words", "removed", "kept"])

    return go


def repeated_passages(docs: DataFrame, *, width: int = 50, run: int = 10) -> DataFrame:
    """(doc_id, n_words, removed array<struct<start, end>>, kept string) for each row.

    A word goes if it is covered by a window of ``width`` consecutive words whose sequence also starts in a document of
    smaller doc_id. ``removed`` holds the maximal intervals of word numbers, end exclusive; ``kept`` the other words,
    joined by one space.

    * a null text has no words; texts shorter than a window stay as they are; texts of any length are read whole;
    * of documents that tie in a window the smallest doc_id keeps it;
    * a null doc_id counts as one id after all others; rows of one id never remove each other's words;
    * repeats within one document stay; an empty table gives an empty result; further columns are ignored.
    """
    common.ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), common.string_or_empty("text").alias("text"))
    # Rows may share an id, so what is found is kept by id and text.
    texts = texts.withColumn("k", F.xxhash64("text").bitwiseAND(-4))
    runs = common.checkpointed(texts.select("d", "text", "k").mapInArrow(_runs(width, run), "m long, x long, d long"))
    kind = F.col("x").bitwiseAND(3)
    shared = runs.groupBy("m", kind.alias("kind")).agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select(F.col("m").alias("of_m"), F.col("kind").alias("of_kind"), "lo")
    met = runs.join(shared, (F.col("m") == F.col("of_m")) & (kind == F.col("of_kind")))
    marks = met.groupBy("d", F.col("x").bitwiseAND(-4).alias("k")).agg(
        F.collect_set(F.when(kind == 0, F.col("m"))).alias("ms"), F.collect_set(F.when((kind == 0) & (F.col("lo") < F.col("d")), F.col("m"))).alias("later"),
        (F.max((kind == 1) & (F.col("lo") < F.col("d"))) & F.max((kind == 2) & (F.col("lo") < F.col("d")))).alias("copy"),
    )

    def windows(runs_of: str) -> DataFrame:
        # A copy repeats a smaller document word for word: all of it goes, and what it repeats is known from the other.
        wanted = marks.where(~F.col("copy") & (F.size(runs_of) > 0)).select("d", "k", F.col(runs_of).alias("ms"))
        return texts.join(wanted.hint("shuffle_hash"), ["d", "k"]).select("d", "text", "ms", "k").mapInArrow(_windows(width, run), "m long, w long, d long, k long")

    first = windows("ms").groupBy("m", "w").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("m", "w", "lo")
    # A window whose run is in no smaller document is in none either: it counts above, but need not be asked for here.
    repeats = windows("later").join(first, ["m", "w"]).where("lo < d").groupBy("d", "k").agg(F.collect_set("w").alias("ws"))
    judged = marks.select("d", "k", "copy").join(repeats, ["d", "k"], "full")
    judged = texts.join(judged.hint("shuffle_hash"), ["d", "k"], "left").select("d", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "ws")
    found = judged.mapInArrow(_kept(width, run), "d long, n_words long, removed array<struct<start: bigint, end: bigint>>, kept string")
    return found.select(F.when(F.col("d") != LAST, F.col("d")).alias("doc_id"), "n_words", "removed", "kept")
