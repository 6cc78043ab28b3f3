"""Resampling towards a target distribution: hashed n-grams, log ratios of two corpora, Gumbel noise, the best drawn.

The features are found by a byte automaton over the UTF-8 buffers that Arrow hands over: a lookup table gives each byte its
lower-cased value and whether it belongs to a word, differences of that give the words' boundaries, and one table-driven
CRC-32 advances over all words of a buffer at once, byte by byte; a run of two words goes on from the first one's register.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: The reflected polynomial of CRC-32, and the bytes of words once A-Z are lower-cased.
POLYNOMIAL = 0xEDB88320
WORD_BYTES = [(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)]
#: Bytes of text that one pass of the automaton takes; longer texts go in pieces that share a word.
PIECE = 1 << 20
#: Bytes of a word that go in step with those of all others; what is left of longer words is summed word by word.
IN_STEP = 48


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


def _lower_table() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[0x41:0x5B] += 0x20
    return low


TABLE, LOWER = _crc_table(), _lower_table()
IS_WORD = np.zeros(256, dtype=bool)
for _first, _last in WORD_BYTES:
    IS_WORD[_first : _last + 1] = True


def _advanced(register: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The registers after the bytes of their words, all words in step. ``sizes`` fall."""
    register = register.copy()
    for k in range(min(int(sizes[0]) if len(sizes) else 0, IN_STEP)):
        n = int(np.searchsorted(-sizes, -k, side="left"))
        r = register[:n]
        register[:n] = TABLE[(r ^ data[starts[:n] + k]) & 0xFF] ^ (r >> np.uint32(8))
    for i in range(int(np.searchsorted(-sizes, -IN_STEP, side="left"))):
        rest = data[starts[i] + IN_STEP : starts[i] + sizes[i]].tobytes()
        # zlib takes and gives the register inverted.
        register[i] = zlib.crc32(rest, int(register[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return register


def hashed(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each feature of the texts that lie one after the other in ``data``."""
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = IS_WORD[data]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # A text's end also ends a word, though the next text may go on with a word byte.
    bounds = offsets[1:-1]
    cut = np.unique(bounds[(inside[bounds] == 1) & (inside[bounds + 1] == 1)])
    starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
    text = np.searchsorted(offsets, starts, side="right") - 1
    sizes = ends - starts

    def fed(register: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The registers, each advanced over its word."""
        place = np.argsort(-sizes[words], kind="stable")
        out = np.empty_like(register)
        out[place] = _advanced(register[place], data, starts[words][place], sizes[words][place])
        return out

    every = np.arange(len(starts))
    register = fed(np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32), every)
    texts, found, run = [text], [register], every
    for n in range(1, longest):
        keep = run + n < len(starts)
        run, register = run[keep], register[keep]
        same = text[run] == text[run + n]
        run, register = run[same], register[same]
        spaced = TABLE[(register ^ np.uint32(0x20)) & 0xFF] ^ (register >> np.uint32(8))
        register = fed(spaced, run + n)
        texts.append(text[run])
        found.append(register)
    return np.concatenate(texts), ((np.concatenate(found) ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)


def _pieces(data: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, int]]:
    """A long text in pieces, and how many words at a piece's start the piece before has counted already: a piece begins with
    the last ``longest`` - 1 words of the one before it."""
    start, shared, end = 0, 0, 0
    while True:
        end = min(max(start + PIECE, end + 1), len(data))
        while end < len(data):  # to the end of a word
            gap = np.flatnonzero(~IS_WORD[LOWER[data[end : end + PIECE]]])
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + PIECE, len(data))
        yield data[start:end], shared
        if end == len(data):
            return
        inside = IS_WORD[LOWER[data[start:end]]]
        words = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)) == 1)
        back = words[-(longest - 1) :] if longest > 1 else words[:0]
        shared = len(back)
        start = start + int(back[0]) if shared else end


def _of_long(data: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, int]:
    """Features per bucket and words of one text of any length."""
    counts, words = np.zeros(buckets, dtype=np.int64), 0
    for piece, shared in _pieces(data, longest):
        bounds = np.array([0, len(piece)], dtype=np.int64)
        counts += np.bincount(hashed(piece, bounds, buckets, longest)[1], minlength=buckets)
        lower = LOWER[piece]
        n = int((np.diff(np.concatenate(([False], IS_WORD[lower])).astype(np.int8)) == 1).sum())
        words += n - shared
        if shared:  # features that lie within the shared words are counted twice
            last = np.flatnonzero(np.diff(np.concatenate(([False], IS_WORD[lower], [False])).astype(np.int8)) == -1)[shared - 1]
            counts -= np.bincount(hashed(piece[: last], np.array([0, last], dtype=np.int64), buckets, longest)[1], minlength=buckets)
    return counts, words


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of stretches of texts of about ``PIECE`` bytes, without copying what Arrow holds."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def bucket_counts(docs: DataFrame, buckets: int, longest: int) -> DataFrame:
    """(bucket, n): how often all texts of ``docs`` hold a feature of each bucket; summed within the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for i, j, data, offsets in _slices(batch.column(0)):
                if j == i + 1 and len(data) > PIECE:
                    total += _of_long(data, buckets, longest)[0]
                else:
                    total += np.bincount(hashed(data, offsets, buckets, longest)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Of each bucket 1,000 times the log ratio of its share in ``target`` to that in ``source``, both smoothed by one."""
    s, t = (dict(map(tuple, bucket_counts(d, buckets, longest).collect())) for d in (source, target))  # one line a bucket
    all_s, all_t = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    ratio = lambda b: (float(t.get(b, 0) + 1) * all_s) / (float(s.get(b, 0) + 1) * all_t)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], dtype=np.int64)


def _noise(doc_id, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each document; ``gain`` has one number a bucket."""
    buckets, schema = len(gain), docs.select("doc_id").schema
    kind = schema[0].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            words, features, total = (np.zeros(len(ids), dtype=np.int64) for _ in range(3))
            for i, j, data, offsets in _slices(batch.column(1)):
                if j == i + 1 and len(data) > PIECE:
                    counts, words[i] = _of_long(data, buckets, longest)
                    features[i], total[i] = counts.sum(), (counts * gain).sum()
                    continue
                text, bucket = hashed(data, offsets, buckets, longest)
                features[i:j] = np.bincount(text, minlength=j - i)
                total[i:j] = _sums(text, gain[bucket], j - i)
                words[i:j] = _words(features[i:j], longest)
            weight = np.where(features > 0, total // np.maximum(features, 1), 0)
            noise = np.array([_noise(x, seed) for x in ids], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight, weight + noise))], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(score, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def _sums(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, text, values)
    return out


def _words(features: np.ndarray, longest: int) -> np.ndarray:
    """The number of words that have so many runs of at most ``longest`` words."""
    short = np.cumsum(np.arange(longest + 1))  # w words, w < longest, have w + (w - 1) + ... + 1 runs
    few = np.searchsorted(short, features)
    return np.where(features <= short[-1], few, (features + longest * (longest - 1) // 2) // longest)


def resampled(docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, buckets: int = 10_000, longest: int = 2, seed: int = 7) -> DataFrame:
    """Draw ``percent`` of the documents with at least ``least_words`` words so that their features follow ``target``'s.

    Returns (doc_id, n_features, weight, score, rank) of every document; the drawn ones have ranks 1, 2, 3, ... from the
    highest score on, ties to the smaller doc_id, the others null. ``docs`` is read twice, ``target`` once.

    * null text: an empty one, without features, weight 0, never drawn if ``least_words`` is above 0;
    * null doc_id: its noise is that of an empty id, and it comes before other ids in ties; repeated ids: each row has a
      line of its own, rows of equal id, weight and features share neither more nor less than consecutive ranks;
    * very long texts go through the automaton in pieces that share a word, so memory depends on the longest word only;
    * an empty target weighs all features by their rarity in ``docs``; empty ``docs`` give an empty result;
    * further columns, of whatever names, are not read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.select("doc_id", "text")
    gain = gains(docs, target.select("text"), buckets, longest)
    rows = common.checkpointed(scored(docs, gain, longest, seed))
    able = F.col("n_words") >= least_words
    # There are few scores, however many documents: gains and noise lie within some 90,000 of zero.
    histogram = rows.where(able).groupBy("score").count().collect()
    left = sum(r["count"] for r in histogram) * percent // 100
    before, ahead = [], 0
    for score, count in sorted(map(tuple, histogram), reverse=True):
        if ahead >= left:
            break
        before.append((score, ahead))
        ahead += count
    starts = F.broadcast(spark.createDataFrame(before, "at long, ahead long"))
    best = able & (F.col("score") >= (before[-1][0] if before else 2**63 - 1))
    # Equal rows share a line until the ranks are known, so that no id is too common for the window.
    lines = rows.where(best).groupBy("score", "doc_id", "n_features", "weight").agg(F.count("*").alias("copies"))
    upto = F.sum("copies").over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features").rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.withColumn("upto", upto).join(starts, F.col("score") == F.col("at"))
    last = F.col("ahead") + F.col("upto")
    placed = placed.withColumn("rank", F.explode(F.sequence(last - F.col("copies") + 1, last)))
    rank = F.when(F.col("rank") <= left, F.col("rank")).alias("rank")
    rest = rows.where(~best).withColumn("rank", F.lit(None).cast("long"))
    columns = ("doc_id", "n_features", "weight", "score")
    return placed.select(*columns, rank).unionByName(rest.select(*columns, "rank"))
