"""Resampling towards a target: the automaton and the whole draw against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
HARD = [None, "", "  .,;  ", "a", "A", "Hello World été 日本 x", "y" * 200 + " q " + "z" * 70, "A-b_c9", "same same same", "x" * 5000 + " " + "word " * 3000]


def features(text, longest=2):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def plain(docs, target, percent, least, buckets, longest, seed):
    s, t = (Counter(bucket(f, buckets) for x in texts for f in features(x, longest)[1]) for texts in ([x for _, x in docs], target))
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(buckets)]
    lines, able = [], []
    for i, x in docs:
        n, found = features(x, longest)
        weight = sum(gain[bucket(f, buckets)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        lines.append([i, len(found), weight, score, None])
        if n >= least:
            able.append(len(lines) - 1)
    able.sort(key=lambda k: (-lines[k][3], (lines[k][0] is not None, lines[k][0] or 0), lines[k][1]))
    for rank, k in enumerate(able[: percent * len(able) // 100], 1):
        lines[k][4] = rank
    return sorted(map(tuple, lines), key=repr)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("aB é9-_ \x00日c ") for _ in range(rng.randint(0, 90))) for _ in range(n)]


@pytest.mark.parametrize("piece", [1 << 20, 40, 7])
@pytest.mark.parametrize("longest", [1, 2, 3])
def test_automaton(monkeypatch, piece, longest):
    monkeypatch.setattr(importance, "PIECE", piece)
    texts = HARD[:8] + random_texts(80)
    for array in (pa.array(texts), pa.array(["gone", *texts])[1:], pa.array(texts, pa.large_string())):
        for i, j, data, offsets in importance._slices(array):
            if j == i + 1 and len(data) > piece:
                counts, words = importance._of_long(data, 50, longest)
                wanted = features(texts[i], longest)
                assert words == wanted[0]
                assert np.array_equal(counts, np.bincount([bucket(f, 50) for f in wanted[1]], minlength=50))
                continue
            text, found = importance.hashed(data, offsets, 50, longest)
            for k in range(i, j):
                assert sorted(found[text == k - i]) == sorted(bucket(f, 50) for f in features(texts[k], longest)[1])


@pytest.mark.parametrize(("longest", "percent", "least", "seed"), [(2, 25, 20, 7), (3, 50, 1, 1), (1, 100, 0, 2)])
def test_draw(spark, longest, percent, least, seed):
    texts = HARD + random_texts(150) + [HARD[-1], "one text " * 15, "one text " * 15, "one text " * 20]
    ids = [None, None, *range(len(texts) - 6), 7, 7, 7, 7]
    df = spark.createDataFrame(list(zip(ids, texts, ["s"] * len(ids))), "doc_id long, text string, score string")
    for name in ("rank", "at", "copies", "n_words", "bucket"):
        df = df.withColumn(name, F.lit("clash"))
    target = spark.createDataFrame([(0, "hello world 日本"), (1, None), (2, "one text b c")], "item_id long, text string")
    got = importance.resampled(df.repartition(3), target, percent=percent, least_words=least, buckets=97, longest=longest, seed=seed)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == plain(list(zip(ids, texts)), ["hello world 日本", None, "one text b c"], percent, least, 97, longest, seed)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (2, "a b")], "doc_id long, text string")
    assert importance.resampled(none, some).count() == 0
    got = importance.resampled(some, none, percent=50, least_words=1).toPandas()
    assert sorted(got.doc_id) == [1, 2] and got["rank"].dropna().tolist() == [1]
