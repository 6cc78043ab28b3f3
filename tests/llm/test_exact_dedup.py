"""Exact duplicates by the stream against plain Python: any batches, digests that collide, and the edge cases."""

import hashlib
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup

#: (doc_id, text): copies far apart, empty texts, nulls, repeated ids, one long text twice.
ROWS = [(k, f"text {k % 37}" if k % 3 else f"own {k}") for k in range(120)]
ROWS += [(200, None), (201, ""), (202, " "), (None, "text 1"), (None, "only null"), (None, "only null"), (7, "text 1"), (118, "text 1"), (7, "text 7"), (7, "text 7"), (300, "long " * 50_000), (301, "long " * 50_000), (302, "Text 1")]


def write(tmp_path, rows, files, reverse=False, extra=True):
    folder = tmp_path / "documents.parquet"
    folder.mkdir()
    for k in range(files):
        part = pd.DataFrame(rows[k::files], columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
        if extra:
            part = part.assign(file="clash", row="clash", digest="clash", known="clash", n="clash", _metadata="clash")
        part.to_parquet(folder / f"part-{(files - k if reverse else k):03d}.parquet")
    return str(folder)


def plain(rows, normal=lambda t: t):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t or "")].append(i)
    return sorted(((i, max((x for x in groups[normal(t or "")] if x is not None), default=None), len(groups[normal(t or "")]), hashlib.sha256(normal(t or "").encode()).hexdigest()) for i, t in rows), key=repr)


def check(found, rows, normal=lambda t: t):
    found = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == plain(rows, normal)
    kept = [r for r in found if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept) and len(kept) == len({r.text_sha256 for r in kept}) == len({normal(t or "") for _, t in rows})


@pytest.mark.parametrize(("files", "per_batch", "reverse"), [(1, None, False), (6, 1, False), (6, 1, True), (6, 4, False)])
def test_any_batches(spark, tmp_path, files, per_batch, reverse):
    check(exact_dedup.exact_duplicates(spark, write(tmp_path, ROWS, files, reverse), files_per_batch=per_batch), ROWS)


@pytest.mark.parametrize("per_batch", [None, 1])
def test_digests_that_collide(spark, tmp_path, per_batch):
    """With a digest of two values most hits are other texts: whole texts decide."""
    short = lambda text: (F.length(text) % 2).cast("string")
    check(exact_dedup.exact_duplicates(spark, write(tmp_path, ROWS, 5), digest=short, files_per_batch=per_batch), ROWS)


def test_one_collision_leaves_other_digests_alone(spark, tmp_path):
    rows = [(k, f"{'ab'[k % 2]}{k % 5}") for k in range(50)]
    first = lambda text: F.when(text.isin("a0", "b1"), F.lit("x")).otherwise(F.sha2(text, 256))
    check(exact_dedup.exact_duplicates(spark, write(tmp_path, rows, 3), digest=first, files_per_batch=1), rows)


def test_normalised_texts(spark, tmp_path):
    check(exact_dedup.exact_duplicates(spark, write(tmp_path, ROWS, 2), normal=F.lower), ROWS, str.lower)


def test_a_text_that_a_third_holds(spark, tmp_path):
    rows = [(k, "everywhere" if k % 3 == 0 else f"text {k}") for k in range(6000)]
    check(exact_dedup.exact_duplicates(spark, write(tmp_path, rows, 4, extra=False), files_per_batch=2), rows)


def test_nothing(spark, tmp_path):
    got = exact_dedup.exact_duplicates(spark, write(tmp_path, [], 1, extra=False))
    assert got.count() == 0 and got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_the_session_keeps_its_state_store(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    exact_dedup.exact_duplicates(spark, write(tmp_path, ROWS[:5], 1))
    assert spark.conf.get(name, None) == before
