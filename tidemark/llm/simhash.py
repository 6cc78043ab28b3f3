"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

_BITS = np.array([np.unpackbits(np.uint8(x), bitorder="little") for x in range(256)], dtype=np.int32)


def fingerprint(text: str, width: int, seed: int) -> int:
    """The bits set in over half the hashes of a text's word shingles; without words, zero."""
    lower = text.translate(_LOWER)
    words = re.findall(common.WORD, lower)
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(" ".join(words).encode("utf-8", "surrogatepass"), seed)
    joined = map(" ".join, zip(*(itertools.islice(words, i, None) for i in range(width)), strict=False))
    hashes = np.fromiter((digest(x, seed) for x in joined), np.uint64, n)
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 256:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view("i8"))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, *, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) for each row; a null text counts as empty."""
    common.ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.string_or_empty("text").alias("text"))
    return texts.mapInArrow(_fingerprints(width, seed), "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """The 64-bit masks of at most ``radius`` bits, as signed numbers."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in itertools.combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints that keep all groups of radius ``radius`` connected.

    Each fingerprint emits every variant within half the radius, so two that differ in at most ``radius`` bits meet in one
    variant, unless the radius is odd: then the variants of half the radius rounded up are taken. Those that meet are
    linked to the smallest of them where the distance holds, else to their next one; for an even radius all that meet are
    in reach of each other, so no group of fingerprints is ever paired out.
    """
    half = (radius + 1) // 2
    masks = F.array(*[F.lit(m).cast("long") for m in ball(half)])
    variants = prints.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    if radius % 2 == 0:
        from pyspark.sql import Window

        met = variants.withColumn("least", F.min("fp").over(Window.partitionBy("variant")))
    else:
        met = variants.withColumnRenamed("fp", "other").join(variants, "variant").withColumnRenamed("other", "least")
    found = met.where("least < fp").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= radius)
    return found.select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that is reachable, for every node of the undirected edges (a, b).

    Labels fall to the least label among the neighbours and then to the label of that label, round by round, until none
    changes: each round lowers a label, so the rounds end. Minima are taken before the shuffle; each round is cut by a
    checkpoint.
    """
    both = common.checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = common.checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.node == near.a, "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("hop"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("jump"))
        after = lower.join(jump, lower.hop == jump["at"], "left").select("node", F.least("hop", F.coalesce("jump", "hop")).alias("new"), (F.least("hop", F.coalesce("jump", "hop")) < F.col("root")).alias("moved"))
        after = common.checkpointed(after)
        moved = after.where("moved").limit(1).count()
        labels = after.select("node", F.col("new").alias("root"))
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, *, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """Near-duplicate groups of documents: (doc_id, fp long, component_id).

    Texts are lower-cased (A-Z) and cut into words; the fingerprint is the bitwise majority of the XXH64 of their shingles
    of ``width`` words, repeats included. Fingerprints link at ``radius`` or fewer differing bits; component_id is the
    smallest doc_id reachable. Rows of one fingerprint are one class, so copies are never paired; a class of any share of all
    rows is in no one task.

    * null and empty texts have fingerprint zero and are linked like any other;
    * a null doc_id stays null and never is a component's id unless all ids of the component are null;
    * texts of any length are fingerprinted whole; repeated rows stay repeated; of ties in component_id there are none, as it
      is the smallest of the ids; an empty table gives an empty result; further columns are ignored.
    """
    prints = common.checkpointed(fingerprints(docs, width=width, seed=seed))
    classes = common.checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(classes.select("fp"), radius))
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    members = common.checkpointed(named.join(least, "root").select("fp", "n", "component_id"))
    return common.joined_by_key(prints, members, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp):
    """A fingerprint as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def first_of_group(docs: DataFrame, *, radius: int = 2, width: int = 3, seed: int = 42) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id, with all its columns.

    Rows of a null doc_id stay, as does every row of the id kept. Texts without words share the fingerprint zero, so of these
    one id stays; a null text counts as empty; very long texts are one fingerprint like any other; an empty table gives an
    empty result; columns keep their names. Only ids and fingerprints are shuffled before the join.
    """
    groups = near_duplicates(docs, radius=radius, width=width, seed=seed)
    gone = groups.where("doc_id > component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id.cast("long") == gone["_gone"], "left_anti")
