"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks. Block k of a source with share w may be placed from slot floor(k / w) on and
must be placed before slot ceil((k + 1) / w); of the blocks released, the one with the earliest deadline goes first. Then
after any number of slots a source has had its share to within less than one block. The schedule repeats after as many
slots as the integer weights sum to, so one period of it, whose size is a parameter, places any number of blocks. When a
source runs out, the others go on with their own weights in a new phase.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common

#: Sources, their summed integer weights and the numbers of a whole schedule are bounded, so that it is small whatever the
#: input: each source that runs out begins a phase with a period of its own.
MOST_SOURCES, MOST_WEIGHT, MOST_NUMBERS = 1_000, 100_000, 2_000_000
#: Rows of which there are more than one in so many of all are dealt out by their partition as well.
HOT_SHARE = 10_000


def period(weights: dict[str, int]) -> dict[str, list[int]]:
    """For each source the slots of its blocks in one period of sum(weights) slots, earliest deadline first."""
    total = sum(weights.values())
    slots: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, s) for s in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            k = len(slots[s])
            heapq.heappush(ready, (-(-(k + 1) * total // weights[s]), s))
        _, s = heapq.heappop(ready)
        slots[s].append(t)
        k = len(slots[s])
        if k < weights[s]:
            heapq.heappush(waiting, (max(t + 1, k * total // weights[s]), s))
    return slots


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[dict]:
    """The phases of a mix: {first slot, period, slots of each source in it, first block of each source}.

    A phase ends with the last block of the source that runs out first.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    done, start, out = dict.fromkeys(left, 0), 0, []
    while left:
        active = {s: weights[s] for s in left}
        total, slots = sum(active.values()), period(active)
        length = min((n - 1) // active[s] * total + slots[s][(n - 1) % active[s]] for s, n in left.items()) + 1
        out.append({"start": start, "period": total, "slots": slots, "first": {s: done[s] for s in left}})
        full, rest = divmod(length, total)
        for s in list(left):
            used = full * active[s] + sum(t < rest for t in slots[s])
            done[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        start += length
    return out


def _plan(spark: SparkSession, weights: dict[str, int], counts: dict[str, int], block: int) -> DataFrame:
    """A line for each source: where its blocks go. As many numbers as the weights sum to, in each phase, at most."""
    steps = phases(weights, {s: -(-n // block) for s, n in counts.items()})
    last = {s: -(-n // block) - 1 for s, n in counts.items()}
    short = {}
    lines = []
    for s in counts:
        mine = [p for p in steps if s in p["slots"]]
        lines.append((s, [p["start"] for p in mine], [p["period"] for p in mine], [p["first"][s] for p in mine], [p["slots"][s] for p in mine]))
        p = mine[-1]
        k = last[s] - p["first"][s]
        w = len(p["slots"][s])
        short[p["start"] + k // w * p["period"] + p["slots"][s][k % w]] = block - (counts[s] - last[s] * block)
    # The slots of the blocks that are not full, with what all of them up to there lack.
    lacking, gaps = 0, []
    for slot in sorted(short):
        if short[slot]:
            lacking += short[slot]
            gaps.append((slot, lacking))
    kind = "source_key string, starts array<bigint>, periods array<bigint>, firsts array<bigint>, slots array<array<bigint>>, gaps array<struct<slot: bigint, lacking: bigint>>"
    return spark.createDataFrame([(*line, gaps) for line in lines], kind)


def even_weights(counts: dict[str, int], *, power: float = 0.5, total: int = 1_000) -> dict[str, int]:
    """Integer weights in proportion to the sizes to a power, one at least: between even shares (0) and the sizes (1)."""
    scaled = {s: n**power for s, n in counts.items()}
    whole = sum(scaled.values()) or 1
    return {s: max(1, round(total * x / whole)) for s, x in scaled.items()}


def _hashable(kind: str) -> bool:
    return "map<" not in kind and "variant" not in kind


def mixed(docs: DataFrame, weights: dict[str, int] | None = None, *, block: int = 8, power: float = 0.5) -> DataFrame:
    """The documents with mix_source, mix_block, mix_slot and mix_position: every row once, at its place in the mix.

    ``weights`` are positive integers for each source; without them (or for sources they lack) they follow the sources'
    sizes to ``power``. Within a source the order is that of a hash of the whole row. While all sources last, a source has
    had its share of the blocks placed so far to within less than one block; when one runs out, the same holds among the
    rest.

    * a null source is the source of empty name; null ids, repeated ids and repeated rows are placed like others;
    * rows that tie are equal in all columns that have a hash (maps have none), so their order does not matter, and a lost
      partition that is computed again places each row once;
    * a source of any size is ranked in buckets of bounded size, none in one task; of a row that is repeated very often the
      copies of each input partition fall into one bucket;
    * an empty table gives an empty result; texts of any length are only hashed and moved; all columns of the documents are
      kept, whatever their names; those that clash with mix_* are replaced;
    * more than MOST_SOURCES sources, weights summing to more than MOST_WEIGHT, or more than MOST_NUMBERS as the product of
      both are refused.
    """
    spark = docs.sparkSession
    common.ship(spark)
    docs = docs.drop("mix_source", "mix_block", "mix_slot", "mix_position")
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    # The columns of the documents are packed, so that their names cannot clash with those used here.
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source.alias("mix_source"), F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if _hashable(kind)]).alias("h")
    )
    sizes = packed.groupBy("mix_source").count().limit(MOST_SOURCES + 1).collect()
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    counts = {r["mix_source"]: r["count"] for r in sizes}
    weights = even_weights(counts, power=power) | {s: int(w) for s, w in (weights or {}).items() if s in counts}
    total = sum(weights.values())
    if any(w < 1 for w in weights.values()) or total > MOST_WEIGHT or total * len(weights) > MOST_NUMBERS:
        raise ValueError(f"weights must be positive integers, sum to {MOST_WEIGHT} at most, and to {MOST_NUMBERS} at most times the number of sources")
    rows = sum(counts.values())
    # Ranks within a source: its rows fall into buckets by hash, a bucket's first rank is the size of those before it.
    per_bucket = max(256, rows // 65_536)
    buckets = spark.createDataFrame([(s, max(1, n // per_bucket)) for s, n in counts.items()], "bucket_source string, buckets int")
    # Fewer than HOT_SHARE lines by construction.
    hot = common.checkpointed(packed.groupBy("h").count().where(F.col("count") > max(per_bucket, rows // HOT_SHARE)).select(F.col("h").alias("hot")))
    if hot.isEmpty():
        hashed = packed
    else:
        # Written with the partition, so that every reader of a row sees the same one.
        packed = common.checkpointed(packed.withColumn("dealt", F.spark_partition_id()))
        hashed = packed.join(F.broadcast(hot), F.col("h") == F.col("hot"), "left")
        hashed = hashed.withColumn("h", F.when(F.col("hot").isNotNull(), F.xxhash64("h", "dealt")).otherwise(F.col("h"))).drop("hot", "dealt")
    hashed = hashed.join(F.broadcast(buckets), F.col("mix_source") == F.col("bucket_source"))
    hashed = hashed.withColumn("b", F.floor(F.shiftrightunsigned("h", 33) * F.col("buckets") / F.lit(2**31)).cast("int")).drop("bucket_source", "buckets")
    filled = hashed.groupBy("mix_source", "b").agg(F.count("*").alias("n"))
    earlier_buckets = Window.partitionBy("mix_source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.select(F.col("mix_source").alias("of_source"), F.col("b").alias("of_b"), F.coalesce(F.sum("n").over(earlier_buckets), F.lit(0)).alias("before"))
    within = Window.partitionBy("mix_source", "b").orderBy("h")
    ranked = hashed.withColumn("r", F.row_number().over(within) - 1)
    ranked = ranked.join(offsets, (F.col("mix_source") == F.col("of_source")) & (F.col("b") == F.col("of_b"))).withColumn("rank", F.col("before") + F.col("r"))
    ranked = ranked.withColumn("mix_block", F.floor(F.col("rank") / block).cast("long"))
    # At most MOST_NUMBERS numbers.
    plan = _plan(spark, weights, counts, block)
    placed = ranked.join(F.broadcast(plan), F.col("mix_source") == F.col("source_key"))
    placed = placed.withColumn("p", F.size(F.filter("firsts", lambda f: f <= F.col("mix_block"))))
    at = lambda c: F.element_at(c, F.col("p"))
    placed = placed.withColumn("k", F.col("mix_block") - at("firsts"))
    width = F.size(at("slots"))
    slot = at("starts") + F.floor(F.col("k") / width).cast("long") * at("periods") + F.element_at(at("slots"), (F.col("k") % width).cast("int") + 1)
    placed = placed.withColumn("mix_slot", slot)
    earlier = F.filter("gaps", lambda g: g["slot"] < F.col("mix_slot"))
    lacking = F.coalesce(F.array_max(F.transform(earlier, lambda g: g["lacking"])), F.lit(0).cast("long"))
    position = F.col("mix_slot") * block + (F.col("rank") - F.col("mix_block") * block) - lacking
    return placed.withColumn("mix_position", position).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], "mix_source", "mix_block", "mix_slot", "mix_position")


def in_mix_order(mix: DataFrame) -> DataFrame:
    """The documents of a mix in order of mix_position, without the mix_* columns: each partition is a stretch of it.

    Positions are unique, so there are no ties; rows of null and of repeated ids have one each; an empty mix stays empty.
    """
    ordered = mix.repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return ordered.drop("mix_source", "mix_block", "mix_slot", "mix_position")
