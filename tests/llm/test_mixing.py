"""The mix against a plain simulation, names that clash, rows that are repeated very often, and the registered query."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, queries

NAMES = ("slots", "starts", "buckets", "source_key", "gaps", "periods", "firsts", "bucket_source", "row", "h", "b", "r", "hot", "rank", "before", "of_source", "of_b", "p", "k", "count", "_h", "_b", "mix_slot", "mix_position", "a b", "x.y")


def plain_mix(blocks, weights):
    """The sources of the blocks, one after the other: of those released the earliest deadline goes first."""
    left, order = dict(blocks), []
    while left:
        active, total, slot, done = {s: weights[s] for s in left}, sum(weights[s] for s in left), 0, dict.fromkeys(left, 0)
        while all(left[s] > 0 for s in active):
            ready = [s for s in active if done[s] * total // weights[s] <= slot]
            s = min(ready, key=lambda s: (-(-(done[s] + 1) * total // weights[s]), s))
            order.append(s)
            done[s], left[s], slot = done[s] + 1, left[s] - 1, slot + 1
        left = {s: n for s, n in left.items() if n}
    return order


@pytest.mark.parametrize("weights", [{"a": 3, "b": 2, "": 1}, {"a": 1, "b": 1, "": 7}, {"a": 50, "b": 1, "": 2}])
def test_mix_is_earliest_deadline_first(spark, weights):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else None) for i in range(500)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=4).toPandas()
    blocks = got.groupby("mix_source").size().map(lambda n: -(-n // 4)).to_dict()
    order = got.drop_duplicates("mix_slot").sort_values("mix_slot").mix_source.tolist()
    assert order == plain_mix(blocks, weights)
    assert sorted(got.mix_position) == list(range(500))
    assert (got.sort_values("mix_position").mix_slot.diff().dropna() >= 0).all()


def test_names_that_clash(spark):
    df = spark.createDataFrame([(i, f"s{i % 2}") for i in range(40)], "doc_id long, source string").withColumn("m", F.create_map(F.lit("a"), F.col("doc_id")))
    for name in NAMES:
        df = df.withColumn(name, F.lit("clash"))
    out = mixing.mixed(df)
    kept = [c for c in df.columns if not c.startswith("mix_")]
    assert out.columns == [*kept, "mix_source", "mix_block", "mix_slot", "mix_position"]
    rows = out.toPandas()
    assert sorted(rows.mix_position) == list(range(40)) and set(rows["slots"]) == set(rows["x.y"]) == {"clash"}
    assert mixing.in_mix_order(out).columns == kept


def test_rows_repeated_very_often_and_texts_under_one_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_SHARE", 10)
    same = spark.range(0, 3000, 1, 6).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    other = spark.range(0, 500, 1, 2).select(F.lit(7).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.col("id").cast("string").alias("text"))
    got = mixing.mixed(same.unionByName(other)).toPandas()
    assert sorted(got.mix_position) == list(range(3500))
    assert (got.text == "t").sum() == 3000 and set(got[got.text != "t"].text) == set(map(str, range(500)))
    # The copies stand in several places of the order, not all in one.
    assert (got.sort_values("mix_position").text == "t").astype(int).diff().abs().sum() > 10


def test_a_schedule_too_large_is_refused(spark):
    df = spark.range(300).select("id", F.col("id").cast("string").alias("source"))
    with pytest.raises(ValueError):
        mixing.mixed(df, {str(i): 300 for i in range(300)})


def test_the_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op1_pfair_mix"](spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id", "source"])
    assert sorted(got.doc_id) == sorted(docs.doc_id) and sorted(got.mix_position) == list(range(len(docs)))
    assert dict(zip(got.doc_id, got.mix_source)) == dict(zip(docs.doc_id, docs.source.fillna("")))
    counts = got.groupby("mix_source").size().to_dict()
    order = got.drop_duplicates("mix_slot").sort_values("mix_slot").mix_source.tolist()
    assert order == plain_mix({s: -(-n // 8) for s, n in counts.items()}, mixing.even_weights(counts))
