"""The pipeline against plain Python on the smallest tables, stage by stage."""

import hashlib

import corpus_pipeline
import pandas as pd
from test_operators import plain_fingerprint, plain_groups, plain_spans

from tidemark.llm import common, mixing, quality

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = common.table(spark, SF, "documents").toPandas().set_index("doc_id")
    field = quality.train(common.table(spark, SF, "documents"), common.table(spark, SF, "labels"))
    scores = {r["doc_id"]: r["score"] for r in quality.score(common.table(spark, SF, "documents"), field).collect()}
    kept = [i for i in docs.index if scores[i] >= corpus_pipeline.KEEP_FROM]
    groups = plain_groups({i: plain_fingerprint(docs.text[i]) for i in kept})
    wanted = {}
    for i in sorted(set(groups.values())):
        text, parts, done = docs.text[i], [], 0
        for a, kind, b in plain_spans(text):
            if a >= done:
                parts += [text[done:a], ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")[kind]]
            done = max(done, b)
        wanted[i] = hashlib.sha256(("".join(parts) + text[done:]).encode()).hexdigest()
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == wanted


def test_stages_keep_the_columns(spark):
    df = common.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        assert stage(spark, df.limit(0), SF).count() == 0


def test_the_result_says_the_place_in_the_mix(spark):
    sources = {r["doc_id"]: r["source"] or "" for r in common.table(spark, SF, "documents").collect()}
    got = sorted((r["mix_position"], sources[r["doc_id"]]) for r in corpus_pipeline.run(spark, SF).collect())
    assert [p for p, _ in got] == list(range(len(got)))
    order = [s for _, s in got]
    weights = mixing.even_weights({s: order.count(s) for s in set(order)})
    until = min(len(order) - order[::-1].index(s) for s in weights)
    for n in range(1, until + 1):
        for s, w in weights.items():
            # Less than a block of eight off in whole blocks, and the block that is being placed.
            assert abs(order[:n].count(s) - w / sum(weights.values()) * n) < 16


def test_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    docs = pd.read_parquet(f"{SF}/documents.parquet").head(60).astype({"doc_id": "Int64", "n_chars": "Int64"})
    good = docs.text[docs.text.str.len().idxmax()]
    odd = [(None, "token = 5 " + good), (None, good[:200] + " other words follow here and there"), (docs.doc_id[3], docs.text[3]), (900, None), (901, ""), (902, " \n"), (903, (good + "\n") * 40), (docs.doc_id[5], "mail a@b.cd now, " + good)]
    extra = pd.DataFrame(odd, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}).assign(lang=None, source=None, n_chars=pd.array([None] * len(odd), dtype="Int64"))
    whole = pd.concat([docs, extra], ignore_index=True)
    for name in ("row", "key", "found", "score", "fp", "mix_slot", "mix_position", "file", "of_file", "_gone", "id", "before", "count", "a b"):
        whole[name] = "clash"
    whole.to_parquet(tmp_path / "documents.parquet")
    pd.read_parquet(f"{SF}/labels.parquet").to_parquet(tmp_path / "labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert list(got.columns) == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "mix_position"]
    assert sorted(got.mix_position) == list(range(len(got))) and len(got) > 10
    # Stage by stage: what the classifier keeps, without the ids that have a smaller near duplicate.
    rows = common.table(spark, str(tmp_path), "documents")
    kept = quality.accepted(rows, quality.train(rows, common.table(spark, str(tmp_path), "labels")), corpus_pipeline.KEEP_FROM).toPandas()
    assert set(kept.columns) == set(whole.columns) and (kept["row"] == "clash").all()
    known = kept[kept.doc_id.notna()]
    prints = [(int(r.doc_id), plain_fingerprint(r.text or "")) for r in known.itertuples()]
    first = plain_groups_of(prints)
    wanted = sorted([i for i, _ in prints if first[i] == i] + [-1] * int(kept.doc_id.isna().sum()))
    assert sorted(got.doc_id.fillna(-1).astype(int)) == wanted


def plain_groups_of(prints):
    """The smallest id that each id reaches by fingerprints at most two bits apart; an id may have several."""
    first = {i: i for i, _ in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints:
            for j, b in prints:
                if (a ^ b).bit_count() <= 2 and first[j] < first[i]:
                    first[i], changed = first[j], True
    return first
