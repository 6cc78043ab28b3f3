"""The registered queries on the smallest tables against plain Python. Those of op1, op2, op4, op5 and op7 are called beside their operators' tests."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from test_operators import plain_fingerprint, plain_groups, plain_removal

from tidemark.llm import html, queries

SF = "/root/testdata/sf0.001"
DOCS = pd.read_parquet(f"{SF}/documents.parquet")
TEXTS = dict(zip(DOCS.doc_id, DOCS.text))


def rows(spark, name, folder=SF):
    return queries.QUERIES[name](spark, folder).toPandas()


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op3(spark):
    prints = {i: plain_fingerprint(t) for i, t in TEXTS.items()}
    groups = plain_groups(prints)
    got = rows(spark, "op3_simhash")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got.itertuples()} == {i: (f"{prints[i]:016x}", groups[i]) for i in TEXTS}


def test_op6(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = rows(spark, "op6_main_text").set_index("page_id")
    assert sorted(got.index) == sorted(pages.page_id)
    for p in pages.itertuples():
        article = re.search(r"<article>.*</article>", p.html, re.S)[0]
        wanted = "\n\n".join(b.text for b in html.blocks(article) if not b.cut)
        assert (got.url[p.page_id], got.text[p.page_id], got.n_chars[p.page_id]) == (p.url, wanted, len(wanted))


def test_op8(spark):
    ids = sorted(TEXTS)
    wanted = [(i, n, gone, digest(kept)) for i, n, gone, kept in plain_removal([TEXTS[i] for i in ids], ids, 50)]
    got = rows(spark, "op8_repeated_passages")
    assert sorted(zip(got.doc_id, got.n_words, got.n_removed, got.kept_sha256)) == wanted


def test_op9(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, "op9_bpe").set_index("doc_id")
    for i, text in TEXTS.items():
        ids = encoding.encode_ordinary(text or "")
        assert tuple(got.loc[i]) == (len(ids), digest(",".join(map(str, ids))), digest(text or ""))


def test_op10_is_the_same_whatever_the_order_of_rows(spark, tmp_path):
    first = rows(spark, "op10_line_field").set_index("doc_id").sort_index()
    assert all(first.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in first.index)
    assert ((first.score >= 0.7) == (first.predicted == 1)).all() and first.score.between(0, 1).all()
    # Held-out rows may change their labels, sources and languages: no score does.
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    labels.loc[[zlib.crc32(str(i).encode()) % 4 == 2 for i in labels.doc_id], "quality"] = 0
    labels.sample(frac=1, random_state=1).to_parquet(tmp_path / "labels.parquet")
    (tmp_path / "documents.parquet").mkdir()
    shuffled = DOCS.sample(frac=1, random_state=2).assign(source="other", lang="xx")
    for k in range(3):
        shuffled.iloc[k::3].to_parquet(tmp_path / "documents.parquet" / f"part-{k}.parquet")
    again = rows(spark, "op10_line_field", str(tmp_path)).set_index("doc_id").sort_index()
    assert np.array_equal(first.score, again.score)


def test_op10_on_held_out_rows(spark):
    got = rows(spark, "op10_line_field", "/root/testdata/sf0.01")
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").dropna(subset=["quality"])
    held = got[got.held_out].merge(labels, on="doc_id")
    assert len(held) > 50 and (held.predicted == held.quality).mean() >= 0.95
