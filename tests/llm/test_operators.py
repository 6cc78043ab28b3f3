"""Every corpus operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, common, exact_search, html, mixing, pii, quality, simhash, substrings, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def docs_of(spark, texts, ids=None, extra=False):
    ids = range(len(texts)) if ids is None else ids
    df = spark.createDataFrame([(i, t, "en", f"src{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))], DOCS)
    if extra:
        for name in ("d", "fp", "row", "key", "score", "mix_slot", "ids"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def sample_texts(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["The", "END,", "çé", "x@y", "日本"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    texts = [*base, None, "", "   \n\t ", "one", "two words", base[3], base[3], base[7] + " more", passage, "lead " + passage, base[0] + " " + passage + " tail", "long " * 30_000]
    return texts


# ------------------------------------------------------------------ 1

def test_mix_places_every_row_once_and_keeps_the_shares(spark):
    ids = list(range(900)) + [None, None, 5, 5]
    rows = [(i, f"s{0 if k % 3 else k % 7}" if k % 11 else None, "x") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    weights = {"s0": 5, "s1": 2, "s2": 1, "": 3}
    got = mixing.mixed(df, weights, block=4).toPandas().sort_values("mix_position")
    assert list(got.mix_position) == list(range(len(ids)))
    blocks = got.drop_duplicates(["mix_source", "mix_block"]).sort_values("mix_slot")
    assert list(blocks.mix_slot) == list(range(len(blocks)))
    counts = got.groupby("mix_source").size().to_dict()
    used = mixing.even_weights(counts) | {s: w for s, w in weights.items() if s in counts}
    until = min(blocks[blocks.mix_source == s].mix_slot.max() for s in counts)
    total = sum(used.values())
    for s, w in used.items():
        placed = np.cumsum((blocks.mix_source == s).to_numpy())[: until + 1]
        assert np.abs(placed - w / total * np.arange(1, until + 2)).max() < 1


def test_period_is_earliest_deadline_first_within_windows():
    for weights in ({"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 3, "d": 1}, {"a": 97, "b": 1, "c": 2}):
        total = sum(weights.values())
        slots = mixing.period(weights)
        assert sorted(t for x in slots.values() for t in x) == list(range(total))
        for s, w in weights.items():
            assert all(k * total // w <= t < -(-(k + 1) * total // w) for k, t in enumerate(slots[s]))


def test_mix_of_nothing_and_refusals(spark):
    empty = docs_of(spark, [])
    assert mixing.mixed(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(docs_of(spark, ["a"]), {"": 0, "src0": 0}).count()
    kept = mixing.in_mix_order(mixing.mixed(docs_of(spark, ["a", None, "b"])))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() == 3


# ------------------------------------------------------------------ 2 and 7

def vectors(spark, n=700, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype("f4")
    x[50:80] = x[50]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [None] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [0.0] * 16, 0), (None, [1.0] * 16, 0), (n + 5, [1.0, 2.0], 0), (n + 6, [3.0, 1.0], 0), (20, x[20].tolist(), 0)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, g int")


def test_exact_search(spark):
    x, df = vectors(spark)
    got = exact_search.exact_top_k(df, lambda i: i % 50 == 0, 5).toPandas()
    zero = len(x) + 4
    q = np.floor(256 * np.concatenate([x, np.zeros((1, 16), "f4")]).astype("f8"))
    ids = np.array([*range(len(x)), zero])
    for i in range(0, 700, 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:5]
        mine = got[got.query_id == i].sort_values("rank")
        assert list(zip(mine.vec_id, mine.score)) == [(ids[j], int(s[j])) for j in order]
    assert exact_search.exact_top_k(df.where("vec_id > 703"), lambda i: i == 705, 5).collect()[0]["vec_id"] == 706
    assert exact_search.exact_top_k(df.limit(0), lambda i: i % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 2.0]), (2, [-1e30, 2.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["score"] for r in exact_search.exact_top_k(huge, lambda i: i == 0).collect()} == {1: 2**63 - 1, 2: -(2**63 - 1)}


def test_learned_partitions_recall(spark):
    x, df = vectors(spark)
    got = ann.learned_partition_search(df, lambda i: i % 20 == 0, 10, rows_per_part=64, sample_rows=400, held_rows=200).toPandas()
    hits = total = 0
    for i in range(0, 700, 20):
        s = x.astype("f8") @ x[i].astype("f8")
        s[i] = -np.inf
        mine = got[got.query_id == i].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, len(mine) + 1)) and i not in set(mine.vec_id)
        assert np.allclose(mine.score, s[mine.vec_id])
        hits, total = hits + (mine.score >= np.sort(s)[-10] - 1e-12).sum(), total + 10
    assert hits / total >= 0.9
    assert ann.learned_partition_search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_balanced_parts_are_bounded():
    x = np.random.default_rng(0).normal(size=(640, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    part = ann.balanced_parts(x, ann._neighbours(x, 8), 10)
    assert np.bincount(part, minlength=10).max() <= np.ceil(1.1 * 64)


# ------------------------------------------------------------------ 3

def plain_fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles)) if shingles else 0


def plain_groups(prints, radius=2):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_groups(spark):
    texts = sample_texts()
    found = simhash.near_duplicates(docs_of(spark, texts, extra=True)).select("doc_id", simhash.hexadecimal("fp").alias("fp"), "component_id").collect()
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    groups = plain_groups(prints)
    assert {r["doc_id"]: (r["fp"], r["component_id"]) for r in found} == {i: (f"{prints[i]:016x}", groups[i]) for i in prints}
    kept = simhash.first_of_group(docs_of(spark, texts)).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(groups.values()))


def test_links_connect_all_within_the_radius(spark):
    rng = random.Random(5)
    values = [0, 1, 3, 7, (1 << 64) - 1, (1 << 63), (1 << 63) | 1]
    for _ in range(40):
        v = rng.getrandbits(64)
        values += [v, v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for radius in (1, 2):
        roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius)).collect()}
        mine = plain_groups({v: v for v in values}, radius)
        same = lambda m: {frozenset(v for v in values if m.get(v, v) == m.get(u, u)) for u in values}
        assert same(roots) == same(mine)


@pytest.mark.parametrize("share", [4, 2_000])
def test_simhash_where_a_third_are_copies(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijkl") * 3 for _ in range(12)) for _ in range(60)]
    texts += [texts[0]] * 70 + [None, " "] * 40 + texts[5:15]
    rng.shuffle(texts)
    found = simhash.near_duplicates(docs_of(spark, texts).repartition(6)).collect()
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert len(found) == len(texts)
    assert {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in found} == {i: (prints[i], g) for i, g in plain_groups(prints).items()}


def test_simhash_nulls_and_nothing(spark):
    df = docs_of(spark, ["a b c d", "a b c d", None, ""], [None, 4, None, 2])
    rows = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert set(rows.values()) == {4, 2}
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


# ------------------------------------------------------------------ 4

def plain_spans(text):
    out = []
    rules = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for kind, rule in enumerate(rules):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                doubled = [sum(divmod(int(d) * 2, 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
                if not 14 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(9)
    alphabet = "ab.@+-() 0123456789%_é\n"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["4111 1111 1111 1111", "+1 (017) 555-7713.", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "300.1.1.1.1", "x@y@z.com", "9" * 5000]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_contexts_find_what_the_patterns_do_not(spark):
    seeds = [f"please write to user{i}@mail{i}.example.com now" for i in range(12)]
    texts = [*seeds, "please write to 7744-secret-9912 now", "nothing to see at 7744", None, "", seeds[0]]
    df = docs_of(spark, texts, extra=True)
    rows = {r["doc_id"]: r for r in pii.spans(df).collect()}
    t = texts[12]
    assert [t[s["start"] : s["end"]] for s in rows[12]["found"]] == ["7744-secret-9912"] and not rows[13]["found"]
    assert all([(s["start"], s["kind"], s["end"]) for s in rows[i]["base"]] == plain_spans(x or "") for i, x in enumerate(texts))
    masked = {r["doc_id"]: r for r in pii.masked(docs_of(spark, texts)).collect()}
    assert masked[0]["text"] == "please write to <EMAIL> now" and masked[0]["n_chars"] == len(masked[0]["text"])
    assert masked[12]["text"] == "please write to <CONTEXT> now" and masked[13]["text"] == texts[13]
    assert pii.spans(docs_of(spark, [])).count() == 0 and pii.masked(docs_of(spark, [])).count() == 0


def test_candidates_without_digits_and_of_any_length(spark):
    seeds = [f"please write to user{i}@mail{i}.example.com now" for i in range(12)]
    key = "k7" * 40
    texts = [*seeds, "please write to bob@intranet now", f"please write to {key} now", "ask bob@intranet", "no such token"]
    rows = {r["doc_id"]: r for r in pii.spans(docs_of(spark, texts)).collect()}
    found = {i: [texts[i][s["start"] : s["end"]] for s in rows[i]["found"]] for i in range(12, 16)}
    assert found == {12: ["bob@intranet"], 13: [key], 14: ["bob@intranet"], 15: []}
    masked = {r["doc_id"]: r["text"] for r in pii.masked(docs_of(spark, texts)).collect()}
    assert masked[12] == masked[13] == "please write to <CONTEXT> now" and masked[14] == "ask <CONTEXT>"


# ------------------------------------------------------------------ 5

def test_url_rules_and_reputation(spark):
    given = ["https://a.Example.ORG/es/x?y", "http://b.example.org/en/1x", "http://x.com/fr/1", "http://x.com/de/1", "http://q.net/z", None, "no scheme", "http://org/x", "ftp://EXAMPLE.org", "http://bad.net:80/p#f", "http://com.net/de/"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("bad", F.lit("clash")).withColumn("host", F.lit("clash"))
    more = spark.range(100, 160).select(F.col("id").alias("page_id"), F.when(F.col("id") % 2 == 0, "http://spam.net/a").otherwise("http://fine.net/a").alias("url"), F.lit("x").alias("bad"), F.lit("x").alias("host"))
    outcomes = more.select("page_id", (F.col("page_id") % 2 == 0).cast("int").alias("bad")).unionByName(spark.createDataFrame([(None, 1), (4, None)], "page_id long, bad int"))
    got = {r["page_id"]: r for r in urls.judge(pages.unionByName(more), outcomes).collect()}
    assert [(got[i]["host"], got[i]["rule"], got[i]["verdict"]) for i in range(11)] == [
        ("a.example.org", "example.org/es/", "block"), ("b.example.org", "example.org/en/1", "block"), ("x.com", "com/fr/", "allow"), ("x.com", "com/de/", "block"), ("q.net", None, "allow"), ("", None, "allow"), ("", None, "allow"),
        ("org", "org/", "allow"), ("example.org", None, "allow"), ("bad.net:80", None, "allow"), ("com.net", None, "allow"),
    ]
    assert {got[100]["verdict"], got[101]["verdict"]} == {"block", "allow"} and got[100]["verdict"] == "block"
    assert got[9]["path"] == "/p"
    assert urls.judge(pages.limit(0), outcomes).count() == 0
    assert urls.judge(pages, outcomes.limit(0)).where("verdict = 'block'").count() == 3


def test_hosts_without_outcomes_are_judged_by_the_levels_above(spark):
    given = [f"http://h{i}.spam.net/a" for i in range(40)] + [f"http://h{i}.fine.net/a" for i in range(40)] + [f"http://d{i}.zip/a" for i in range(40)]
    new = ["http://new.spam.net/x", "http://new.fine.net/x", "http://new.zip/x", "http://new.other/x", None]
    pages = spark.createDataFrame(list(enumerate(given + new)), "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(not 40 <= i < 80)) for i in range(120)], "page_id long, bad int")
    got = {r["page_id"]: r for r in urls.judge(pages, outcomes).collect()}
    assert [got[i]["verdict"] for i in range(120, 125)] == ["block", "allow", "block", "allow", "allow"]
    assert all((got[i]["n_labelled"], got[i]["n_bad"]) == (0, 0) for i in range(120, 125))


# ------------------------------------------------------------------ 6

CASES = {
    "<html><body><nav><a href=x>Home</a> menu words here</nav><article><h1>A &amp; B</h1><p>One  two\n three <b>four</b>five.</p><p>Six<br>seven &lt;ok&gt;.</p></article><footer>all rights reserved here</footer></body></html>": "A & B\n\nOne two three fourfive.\n\nSix seven <ok>.",
    "": "", "<nav>only a menu with words</nav>": "", "<article><p>Unclosed text of the article goes on<p>and on": "Unclosed text of the article goes on\n\nand on",
    "<article><h1>T</h1><p>First part of the text, long enough.</p><div class='ad-box'>Buy now and save money on it</div><p>Second part of the text, long enough.</p></article><div id=comments><p>I like it so much, thanks!</p></div>": "T\n\nFirst part of the text, long enough.\n\nSecond part of the text, long enough.",
    "<article><p>Text before the script is here.</p><script>var x='<p>no</p>';</script><form><p>Your name please</p><button>Send</button></form><p>Text after the script is here.</p></article>": "Text before the script is here.\n\nText after the script is here.",
}


def test_main_text(spark):
    rows = [(i, "u", h) for i, h in enumerate(CASES)] + [(90, None, None), (None, "u", "<p>Plain words that stand alone in a page.</p>"), (91, "u", "<article><p>" + "word " * 40_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extract(df).collect()
    by = {r["page_id"]: r for r in got}
    assert [by[i]["text"] for i in range(len(CASES))] == list(CASES.values())
    assert by[90]["text"] == "" and by[90]["n_chars"] == 0 and by[None]["text"].startswith("Plain") and by[91]["n_chars"] == 5 * 40_000 - 1
    assert html.extract(df.limit(0)).count() == 0


def test_weights_make_words_positive_and_tags_negative():
    w = html.learn()
    assert w.block_tag < 0 and w.inline_tag < 0 and dict(zip(html.FEATURES, w.word))["side_word"] < 0 < dict(zip(html.FEATURES, w.word))["main_tag"]


# ------------------------------------------------------------------ 8

def plain_removal(texts, ids, width):
    words = [WORD.findall(t or "") for t in texts]
    least = {}
    for i, w in zip(ids, words):
        for s in range(len(w) - width + 1):
            key = tuple(w[s : s + width])
            least[key] = min(least.get(key, 1 << 62), i)
    out = []
    for i, w in zip(ids, words):
        gone = set()
        for s in range(len(w) - width + 1):
            if least[tuple(w[s : s + width])] < i:
                gone.update(range(s, s + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize(("width", "run"), [(50, 10), (12, 3), (5, 5), (3, 1)])
def test_repeated_passages(spark, width, run):
    texts = sample_texts(4)
    got = substrings.repeated_passages(docs_of(spark, texts, extra=True), width=width, run=run).collect()
    mine = sorted((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["removed"]), r["kept"]) for r in got)
    assert mine == plain_removal(texts, range(len(texts)), width)
    for r in got:
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


def test_repeated_passages_null_and_repeated_ids(spark):
    p = " ".join(f"p{i}" for i in range(60))
    got = substrings.repeated_passages(docs_of(spark, [p, p, p, "x " + p], [7, 7, None, 9])).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["kept"]) > 0) for r in got) == [(False, 7, True), (False, 7, True), (False, 9, True), (True, 0, False)]
    assert next(r["kept"] for r in got if r["doc_id"] == 9) == "x"
    assert substrings.repeated_passages(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("shared", [None, 8])
def test_a_copy_leaves_other_texts_of_its_id_alone(spark, shared):
    p, q, tail = (" ".join(f"{c}{i}" for i in range(60)) for c in "pqt")
    texts = [p, p, q, "x " + p, "", tail] + ([q + " y"] if shared else [])
    ids = [7, shared, shared, shared, shared, 3] + ([9] if shared else [])
    got = substrings.repeated_passages(docs_of(spark, texts, ids)).collect()
    wanted = [(7, p), (shared, ""), (shared, q), (shared, "x"), (shared, ""), (3, tail)] + ([(9, "y")] if shared else [])
    assert sorted(map(repr, ((r["doc_id"], r["kept"]) for r in got))) == sorted(map(repr, wanted))


# ------------------------------------------------------------------ 9

def test_bpe_is_the_reference_encoding(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", None, "a", " " * 300, "x" * 900, "日本語" * 80, "it's we'll 're " * 60, "\n\n \t x" * 80, "é😀👍🏽 " * 60, "a'l" * 200, "<|endoftext|>", "rep " * 90, "rep " * 90]
    texts += ["".join(rng.choice("ab 1.'\nsl é\t日") for _ in range(rng.randint(0, 400))) for _ in range(40)]
    ids = [*range(11), 500, 500, *range(600, 640)]
    df = docs_of(spark, texts, ids, extra=True)
    wanted = sorted((i, tuple(encoding.encode_ordinary(t or ""))) for i, t in zip(ids, texts))
    for chunk, overlap in ((50, 16), (30, 30), (32_768, 1_024)):
        encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
        assert sorted((r["doc_id"], tuple(np.frombuffer(r["ids"], "<i4").tolist())) for r in encoded.collect()) == wanted
    decoded = sorted((r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(encoded, RANKS).collect())
    assert decoded == sorted((i, (t or "").encode()) for i, t in zip(ids, texts))
    digest = {r["doc_id"]: r for r in bpe.digests(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert digest[5]["decoded_sha256"] == hashlib.sha256(texts[5].encode()).hexdigest()
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


# ------------------------------------------------------------------ 10

def quality_corpus(n=400, seed=8):
    rng = random.Random(seed)
    plain = lambda: " ".join(rng.choice(["the", "of", "river", "stone", "house", "walked", "slowly"]) for _ in range(12)).capitalize() + "."
    junk = lambda: " ".join(w + rng.choice(["###", "$$$", "***"]) for w in ["buy", "now", "cheap", "best", "deal", "free"])
    texts, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        lines = [plain() for _ in range(rng.randint(1, 6))] + ([junk() for _ in range(rng.randint(2, 6))] if bad else [])
        rng.shuffle(lines)
        texts.append("\n".join(lines))
        labels.append((i, 0 if bad else 1, 0))
    return texts, labels


def test_quality_held_out(spark):
    texts, labels = quality_corpus()
    df, lab = docs_of(spark, texts, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    field = quality.train(df, lab)
    got = quality.score(df, field).withColumn("out", quality.held_out()).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["out"]]
    assert len(held) > 60 and np.mean([(r["score"] >= 0.7) == (labels[r["doc_id"]][1] == 1) for r in held]) > 0.95
    lines = quality.score(docs_of(spark, ["The river walked slowly of stone.\nbuy### now$$$ cheap*** best### deal$$$ free***"]), field, with_lines=True).collect()[0]["line_good"]
    assert lines[0] > lines[1]


def test_quality_edges(spark):
    texts, labels = quality_corpus(60)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    field = quality.train(docs_of(spark, texts), lab)
    odd = docs_of(spark, [None, "", "\n\n\n", "x" * 200_000, "y\n" * 20_000], [None, 1, 1, 2, 3])
    assert all(0 <= r["score"] <= 1 for r in quality.score(odd, field).collect()) and quality.score(odd.limit(0), field).count() == 0
    none = quality.train(docs_of(spark, texts), lab.limit(0))
    assert quality.score(docs_of(spark, ["a"]), none).collect()[0]["score"] == pytest.approx(0.5)
    kept = quality.accepted(docs_of(spark, texts, extra=True), field, 0.7)
    assert "d" in kept.columns and 0 < kept.count() < 60


def test_forward_backward_sums_over_all_labellings():
    rng = np.random.default_rng(1)
    counts, steps = np.array([4, 1, 3]), rng.normal(size=(2, 2))
    unary = rng.normal(size=8)
    got, _ = quality.forward_backward(unary, steps, counts)
    at = 0
    for n in counts:
        weights = {}
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            weights[code] = np.exp(sum(unary[at + i] * y[i] for i in range(n)) + sum(steps[y[i - 1], y[i]] for i in range(1, n)))
        for i in range(n):
            assert got[at + i] == pytest.approx(sum(w for c, w in weights.items() if c >> i & 1) / sum(weights.values()))
        at += n
