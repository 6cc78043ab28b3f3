"""Bootstrapped contexts against plain Python, the time of long texts, names that clash, and the registered query."""

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_operators import docs_of, plain_spans

from tidemark.llm import pii, queries


def plain_scores(edges, rounds=3, trust=0.8, prior=1.0):
    """edges: (context, instance, belief, neutral)."""
    belief = defaultdict(float)
    graph = defaultdict(dict)
    for context, instance, b, neutral in edges:
        belief[instance] = max(belief[instance], b)
        graph[context][instance] = graph[context].get(instance, False) or neutral
    score, standing = dict.fromkeys(belief, 0.0), dict(belief)
    for _ in range(rounds):
        worth = {c: sum(standing[i] for i in of) / (sum(standing[i] if neutral else 1 for i, neutral in of.items()) + prior) for c, of in graph.items()}
        wrong = dict.fromkeys(belief, 1.0)
        for c, of in graph.items():
            if worth[c] >= trust:
                for i in of:
                    wrong[i] *= 1 - min(worth[c], 0.999)
        score = {i: 1 - wrong[i] for i in belief}
        standing = {i: max(belief[i], score[i]) for i in belief}
    return {i: s for i, s in score.items() if belief[i] < 1}


def plain_found(texts, keys=True):
    """What the whole method adds to each text, and how much of it is no seed."""
    edges, seen, lefts = [], [], defaultdict(set)
    for n, text in enumerate(texts):
        for a, b, belief in pii.met(text or "")[1]:
            token, (left, *others) = text[a:b].lower(), pii.patterns(text, a, b)
            edges += [(left, token, belief, False), *((p, token, belief, any(c == "@" or c.isalpha() for c in token)) for p in others)]
            seen.append((n, a, b, belief))
            if belief < 1 and pii.key_like(text[a:b]):
                lefts[left].add(token)
    families = sorted((c for c in lefts if len(lefts[c]) >= pii.LEAST_SEEDS), key=lambda c: (-len(lefts[c]), pii._number(c)))[: pii.FAMILIES]
    seeds = {t for c in families for t in sorted(lefts[c], key=pii._number)[: pii.SEEDS]} if keys else set()
    scores = plain_scores([(c, i, max(b, pii.KEY_BELIEF) if i in seeds else b, neutral) for c, i, b, neutral in edges])
    found, new = defaultdict(set), defaultdict(set)
    for n, a, b, belief in seen:
        if belief < 1 and scores[texts[n][a:b].lower()] >= 0.8:
            found[n].add((a, b))
            if texts[n][a:b].lower() not in seeds:
                new[n].add((a, b))
    return [sorted(found[n]) for n in range(len(texts))], [len(new[n]) for n in range(len(texts))]


def test_scores_of_the_graph(spark):
    rng = random.Random(6)
    edges = [(c, i, {0: 1.0, 1: 0.9}.get(i % 4, 0.0)) for c in range(40) for i in (rng.sample(range(120), rng.randint(1, 25)) if c % 2 else rng.sample(range(0, 120, 4), rng.randint(1, 25)) + [c])]
    df = spark.createDataFrame([(c, i, b) for c, i, b in edges + edges[:50]], "context long, instance long, belief double")
    got = {r["instance"]: r["score"] for r in pii.confident(df).collect()}
    assert got == pytest.approx(plain_scores([(*e, False) for e in edges])) and any(s > 0 for s in got.values()) and any(s == 0 for s in got.values())
    assert pii.confident(df.limit(0)).count() == 0


def corpus(n=400):
    rng = random.Random(12)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    texts, secrets = [], {}
    for i in range(n):
        kind, text = i % 8, some(12)
        if kind == 0:
            secret = "%040x" % rng.getrandbits(160)
            text += f' token = "{secret}" ' + some(4)
            secrets[i] = secret
        elif kind == 1 and i % 5 == 0:  # not key-like, but where keys stand
            secrets[i] = f"pass-{rng.randint(1000, 9999)}"
            text += f' token = "{secrets[i]}" ' + some(4)
        elif kind == 2:
            text += f" mail user{i}@mail{i % 9}.example.com " + some(3)
        elif kind == 3:
            text += f" in {rng.randint(1500, 2020)} " + some(3)
        elif kind == 4 and i < 20:
            text += f" commit {rng.getrandbits(160):040x} " + some(3)  # keys that nothing confirms
        texts.append(text)
    return texts, secrets


def test_unseen_identifiers_are_found_and_others_left_alone(spark):
    texts, secrets = corpus()
    texts += [None, "", texts[0]]
    got = {r["doc_id"]: r for r in pii.spans(docs_of(spark, texts, extra=True)).collect()}
    wanted, new = plain_found(texts)
    assert [got[i]["discovered"] for i in range(len(texts))] == new and sum(new) >= len(secrets) - pii.SEEDS
    assert [[(s["start"], s["end"]) for s in got[i]["found"]] for i in range(len(texts))] == wanted
    assert {i: [texts[i][a:b] for a, b in w] for i, w in enumerate(wanted) if w} == {i: [s] for i, s in (secrets | {402: secrets[0]}).items()}
    masked = {r["doc_id"]: r["text"] for r in pii.masked(docs_of(spark, texts)).collect()}
    assert all(f'token = "<CONTEXT>"' in masked[i] for i in secrets)


def test_tokens():
    token = lambda t: [t[a:b] for a, b in pii.candidates(t)]
    assert token("id:4711-x, (2024). a@b @1 no. 1.2.3.4/5 é1234é user@host.") == ["4711-x", "2024", "a@b", "1.2.3.4/5", "1234", "user@host"]
    assert token("x" * 100 + "1234 " + "9" * 5000) == ["x" * 100 + "1234", "9" * 5000]
    assert pii.patterns('The\ttoken = "A1B2"###', 13, 17) == ['L token = "', 'S = " a93', 'B " _ " a93']
    assert pii.patterns("\n5 12345", 3, 8) == ["L ^ ^ 9", "S ^ 9 93", "B 9 _ $ 93"]


LONG = {"digits": "1" * 200_000, "dotted": "1." * 100_000, "unspaced": "漢字" * 100_000 + "1", "numbered": "漢字1234" * 30_000, "at": "a@" * 100_000, "letters": "a" * 200_000 + "1234", "plus": "+1(" * 60_000, "spaces": " " * 100_000 + "1234" + " " * 100_000}


@pytest.mark.parametrize("name", LONG)
def test_time_is_in_proportion(name):
    began = time.perf_counter()
    for a, b, _ in pii.met(LONG[name])[1]:
        pii.patterns(LONG[name], a, b)
    assert time.perf_counter() - began < 5


def test_names_that_clash(spark):
    texts = ["write to a@b.cd now", None]
    df = docs_of(spark, texts)
    for name in ("_found", "_of_doc", "_of_key", "found", "of_doc", "of_key", "row", "key", "id", "base", "seen", "a b", "a.b:c"):
        df = df.withColumn(name, F.lit("clash"))
    out = pii.masked(df)
    assert out.columns == df.columns and sorted(r["text"] for r in out.collect()) == ["", "write to <EMAIL> now"]
    assert all(r["_found"] == r["a b"] == r["a.b:c"] == "clash" for r in out.collect())


def test_the_registered_query(spark, tmp_path):
    texts, _ = corpus(200)
    texts += [None, "4111 1111 1111 1111 and 1.2.3.4, +1 (017) 555-7713"]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    wanted = {}
    for i, (text, found, new) in enumerate(zip(texts, *plain_found(texts), strict=True)):
        base = plain_spans(text or "")
        names = [*pii.KINDS, "context"]
        line = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
        every = [*base, *((a, 4, b) for a, b in found)]
        wanted[i] = (*(sum(k == n for _, k, _ in base) for n in range(4)), hashlib.sha256(line(base).encode()).hexdigest(), line(every), len(every), new)
    got = queries.QUERIES["op4_contextual_pii"](spark, str(tmp_path))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == wanted


def test_seeds_of_fixed_patterns_alone(spark):
    """Without the rule of keys: base spans teach the contexts in which tokens of other shapes are then discovered."""
    rng = random.Random(3)
    texts, planted = [], {}
    for i in range(240):
        who = f"user{i}@mail{i % 7}.example.com" if i % 3 else f"user{i}@intranet{i}" if i % 2 else "%040x" % rng.getrandbits(160)
        texts.append(f'some words contact = "{who}" and {rng.randint(1000, 9999)} more, code x{i}y{rng.randint(100, 999)} here')
        if i % 3 == 0:
            planted[i] = who
    got = {r["doc_id"]: r for r in pii.spans(docs_of(spark, texts), keys=False).collect()}
    wanted, new = plain_found(texts, keys=False)
    assert [[(s["start"], s["end"]) for s in got[i]["found"]] for i in range(len(texts))] == wanted and [got[i]["discovered"] for i in range(len(texts))] == new
    found = {i: texts[i][a:b] for i, w in enumerate(wanted) for a, b in w}
    assert set(found.items()) <= set(planted.items()) and len(found) >= 0.9 * len(planted)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_planted_tokens_of_the_tables(spark, sf):
    """All planted tokens and nothing else; a bounded list of them are seeds, the others are discovered."""
    folder = f"/root/testdata/{sf}"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    planted = {(i, m.start(1), m.end(1)) for i, t in texts.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t, re.I)}
    got = pii.spans(spark.read.parquet(f"{folder}/documents.parquet")).where("size(found) > 0").collect()
    assert {(r["doc_id"], s["start"], s["end"]) for r in got for s in r["found"]} == planted
    seeds = sorted({texts[i][a:b].lower() for i, a, b in planted}, key=pii._number)[: pii.SEEDS]
    discovered = sum(texts[i][a:b].lower() not in seeds for i, a, b in planted)
    assert sum(r["discovered"] for r in got) == discovered > 0 and (sf == "sf0.01" or discovered > 0.9 * len(planted))
