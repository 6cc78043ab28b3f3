"""The whole quality query against plain Python: features character by character, marginals by sums in logarithms."""

import math
import zlib

import pandas as pd
import pytest

from tidemark.llm import common, quality, queries

SF = "/root/testdata/sf0.001"
SYMBOLS, STOPS, SPACES = set("*$#%&~^_=+<>{}[]\\@`"), set(".,;:?-'\"()"), set(" \t\r\x0b\x0c")


def features(lines):
    out = []
    for i, line in enumerate(lines):
        n = len(line.encode("utf-8", "surrogatepass"))
        size, words = max(n, 1), line.split()
        count = lambda inside: sum(1 for c in line if inside(c)) / size
        f = [
            math.log1p(n) / 5, count(lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ"), count(lambda c: "0" <= c <= "9"), count(SYMBOLS.__contains__), count(STOPS.__contains__), count(SPACES.__contains__),
            count(lambda c: c == "|"), count(lambda c: c == "!"), 0.0, 0.0, 0.0, float(line[-1:] in tuple('.?!:"')), float("A" <= line[:1] <= "Z" or "À" <= line[:1] <= "ÿ"), float(n == 0), 0.0,
        ]
        if words:
            f[8:11] = len(set(words)) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words), min(n / len(words) / 10, 5)
            f[14] = float(i > 0 and line == lines[i - 1])
        out.append(f)
    return out


def log_sum(values):
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def good_lines(unary, steps):
    """P(good) of each line of a chain: label 1 adds its log odds, each pair of neighbours its step."""
    n = len(unary)
    node = [(0.0, max(-30.0, min(30.0, u))) for u in unary]
    ahead, behind = [list(node[0])], [[0.0, 0.0]]
    for t in range(1, n):
        ahead.append([node[t][b] + log_sum([ahead[-1][a] + steps[a][b] for a in (0, 1)]) for b in (0, 1)])
    for t in range(n - 2, -1, -1):
        behind.append([log_sum([steps[a][b] + node[t + 1][b] + behind[-1][b] for b in (0, 1)]) for a in (0, 1)])
    behind.reverse()
    both = [[x + y for x, y in zip(f, g)] for f, g in zip(ahead, behind)]
    return [math.exp(g - log_sum([b, g])) for b, g in both]


def plain_score(text, field):
    lines = text.split("\n")
    own, unary = features(lines), []
    for i, f in enumerate(own):
        before, after = own[i - 1] if i else f, own[i + 1] if i + 1 < len(own) else f
        x = [*f, *((a + b) / 2 for a, b in zip(before, after)), 1.0]
        unary.append(sum(a * w for a, w in zip(x, field.weights)))
    good = good_lines(unary, field.steps.tolist())
    weight = [max(len(line.encode("utf-8", "surrogatepass")), 1) for line in lines]
    mean = sum(g * w for g, w in zip(good, weight)) / sum(weight)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, field.slope * mean + field.offset))))


def test_the_query_as_plain_python_scores(spark, tmp_path):
    docs = pd.read_parquet(f"{SF}/documents.parquet").astype({"doc_id": "Int64"})
    odd = pd.DataFrame([(None, "A line.\n\n\nA line.\nA line."), (900, None), (901, ""), (902, "\n"), (903, "ÉÀ ÿ þ!!||*** 12\n" * 300), (903, " \t x\r\n y")], columns=["doc_id", "text"])
    whole = pd.concat([docs, odd.astype({"doc_id": "Int64"})], ignore_index=True)
    whole.to_parquet(tmp_path / "documents.parquet")
    pd.read_parquet(f"{SF}/labels.parquet").to_parquet(tmp_path / "labels.parquet")
    field = quality.train(common.table(spark, str(tmp_path), "documents"), common.table(spark, str(tmp_path), "labels"))
    key = lambda i, s: (-1 if i is None or i is pd.NA or i != i else int(i), s)
    wanted = sorted(key(r.doc_id, plain_score(r.text or "", field)) for r in whole.itertuples())
    got = queries.QUERIES["op10_line_field"](spark, str(tmp_path)).collect()
    assert [i for i, _ in wanted] == [i for i, _ in sorted(key(r.doc_id, r.score) for r in got)]
    assert [s for _, s in sorted(key(r.doc_id, r.score) for r in got)] == pytest.approx([s for _, s in wanted], abs=1e-9)
    assert all(r.predicted == (r.score >= 0.7) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
