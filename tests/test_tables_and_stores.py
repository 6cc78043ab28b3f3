"""HTML tables against grids that are known, pair sums against NumPy, the keyed store over successive runs and failures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import html_tables
from tidemark.operators import moments, portfolio
from tidemark.sources.store import Conflict, KeyedStore


def found(spark, *pages):
    got = html_tables.cells(spark.createDataFrame(list(enumerate(pages)), "page long, html string"))
    out = {}
    for r in got.collect():
        out.setdefault((r.page, r.tbl), {})[r.row, r.col] = (r.header, r.cell)
    return out


def test_random_grids(spark):
    """A grid is covered by rectangles at random, written with and without end tags, and must come back whole."""
    rng, pages, wanted = random.Random(5), [], {}
    for page in range(25):
        high, wide = rng.randint(1, 6), rng.randint(1, 6)
        taken, lines = {}, []
        for r in range(high):
            line = ""
            for c in range(wide):
                if (r, c) in taken:
                    continue
                across = rng.randint(1, 3) if rng.random() < 0.3 else 1
                across = next((k for k in range(1, across) if c + k >= wide or (r, c + k) in taken), across)
                down = min(rng.randint(1, 3), high - r) if rng.random() < 0.3 else 1
                name = f"c{r}.{c} &amp; <b>x</b>\n y"
                taken |= {(r + i, c + k): f"c{r}.{c} & x y" for i in range(down) for k in range(across)}
                spans = (f' colspan="{across}"' if across > 1 else "") + (f" rowspan={down}" if down > 1 else "")
                line += f"<td{spans}>{name}" + ("</td>" if page % 2 else "")
            lines.append(f"<tr>{line}" + ("</tr>" if page % 2 else ""))
        pages.append(f"<p>before<table><thead><tr>{''.join(f'<th>h{c}</th>' for c in range(wide))}</thead><tbody>{''.join(lines)}</table> after")
        wanted[page, 0] = {at: (f"h{at[1]}", text) for at, text in taken.items()}
    assert found(spark, *pages) == wanted


def test_headers_nesting_and_broken_pages(spark):
    got = found(
        spark,
        "<table><tr><th colspan=2>Both<tr><th>A<th>B<tr><td>1<td>2<tfoot><tr><td>3<td>4</table>",
        "<table><tr><td>out<table><tr><td>in</table>er<td>next</table><table><tr><td>last",
        "<table><tr><td rowspan=0>all<td>a<tr><td>b<tr><td>c</table>",
        "<td>no table</td><table></table><table><tr></tr><tr><td colspan=x>odd<script>var a = '<td>';</script></td></table></table>",
        None,
        "",
    )
    assert got == {
        (0, 0): {(0, 0): ("Both A", "1"), (0, 1): ("Both B", "2"), (1, 0): ("Both A", "3"), (1, 1): ("Both B", "4")},
        (1, 0): {(0, 0): (None, "outer"), (0, 1): (None, "next")},
        (1, 1): {(0, 0): (None, "in")},
        (1, 2): {(0, 0): (None, "last")},
        (2, 0): {(r, c): (None, "all" if c == 0 else "abc"[r]) for r in range(3) for c in range(2)},
        (3, 1): {(0, 0): (None, "odd")},
    }


def test_first_column_with_enough_symbols(spark):
    rows = "".join(f"<tr><td>Name {i}<td>SEHK: {i}<td>{i}" for i in range(12))
    page = f"<table><tr><th>Code<tr><td>1</table><table><tr><th>Company<th>Ticker symbol<th>Code{rows}</table>"
    cells = html_tables.cells(spark.createDataFrame([(1, page), (2, "<table><tr><th>Code<tr><td>1</table>")], "page long, html string"))
    digits = F.regexp_replace("cell", "[^0-9]", "")
    got = html_tables.constituents(cells, ["page"], ("symbol", "code"), F.when(F.length(digits) > 0, digits))
    assert sorted(map(tuple, got.collect())) == [(1, i, str(i)) for i in range(12)]


@pytest.mark.parametrize(("tile", "block"), [(128, 512), (4, 7)])
def test_pair_moments(spark, monkeypatch, tile, block):
    monkeypatch.setattr(moments, "TILE", tile)
    monkeypatch.setattr(moments, "BLOCK", block)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 13))
    there = rng.random((40, 13)) < 0.7
    there[:, 12] = False
    rows = [(b, f"n{k:02d}", d, float(x[d, k] * (b + 1))) for b in range(2) for d in range(40) for k in range(13) if there[d, k]]
    got = moments.pair_moments(spark.createDataFrame(rows, "book long, ticker string, place int, x double").repartition(3)).collect()
    assert len(got) == len({(r.book, *sorted((r.a, r.b))) for r in got}) == 2 * 12 * 13 // 2
    for r in got:
        a, b = int(r.a[1:]), int(r.b[1:])
        both = there[:, a] & there[:, b]
        u, v = x[both, a] * (r.book + 1), x[both, b] * (r.book + 1)
        assert np.allclose([r.n, r.sx, r.sy, r.sxx, r.syy, r.sxy], [both.sum(), u.sum(), v.sum(), (u * u).sum(), (v * v).sum(), (u * v).sum()])


def test_correlations_of_many_names(spark):
    """300 names in several tiles: all 44,850 pairs; a name that does not move has no correlation."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 300)) + rng.normal(size=(80, 1))
    x[:, 7] = 0.01
    rows = [(f"n{k:03d}", d, float(x[d, k])) for d in range(80) for k in range(300)]
    got = portfolio.correlations(spark.createDataFrame(rows, "ticker string, rn_desc int, r double")).toPandas()
    wanted = np.corrcoef(x, rowvar=False)
    assert len(got) == 300 * 299 // 2 and (got.a < got.b).all() and (got.n == 80).all()
    still = (got.a == "n007") | (got.b == "n007")
    assert got[still]["corr"].isna().all()
    moving = got[~still]
    assert np.allclose(moving["corr"], wanted[moving.a.str[1:].astype(int), moving.b.str[1:].astype(int)])


STORE = "day int, k string, v double"


def said(store, version=None):
    return sorted(map(tuple, store.read(version).collect()))


def test_store_over_runs(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), STORE, ["day", "k"], buckets=4)
    rows = lambda *r: spark.createDataFrame(list(r), f"{STORE}, at int")
    assert said(store) == [] and store.versions() == []
    first = rows((1, "a", 1.0, 1), (1, "a", 2.0, 3), (1, "a", 9.0, 2), (1, "b", 5.0, 1), (2, "a", 3.0, 1))
    assert store.upsert(first, "at") == 1
    assert said(store) == [(1, "a", 2.0), (1, "b", 5.0), (2, "a", 3.0)]
    store.upsert(first, "at")
    assert said(store) == [(1, "a", 2.0), (1, "b", 5.0), (2, "a", 3.0)]
    store.upsert(rows((2, "a", None, 0), (3, "c", 7.0, 0)), "at", deleted=rows((1, "b", 0.0, 0), (9, "z", 0.0, 0)).select("day", "k"))
    assert said(store) == [(1, "a", 2.0), (2, "a", None), (3, "c", 7.0)]
    assert said(store, 1) == [(1, "a", 2.0), (1, "b", 5.0), (2, "a", 3.0)]
    store.vacuum()
    assert store.versions() == [3] and said(KeyedStore(spark, str(tmp_path / "s"), STORE, ["day", "k"])) == [(1, "a", 2.0), (2, "a", None), (3, "c", 7.0)]


def test_store_writes_touched_buckets_only(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), STORE, ["k"], buckets=8)
    store.upsert(spark.createDataFrame([(0, f"k{i}", float(i)) for i in range(100)], STORE), "day")
    before = store._manifest()[1]
    store.upsert(spark.createDataFrame([(1, "k5", 0.5)], STORE), "day")
    after = store._manifest()[1]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert dict((k, v) for _, k, v in said(store))["k5"] == 0.5 and store.read().count() == 100


def test_store_after_a_write_that_fails(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), STORE, ["k"], buckets=2)
    store.upsert(spark.createDataFrame([(0, "a", 1.0)], STORE), "day")
    broken = spark.range(3).select(F.lit(1).alias("day"), F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.lit("a")).alias("k"), F.lit(2.0).alias("v"))
    with pytest.raises(Exception, match="broken"):
        store.upsert(broken, "day")
    with pytest.raises(ValueError, match="null"):
        store.upsert(spark.createDataFrame([(0, None, 1.0)], STORE), "day")
    assert said(store) == [(0, "a", 1.0)] and store.versions() == [1]
    store.vacuum()
    assert said(store) == [(0, "a", 1.0)]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    store = KeyedStore(spark, str(tmp_path / "s"), STORE, ["k"], buckets=2)
    one = spark.createDataFrame([(0, "a", 1.0)], STORE)
    store.upsert(one, "day")
    monkeypatch.setattr(store, "_manifest", lambda version=None: (0, {}))
    with pytest.raises(Conflict):
        store.upsert(one.withColumn("v", F.lit(2.0)), "day")
    assert said(KeyedStore(spark, str(tmp_path / "s"), STORE, ["k"])) == [(0, "a", 1.0)]
