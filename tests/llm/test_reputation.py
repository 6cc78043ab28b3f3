"""The reputation of hosts, with and without outcomes of their own, on a table where it blocks, against the SQL twin."""

import random

import duckdb
import pandas as pd
import pytest

from tidemark.llm import common, queries, urls


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(2)
    pages, labels = [], []

    def add(host, bad, path="/a"):
        i = len(pages)
        pages.append((i, None if host is None else f"http://{host}{path}"))
        if bad is not None:
            labels.append((i, 1 - bad, 0))

    for i in range(400):
        add(f"h{i % 40}.bad.net", 1)
        add(f"h{i % 40}.mixed.net", int(rng.random() < 0.3))
        add(f"h{i % 40}.good.net", 0)
        add(f"s{i % 50}.co.uk", int(i % 50 < 25))
        add(f"10.0.{i % 4}.{i % 7}", i % 2)
        add(f"d{i % 30}.zip", 1)
        add(f"www.Good{i % 9}.info:8080", 0)
    for host in ("new.bad.net", "new.good.net", "new.mixed.net", "a.b.new.co.uk", "10.9.9.9", "new.zip", "other.unknown", "unknown", "", None):
        add(host, None)
    add("x.example.org", 1, "/en/1")
    add("same.net", 1)
    folder = tmp_path_factory.mktemp("reputation")
    pd.DataFrame(pages, columns=["page_id", "url"]).assign(html="").to_parquet(folder / "pages.parquet")
    pd.DataFrame([*labels, (labels[0][0], None, 0), (10**9, 0, 1)], columns=["doc_id", "quality", "toxic"]).astype("Int64").to_parquet(folder / "labels.parquet")
    return str(folder)


def test_twin(spark, folder):
    got = queries.QUERIES["op5_host_reputation"](spark, folder).toPandas().sort_values("page_id").reset_index(drop=True)
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    wanted = con.execute(queries.ORACLE_SQL["op5_host_reputation"]).df()[list(got.columns)].sort_values("page_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got.fillna("-").astype(str), wanted.fillna("-").astype(str))
    verdict = dict(zip(got.host, got.verdict))
    assert [verdict[h] for h in ("h3.bad.net", "new.bad.net", "h3.good.net", "new.good.net", "d2.zip", "new.zip", "s3.co.uk", "s30.co.uk", "www.good3.info:8080", "")] == ["block", "block", "allow", "allow", "block", "block", "block", "allow", "allow", "allow"]
    assert (got[got["rule"].isna()].verdict == "block").sum() > 500


def test_domains_and_suffixes(spark):
    hosts = {"a.b.c.com": ("c.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "a.x.com.au:80": ("x.com.au", "com.au"), "1.2.3.4": ("1.2.3.4", "ip"), "1.2.3.4:8": ("1.2.3.4", "ip"), "localhost": ("localhost", "localhost"), "a.uk": ("a.uk", "uk")}
    got = urls.with_domains(spark.createDataFrame([(h,) for h in hosts], "host string")).collect()
    assert {r["host"]: (r["domain"], r["suffix"]) for r in got} == hosts


def test_the_posterior_is_the_beta_binomial_one(spark):
    """By hand: one suffix, two domains, hosts with (n, bad) of (8, 8), (8, 0) and (4, 2)."""
    outcomes = [("a.x.net", 1)] * 8 + [("b.x.net", 0)] * 8 + [("c.y.net", 1)] * 2 + [("c.y.net", 0)] * 2
    found, _, _, anywhere = urls.reputation(spark.createDataFrame(outcomes, "host string, bad int"))
    rows = {r["host"]: r for r in found.collect()}

    def strength(groups):
        n, bad, m = sum(g[0] for g in groups), sum(g[1] for g in groups), len(groups)
        rate = bad / n
        spread = rate * (1 - rate)
        between = sum(b * b / k for k, b in groups) - n * rate * rate - (m - 1) * spread
        scale = n - sum(k * k for k, _ in groups) / n
        return 500.0 if scale <= 0 or between <= 0 or spread <= 0 else round(min(max(spread / (between / scale) - 1, 2), 500), 3)

    k_top, k_suffix, k_x = strength([(20, 10)]), strength([(16, 8), (4, 2)]), strength([(8, 8), (8, 0)])
    mu_suffix = (10 + k_top * 0.5) / (20 + k_top)
    mu_x = (8 + k_suffix * mu_suffix) / (16 + k_suffix)
    assert (rows["a.x.net"]["alpha"], rows["a.x.net"]["beta"]) == pytest.approx((8 + k_x * mu_x, k_x * (1 - mu_x)))
    assert tuple(anywhere.first()) == pytest.approx((0.5, 2.0))


@pytest.mark.parametrize("share", [3, 2_000])
def test_a_third_of_the_pages_on_one_host_and_a_third_without_any(spark, monkeypatch, share):
    """Hosts that are sent and hosts that are joined get the verdicts of a plain loop."""
    monkeypatch.setattr(common, "HOT_SHARE", share)
    urls_of = ["http://big.bad.net/x"] * 300 + [None, "no scheme"] * 150 + [f"http://h{i % 60}.good.net/" for i in range(180)] + [f"http://s{i % 40}.bad.net/" for i in range(120)]
    pages = spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string").repartition(7)
    outcomes = spark.createDataFrame([(i, int(".bad." in u)) for i, u in enumerate(urls_of) if u and "://" in u], "page_id long, bad int")
    rows = {r["page_id"]: r for r in urls.judge(pages, outcomes).collect()}
    assert len(rows) == len(urls_of)
    assert {i: (r["host"], r["verdict"], r["n_labelled"] > 0) for i, r in rows.items()} == {
        i: ("", "allow", False) if not u or "://" not in u else (u.split("/")[2], "block" if ".bad." in u else "allow", True) for i, u in enumerate(urls_of)
    }
    assert rows[0]["n_labelled"] == rows[0]["n_bad"] == 300
