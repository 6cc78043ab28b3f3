"""Lines of text: numbers are rounded as C rounds them."""

import duckdb

from tidemark.plans import feeds

QUOTES = [("A", 0.125, 0.25), ("B", 1.005, -0.35), ("C", 2.675, 0.05), ("D", 10.0, -0.04), ("E", 1e15 + 0.125, 0.0), ("F", 7.0, None), ("G", -0.001, float("inf"))]


def test_ties_and_decimals_that_are_none(spark, monkeypatch):
    """What stands at half a digit, or seems to, in the query and in its SQL."""
    kind = "ticker string, price double, change_pct double"
    monkeypatch.setattr(feeds.T, "quotes", lambda spark, sf_dir: spark.createDataFrame(QUOTES, kind))
    got = dict(feeds.QUERIES["snk12_text_lines"](spark, "").collect())
    assert got["A"] == "A closed at 0.12 (+0.2%)" and got["B"] == "B closed at 1.00 (-0.3%)" and set(got) == set("ABCDEG")
    con = duckdb.connect()
    con.execute("CREATE TABLE t_quotes (ticker VARCHAR, price DOUBLE, change_pct DOUBLE)")
    con.executemany("INSERT INTO t_quotes VALUES (?, ?, ?)", QUOTES)
    sql = feeds.ORACLE_SQL["snk12_text_lines"]
    assert got == dict(con.execute(sql[sql.rindex("SELECT ticker, ticker ||") :]).fetchall())
