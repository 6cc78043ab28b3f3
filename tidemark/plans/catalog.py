"""The registered queries of the main library and their SQL twins."""

from __future__ import annotations

from tidemark.plans import feeds, fundamental, markets, portfolio, scalars, technical

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (technical, fundamental, portfolio, markets, scalars, feeds):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL


def flagship(spark, sf_dir):
    """The technical snapshot by part type, whose few tickers have long histories even in the smallest tables."""
    return technical.snapshot(spark, sf_dir, "p_type")
