"""Registers named queries over adapter tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from .adapter import tables, with_tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


#: What a query of the last rankings alone reads in Spark: no earlier ranking is made for it.
LAST = {"links": "last_links", "ranking_entries": "last_entries"}


def query(name: str, needs: tuple[str, ...] = (), sql: str | None = None, last: bool = False):
    """Register ``f(*tables) -> DataFrame``; ``sql`` states the same over the same tables. With ``last`` the query takes of all rankings each discipline's last only."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*tables(spark, sf_dir, *(LAST.get(n, n) if last else n for n in needs)))
        if sql is not None:
            ORACLES[name] = (with_tables(*needs) if needs else "") + sql
        return f

    return register


def raw_query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame``."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register
