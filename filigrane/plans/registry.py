"""Named queries: a Spark function and, where SQL can say it, the statement it must agree with."""
from __future__ import annotations

from collections.abc import Callable

from filigrane.plans import oracle

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: str = "", sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle.sql(needs, sql)
        return fn
    return deco
