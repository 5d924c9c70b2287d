"""Named queries and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import DUCK_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name`` and the equivalent SQL, if there is one."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return fn
    return wrap


def with_views(sql: str) -> str:
    """Prefix the SQL with the binding views it needs, dependencies first."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bb_\w+\b", text)):
            if name in DUCK_VIEWS and name not in needed:
                visit(DUCK_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    views = ",\n".join(f"{n} AS ({DUCK_VIEWS[n].strip()})" for n in needed)
    if re.match(r"(?i)with\b", body):
        rest = re.sub(r"(?i)^with(\s+recursive)?\s", "", body, count=1)
        head = "WITH RECURSIVE " if re.match(r"(?i)with\s+recursive", body) else "WITH "
        return f"{head}{views},\n{rest}"
    return f"WITH {views}\n{body}"
