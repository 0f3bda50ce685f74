"""Query catalogue: every registered query reads the given tables at ``sf_dir``.

``register(name, sql)`` records the Spark builder ``fn(spark, sf_dir)`` and,
when the result is SQL-expressible, the DuckDB oracle producing the same
columns.  Modules are imported below so that importing the package fills the
registry.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def with_ctes(*ctes: str) -> str:
    """Join CTE bodies into one ``WITH`` prefix."""
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes if c and c.strip()) + "\n"


from vicinity.plans import search, corpus, text, vectors, index, multilabel, sampling, analysis, streaming, evaluation  # noqa: E402,F401
