"""Every registered query by name, with its SQL where SQL can express it."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir) under name."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _load() -> None:
    from . import plans  # noqa: F401  registers the queries


def queries() -> dict:
    _load()
    return QUERIES


def oracles() -> dict:
    _load()
    return ORACLES
