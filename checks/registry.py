"""All registered queries and their SQL."""

from __future__ import annotations

from checks import places, tables

_PARTS = (tables, places)


def queries() -> dict:
    return {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
