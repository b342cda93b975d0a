"""Registered queries: operator name -> (Spark query, SQL twin or None)."""

from __future__ import annotations

from . import pairs, rows, scoring, stats, tables
from .base import Entry

MODULES = (rows, scoring, stats, pairs, tables)


def entries() -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    for module in MODULES:
        for name, entry in module.ENTRIES.items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = entry
    return out
