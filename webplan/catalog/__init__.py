"""Named queries over the page corpus, each next to the SQL it must agree with."""

from __future__ import annotations

import importlib

MODULES = [
    "links", "elements", "naming", "fields", "candidates", "grouping", "taxonomy", "quality", "tables", "streams",
]


def load():
    from webplan.catalog import base

    for name in MODULES:
        importlib.import_module(f"webplan.catalog.{name}")
    return base.QUERIES, base.ORACLE
