"""Helpers shared by the expression modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once however often the body mentions it.

    Column expressions have no variables: nesting parsed addresses would otherwise copy the whole
    parse into every mention and the plan would grow exponentially."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
