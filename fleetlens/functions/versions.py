"""E1: version keys as integer arrays.

Spark orders arrays lexicographically, shorter-prefix first, so a parsed key
compares like a tuple of ints: ``[2,10] > [2,9]`` and ``[3,0] < [3,0,0,0]``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.functions.columns import as_col


def version_key(version: Column | str) -> Column:
    """Dotted text to ``array<int>``; a non-numeric part becomes NULL."""
    parts = F.split(as_col(version), r"\.")
    return F.transform(parts, lambda p: p.try_cast("int"))


def version_prefix(key: Column | str, n: int = 2) -> Column:
    """First ``n`` parts of a key (the two-part stack version)."""
    return F.slice(as_col(key), 1, n)


def version_literal(parts: Sequence[int] | str) -> Column:
    """A constant key, from ``(3, 0)`` or ``"3.0"``."""
    if isinstance(parts, str):
        parts = [int(p) for p in parts.split(".")]
    return F.array(*[F.lit(int(p)) for p in parts])
