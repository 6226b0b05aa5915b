"""Small column helpers shared by the operators (E3, E4 and friends)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cols(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def falsy_default(value: Column | str, default: Column | str | int | float) -> Column:
    """E3: ``x or d`` — NULL and empty text both fall back to the default."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(as_col(value), F.lit("")), d)


def upper_list(names: str | Iterable[str] | None) -> list[str]:
    """E4: a comma list, upper-cased, split without trimming (``"a, b"`` keeps
    the blank in front of ``B``)."""
    if names is None:
        return []
    if isinstance(names, str):
        if names == "":
            return []
        names = names.split(",")
    return [n.upper() for n in names]


def regex_quote(text: str) -> str:
    """Quote a literal separator for Spark's (Java) ``split`` pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def java_replacement(py_replacement: str) -> str:
    """Python ``re.sub`` replacement text to Java's ``regexp_replace`` form:
    ``\\1`` and ``\\g<1>`` become ``$1``; a literal ``$`` is escaped."""
    out = py_replacement.replace("$", r"\$")
    out = re.sub(r"\\g<(\d+)>", r"$\1", out)
    return re.sub(r"\\(\d)", r"$\1", out)
