"""Text jobs: W16 rewrite_text, W17 extract_first. Both are map-only column
expressions over whole texts; no UDF."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import as_col, cols
from fleetlens.plans.skew import join_table


def rewrite_text(df: DataFrame, text: str,
                 rules: Sequence[tuple[str, str | Column]], name: str | None = None) -> DataFrame:
    """W16. Apply an ordered list of regex replacements (every match) to the
    whole text. Order matters: each rule sees the output of the one before.
    Patterns are Java regexes (an unescaped dot matches any character);
    replacements use ``$1`` for groups (see
    :func:`fleetlens.functions.java_replacement` for Python-style text) and
    may be columns, e.g. a per-cluster value joined in beforehand."""
    return df.withColumn(name or text, rewrite_expr(F.col(text), rules))


def rewrite_expr(text: Column, rules: Sequence[tuple[str, str | Column]]) -> Column:
    """The fold of :func:`rewrite_text` as a column expression."""
    out = text
    for pattern, repl in rules:
        r = repl if isinstance(repl, Column) else F.lit(repl)
        out = F.regexp_replace(out, F.lit(pattern), r)
    return out


def rewrite_by_rules(df: DataFrame, text: str, rules: DataFrame, on: str | Sequence[str], ord: str = "ord",
                     pattern: str = "pattern", replacement: str = "replacement", name: str | None = None) -> DataFrame:
    """W16 with the rules as a table: each row's text goes through the rules of its key ``on``, by ascending
    ``ord``, each seeing the output of the one before (equal ``ord``: by pattern). Patterns and replacements are
    as in :func:`rewrite_text`; values from data are quoted with :func:`literal_replacement`. A rule with a NULL
    pattern or replacement leaves the text as it is, and so does a key without rules.

    The rules become one row per key, broadcast after their size is checked; beyond that texts meet the row with hot
    keys kept in place. So no text is copied per rule, and a key that holds a third of the texts is not shuffled to one task.
    """
    on = cols(on)
    rule = F.struct(F.col(ord).alias("o"), F.col(pattern).alias("p"), F.col(replacement).alias("r"))
    per_key = rules.filter(F.col(pattern).isNotNull() & F.col(replacement).isNotNull()).groupBy(*on).agg(
        F.sort_array(F.collect_list(rule)).alias("_fl_rules"))
    j = join_table(df, per_key, on)
    folded = F.aggregate("_fl_rules", F.col(text), lambda t, r: F.regexp_replace(t, r["p"], r["r"]))
    new = F.when(F.col("_fl_rules").isNull(), F.col(text)).otherwise(folded)
    target = name or text
    return j.select(*[F.col(f"`{c}`") for c in df.columns if c != target], new.alias(target)).select(
        *[F.col(f"`{c}`") for c in df.columns], *([] if target in df.columns else [F.col(target)]))


def literal_replacement(value: Column) -> Column:
    """Escape ``\\`` and ``$`` in a column so it is inserted verbatim as a
    regex replacement (host names, realms and lifetimes come from data)."""
    return F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), r"\$", r"\\\$")


_ONE = re.compile(r"[^\\^$.|?*+()\[\]{}]|\\[\\^$.|?*+()\[\]{}]", re.S)
_CLASS = re.compile(r"\[([^\\^\[\]-][^\\\[\]-]*)\]")


def _separators(sep: str) -> set[str]:
    """The characters that ``sep`` matches if it is one character or a plain class, else none."""
    if _ONE.fullmatch(sep):
        return {sep[-1]}
    found = _CLASS.fullmatch(sep)
    return set(found[1]) if found and "&&" not in found[1] else set()


def _around_first(text: Column, ends: set[str], sep: str, token: str) -> Column:
    """The piece around the first ``token``: from the last separator before it to the next one after it."""
    at = F.locate(token, text)
    head = F.element_at(F.split(F.substring_index(text, token, 1), sep), -1)
    nexts = [F.call_function("locate", F.lit(c), text, at) for c in sorted(ends)]
    stop = F.least(*[F.when(n > 0, n) for n in nexts], F.lit(2**31 - 1))
    return F.when(at > 0, F.concat(head, F.substr(text, at, stop - at)))


def extract_first(df: DataFrame, text: str | Column, sep: str, token: str,
                  kv_sep: str = ":", name: str = "value", status: str | None = "status",
                  cast: str = "int") -> DataFrame:
    """W17. Split the text on the regex ``sep``; take the first piece that
    contains ``token`` (anywhere, not only at its start); its second field
    after the literal ``kv_sep``, trimmed and cast. A missing piece, bad
    number or 0 gives NULL; ``status`` says which: found / absent / invalid /
    zero.

    Where ``sep`` is one character or a class of listed characters of which ``token`` has none,
    the piece is what lies around the first token: nothing behind it is split. Any other
    ``sep`` needs all pieces of a text."""
    at = as_col(text)
    ends = _separators(sep)
    if token and ends and not ends & set(token):
        piece = _around_first(at, ends, sep, token)
    else:
        piece = F.get(F.filter(F.split(at, sep), lambda p: p.contains(token)), 0)
    raw = F.trim(F.split_part(piece, F.lit(kv_sep), F.lit(2)))
    num = raw.try_cast(cast)
    out = df.withColumn(name, F.when(num != 0, num))
    if status:
        st = (F.when(piece.isNull(), F.lit("absent"))
              .when(num.isNull(), F.lit("invalid"))
              .when(num == 0, F.lit("zero"))
              .otherwise(F.lit("found")))
        out = out.withColumn(status, st)
    return out
