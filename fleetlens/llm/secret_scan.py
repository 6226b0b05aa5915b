"""Operator 3: secret scans over a trigram inverted index (built-in functions only).

Each rule's expression gives a Boolean trigram query (``trigrams.py``). The index
holds, for the trigrams that occur in any query, the documents that contain them;
intersecting its postings gives the documents a rule can match, and only
those are searched with the expression. Rules without a mandatory trigram
(hex strings) search every document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty
from .trigrams import query

_WORD = 62


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, non-overlapping) whose ``group`` has ``min_chars`` or more."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0


# The three base rules and three more. In ``access`` and ``hex`` the least length is in the
# pattern: a match ends where its run of characters ends, so a match too short
# hides no longer one. In ``assign`` a short match can hide a long one, so it is dropped after.
BASE = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def trigram_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings ``gram`` (number in ``grams``), ``id`` of ``docs(id, text)``."""
    wanted = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(g).alias("gram")) for i, g in enumerate(grams)])
    low = docs.select("id", F.lower("text").alias("low"))
    present = F.filter(wanted, lambda g: F.contains(F.col("low"), g["gram"]))
    return low.select(F.explode(F.transform(present, lambda g: g["no"])).alias("gram"), "id")


def candidates(index: DataFrame, grams: list[str], queries: dict[str, list]) -> DataFrame:
    """Intersected postings: ``may_id`` and a flag per rule with a query."""
    number = {g: i for i, g in enumerate(grams)}
    words = range(-(-len(grams) // _WORD))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") % _WORD)
    found = index.groupBy("id").agg(*[
        F.bit_or(F.when(F.floor(F.col("gram") / _WORD) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words
    ])

    def has(trigrams) -> Column:
        out = F.lit(True)
        for w in words:
            need = sum(1 << number[g] % _WORD for g in trigrams if number[g] // _WORD == w)
            if need:
                out = out & (F.col(f"w{w}").bitwiseAND(F.lit(need)) == need)
        return out

    def holds(conditions) -> Column:
        out = F.lit(True)
        for condition in conditions:
            one = F.lit(False)
            for trigrams in condition:
                one = one | has(trigrams)
            out = out & one
        return out

    flags = [holds(conditions).alias(f"may_{kind}") for kind, conditions in queries.items()]
    return found.select(F.col("id").alias("may_id"), *flags)


# Matches per step of the running sums: appending to an array copies it, so arrays are kept this short.
_STEP = 256


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """Sums of the entries before each entry of an array of numbers shorter than some ten thousand."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(
        lengths, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["out"], s["at"]).alias("out")), lambda s: s["out"])


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of ``start, order, end, kind`` (code points) of a rule's matches in a text.

    The pieces between the matches and the matches themselves make up the text, so the
    offsets are running sums of their lengths. They are summed in steps of some hundred matches, then within
    each step, so the time grows in proportion to the matches.
    """
    pattern, long = F.lit(rule.pattern), lambda c: F.length(c).cast("long")
    whole, part = F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(rule.group))
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    zipped = F.filter(F.arrays_zip(
        F.transform(F.split(text, rule.pattern, -1), long).alias("gap"), F.transform(whole, long).alias("len"),
        F.transform(part if rule.min_chars else whole, long).alias("part"),
    ), lambda x: x["len"].isNotNull())

    def steps(found):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / _STEP).cast("int")), lambda i: F.slice(found, i * _STEP + 1, F.lit(_STEP)))

    def within(step, at):
        starts = _running(F.transform(step, lambda x: x["gap"] + x["len"]))
        hits = F.transform(F.arrays_zip(step.alias("x"), starts.alias("before")), lambda z: F.struct(
            (at + z["before"] + z["x"]["gap"]).alias("start"), F.lit(order).alias("order"),
            (at + z["before"] + z["x"]["gap"] + z["x"]["len"]).alias("end"), F.lit(rule.kind).alias("kind"), z["x"]["part"].alias("part")))
        return F.transform(F.filter(hits, lambda h: h["part"] >= rule.min_chars), lambda h: h.dropFields("part"))

    def placed(parts):
        at = _running(F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + x["len"])))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("step"), at.alias("at")), lambda z: within(z["step"], z["at"])))

    return F.when(F.regexp_like(text, pattern), _let(_let(zipped, steps), placed)).otherwise(none)


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_<kind>`` per base rule, ``found`` and ``base_sha256``, ``spans``.

    ``found`` is the array of all spans by start, then rule order; ``spans`` the
    same as text (``kind:start:end``, comma-joined) and ``base_sha256`` the digest of
    that text for the base rules alone. Null text counts as empty. Rows that
    repeat a document id are each searched on their own text (the index may let through
    one for the other's sake, which changes no result); null ids are one
    posting. An empty table gives no row, a very long text takes time in proportion to its length and matches, and
    other columns of ``docs`` are ignored, whatever their names.
    """
    rules = (*base, *more)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    queries = {r.kind: q for r in rules if (q := query(r.pattern))}
    grams = sorted({g for q in queries.values() for condition in q for clause in condition for g in clause})
    may = candidates(saved(trigram_index(texts, grams), "trigrams"), grams, queries)
    joined = texts.join(may.hint("merge"), F.col("id").eqNullSafe(F.col("may_id")), "left")
    none = F.array().cast("array<struct<start:bigint,order:int,end:bigint,kind:string>>")
    per_rule = [
        (F.when(F.col(f"may_{r.kind}"), spans(F.col("text"), r, i)).otherwise(none) if r.kind in queries else spans(F.col("text"), r, i)).alias(f"s_{r.kind}")
        for i, r in enumerate(rules)
    ]
    found = joined.select("id", *per_rule)
    names = lambda chosen: F.array_sort(F.concat(*[F.col(f"s_{r.kind}") for r in chosen]))
    text = lambda array: F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base],
        F.sha2(text(names(base)), 256).alias("base_sha256"), text(names(rules)).alias("spans"), names(rules).alias("found"),
    )
