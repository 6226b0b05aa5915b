"""Operator 9: mixing sources to target weights by temperature.

Weights are the sources' token shares to a power (the exponent is one over
the temperature), normalised. The exponent is bisected until the weights reach a target
entropy or no source is repeated more often than a limit. The weights
become documents as block permutations: a source's documents are dealt by hash
into blocks, the blocks are read in a shuffled order, each time round in another one, and reading
stops where the source's token budget ends.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_or_empty

_STEPS = 64
_BAND_BITS = 16


def n_tokens(text_col: str) -> Column:
    """White-space words of a text as its tokens."""
    return F.regexp_count(text_or_empty(text_col), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _statistics(sizes: DataFrame, exponents: list[float], budget: int | None) -> DataFrame:
    """For each exponent: entropy of the weights and the largest number of passes over a source.

    Two aggregations over one row per source; powers are taken relative to
    the largest source so that they neither overflow nor vanish together. Without a budget
    the largest source is read once.
    """
    grid = sizes.withColumn("x", F.explode(F.array(*map(F.lit, exponents)))).withColumn("p", F.pow(F.col("tokens") / F.col("largest"), F.col("x")))
    sums = grid.groupBy("x").agg(
        F.sum("p").alias("total"), F.sum(F.col("p") * F.log("p")).alias("plogp"), F.max(F.col("p") / F.col("tokens")).alias("top"), F.max("largest").alias("largest"),
    )
    return sums.select(
        "x", (F.log("total") - F.col("plogp") / F.col("total")).alias("entropy"),
        (F.col("top") * (F.col("largest") if budget is None else F.lit(budget) / F.col("total"))).alias("passes"),
    )


def find_exponent(
    sizes: DataFrame, budget: int | None, target_entropy: float | None = None, max_passes: float | None = None, tolerance: float = 1e-9
) -> float:
    """The exponent in [0, 1] for ``sizes(source, tokens)`` (tokens > 0).

    With ``target_entropy`` (nats): the largest exponent whose weights have at
    least that entropy. With ``max_passes``: the smallest exponent with which
    no source is read more often. Entropy falls and the largest number of passes falls as the
    exponent grows, so the interval can be narrowed; each job tries 64 exponents at once.
    A target out of reach gives the nearest end of [0, 1]; with both, the larger exponent.
    """
    largest = sizes.agg(F.max("tokens")).first()[0]
    if not largest:
        return 1.0
    sizes = sizes.withColumn("largest", F.lit(float(largest)))

    def narrow(fits_below) -> float:
        low, high = 0.0, 1.0
        while high - low > tolerance:
            xs = [low + (high - low) * i / _STEPS for i in range(_STEPS + 1)]
            below = [r["x"] for r in _statistics(sizes, xs, budget).collect() if fits_below(r)]
            if not below:
                return low
            if len(below) == len(xs):
                return high
            low = max(below)
            high = min(x for x in xs if x > low)
        return low

    found = []
    if target_entropy is not None:
        found.append(narrow(lambda r: r["entropy"] >= target_entropy))
    if max_passes is not None:
        low = narrow(lambda r: r["passes"] > max_passes)
        found.append(min(1.0, low + tolerance) if low > 0 else low)
    return max(found, default=1.0)


def temperature_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    budget: int | str | None = None, target_entropy: float | None = None, max_passes: float | None = 4.0,
    entropy_share: float | None = None, block_tokens: int = 1_000_000, seed: int = 42,
) -> DataFrame:
    """The mixture: one row per document and pass it is read in.

    Returns ``doc_id, source, n_tokens, pass`` (from 0), ``block`` (rank of its
    block in that pass of the source), ``slot`` (place in the block), and ``weight`` of its source.

    ``budget``: tokens to deal out, by default the corpus's own; ``"cover"`` for as many as
    read the largest source once, so that every document is read at least once and
    smaller sources up to ``max_passes`` times. ``entropy_share``: the
    target entropy as a share of the way from the sources' own entropy (0)
    to the uniform one (1), instead of ``target_entropy``. A source's budget is
    its weight times ``budget``, rounded; its last document is the one that
    reaches it. Null text counts as empty; a text without tokens has no
    weight and is not dealt out. Null is a source like any other. Rows that repeat a
    document id are documents of their own.

    No task holds a source: tokens are counted per block (a hash range of about
    ``block_tokens`` tokens of a source), blocks are ordered within bands of their order, whose totals are
    added up per source and pass (at most 65,536), and
    only the block in which a budget ends is cut, in the order of its own documents.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    rows = saved(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), key.alias("key"),
                    n_tokens(text_col).alias("n_tokens")).where("n_tokens > 0"),
        "mix-docs",
    )
    sizes = saved(rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens")), "mix-sizes")
    total, sources = sizes.agg(F.sum("tokens"), F.count("*")).first()
    total = total or 0
    cover = budget == "cover"
    budget = None if cover else total if budget is None else budget
    if entropy_share is not None and sources:
        own = _statistics(
            sizes.withColumn("largest", F.lit(float(total))), [1.0], budget
        ).first()["entropy"]
        target_entropy = own + entropy_share * (math.log(sources) - own)
    x = find_exponent(sizes, budget, target_entropy, max_passes)
    power = F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(x))
    scale = sizes.agg(F.sum(power)).first()[0] or 1.0
    if cover:
        largest = sizes.agg(F.max("tokens")).first()[0] or 0
        budget = largest * scale / ((largest / (total or 1)) ** x or 1.0)
    least = F.col("tokens") if cover else F.lit(0)
    quota = sizes.select(
        "key", "tokens", (power / scale).alias("weight"),
        F.ceil(F.col("tokens") / block_tokens).alias("blocks"),
    ).withColumn("quota", F.greatest(least, F.round(F.col("weight") * F.lit(float(budget))).cast("long")))
    quota = saved(quota.select("*", F.expr("quota div tokens").alias("full"), F.expr("quota % tokens").alias("rest")), "mix-quota")

    dealt = rows.join(quota, "key").withColumn(
        "block_no", F.pmod(F.xxhash64("doc_id", "n_tokens", F.lit(seed)), F.col("blocks"))
    )
    turns = F.when(F.col("rest") > 0, F.col("full") + 1).otherwise(F.col("full"))
    blocks = dealt.groupBy("key", "block_no", "full", "rest", "tokens").agg(F.sum("n_tokens").alias("size"))
    blocks = blocks.withColumn("pass", F.explode(
        F.when(turns > 0, F.sequence(F.lit(0).cast("long"), turns - 1)).otherwise(F.array().cast("array<long>"))
    ))
    order = F.xxhash64("block_no", "pass", F.lit(seed + 1))
    blocks = saved(blocks.withColumn("order", order).withColumn("band", F.shiftright("order", 64 - _BAND_BITS)), "mix-order")
    lower = Window.partitionBy("key", "pass").orderBy("band")
    bands = blocks.groupBy("key", "pass", "band").agg(F.count("*").alias("n"), F.sum("size").alias("s")).select(
        "key", "pass", "band", (F.sum("n").over(lower) - F.col("n")).alias("n_ahead"), (F.sum("s").over(lower) - F.col("s")).alias("s_ahead"))
    in_band = Window.partitionBy("key", "pass", "band").orderBy("order", "block_no")
    blocks = blocks.join(bands, ["key", "pass", "band"]).select(
        "key", "block_no", "pass", (F.col("n_ahead") + F.row_number().over(in_band) - 1).cast("long").alias("block"),
        (F.col("s_ahead") + F.sum("size").over(in_band) - F.col("size")).alias("before"), "size",
        F.when(F.col("pass") < F.col("full"), F.col("tokens")).otherwise(F.col("rest")).alias("limit"),
    ).where("before < limit")
    placed = dealt.select("key", "block_no", "doc_id", "source", "n_tokens", "weight").join(
        saved(blocks, "mix-blocks"), ["key", "block_no"]
    )
    in_block = Window.partitionBy("key", "block_no", "pass").orderBy(
        F.xxhash64("doc_id", "n_tokens", "pass", F.lit(seed + 2)), F.col("doc_id"), F.col("n_tokens")
    )
    placed = placed.withColumn("slot", (F.row_number().over(in_block) - 1).cast("long")).withColumn(
        "so_far", F.col("before") + F.sum("n_tokens").over(in_block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    )
    return placed.where("so_far < limit").select("doc_id", "source", "n_tokens", "pass", "block", "slot", "weight")
