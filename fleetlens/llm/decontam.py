"""Operator 5: benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is split into k + 1 pieces. An
occurrence with at most k edits leaves one piece untouched, so every
occurrence contains an exact piece hit. All pieces of a block of items form one automaton;
each hit gives a window of the text, and Myers' bit-parallel distance
decides it.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh_path, text_or_empty

ERROR_RATE = 0.05
BLOCK_CHARS = 1_000_000
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_SPACES = re.compile(r"[\x20\x09-\x0D]+")


def normal(text: str) -> str:
    """Lower case, white space runs as one blank, trimmed."""
    return _SPACES.sub(" ", text).strip(" ").lower()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` consecutive pieces (offset, text) of nearly equal length."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def at_boundaries(text: str, a: int, b: int) -> bool:
    """Whether ``text[a:b]`` cuts no word at its ends; scripts written without blanks have boundaries everywhere."""
    def joined(c):
        return c.isalnum() and not _UNSPACED.match(c)

    return all(not 0 < i < len(text) or not (joined(text[i - 1]) and joined(text[i])) for i in (a, b))


def myers(pattern: str, text: str, budget: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to a substring of the text, and its end; None above the budget.

    Myers 1999: the columns of the distance matrix as two bit vectors of the pattern's length.
    """
    m, masks = len(pattern), {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for end, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        across = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(across | up)), up & across
        if score <= budget and (best is None or score < best[0]):
            best = (score, end)
    return best


class _Block:
    """The automaton over the pieces of one block of items."""

    def __init__(self, items: list[tuple], rate: float, min_chars: int):
        self.items, owners = [], {}
        for item_id, text in items:
            budget = int(len(text) * rate)
            for offset, piece in pieces(text, budget):
                owners.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((item_id, text, budget, budget == 0 and len(text) < min_chars))
        self.automaton = ahocorasick.Automaton()
        for piece, where in owners.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """For each item the merged text windows that its piece hits allow."""
        found: dict[int, list[list[int]]] = {}
        for last, (length, where) in self.automaton.iter(text):
            for k, offset in where:
                _, item, budget, whole = self.items[k]
                start = last + 1 - length - offset - budget
                if whole and (k in found or not at_boundaries(text, start, last + 1)):
                    continue
                found.setdefault(k, []).append([max(0, start), start + len(item) + 2 * budget])
        for k, spans in found.items():
            spans.sort()
            merged = [spans[0]]
            for a, b in spans[1:]:
                if a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            found[k] = merged
        return found

    def matches(self, text: str):
        """(item id, distance, end, item length) of the best occurrence of each item in the text."""
        text = normal(text)
        for k, spans in self.windows(text).items():
            item_id, item, budget, _ = self.items[k]
            best = None
            for a, b in spans:
                hit = myers(item, text[a:b], budget)
                if hit and (best is None or (hit[0], a + hit[1]) < best):
                    best = (hit[0], a + hit[1])
            if best:
                yield item_id, *best, len(item)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
    error_rate: float = ERROR_RATE, min_chars: int = 40, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Pairs ``doc_id, item_id, distance, end, n_chars``: items that occur in documents.

    Both sides are compared in lower case with white space runs as one blank. The
    budget of an item of n characters is ``int(n * error_rate)`` edits; ``end`` is
    the code point where the best occurrence ends in the normalised text and
    ``n_chars`` the item's length. Items shorter than ``min_chars`` whose budget is 0
    must stand at word boundaries ("art" is not in "start"). Null and empty items match nothing. Rows that repeat a document or an item give their
    pairs once. The items go to the tasks in blocks of about ``block_chars``
    characters, one pass over the documents for each block, whose matches are written before the
    next block is read: driver and tasks hold one block at a time, however large the benchmark is.
    """
    item_type, doc_type = benchmark.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    tidy = F.lower(F.trim(F.regexp_replace(text_or_empty(item_text_col), r"[\x20\x09-\x0D]+", " ")))
    items = benchmark.select(F.col(item_col).alias("item_id"), tidy.alias("item")).where("item <> ''").distinct()
    total = items.agg(F.sum(F.length("item"))).first()[0] or 0
    blocks = -(-total // block_chars)
    picked = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    schema = f"doc_id {doc_type}, item_id {item_type}, distance long, end long, n_chars long"
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    types, path = [to_arrow_type(f.dataType) for f in out.schema], fresh_path(spark, "hits")
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == b).collect()
        scan = _scan([(r[0], normal(r[1])) for r in rows], error_rate, min_chars, types)
        if rows:
            picked.mapInArrow(scan, schema).write.mode("append").parquet(path)
    if blocks:
        out = spark.read.schema(schema).parquet(path)
    return out.groupBy("doc_id", "item_id").agg(
        F.min(F.struct("distance", "end", "n_chars")).alias("best")
    ).select("doc_id", "item_id", "best.distance", "best.end", "best.n_chars")


def _scan(items: list[tuple], rate: float, min_chars: int, types: list[pa.DataType]):
    def run(batches):
        block = _Block(items, rate, min_chars)
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for match in block.matches(text):
                    for column, value in zip(found, (doc, *match), strict=True):
                        column.append(value)
            arrays = [pa.array(column, kind) for column, kind in zip(found, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "distance", "end", "n_chars"])

    return run
