"""Operator 7: HTML extraction by nearest-URL page differencing.

Pages of a host are ordered by URL path; a page is paired with whichever of
its two neighbours has the longer common path prefix. The text lines of a
pair are aligned by longest common subsequence, and lines the two share are
deleted as boilerplate, also inside a main element or an element whose class says
that it holds the content. Of these zones the one with enough of the page's unshared text is taken.
Differencing sees every line of a page, those of menus, headers and footers too; the markup decides about lines
that no neighbour shares (``page_text.py``). Only the text of an article element is kept whole.

Pages meet their neighbours by one shuffle: their keys alone are sorted first, to cut the order into ranges of equal
numbers of pages; then a page is parsed once and its lines go, compressed, to its range. The first page of a range is
also sent to the range before and the last one to the range after. A task reads its ranges in order and
holds three pages at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty
from .page_text import ARTICLE, FRAME, INSIDE, MAIN, MARKED, OTHER, page_lines

_MOST_BITS = 1 << 27
_OF_ZONE, _OF_PAGE = 0.5, 0.25
ROWS_PER_RANGE, MOST_RANGES, MOST_CUT_BYTES = 1024, 1 << 16, 64 << 20
_ORDER = ["host", "path", "row"]


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence of two lists of lines (or any values).

    Equal ends are taken first and lines the other side lacks are left out. The rest is
    the bit-parallel recurrence on the set of increases; above a memory
    bound it is split in halves by Hirschberg's rule.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    tail = 0
    while tail < min(len(a), len(b)) - lo and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[lo : len(a) - tail]) & set(b[lo : len(b) - tail])
    ia = [i for i in range(lo, len(a) - tail) if a[i] in both]
    ib = [j for j in range(lo, len(b) - tail) if b[j] in both]
    middle = _align([a[i] for i in ia], [b[j] for j in ib])
    return [
        *((i, i) for i in range(lo)), *((ia[i], ib[j]) for i, j in middle),
        *((len(a) - tail + i, len(b) - tail + i) for i in range(tail)),
    ]


def _rows(a: list, b: list, keep: bool) -> list[int]:
    """Bit vectors after each line of ``a``: a zero bit j marks an increase of the length at ``b[j]``."""
    where: dict = {}
    for j, line in enumerate(b):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for line in a:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        if keep:
            rows.append(v)
    return rows if keep else [v]


def _lengths(v: int, m: int) -> list[int]:
    out, n = [0], 0
    for c in reversed(bin(v | 1 << m)[3:]):
        n += c == "0"
        out.append(n)
    return out


def _align(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [(0, b.index(a[0]))] if a[0] in b else []
    if len(a) * len(b) > _MOST_BITS:
        half = len(a) // 2
        left = _lengths(_rows(a[:half], b, False)[0], len(b))
        right = _lengths(_rows(a[half:][::-1], b[::-1], False)[0], len(b))
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        return _align(a[:half], b[:cut]) + [(i + half, j + cut) for i, j in _align(a[half:], b[cut:])]
    rows, out, i, j = _rows(a, b, True), [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        increase = not rows[i] >> j & 1
        if not increase:
            j -= 1
        elif i and not rows[i - 1] >> j & 1:
            i -= 1
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def shared_lines(own: list, other: list, sizes: list[int], copy_share: float) -> list[int]:
    """Indexes of ``own`` lines that the pair shares; none if the pages are copies of each other."""
    shared = [i for i, _ in common_lines(own, other)]
    if sum(sizes[i] for i in shared) >= copy_share * max(1, sum(sizes)):
        return []
    return shared


_PARSED = "copies long, best int, zones binary, lines binary"
_PLACED = "range int, guest boolean"


def _parse(batches):
    """Compressed lines of every page with their zones; equal rows of a batch go on as one. The html goes no further."""
    for batch in batches:
        copies: dict[str, int] = {}
        at: list[int] = []
        for i, row in enumerate(batch.column("row").to_pylist()):
            if row not in copies:
                at.append(i)
            copies[row] = copies.get(row, 0) + 1
        batch = batch.take(pa.array(at, pa.int64()))
        best, zones, texts = [], [], []
        for html in batch.column("html").to_pylist():
            lines, top = page_lines(html)
            best.append(top)
            zones.append(bytes(z - FRAME for _, z in lines))
            texts.append(zstandard.compress("\n".join(t for t, _ in lines).encode(), 3))
        names = [f.name for f in batch.schema if f.name != "html"]
        yield pa.RecordBatch.from_arrays(
            [
                *map(batch.column, names), pa.array(list(copies.values()), pa.int64()), pa.array(best, pa.int32()),
                pa.array(zones, pa.binary()), pa.array(texts, pa.binary()),
            ],
            [*names, "copies", "best", "zones", "lines"],
        )


def url_ranges(keys: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> list[tuple]:
    """First and last key of each range of the order by host, path and row, in that order.

    Ranges hold equal numbers of distinct keys: ``rows_per_range``, or more where there would be over ``MOST_RANGES``
    ranges or keys so long that the cut points could exceed ``MOST_CUT_BYTES``. So the driver gets two keys per range and two numbers per
    partition, whatever the size of the table.
    """
    ranked = saved(
        keys.select(_ORDER).distinct().repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
        .withColumn("at", F.monotonically_increasing_id()), "url-order",
    )
    width = F.octet_length("host") + F.octet_length("path") + F.octet_length("row")
    part = F.shiftright("at", 33)
    parts = sorted(ranked.groupBy(part.alias("part")).agg(F.count("*"), F.max(width)).collect())
    if not parts:
        return []
    rows, widest = sum(n for _, n, _ in parts), max(w for _, _, w in parts)
    most = max(1, min(MOST_RANGES, MOST_CUT_BYTES // (2 * widest)))
    step = max(rows_per_range, -(-rows // most))
    ahead, offsets = 0, []
    for no, n, _ in parts:
        offsets.append((no, ahead))
        ahead += n
    offsets = keys.sparkSession.createDataFrame(offsets, "part long, ahead long")
    place = F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    cuts = ranked.join(F.broadcast(offsets), part == F.col("part")).withColumn("place", place).where(
        (F.col("place") % step == 0) | (F.col("place") % step == step - 1) | (F.col("place") == rows - 1)
    )
    found = {r.place: (r.host, r.path, r.row) for r in cuts.select("place", *_ORDER).collect()}
    return [(found[p], found[min(p + step, rows) - 1]) for p in range(0, rows, step)]


def _placed(batches, ranges: list[tuple]):
    """Rows with the range they belong to, and as guests in the range they border on."""
    firsts = [first for first, _ in ranges]
    for batch in batches:
        at, where, guest = [], [], []
        for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in _ORDER), strict=True)):
            k = bisect_right(firsts, key) - 1
            for no, is_guest, here in (
                (k, False, True), (k - 1, True, key == ranges[k][0] and k > 0), (k + 1, True, key == ranges[k][1] and k + 1 < len(ranges)),
            ):
                if here:
                    at.append(i)
                    where.append(no)
                    guest.append(is_guest)
        taken = batch.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*taken.columns, pa.array(where, pa.int32()), pa.array(guest, pa.bool_())], [*taken.schema.names, "range", "guest"]
        )


def _in_url_order(rows: DataFrame, ranges: list[tuple], prepare, schema: str) -> DataFrame:
    """``rows`` after ``prepare``, ranges whole in a partition and sorted by key."""
    cuts = rows.sparkSession.sparkContext.broadcast(ranges)

    def run(batches):
        yield from _placed(prepare(batches), cuts.value)

    return rows.mapInArrow(run, f"{schema}, {_PLACED}").repartition("range").sortWithinPartitions("range", *_ORDER)


def _near(a: str, b: str) -> int:
    """Length of the common prefix of two paths, counted in whole segments."""
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += len(x) + 1
    return n


def _nearest(batches):
    """Each row that is no guest, in order, with its nearest by URL path on the same host, or None.

    Of two neighbours the one with the longer common path prefix is the
    nearest; on a tie the one before. Equal rows are one, with their copies added up.
    """
    before = here = None
    for after in chain((row for batch in batches for row in batch.to_pylist()), [None]):
        if here and after and (here["range"], here["row"]) == (after["range"], after["row"]):
            here["copies"] += after["copies"]
            continue
        if here and not here["guest"]:
            beside = [
                (_near(here["path"], other["path"]), side, other) for side, other in ((1, before), (0, after))
                if other and (other["range"], other["host"]) == (here["range"], here["host"])
            ]
            yield here, max(beside, key=lambda found: found[:2])[2] if beside else None
        before, here = here, after


def _pairs(batches):
    for me, other in _nearest(batches):
        if other:
            yield pa.RecordBatch.from_arrays([pa.array([me["row"]]), pa.array([other["row"]])], ["me", "other"])


def pair_by_url(pages: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``me, other`` for ``pages(row, host, path)``: row keys of a page and of its nearest by URL path.

    The pairs that :func:`page_diff` compares, by the same ranges and tasks.
    """
    keys = pages.select(*_ORDER, F.lit(1).cast("long").alias("copies"))
    ordered = _in_url_order(keys, url_ranges(keys, rows_per_range), iter, "host string, path string, row string, copies long")
    return ordered.mapInArrow(_pairs, "me string, other string")


def main_text(html: str, gone: list[int], copy_share: float = 0.8) -> str:
    """:func:`zone_text` of a page's html."""
    lines, best = page_lines(html)
    return zone_text(lines, best, gone, copy_share)


def zone_text(lines: list[tuple[str, int]], best: int, gone: list[int], copy_share: float = 0.8) -> str:
    """The article: lines of one zone without the shared ones; an article element keeps those too.

    The zone is the highest that holds enough of the page's unshared text: a half of what any
    zone around it holds, or a quarter of the whole page for article and main elements. So a teaser
    or a line whose class says text does not stand for the article beside it. Articles in
    wrappers named as something else are taken if they hold more than a page without article and main.
    A zone that is shared by ``copy_share`` of its text is a copy inside another frame and keeps its lines.
    """
    drop = set(gone)

    def chars(part):
        return sum(len(lines[i][0]) for i in part)

    def unshared(part):
        left = [i for i in part if i not in drop]
        return part if chars(part) - chars(left) >= copy_share * chars(part) else left

    zones = [z for z in (ARTICLE, MAIN, MARKED, OTHER) if z <= best]
    parts = {z: [i for i, line in enumerate(lines) if line[1] >= z] for z in zones}
    parts[INSIDE] = [i for i, line in enumerate(lines) if line[1] == INSIDE]
    kept = {z: unshared(part) for z, part in parts.items()}
    size = {z: chars(part) for z, part in kept.items()}

    def enough(z, around):
        return size[z] >= (_OF_PAGE if around == OTHER and z >= MAIN else _OF_ZONE) * size[around]

    zone = next(z for z in zones if all(enough(z, around) for around in zones if around < z))
    if zone < MAIN and size[INSIDE] > size[OTHER]:
        zone = INSIDE
    return "\n".join(lines[i][0] for i in (parts if zone in (ARTICLE, INSIDE) else kept)[zone])


def _lines(page: dict) -> list[str]:
    """Lines of a page, unpacked once."""
    if "texts" not in page:
        page["texts"] = zstandard.decompress(page["lines"]).decode().split("\n") if page["zones"] else []
    return page["texts"]


_OUT_ROWS, _OUT_CHARS = 1000, 4 << 20


def _texts(copy_share: float):
    def run(batches):
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        id_type = head.schema.field("page_id").type

        def packed():
            ids, urls, texts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

        rows, chars = [], 0
        for page, other in _nearest(chain([head], batches)):
            own = _lines(page)
            gone = shared_lines(own, _lines(other), [len(t) for t in own], copy_share) if other else []
            zones = (z + FRAME for z in page["zones"])
            text = zone_text(list(zip(own, zones, strict=True)), page["best"], gone, copy_share)
            for _ in range(page["copies"]):
                rows.append((page["page_id"], page["url"], text))
                chars += len(text)
                if len(rows) >= _OUT_ROWS or chars >= _OUT_CHARS:
                    yield packed()
                    rows, chars = [], 0
        if rows:
            yield packed()

    return run


def page_diff(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", copy_share: float = 0.8,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points).

    ``copy_share``: two neighbours that share this much of a page's text are copies
    of one page, not two pages with one frame, and keep their lines; the same holds for the zone
    that is taken. Null html is an empty page with an empty
    text; a null or relative url stands for a host and path of its own
    (both empty). Rows that repeat a page id, or a whole row, are pages of
    their own and get the text of their own html; equal rows get the same text. An empty table gives no row,
    a very long page is parsed as a whole, and other columns of ``pages`` are ignored, whatever their names.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"),
        F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1).alias("host"),
        F.regexp_extract(url, r"(?i)^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
    ).withColumn("row", F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.md5(F.coalesce("url", F.lit("-"))), F.md5("html"))))
    id_type = pages.schema[id_col].dataType.simpleString()
    ranges = url_ranges(rows, rows_per_range)
    ordered = _in_url_order(rows, ranges, _parse, f"page_id {id_type}, url string, host string, path string, row string, {_PARSED}")
    return ordered.mapInArrow(_texts(copy_share), f"page_id {id_type}, url string, text string, n_chars long")
