"""Operator 4: quality classifier by co-training.

Two views of a document: its text (character-class shares, compressibility, word
repetition; linear discriminant) and its metadata (language, source, length;
naive Bayes over hashed values). Each round, either view hands the other one the unlabelled
documents that it ranks furthest to either side, a share that grows with the rounds, split between the classes as the
labels are. They count with the view's calibrated probabilities, and all together at most ``GAIN`` times the labelled rows
times what the view is found to know of held-out labels, so a view that knows little misleads little. Both views are
fitted anew and calibrated on labelled rows that neither was fitted on. The calibrated views are combined to score
every document.

Both models are functions of sums over rows (counts, first and second
moments), so they are fitted on all labelled and pseudo-labelled documents, with no sample: a
pass returns one vector of fixed size per partition, Spark adds them up, and the driver
solves for the model.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_or_empty

BUCKETS = 1024
BINS = 601
_LIMIT = 30.0
_KINDS = 9
GAIN = 0.5


def _byte_kinds() -> np.ndarray:
    """Kind of each byte: other, non-ASCII, upper, digit, blank, newline, punctuation, bar, symbol."""
    kinds = np.full(256, 8)
    kinds[128:] = 1
    kinds[[*range(ord("a"), ord("z") + 1)]] = 0
    kinds[[*range(ord("A"), ord("Z") + 1)]] = 2
    kinds[[*range(ord("0"), ord("9") + 1)]] = 3
    kinds[[32, 10, 124]] = 4, 5, 7
    kinds[[*b".,;:?'\"-()"]] = 6
    return kinds


_KIND = _byte_kinds()
N_TEXT = _KINDS + 4


def text_features(text: str) -> list[float]:
    """Shares of byte kinds, compressed share, words equal to the one before, distinct words, log length."""
    data = text.encode()
    n, words = max(1, len(data)), data.split()
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=_KINDS) / n
    again = sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words) - 1)
    packed = min(2.0, len(zlib.compress(data, 1)) / n) if data else 0.0
    return [*kinds.tolist(), packed, again, len(set(words)) / max(1, len(words)), float(np.log(n))]


def _features(batches):
    for batch in batches:
        x = [text_features(t) for t in batch.column("text").to_pylist()]
        names = [f.name for f in batch.schema if f.name != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(x, pa.list_(pa.float64()))], [*names, "x"])


def features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta_cols: list[str], label_col: str, label_id_col: str, row_col: str | None = None) -> DataFrame:
    """``id, row, meta`` (bucket numbers), ``x``, ``y`` (0, 1, null), ``held`` (calibration row) and ``u`` (hash of the id in [0, 1)) per document."""
    size = F.floor(F.log2(F.octet_length(text_or_empty(text_col)) + 1)).cast("string")
    values = [*(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in meta_cols), size]
    buckets = [F.lit(i * BUCKETS) + F.pmod(F.xxhash64(v), F.lit(BUCKETS)) for i, v in enumerate(values)]
    row = F.col(row_col) if row_col else F.lit(0)
    rows = docs.select(F.col(id_col).alias("id"), row.cast("long").alias("row"), F.array(*buckets).alias("meta"), text_or_empty(text_col).alias("text"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, row long, meta array<long>, x array<double>"
    votes = labels.groupBy(F.col(label_id_col).alias("label_id")).agg(F.avg(label_col).alias("vote"))
    y = F.when(F.col("vote") > 0.5, 1).when(F.col("vote") < 0.5, 0)
    votes = votes.where("label_id is not null").select("label_id", y.alias("y"))
    joined = rows.mapInArrow(_features, schema).join(votes, F.col("id") == F.col("label_id"), "left")
    u = F.pmod(F.xxhash64("id", F.lit("u")), F.lit(10_007)) / 10_007
    return joined.select("id", "row", "meta", "x", "y", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("held"), u.alias("u"))


@dataclass
class Views:
    """Both models and their calibrations (slope, offset); all None before the first fit."""

    text: tuple[np.ndarray, float] | None = None
    meta: np.ndarray | None = None
    prior: float = 0.0
    held_prior: float | None = None
    scale: tuple = ((1.0, 0.0), (1.0, 0.0))
    trust: tuple = (0.0, 0.0)  # share of the held-out labels' entropy that each view explains
    handed: list = field(default_factory=list)  # per round: documents handed to the text view, to the metadata view

    def raw(self, x: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Log odds per view, shape (2, n)."""
        if self.text is None:
            return np.zeros((2, len(x)))
        weights, offset = self.text
        return np.clip([x @ weights + offset, self.meta[meta].sum(1) + self.prior], -_LIMIT, _LIMIT)

    def calibrated(self, x: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.array([a * z + b for z, (a, b) in zip(self.raw(x, meta), self.scale, strict=True)])


def _columns(batch):
    n = batch.num_rows
    flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
    y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
    held, u = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("held", "u"))
    return flat("x").reshape(n, -1), flat("meta").reshape(n, -1), y, held.astype(bool), u


def _bin(z: np.ndarray) -> np.ndarray:
    return np.rint((np.clip(z, -_LIMIT, _LIMIT) + _LIMIT) / (2 * _LIMIT) * (BINS - 1)).astype(int)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _furthest(rows: DataFrame, views: Views, share: float) -> list[tuple] | None:
    """Per view, what it hands over: the bin of scores it starts from and the part of that bin, below and above its prior.

    ``share`` of the unlabelled rows, by rank and split between the classes as the labelled rows are; a view gives fewer
    where it has fewer scores on that side of its prior.
    """
    if views.text is None or share <= 0:
        return None

    def count(x, meta, y, held, u):
        return np.concatenate([np.bincount(_bin(z[np.isnan(y)]), minlength=BINS) for z in views.calibrated(x, meta)])

    good = float(_sigmoid(np.array(views.prior)))
    middle = int(_bin(np.array(views.prior if views.held_prior is None else views.held_prior)))
    out = []
    for counts in _summed(rows.where("y is null"), count, 2 * BINS).reshape(2, BINS):
        sides = []
        for order, part in ((range(middle), 1 - good), (range(BINS - 1, middle, -1), good)):
            left, at, some = share * part * counts.sum(), None, 0.0
            for b in order:
                if left <= 0:
                    break
                if counts[b]:
                    at, some = b, min(1.0, left / counts[b])
                    left -= counts[b]
            sides.append((at, some))
        out.append(tuple(sides))
    return out


def _handed(z: np.ndarray, u: np.ndarray, sides: tuple) -> np.ndarray:
    """Which rows a view hands over; within the last bin, those of smallest hash."""
    at, out = _bin(z), np.zeros(len(z), dtype=bool)
    (low, low_part), (high, high_part) = sides
    if low is not None:
        out |= (at < low) | ((at == low) & (u < low_part))
    if high is not None:
        out |= (at > high) | ((at == high) & (u < high_part))
    return out


def _summed(rows: DataFrame, count, size: int) -> np.ndarray:
    """Sum over all rows of ``count(x, meta, y, held, u)``, a vector of ``size`` numbers per batch."""
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += count(*_columns(batch))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "v"])

    out = np.zeros(size)
    for at, v in rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v")).collect():
        out[at] = v
    return out


def _fit(rows: DataFrame, n_meta: int, views: Views, share: float) -> Views | None:
    """New models from labelled rows and from what the other view hands over."""
    d, width = N_TEXT, n_meta * BUCKETS
    per_class = 1 + d + d * d + width + 2
    furthest = _furthest(rows, views, share)

    def count(x, meta, y, held, u):
        z, known = views.calibrated(x, meta), ~np.isnan(y)
        out = np.zeros((2, 2, per_class))  # labelled or handed over, class
        weights = np.zeros((2, 2, 2, len(y)))  # labelled or handed over, target view, class, row
        for c in (0, 1):
            weights[0, :, c, known & ~held & (y == c)] = 1
        if furthest is not None:
            for target, source in ((0, 1), (1, 0)):
                given, p = ~known & _handed(z[source], u, furthest[source]), _sigmoid(z[source])
                weights[1, target, 1, given], weights[1, target, 0, given] = p[given], 1 - p[given]
                out[1, target, -1] = given.sum()
        for kind, c in ((0, 0), (0, 1), (1, 0), (1, 1)):
            for_text, for_meta = weights[kind, :, c]
            a, into = x * for_text[:, None], out[kind, c]
            into[0], into[1 : 1 + d], into[1 + d : 1 + d + d * d] = for_text.sum(), a.sum(0), (a.T @ x).ravel()
            into[-width - 2 : -2] = np.bincount(meta.ravel(), np.repeat(for_meta, n_meta), minlength=width)
            into[-2] = for_meta.sum()
        return out.ravel()

    own, handed = _summed(rows, count, 4 * per_class).reshape(2, 2, per_class)
    split, sums = 1 + d + d * d, own.copy()
    for c in (0, 1):  # both targets: the text view's sums stand first, then the metadata view's
        for part, total, source in ((slice(0, split), 0, 1), (slice(split, -1), -2, 0)):
            most = GAIN * views.trust[source] * own[c, total]
            sums[c, part] += handed[c, part] * min(1.0, most / max(1e-9, handed[c, total]))
    if not sums[:, 0].all() or not sums[:, -2].all():
        return None
    n, mean = sums[:, 0], sums[:, 1 : 1 + d] / sums[:, :1]
    spread = sums[:, 1 + d : 1 + d + d * d].reshape(2, d, d).sum(0) - sum(n[c] * np.outer(mean[c], mean[c]) for c in (0, 1))
    spread = spread / max(1.0, n.sum() - 2)
    spread += np.diag(1e-4 * np.diag(spread) + 1e-6)
    weights = np.linalg.solve(spread, mean[1] - mean[0])
    evidence = np.log((sums[:, -width - 2 : -2] + 1) / (sums[:, -2:-1] + BUCKETS))
    return Views(
        (weights, float(-weights @ mean.sum(0) / 2 + np.log(n[1] / n[0]))), evidence[1] - evidence[0], float(np.log(sums[1, -2] / sums[0, -2])),
        handed=[*views.handed, tuple(int(x) for x in handed[:, -1])],
    )


def _platt(zero: np.ndarray, one: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and offset of a logistic fit to counts of both labels per score bin."""
    z, a, b = np.linspace(-_LIMIT, _LIMIT, BINS), 0.0, float(np.log((one.sum() + 1) / (zero.sum() + 1)))
    t1, t0 = (one.sum() + 1) / (one.sum() + 2), 1 / (zero.sum() + 2)  # Platt's smoothed targets
    n, target = zero + one, one * t1 + zero * t0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g = np.array([((n * p - target) * z).sum() + 1e-3 * a, (n * p - target).sum()])
        w = n * p * (1 - p)
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return (a, b) if a > 0 else (0.0, float(np.log((one.sum() + 1) / (zero.sum() + 1))))


def _calibrate(rows: DataFrame, views: Views) -> Views:
    def count(x, meta, y, held, u):
        out = np.zeros((2, 2, BINS))
        for v, z in enumerate(views.raw(x, meta)):
            at = _bin(z)
            for c in (0, 1):
                out[v, c] = np.bincount(at[held & (y == c)], minlength=BINS)
        return out.ravel()

    sums = _summed(rows.where("held and y is not null"), count, 4 * BINS).reshape(2, 2, BINS)
    if not sums[0, 0].sum() or not sums[0, 1].sum():
        return views
    views.scale = tuple(_platt(*sums[v]) for v in (0, 1))
    views.held_prior = float(np.log(sums[0, 1].sum() / sums[0, 0].sum()))
    centre, share = np.linspace(-_LIMIT, _LIMIT, BINS), float(_sigmoid(np.array(views.held_prior)))
    known = []
    for (zero, one), (a, b) in zip(sums, views.scale, strict=True):
        p = np.clip(_sigmoid(a * centre + b), 1e-6, 1 - 1e-6)
        loss = -(one * np.log(p) + zero * np.log(1 - p)).sum() / (one + zero).sum()
        known.append(max(0.0, 1 - loss / -(share * np.log(share) + (1 - share) * np.log(1 - share))))
    views.trust = tuple(known)
    return views


def cotrain(rows: DataFrame, n_meta: int, rounds: int = 3, share: float = 0.1) -> Views:
    """Views fitted on written ``features``; ``handed`` tells how many documents changed hands in each round."""
    views = Views()
    for r in range(rounds):
        fitted = _fit(rows, n_meta, views, share * r)
        if fitted is None:
            break
        views = _calibrate(rows, fitted)
    return views


def cotrained_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    meta_cols: tuple[str, ...] = ("lang", "source"), label_col: str = "quality", label_id_col: str = "doc_id",
    rounds: int = 4, share: float = 0.1, keep_from: float = 0.5, row_col: str | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, p_text, p_meta, quality, keep``.

    ``p_text`` and ``p_meta`` are the calibrated probabilities of the good class,
    ``quality`` the combined one (log odds added, the prior counted once), ``keep``
    is ``quality >= keep_from``. ``row_col`` names a whole number per row that is returned as well, to tell rows
    that repeat an id apart (each is scored on its own text). ``share``: the part of the unlabelled documents that each
    view hands to the other in the second round; twice that in the third, and so on (the first round has labels
    alone). Every fifth labelled document, by hash of its id, is held out for calibration.

    Null text counts as empty, null metadata is a value of its own, an empty table gives no row. Several labels of a
    document are averaged; an even vote is none. Very long texts are read whole. Without labelled rows of both classes nothing can
    be learned: every probability is 0.5 and every document stays. Columns of ``docs`` that are not named are ignored.
    """
    rows = saved(features(docs, labels, id_col, text_col, list(meta_cols), label_col, label_id_col, row_col), "cotrain")
    views = cotrain(rows, len(meta_cols) + 1, rounds, share)
    prior = views.prior if views.held_prior is None else views.held_prior

    def score(batches):
        for batch in batches:
            x, meta, _, _, _ = _columns(batch)
            z = views.calibrated(x, meta) if batch.num_rows else np.zeros((2, 0))
            both = np.array([z[0], z[1], z[0] + z[1] - (prior if views.text is not None else 0.0)])
            p = _sigmoid(both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *map(pa.array, p), pa.array(p[2] >= keep_from), batch.column("row")],
                ["doc_id", "p_text", "p_meta", "quality", "keep", "row"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"doc_id {kind}, p_text double, p_meta double, quality double, keep boolean, row long")
    return scored.withColumnRenamed("row", row_col) if row_col else scored.drop("row")
