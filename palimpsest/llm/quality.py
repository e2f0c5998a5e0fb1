"""Quality by ordinal regression on graded ratings (cumulative link).

Grades 0..K-1 share one weight for each hashed text feature and have K-1 ordered
thresholds: P(grade > k) = sigmoid(w.x - t_k). Thresholds are kept in order by learning
the first and the logarithms of the gaps. The features of a text are the mean over its units
(white-space separated, those over ``langid.LONGEST`` characters cut to consecutive pieces that count as
units, so the whole text counts) of the unit's own hash, its shape (case, digits and marks with runs
collapsed) and its word, so a unit is one number once the weights are known, which workers cache.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import bounded_sample, prepare
from palimpsest.llm.langid import split

#: Most units a worker keeps.
KEPT = 1 << 20
RUN = re.compile(r"(.)\1+", re.S)
SHAPE = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})


def shape(unit: str) -> str:
    """Letters as a or A, digits as 0, runs collapsed: "Hello!!" is "Aa!"."""
    if not unit.isascii():
        unit = "".join(("A" if c.isupper() else "a") if c.isalpha() else c for c in unit)
    return RUN.sub(r"\1", unit.translate(SHAPE))


def features(unit: str, buckets: int) -> tuple[int, int, int]:
    names = ("u" + unit, "s" + shape(unit), "w" + unit.lower().strip(".,;:!?"))
    return tuple(zlib.crc32(x.encode("utf-8", "replace")) % buckets for x in names)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, of latent scores z."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds, -30, 30)))


class Scorer(dict):
    """unit -> its part of the latent score."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def __missing__(self, unit: str) -> float:
        got = float(self.model.weights[list(features(unit, len(self.model.weights)))].sum())
        if len(self) >= KEPT:
            self.clear()
        self[unit] = got
        return got

    def latent(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            if units := split(t):
                out[i] = sum(map(self.__getitem__, units)) / len(units)
        return out


class _Features(dict):
    """unit -> its features, for the units of the training texts."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, unit: str) -> tuple[int, int, int]:
        self[unit] = got = features(unit, self.buckets)
        return got


def fit(rows: list[tuple[str | None, int]], grades: int, buckets: int = 1 << 17, epochs: int = 12, rate: float = 0.5, batch: int = 256, decay: float = 1e-7, seed: int = 3) -> Model:
    """Maximum likelihood by Adagrad over mini-batches of (text, grade) rows."""
    w, gap = np.zeros(buckets), np.zeros(max(grades - 2, 0))
    share = [(sum(y > k for _, y in rows) + 0.5) / (len(rows) + 1.0) for k in range(grades - 1)]
    start = -np.log(np.array(share) / (1 - np.array(share)))
    first = start[0]
    if grades > 2:
        gap = np.log(np.maximum(np.diff(start), 0.05))
    thresholds = lambda: first + np.concatenate(([0.0], np.cumsum(np.exp(gap))))
    table = _Features(buckets)
    index, value = [], []
    for text, _ in rows:
        units = split(text)
        f = np.array([table[u] for u in units], np.int64).ravel()
        at, n = np.unique(f, return_counts=True)
        index.append(at)
        value.append(n / max(1, len(units)))
    y = np.array([g for _, g in rows], np.int64)
    gw, g0, gg = np.full(buckets, 1e-8), 1e-2, np.full(len(gap), 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            idx, val = np.concatenate([index[i] for i in pick]), np.concatenate([value[i] for i in pick])
            doc = np.repeat(np.arange(len(pick)), [len(index[i]) for i in pick])
            z = np.bincount(doc, w[idx] * val, len(pick))
            t = np.concatenate(([-np.inf], thresholds(), [np.inf]))
            g = y[pick]
            up, low = 1 / (1 + np.exp(-np.clip(z - t[g], -30, 30))), 1 / (1 + np.exp(-np.clip(z - t[g + 1], -30, 30)))
            p = np.maximum(up - low, 1e-9)  # P(grade = g)
            du, dl = up * (1 - up), low * (1 - low)
            dz = -(du - dl) / p
            dt = np.bincount(g, du / p, grades)[1:] - np.bincount(g, dl / p, grades)[:-1]
            hit, where = np.unique(idx, return_inverse=True)
            dw = np.bincount(where, dz[doc] * val, len(hit)) / len(pick) + decay * w[hit]
            gw[hit] += dw**2
            w[hit] -= rate * dw / np.sqrt(gw[hit])
            dt /= len(pick)
            g0 += dt.sum() ** 2
            first -= 0.1 * dt.sum() / np.sqrt(g0)
            if grades > 2:
                dg = np.cumsum(dt[::-1])[::-1][1:] * np.exp(gap)
                gg += dg**2
                gap -= 0.1 * dg / np.sqrt(gg)
    return Model(w.astype(np.float32), thresholds())


def train(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", most_rows: int = 6000, most_bytes: int = 24 << 20, **options: float) -> Model:
    """Fit on a bounded sample of rated rows: ``most_rows`` documents, about ``most_bytes`` of text.

    Null ids and grades and grades outside 0..grades-1 are not used; of an id rated more
    than once the highest grade counts.
    """
    good = ratings.where(F.col(grade_col).between(0, grades - 1) & F.col(id_col).isNotNull())
    prepare(docs.sparkSession)
    picked = good.groupBy(id_col).agg(F.max(grade_col).cast("int").alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(2 * most_rows)
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)
    return fit([(r[text_col], r["y"]) for r in bounded_sample(rows, id_col, text_col, most_rows, most_bytes)], grades, **options)


def quality(docs: DataFrame, model: Model, tail: int, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, expected_grade, tail_prob = P(grade >= tail), selected (tail_prob >= least).

    Null and empty texts have latent score 0. Repeated rows come out repeated, null ids
    stay null, other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    if not 1 <= tail <= len(model.thresholds):
        raise ValueError("tail must be a grade above the lowest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for b in batches:
            p = sent.value.tails(scorer.latent(b.column(1).to_pylist()))
            cols = [b.column(0), pa.array(p.sum(axis=1)), pa.array(np.ascontiguousarray(p[:, tail - 1]))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "expected_grade", "tail_prob"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, expected_grade double, tail_prob double")
    return out.select(F.col("id").alias(id_col), "expected_grade", "tail_prob", (F.col("tail_prob") >= least).alias("selected"))
