"""Toxicity by subword-bag embeddings: averaged n-gram vectors into a linear softmax.

A word is the bag of its character n-grams and itself, each hashed to a bucket with a
vector; a window of words is the mean of those vectors, and a linear layer with a softmax gives
the probability of the toxic class. Vectors and layer are trained jointly in numpy.
A text's score comes from its highest window, so a few words count in a long text too;
labels are of whole texts, so training first takes every window of a toxic text as
toxic and then only those that stand out. Misspelt or unseen words share n-grams.

A word of more than ``LONGEST`` characters (text without white space, joined words) counts
as a row of pieces, each with its own hash and the n-grams that start in its ``PIECE``
characters, so every n-gram of the whole word counts once, in training and scoring.

After training a word is two numbers (sum of its n-grams' logits, and their count), which
workers cache, so scoring is a dictionary lookup a word and running sums.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import bounded_sample, prepare

EDGES = ".,;:!?\"'()[]{}<>*#$%&/\\|-_=+~`^@«»“”„‘’…¡¿"
#: Most words that a worker keeps.
KEPT = 1 << 20
#: Characters of the n-grams, of a word that is taken whole, and of the pieces of longer ones.
LEAST, MOST = 3, 5
LONGEST, PIECE = 64, 8
#: Characters of the texts that a scorer splits at a time (one text at least, whole).
SPLIT = 1 << 20


def _marked(word: str) -> tuple[str, int]:
    """The word with its ends marked, or a piece as it is; and the places where its n-grams may start."""
    return (word[1:], PIECE) if word[0] == " " else (f"<{word}>", len(word) + 2)


def grams(word: str, buckets: int) -> list[int]:
    """Buckets of the word or piece and of its character n-grams."""
    marked, starts = _marked(word)
    out = [zlib.crc32(marked.encode("utf-8", "replace")) % buckets]
    for n in range(LEAST, MOST + 1):
        out += [zlib.crc32(marked[i : i + n].encode("utf-8", "replace")) % buckets for i in range(min(starts, len(marked) - n + 1))]
    return out


def n_grams(word: str) -> int:
    """How many buckets ``grams`` gives; none for no word."""
    if not word:
        return 0
    marked, starts = _marked(word)
    return 1 + sum(max(0, min(starts, len(marked) - n + 1)) for n in range(LEAST, MOST + 1))


def pieces(unit: str) -> list[str]:
    """The unit, or the pieces of one whose word is longer than ``LONGEST``. They begin with a space, which no unit does,
    and reach over the next piece's beginning by what their last n-grams need."""
    word = unit.strip(EDGES)
    if len(word) <= LONGEST:
        return [unit]
    marked = f"<{word}>"
    return [" " + marked[i : i + PIECE + MOST - 1] for i in range(0, len(marked) - LEAST + 1, PIECE)]


def units(text: str | None) -> list[str]:
    """White-space separated units of a whole text in lower case; long ones in pieces."""
    own = (text or "").lower().split()
    if not own or max(map(len, own)) <= LONGEST:
        return own
    return [p for u in own for p in pieces(u)]


def bare(unit: str) -> str:
    """The word of a unit; a piece as it is."""
    return unit if unit[0] == " " else unit.strip(EDGES)


@dataclass
class Model:
    """Logit of each bucket, bias, and the calibration of a text's highest window."""

    logits: np.ndarray
    bias: float
    window: int
    slope: float
    shift: float

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """unit -> its place in ``parts``, which holds (sum of logits, number of n-grams)."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.parts = np.zeros((1024, 2))
        self.n = 0

    def __missing__(self, unit: str) -> int:
        word = bare(unit)
        g = grams(word, len(self.model.logits)) if word else []
        if self.n == len(self.parts):
            self.parts = np.concatenate((self.parts, np.zeros_like(self.parts)))
        self.parts[self.n] = self.model.logits[g].sum() if g else 0.0, len(g)
        if len(unit) <= LONGEST:
            self[unit] = self.n
        self.n += 1
        return self.n - 1

    def highest(self, texts: list[str | None]) -> np.ndarray:
        """Logit of the highest window of each whole text (no words: the bias); some ``SPLIT`` characters at a time."""
        upto = np.cumsum([len(t or "") for t in texts])
        out, begin = [np.empty(0)], 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + SPLIT, "right")))
            out.append(self._highest(texts[begin:end]))
            begin = end
        return np.concatenate(out)

    def _highest(self, texts: list[str | None]) -> np.ndarray:
        if self.n > KEPT:
            self.clear()
            self.n = 0
        own = [units(t) for t in texts]
        size = np.array([len(u) for u in own], np.int64)
        out = np.full(len(texts), self.model.bias)
        some = np.flatnonzero(size)
        if not len(some):
            return out
        size = size[some]
        at = np.fromiter((self[u] for x in own for u in x), np.int64, int(size.sum()))
        sums = np.concatenate((np.zeros((1, 2)), self.parts[at].cumsum(axis=0)))
        first, w = np.concatenate(([0], np.cumsum(size)[:-1])), self.model.window
        n = np.maximum(size - w + 1, 1)
        group = np.concatenate(([0], np.cumsum(n)[:-1]))
        begin = np.repeat(first - group, n) + np.arange(n.sum())
        end = np.minimum(begin + w, np.repeat(first + size, n))
        part = sums[end] - sums[begin]
        out[some] += np.maximum.reduceat(part[:, 0] / np.maximum(part[:, 1], 1), group)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.model.slope * self.highest(texts) + self.model.shift, -30, 30)))


class _Net:
    """Bucket vectors and a two-class softmax layer, trained with Adagrad on mini-batches of windows."""

    def __init__(self, words: list[str], buckets: int, dim: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.count = np.array([n_grams(w) for w in words], np.int64)
        self.flat = np.fromiter((g for w in words if w for g in grams(w, buckets)), np.int32, int(self.count.sum()))
        self.begin = np.concatenate(([0], np.cumsum(self.count)))[:-1]
        self.v = rng.normal(0, 0.1, (buckets, dim))
        self.w, self.b = rng.normal(0, 0.1, (dim, 2)), np.zeros(2)
        self.gv, self.gw, self.gb = np.full(buckets, 1e-6), np.full((dim, 2), 1e-6), np.full(2, 1e-6)
        self.rng = rng

    def _take(self, words: np.ndarray) -> np.ndarray:
        n = self.count[words]
        return self.flat[np.repeat(self.begin[words] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]

    def train(self, windows: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float = 0.3, batch: int = 2048) -> None:
        """windows: rows of word numbers, -1 for none."""
        dim = self.v.shape[1]
        for _ in range(epochs):
            order = self.rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                rows = windows[pick]
                used, back = np.unique(rows, return_inverse=True)
                back = back.reshape(rows.shape)
                none = int(used[0] == -1)
                real = used[none:]
                g, n = self._take(real), self.count[real]
                first = np.repeat(np.arange(len(real)), n)
                word = np.stack([np.bincount(first, self.v[g, k], len(real)) for k in range(dim)], axis=1)
                if none:
                    word, n = np.concatenate((np.zeros((1, dim)), word)), np.concatenate(([0], n))
                total = np.maximum(n[back].sum(axis=1), 1)
                x = word[back].sum(axis=1) / total[:, None]
                z = x @ self.w + self.b
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = p.copy()
                d[np.arange(len(pick)), y[pick]] -= 1
                d *= weight[pick][:, None]
                dx = d @ self.w.T / total[:, None]
                flat = back.ravel()
                dword = np.stack([np.bincount(flat, np.repeat(dx[:, k], rows.shape[1]), len(used)) for k in range(dim)], axis=1)[none:]
                hit, where = np.unique(g, return_inverse=True)
                dv = np.stack([np.bincount(where, dword[first, k], len(hit)) for k in range(dim)], axis=1)
                dw, db = x.T @ d / len(pick), d.mean(axis=0)
                self.gv[hit] += (dv**2).mean(axis=1)
                self.v[hit] -= rate * dv / np.sqrt(self.gv[hit])[:, None]
                self.gw += dw**2
                self.w -= rate * 0.3 * dw / np.sqrt(self.gw)
                self.gb += db**2
                self.b -= rate * 0.3 * db / np.sqrt(self.gb)

    def logits(self) -> tuple[np.ndarray, float]:
        return (self.v @ (self.w[:, 1] - self.w[:, 0])).astype(np.float32), float(self.b[1] - self.b[0])


def fit(rows: list[tuple[str | None, int]], window: int = 8, buckets: int = 1 << 18, dim: int = 4, seed: int = 7, negatives: int = 60_000) -> Model:
    """Train on (text, label) rows; a model that knows nothing gives the share of label 1."""
    share = (sum(y for _, y in rows) + 1) / (len(rows) + 2) if rows else 0.5
    prior = math.log(share / (1 - share))
    if len({y for _, y in rows}) < 2:
        return Model(np.zeros(buckets, np.float32), 0.0, window, 0.0, prior)
    number: dict[str, int] = {}
    parts, owner, label = [], [], []
    for d, (text, y) in enumerate(rows):
        own = [number.setdefault(bare(u), len(number)) for u in units(text)]
        n = max(1, -(-len(own) // window))
        grid = np.full(n * window, -1, np.int32)
        grid[: len(own)] = own
        parts.append(grid.reshape(n, window))
        owner.append(np.full(n, d))
        label.append(np.full(n, y))
    windows, owner, label = np.concatenate(parts), np.concatenate(owner), np.concatenate(label)
    net = _Net(list(number), buckets, dim, seed)
    ones, zeros = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    rng = np.random.default_rng(seed)

    def logit_of(which: np.ndarray) -> np.ndarray:
        z, b = net.logits()
        sums = np.add.reduceat(np.append(z[net.flat], 0.0), np.minimum(net.begin, len(net.flat)))
        per = np.append(np.where(net.count > 0, sums, 0.0), 0.0)
        cnt = np.append(net.count, 0)
        return per[windows[which]].sum(axis=1) / np.maximum(cnt[windows[which]].sum(axis=1), 1) + b

    sample = rng.permutation(zeros)[:negatives]
    pick = np.concatenate((ones, sample))
    passes = max(1, min(4, 8000 // len(rows)))  # few rows are gone through more often
    net.train(windows[pick], label[pick], np.ones(len(pick)), epochs=passes)
    for _ in range(2):
        z = logit_of(ones)
        top = np.full(len(rows), -np.inf)
        np.maximum.at(top, owner[ones], z)
        chosen = ones[z >= np.maximum(0.5 * top[owner[ones]] + 0.5 * np.median(z), np.minimum(top[owner[ones]], 0.0))]
        z0 = logit_of(zeros)
        hard = zeros[np.argsort(-z0, kind="stable")[: negatives // 8]]
        pick = np.concatenate((chosen, hard, rng.permutation(zeros)[: negatives // 2]))
        n1 = len(chosen)
        weight = np.where(label[pick] == 1, min(8.0, max(1.0, (len(pick) - n1) / n1 / 4)), 1.0)
        net.train(windows[pick], label[pick], weight, epochs=passes)
    logits, bias = net.logits()
    model = Model(logits, bias, window, 1.0, 0.0)
    del net, number, windows
    scorer = model.scorer()
    x = np.concatenate([scorer.highest([t for t, _ in rows[i : i + 128]]) for i in range(0, len(rows), 128)])
    y = np.array([v for _, v in rows])
    model.slope, model.shift = _calibrate(x, y)
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    mean, sd = x.mean(), x.std() or 1.0
    f = np.stack([(x - mean) / sd, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(f @ beta, -30, 30)))
        h = f.T @ (f * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        beta += np.clip(np.linalg.solve(h, f.T @ (t - p) - 1e-3 * beta), -2, 2)
    return float(beta[0] / sd), float(beta[1] - beta[0] * mean / sd)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 8000, most_bytes: int = 32 << 20, **options: int) -> Model:
    """Fit on a bounded sample of the labelled rows: ``most_rows`` documents, about ``most_bytes`` of text.

    Rows with a null id or label are not used; of repeated ids each text counts.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    prepare(docs.sparkSession)
    picked = known.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(2 * most_rows)
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)
    return fit([(r[text_col], r["y"]) for r in bounded_sample(rows, id_col, text_col, most_rows, most_bytes)], **options)


def toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (1 from ``threshold`` on).

    Null and empty texts get the calibrated score of no words. Repeated rows come out
    repeated, null ids stay null, other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(b.column(1).to_pylist()))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text scores below the threshold; no shuffle."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for b in batches:
            yield b.filter(pa.array(scorer.scores(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)
