"""Packing by vector bin packing with the dot-product heuristic.

An example is a vector (tokens, segments, loss-bearing tokens) and a sequence a bin with a limit
in each of the three. The open bin takes, of the buffered examples that fit in every
dimension, the one whose vector has the largest dot product with what is left of the
bin, both scaled by the limits. Each task packs its own rows as a stream with a bounded
buffer, so nothing is shuffled and no task holds more than the buffer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import bpe
from palimpsest.llm._common import prepare


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of one sequence."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be at least 1")


class Packer:
    """Fills one bin after another from a buffer of (vector, payload) examples.

    With ``cut``, an example none of which fits is cut so that the bin is filled:
    ``cut(payload, n)`` gives the payloads of its first n tokens and of the rest. All
    tokens of an example that is cut must bear loss or none.
    """

    def __init__(self, limits: Limits, buffer: int = 1024, cut=None) -> None:
        self.most = np.array([limits.tokens, limits.segments, limits.loss], np.int64)
        self.buffer, self.cut = buffer, cut
        self.size = np.zeros((buffer + 1, 3), np.int64)
        self.held: list = [None] * (buffer + 1)
        self.n = 0

    def add(self, tokens: int, loss: int, payload: object, segments: int = 1) -> Iterator[list]:
        """Takes an example; yields the bins (lists of payloads) that this completes."""
        self.size[self.n] = tokens, segments, loss
        self.held[self.n] = payload
        self.n += 1
        if self.n > self.buffer:
            while self.n > self.buffer // 2:
                yield self._fill()

    def finish(self) -> Iterator[list]:
        while self.n:
            yield self._fill()

    def _take(self, i: int) -> object:
        got, self.n = self.held[i], self.n - 1
        self.size[i], self.held[i], self.held[self.n] = self.size[self.n], self.held[self.n], None
        return got

    def _fill(self) -> list:
        left, bin_ = self.most.copy(), []
        while self.n and left[0] > 0 and left[1] > 0:
            size = self.size[: self.n]
            fits = np.flatnonzero((size <= left).all(axis=1))
            if len(fits):
                i = fits[np.argmax(size[fits] @ (left / self.most**2))]
                left -= size[i]
                bin_.append(self._take(i))
            elif self.cut:
                i = int(np.argmax(size[:, 0] * (size[:, 1] <= left[1])))
                tokens, segments, loss = size[i].tolist()
                n = int(min(left[0], left[2]) if loss else left[0])
                if n < 1 or segments > left[1] or n >= tokens:
                    break
                head, self.held[i] = self.cut(self.held[i], n)
                self.size[i] = tokens - n, segments, loss and tokens - n
                bin_.append(head)
                break
            else:
                break
        if not bin_:  # larger than an empty bin
            bin_.append(self._take(0))
        return bin_


def pack_examples(examples: DataFrame, limits: Limits = Limits(), id_col: str = "id", tokens_col: str = "n_tokens", segments_col: str = "n_segments", loss_col: str = "n_loss", buffer: int = 1024) -> DataFrame:
    """Whole instruction examples to sequences: id, sequence_id, slot, offset, oversize.

    Null counts are 0 (segments: 1); an example over a limit gets a sequence of its own and
    ``oversize`` true. Every row is placed once, repeated rows and null ids too.
    """
    prepare(examples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, made = Packer(limits, buffer), 0
        first = TaskContext.get().partitionId() << 40

        def rows(bins: Iterator[list]) -> Iterator[tuple]:
            nonlocal made
            for b in bins:
                at = 0
                for slot, (key, tokens, over) in enumerate(b):
                    yield key, first + made, slot, at, over
                    at += tokens
                made += 1

        for b in batches:
            out = []
            for key, t, s, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                over = t > limits.tokens or s > limits.segments or m > limits.loss
                out += rows(iter([[(key, t, over)]]) if over else packer.add(t, m, (key, t, over), s))
            yield _batch(out, b.schema.field(0).type)
        yield _batch(list(rows(packer.finish())), b.schema.field(0).type) if packer.n else _batch([], pa.int64())

    def _batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [kind, pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["id", "sequence_id", "slot", "offset", "oversize"])

    kind = examples.schema[id_col].dataType.simpleString()
    count = lambda c, d: F.coalesce(F.col(c).cast("long"), F.lit(d).cast("long"))
    cols = [F.col(id_col).alias("id"), count(tokens_col, 0), count(segments_col, 1), count(loss_col, 0)]
    out = examples.select(*cols).mapInArrow(run, f"id {kind}, sequence_id long, slot long, offset long, oversize boolean")
    return out.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", buffer: int = 1024) -> DataFrame:
    """Whole texts, tokenized and cut to sequences; one row per piece.

    id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A text's ids are
    followed by ``end_id`` (null and empty texts: that alone), and all bear loss. Texts are
    cut into full sequences, their rests packed and cut to fill gaps. Bins that stay below the limit (those full
    of segments, and a task's last ones) are cut to powers of two, which need no padding.
    Repeated rows and null ids are packed like any other; other columns are ignored.
    """
    prepare(docs.sparkSession)
    most = min(limits.tokens, limits.loss)
    end = np.array([end_id], "<u4").tobytes()

    def cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        key, start, ids, total = piece
        return (key, start, ids[: 4 * n], total), (key, start + n, ids[4 * n :], total)

    def powers(bin_: list) -> Iterator[list]:
        """A bin as bins of powers of two tokens."""
        left = sum(len(p[2]) for p in bin_) // 4
        while left:
            want = 1 << (left.bit_length() - 1)
            left, out = left - want, []
            while want:
                piece, rest = cut(bin_[0], want)
                want -= len(piece[2]) // 4
                out.append(piece)
                bin_ = [rest, *bin_[1:]] if rest[2] else bin_[1:]
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, packer, made = bpe.units(path), Packer(limits, buffer, cut), 0
        first = TaskContext.get().partitionId() << 40
        kind = None
        cols: list[list] = [[] for _ in range(7)]

        def put_all(bin_: list) -> None:
            held = sum(len(p[2]) for p in bin_) // 4
            for part in [bin_] if held == limits.tokens else powers(bin_):
                put(part)

        def put(bin_: list) -> None:
            nonlocal made
            at = 0
            for key, start, ids, total in bin_:
                n = len(ids) // 4
                for c, v in zip(cols, (key, start, n, zlib.crc32(ids), total, first + made, at), strict=True):
                    c.append(v)
                at += n
            made += 1

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else pa.int64()) for i, c in enumerate(cols)], NAMES)
            for c in cols:
                c.clear()
            return out

        for b in batches:
            kind = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = units.ids(text.as_py()) + end
                total = len(ids) // 4
                whole = total - total % most
                for at in range(0, whole, most):
                    put([(key, at, ids[4 * at : 4 * (at + most)], total)])
                if whole < total:
                    for bin_ in packer.add(total - whole, total - whole, (key, whole, ids[4 * whole :], total)):
                        put_all(bin_)
            yield rows()
        for bin_ in packer.finish():
            put_all(bin_)
        if kind is not None:
            yield rows()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in NAMES[1:]))
    return out.withColumnRenamed("id", id_col)


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
