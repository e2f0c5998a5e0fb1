"""Benchmark decontamination by winnowing.

Of each window of w consecutive k-gram hashes the smallest (rightmost of equals) is
kept as a fingerprint. Two texts that share w + k - 1 words share a fingerprint, at the
same place of the shared span; the fingerprints of training texts are joined with those of
the benchmark and each hit is extended word by word while both texts agree, as far as a
window that holds the fingerprint can reach: longer spans have more fingerprints. Places that agree in
all words within that reach are extended once, so repeated words stay cheap. Items
shorter than the window are fingerprinted with w and k that guarantee their own length.

Word identifiers are exact (a dictionary of the benchmark's words), so a hit that is
extended to the needed length is a true match. The benchmark is broadcast in blocks whose
bytes are counted first (``block_bytes`` each at about that); the training texts are
never shuffled for the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import prepare

#: Bytes of words to themselves in lower case, all others to a space.
WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
NONE = np.iinfo(np.uint64).max
#: Pairs of places that are extended at a time.
PAIRS = 1 << 20


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a whole text as UTF-8."""
    return (text or "").encode("utf-8").translate(WORDS).split()


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k ids from each place on; NONE where one of them isn't a benchmark word."""
    n = len(ids) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        known &= part > 0
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h[h == NONE] = NONE - np.uint64(1)
    h[~known] = NONE
    return h


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the smallest hash of each window of w (the rightmost of equals)."""
    n = len(h) - w + 1
    if n < 1:
        return np.empty(0, np.int64)
    least, at = h[:n].copy(), np.arange(n)
    for j in range(1, w):
        smaller = h[j : j + n] <= least
        least[smaller] = h[j : j + n][smaller]
        at[smaller] = np.flatnonzero(smaller) + j
    return np.unique(at[least != NONE])


def alike(ids: np.ndarray, places: np.ndarray, before: int, after: int, also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of places with equal words from ``before`` before to ``after`` after and equal ``also``: one of each, class of each.

    Ids below 1 aren't words, and what lies beyond one makes no difference.
    """
    rows = np.empty((len(places), before + after + 1), np.int32)
    rows[:, -1] = also
    for j in range(before + after):
        rows[:, j] = ids[np.clip(places + (j - before), 0, len(ids) - 1)]
    for j in range(before - 1, -1, -1):
        rows[rows[:, j + 1] < 1, j] = 0
    for j in range(before + 1, before + after):
        rows[rows[:, j - 1] < 1, j] = 0
    _, one, group = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return one, group.ravel()


class Benchmark:
    """Fingerprints and words of one block of items, for lookup in a worker."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, k: int) -> None:
        self.window, self.vocabulary, ids = window, {}, [np.array([-1], np.int32)]
        self.names: list[str] = []
        start, sizes = [], []
        at = 1
        for name, text in items:
            w = words(text)
            if not w:
                continue
            own = np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w] + [-1], np.int32)
            ids.append(own)
            self.names.append("" if name is None else name)
            start.append(at)
            sizes.append(len(w))
            at += len(own)
        self.ids, self.start, self.size = np.concatenate(ids), np.array(start, np.int64), np.array(sizes, np.int64)
        self.classes = []
        for length in sorted({min(int(s), window) for s in sizes}):
            own = np.flatnonzero(self.size >= window if length == window else self.size == length)
            kk = min(k, length)
            places = [winnow(gram_hashes(self.ids[self.start[i] : self.start[i] + self.size[i]], kk), length - kk + 1) + self.start[i] for i in own]
            places = np.concatenate(places)
            # of places with equal surroundings in one item one stands for all
            item = np.searchsorted(self.start, places, "right") - 1
            places = places[alike(self.ids, places, length - kk, length, item)[0]]
            h = gram_hashes(self.ids, kk)[places]
            order = np.argsort(h, kind="stable")
            self.classes.append((length, kk, h[order], places[order]))

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matched spans (start, end, item), which together cover all that matches, in ids, which holds a 0 at both ends and between texts."""
        found = []
        for length, k, hashes, places in self.classes:
            known = np.concatenate(([0], (ids > 0).view(np.int8), [0]))
            edge = np.flatnonzero(np.diff(known))
            runs = [(a, b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b - a >= length]
            if not runs:
                continue
            pick = np.concatenate([np.arange(a - 1, b + 1) for a, b in runs])  # with the 0 before and after
            h = gram_hashes(ids[pick], k)
            p = winnow(h, length - k + 1)
            lo, hi = np.searchsorted(hashes, h[p], "left"), np.searchsorted(hashes, h[p], "right")
            p, lo, hi = pick[p[hi > lo]], lo[hi > lo], hi[hi > lo]
            if not len(p):
                continue
            one, group = alike(ids, p, length - k, length, np.zeros(len(p), np.int32))
            found.append(self._hits(ids, p, one, group, lo[one], hi[one], places, length, k))
        if not found:
            return (np.empty(0, np.int64),) * 3
        return tuple(np.unique(np.concatenate(found, axis=1), axis=1))

    def _hits(self, ids: np.ndarray, p: np.ndarray, one: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, places: np.ndarray, length: int, k: int) -> np.ndarray:
        """Spans (start, end, item) of the places p, whose classes have the benchmark places from lo to hi.

        All spans at a place hold it, so of an item the furthest start and end there say the same as all of them.
        """
        upto, begin, best = np.cumsum(hi - lo), 0, []
        while begin < len(one):  # pairs by blocks
            end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + PAIRS, "right")))
            n = (hi - lo)[begin:end]
            at = np.repeat(np.arange(begin, end), n)
            q = places[np.repeat(lo[begin:end] - (np.cumsum(n) - n), n) + np.arange(len(at))]
            left, right = self._extent(ids, p[one[at]] - 1, q - 1, -1, length - k), self._extent(ids, p[one[at]], q, 1, length)
            item = np.searchsorted(self.start, q, "right") - 1
            keep = left + right >= length
            pair, of = np.unique(np.stack([at, item])[:, keep], axis=1, return_inverse=True)
            far = np.zeros((2, pair.shape[1]), np.int64)
            np.maximum.at(far[0], of.ravel(), left[keep])
            np.maximum.at(far[1], of.ravel(), right[keep])
            best.append(np.concatenate([pair, far]))
            begin = end
        at, item, left, right = np.concatenate(best, axis=1)
        # back to all members of the classes
        members, many = np.argsort(group, kind="stable"), np.bincount(group)
        n = many[at]
        pick = np.repeat((np.cumsum(many) - many)[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place = p[members[pick]]
        return np.stack([place - np.repeat(left, n), place + np.repeat(right, n), np.repeat(item, n)])

    def _extent(self, ids: np.ndarray, p: np.ndarray, q: np.ndarray, step: int, most: int) -> np.ndarray:
        """How many words agree from (p, q) on, in steps of 1 or -1, up to ``most``."""
        out, go = np.zeros(len(p), np.int64), np.arange(len(p))
        for n in range(most):
            go = go[ids[p[go] + step * n] == self.ids[q[go] + step * n]]
            if not len(go):
                break
            out[go] += 1
        return out


def _blocks(items: DataFrame, item_col: str, text_col: str, window: int, k: int, block_bytes: int) -> Iterator[Benchmark]:
    rows = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k_ in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k_)
        yield Benchmark(sorted({(r.i, r.t) for r in part.toLocalIterator()}, key=lambda r: (r[0] or "", r[1] or "")), window, k)


def _ids(texts: pa.Array, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, list[int], list[int]]:
    """Word ids of texts one after another, a 0 before, between and after; where each text starts, and its number of words."""
    ids, first, counts = [np.zeros(1, np.int32)], [], []
    at = 1
    for t in texts:
        w = words(t.as_py())
        ids += [np.fromiter(map(vocabulary.get, w, repeat(0)), np.int32, len(w)), ids[0]]
        first.append(at)
        counts.append(len(w))
        at += len(w) + 1
    return np.concatenate(ids), first, counts


def matched_spans(docs: DataFrame, bench: Benchmark, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n_words, spans array<struct<s,e>>, items array<string>) per row; spans are merged."""
    sent = docs.sparkSession.sparkContext.broadcast(bench)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        span_type, item_type = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.list_(pa.string())
        for b in batches:
            ids, first, counts = _ids(b.column(2), own.vocabulary)
            start, end, item = own.spans(ids)
            spans: list[list] = [[] for _ in counts]
            items: list[set] = [set() for _ in counts]
            for d, s, e, i in zip((np.searchsorted(first, start, "right") - 1).tolist(), start.tolist(), end.tolist(), item.tolist(), strict=True):
                s, e = s - first[d], e - first[d]
                items[d].add(own.names[i])
                if spans[d] and s <= spans[d][-1]["e"]:
                    spans[d][-1]["e"] = max(e, spans[d][-1]["e"])
                else:
                    spans[d].append({"s": s, "e": e})
            cols = [b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(spans, span_type), pa.array([sorted(x) for x in items], item_type)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "text_key", "n_words", "spans", "items"])

    kind = docs.schema[id_col].dataType.simpleString()
    cols = [F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("t")]
    return docs.select(*cols).mapInArrow(run, f"id {kind}, text_key long, n_words long, spans array<struct<s:bigint,e:bigint>>, items array<string>")


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs, all columns, of whose text no word is hit; no shuffle, and blocks follow one another in one pass."""
    spark = prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def filtered(rows: DataFrame, bench: Benchmark) -> DataFrame:
        sent = spark.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, first, _ = _ids(b.column(at), sent.value.vocabulary)
                clean = np.ones(b.num_rows, bool)
                clean[np.searchsorted(first, sent.value.spans(ids)[0], "right") - 1] = False
                yield b.filter(pa.array(clean))

        return rows.mapInArrow(run, docs.schema)

    for bench in _blocks(items, item_col, item_text_col, window, k, block_bytes):
        docs = filtered(docs, bench)
    return docs


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of ``window`` consecutive words of an item (of
    the whole item if that is shorter). Null and empty texts have no words; items
    without words match nothing; repeated items count once by id, and a null item id
    counts as an empty one. Repeated documents come out repeated; an empty benchmark
    contaminates nothing. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    found = [matched_spans(docs, b, id_col, text_col) for b in _blocks(items, item_col, item_text_col, window, k, block_bytes)]
    out = found[0]
    if len(found) > 1:
        found = [f.checkpoint() for f in found]  # texts are read once a block
        out = found[0]
        hits = [f.where(F.size("items") > 0).distinct() for f in found]
        more = hits[0]
        for h in hits[1:]:
            more = more.union(h)
        step = lambda a, x: F.when((F.size(a) > 0) & (x.s <= F.element_at(a, -1).e), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1).s.alias("s"), F.greatest(F.element_at(a, -1).e, x.e).alias("e"))))).otherwise(F.concat(a, F.array(x)))
        spans = F.aggregate(F.array_sort(F.flatten(F.collect_list("spans"))), F.array().cast("array<struct<s:bigint,e:bigint>>"), step)
        more = more.groupBy(F.col("id").alias("i"), F.col("text_key").alias("x")).agg(spans.alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        out = out.select("id", "text_key", "n_words").join(more, F.col("id").eqNullSafe(F.col("i")) & F.col("text_key").eqNullSafe(F.col("x")), "left")
        out = out.withColumns({"spans": F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x.e - x.s)
    listed = F.array_join(F.array_sort("items"), ",")
    return out.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
