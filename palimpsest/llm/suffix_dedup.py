"""Removal of repeated byte strings by suffix sorting.

Every byte covered by a string of ``length`` bytes that also starts in a document with a smaller
id goes. The work is dealt out by content, so no task sees more than a bounded share:

1. Documents are dealt to groups by id. Of each window of ``length`` bytes the smallest
   hash of its k-byte grams (its minimizer) is computed; equal windows have equal minimizers.
   Groups send their minimizers, each once, to buckets by hash.
2. A bucket tells the groups which minimizers occur in more than one document, and which are
   frequent. Windows under a frequent one are dealt by it and their largest hash, so that a common phrase
   with ever different neighbours doesn't come to one bucket.
3. Groups cut the runs of windows under such minimizers out as segments and send each different
   one once, with its smallest id, to the bucket of its windows. So a passage that is in a third
   of all documents costs a row a group, not a row a document.
4. A bucket sorts the suffixes at all window starts by two-stage sorting: only those smaller than
   their successors are sorted directly (by their first ``length`` bytes), the others are
   induced by scanning the buckets of first bytes in order. Adjacent common prefixes of ``length`` or more
   bytes give the equal windows and their smallest id, which is told to the groups.
5. Groups mark the windows and remove the bytes they cover. Where their runs are they have told themselves in step 3.

The three passes over the texts are cogroups on one exchange, which Spark reuses.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import prepare

#: Bytes of a gram; two words of 8 bytes are hashed.
GRAM = 16
#: The low bits of a minimizer are free for notes on it.
LOW = np.uint64(15)
NOTE = "g int, m int, kind int, data binary"
_NOTE = pa.schema([("g", pa.int32()), ("m", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def words_at(data: bytes) -> np.ndarray:
    """The 8 bytes from each place on as a little-endian number."""
    n = len(data) - 7
    out = np.empty(max(n, 0), np.uint64)
    for i in range(min(8, max(n, 0))):
        part = np.frombuffer(data, "<u8", (len(data) - i) // 8, i)
        out[i::8] = part
    return out


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of the gram from each place on; the LOW bits are 0."""
    w = words_at(data)
    h = w[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h += w[8:]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h &= ~LOW
    return h


def over_windows(best: np.ufunc, h: np.ndarray, length: int) -> np.ndarray:
    """The least or greatest (``best``) gram hash of each window of ``length`` bytes."""
    span, have = length - GRAM + 1, 1
    while 2 * have <= span:
        h = best(h[:-have], h[have:])
        have *= 2
    return best(h[: len(h) - (span - have)], h[span - have :]) if span > have else h


def runs(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of windows with one minimizer: first window, last window, minimizer; from the gram hashes."""
    m = over_windows(np.minimum, h, length)
    cut = np.flatnonzero(m[1:] != m[:-1]) + 1
    first = np.concatenate(([0], cut))
    return first, np.concatenate((cut - 1, [len(m) - 1])), m[first]


def shared_runs(data: bytes, shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows under shared minimizers: first window, last window, what they are dealt by.

    ``shared`` is in order; its lowest bit marks frequent minimizers, whose runs are cut where the largest hash changes.
    """
    h = gram_hashes(data)
    first, last, key = runs(h, length)
    at = np.searchsorted(shared, key)
    at[at == len(shared)] = 0
    hit = (shared[at] & ~LOW) == key
    often = hit & (shared[at] & LOW > 0)
    first, last, key, often = first[hit], last[hit], key[hit], often[hit]
    if not often.any():
        return first, last, key
    most = over_windows(np.maximum, h, length)
    size = last - first + 1
    run = np.repeat(np.arange(len(first)), size)
    place = np.arange(len(run)) + (first - (np.cumsum(size) - size))[run]
    by = key[run]
    mark = often[run]
    by[mark] = (by[mark] ^ (most[place[mark]] >> np.uint64(4))) * np.uint64(0x9E3779B97F4A7C15)
    begin = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (by[1:] != by[:-1]))))
    end = np.concatenate((begin[1:], [len(run)])) - 1
    return place[begin], place[end], by[begin]


def _rows(docs: pa.Table) -> list[tuple[int | None, bytes]]:
    """(id, text) of all rows; a null text is empty."""
    texts = docs.column("text").cast(pa.binary()).to_pylist()
    return [(i, t or b"") for i, t in zip(docs.column("id").to_pylist(), texts, strict=True)]


def _texts(docs: pa.Table, length: int) -> list[tuple[int, bytes]]:
    """(id, text) of the documents that can share a window, each once and in order; a null id is neither earlier nor later."""
    return sorted({(i, t) for i, t in _rows(docs) if i is not None and len(t) >= length})


def _squeeze(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit numbers, byte by byte of a column, packed."""
    planes = [np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _columns(data: bytes, n: int) -> list[np.ndarray]:
    """The n columns that were squeezed, as 64-bit numbers."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(n, 4, -1)
    return [np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in planes]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)


def _notes(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, _NOTE.types, strict=True)], schema=_NOTE)


def _split(values: np.ndarray, owner: np.ndarray):
    """(owner, its values) with order kept."""
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
    for part, own in zip(np.split(values, cut), np.split(owner, cut), strict=True):
        if len(own):
            yield int(own[0]), part


def send_minimizers(docs: pa.Table, length: int, buckets: int) -> pa.Table:
    """A group's different minimizers by bucket; the low bits hold the logarithm of how many of its documents have it."""
    g = docs.column("g")[0].as_py()
    parts, ids = [], []
    for i, t in _texts(docs, length):
        own = np.unique(runs(gram_hashes(t), length)[2])
        parts.append(own)
        ids.append(np.full(len(own), i, np.int64))
    if not parts:
        return _notes([])
    h, d = np.concatenate(parts), np.concatenate(ids)
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    level = np.log2(np.diff(np.concatenate((first, [len(h)])))).clip(1, 15).astype(np.uint64)
    h = h[first] | np.where(several, level, np.uint64(0))
    return _notes([(g, m, 0, part.tobytes()) for m, part in _split(h, _bucket(h, buckets))])


def shared_minimizers(notes: pa.Table, frequent: int) -> pa.Table:
    """For each group those of its minimizers that are in two documents at least; the lowest bit marks those in about ``frequent`` or more."""
    m = notes.column("m")[0].as_py()
    parts = [np.frombuffer(x, np.uint64) for x in notes.column("data").to_pylist()]
    h = np.concatenate(parts)
    owner = np.repeat(np.array(notes.column("g").to_pylist(), np.int32), [len(p) for p in parts])
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    bare, times = h & ~LOW, np.int64(1) << (h & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bare[1:] != bare[:-1])))
    size = np.diff(np.concatenate((first, [len(h)])))
    total = np.add.reduceat(times, first)
    keep = np.repeat(total > 1, size)
    h = bare | np.repeat(total >= frequent, size).astype(np.uint64)
    return _notes([(g, m, 0, part.tobytes()) for g, part in _split(h[keep], owner[keep])])


def send_segments(docs: pa.Table, notes: pa.Table, length: int, buckets: int) -> pa.Table:
    """A group's different segments by bucket: their number, lengths, smallest ids and bytes.

    A note to the group itself (kind 2, by way of the bucket of its own number) says where its runs are, so that they
    aren't looked for again: see ``_runs_note``.
    """
    if not docs.num_rows or not notes.num_rows:
        return _notes([])
    g = docs.column("g")[0].as_py()
    shared = np.sort(np.frombuffer(b"".join(notes.column("data").to_pylist()), np.uint64))
    numbers: dict[bytes, int] = {}  # a segment's number is that of its first use, in order of ids
    owner, first, last, key, number, ids = [], [], [], [], [], []
    for d, (i, t) in enumerate(_texts(docs, length)):
        a, b, k = shared_runs(t, shared, length)
        if len(a):
            owner.append(np.full(len(a), d, np.int64))
            ids.append(np.full(len(a), i, np.int64))
            first.append(a)
            last.append(b)
            key.append(k)
            number += [numbers.setdefault(t[x:y], len(numbers)) for x, y in zip(a.tolist(), (b + length).tolist(), strict=True)]
    if not owner:
        return _notes([])
    owner, first, last, ids, number = np.concatenate(owner), np.concatenate(first), np.concatenate(last), np.concatenate(ids), np.array(number, np.int64)
    bucket = _bucket(np.concatenate(key), buckets)
    use = np.flatnonzero(np.concatenate(([True], np.maximum.accumulate(number)[1:] > np.maximum.accumulate(number)[:-1])))
    bucket, least = bucket[use], ids[use]
    listed = list(numbers)
    order = np.array(sorted(range(len(listed)), key=listed.__getitem__))
    order = order[np.argsort(bucket[order], kind="stable")]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    rows, pack = [], zstandard.ZstdCompressor(level=3)
    count = []
    for m, part in _split(order, bucket[order]):
        own = [listed[j] for j in part.tolist()]
        sizes = np.fromiter(map(len, own), "<u4", len(own))
        # in byte order neighbours share their beginnings, so this packs well
        rows.append((g, m, 0, pack.compress(np.array([len(own)], "<u4").tobytes() + sizes.tobytes() + least[part].astype("<i8").tobytes() + b"".join(own))))
        count.append((m, len(own)))
    rows.append((g, g, 2, _runs_note(owner, first, last, np.where(ids > least[number], 0, place[number] + 1), count)))
    return _notes(rows)


def _runs_note(owner: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray, count: list[tuple[int, int]]) -> bytes:
    """Runs of a group's documents (numbered in order of id and text): document, first window, windows less 1, place of the segment.

    Places count from 1 over buckets and within them; 0 stands for a segment that a smaller id of the group has as well, so
    that all of the run goes. The buckets and their numbers of segments follow.
    """
    runs = _squeeze(owner, np.diff(first, prepend=0) & 0xFFFFFFFF, last - first, place)
    return np.array([len(runs)], "<u4").tobytes() + runs + np.array(count, "<u4").tobytes()


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places in the order of their suffixes, right for the first ``depth`` bytes.

    ``text`` must end in a 0, a 255 and ``depth`` more bytes. A suffix is "ascending" if it is smaller than its
    successor. Ascending ones are sorted directly by ``depth`` bytes; a descending one is its
    first byte before its successor, so it falls into place when its successor's bucket (of one first
    byte) is scanned. ``wanted`` marks places; those needed to induce them are added and taken out again.
    """
    n = len(text) - depth
    less, more = text[:-1] < text[1:], text[:-1] > text[1:]
    # equal neighbours take the kind of the next place that differs
    differs = np.where(less | more, np.arange(len(text) - 1, dtype=np.int32), np.int32(len(text) - 1))
    nearest = np.minimum.accumulate(differs[::-1])[::-1]
    up = np.concatenate((less, [False]))[nearest][:n]
    del differs, nearest, more
    # up to the next ascending place every place is needed
    next_up = np.minimum.accumulate(np.where(up, np.arange(n, dtype=np.int32), np.int32(n))[::-1])[::-1]
    start = np.flatnonzero(wanted)
    edge = -np.bincount(np.minimum(next_up[start], n - 1) + 1, minlength=n + 1)
    edge[start] += 1
    needed = np.cumsum(edge[:n]) > 0
    del next_up, edge
    direct = np.flatnonzero(needed & up)
    rows = np.lib.stride_tricks.sliding_window_view(text, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"V{depth}").view(f"S{depth}").ravel(), kind="stable")]
    del rows
    head = text[direct]
    bounds = np.searchsorted(head, np.arange(257))
    follows = np.zeros(n + 1, bool)  # is the place before needed and descending?
    follows[1:] = needed & ~up
    pending: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def scan(part: np.ndarray, c: int) -> np.ndarray:
        """Induces the places before ``part``; those of the same first byte are returned."""
        out.append(part)
        before = part[follows[part]] - 1
        first = text[before]
        same = before[first == c]
        before, first = before[first > c], first[first > c]
        if len(before):
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cut = np.flatnonzero(first[1:] != first[:-1]) + 1
            for b, piece in zip(first[np.concatenate(([0], cut))].tolist(), np.split(before, cut), strict=True):
                pending[b].append(piece)
        return same

    for c in range(256):
        if pending[c]:
            part = np.concatenate(pending[c])
            pending[c] = []
            while len(part):
                part = scan(part, c)
        if bounds[c] < bounds[c + 1]:
            scan(direct[bounds[c] : bounds[c + 1]], c)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[wanted[order]]


def smallest_ids(notes: pa.Table, length: int) -> pa.Table:
    """For each group the stretches of its segments' windows that occur under a smaller id than the segment's.

    Segments that several groups sent are sorted once, under their smallest id; in the other groups all of their windows
    occur under a smaller one. A group's note to itself is passed on.
    """
    m = notes.column("m")[0].as_py()
    kind = np.array(notes.column("kind").to_pylist())
    passed, notes = notes.filter(pa.array(kind == 2)).select(_NOTE.names), notes.filter(pa.array(kind == 0))
    if not notes.num_rows:
        return passed
    owner, ids, which = [], [], []
    distinct: dict[bytes, int] = {}
    unpack = zstandard.ZstdDecompressor()
    for g, x in zip(notes.column("g").to_pylist(), map(unpack.decompress, notes.column("data").to_pylist()), strict=True):
        n = int(np.frombuffer(x, "<u4", 1)[0])
        ends = np.cumsum(np.frombuffer(x, "<u4", n, 4), dtype=np.int64) + 4 + 12 * n
        ids.append(np.frombuffer(x, "<i8", n, 4 + 4 * n))
        owner.append(np.full(n, g, np.int32))
        starts = [4 + 12 * n, *ends[:-1].tolist()]
        which.append(np.array([distinct.setdefault(x[a:b], len(distinct)) for a, b in zip(starts, ends.tolist(), strict=True)], np.int64))
    local = np.concatenate([np.arange(len(x)) for x in which])
    which, ids, owner = np.concatenate(which), np.concatenate(ids), np.concatenate(owner)
    own = np.full(len(distinct), np.iinfo(np.int64).max)
    np.minimum.at(own, which, ids)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))
    text = np.frombuffer(b"".join(distinct) + b"\x00\xff" + bytes(length + 8), np.uint8)
    del distinct
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    count = size - length + 1  # windows of each segment
    at, first, last = _later_stretches(text, begin, count, own, length)
    # of each segment that was sent: all windows, or the stretches found
    whole = np.flatnonzero(ids > own[which])
    told = [np.stack([local[whole], np.zeros(len(whole), np.int64), count[which[whole]] - 1], axis=1)]
    rest = np.flatnonzero(ids == own[which])
    low, high = np.searchsorted(at, which[rest], "left"), np.searchsorted(at, which[rest], "right")
    n = high - low
    pick = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    told.append(np.stack([np.repeat(local[rest], n), first[pick], last[pick]], axis=1))
    to = np.concatenate((owner[whole], np.repeat(owner[rest], n)))
    return pa.concat_tables([_notes([(g, m, 1, _squeeze(*part.T)) for g, part in _split(np.concatenate(told), to)]), passed])


def _later_stretches(text: np.ndarray, begin: np.ndarray, count: np.ndarray, own: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows that also occur in a segment of a smaller id: segment, first and last window.

    Segments start at ``begin`` in ``text`` and have ``count`` windows and the id ``own`` each.
    """
    edge = np.zeros(len(text) + 1, np.int8)
    edge[begin] = 1
    edge[begin + count] = -1
    wanted = np.cumsum(edge[: len(text) - length], dtype=np.int8) > 0
    del edge
    order = suffix_order(text, wanted, length)
    w = words_at(text.tobytes())
    a, b = order[:-1], order[1:]
    equal = np.ones(len(a), bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        equal &= w[a + k] == w[b + k]
    first = np.flatnonzero(np.concatenate(([True], ~equal)))
    segment = np.repeat(np.arange(len(begin), dtype=np.int32), count + length - 1)
    ids = own[segment[order]]
    least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.concatenate((first, [len(order)]))))
    later = np.zeros(len(segment), bool)
    later[order[least < ids]] = True
    place = np.flatnonzero(later)
    at = segment[place]
    offset = place - begin[at]
    new = np.concatenate(([True], (place[1:] != place[:-1] + 1) | (at[1:] != at[:-1]))) if len(place) else np.empty(0, bool)
    lead = np.flatnonzero(new)
    end = np.concatenate((lead[1:], [len(place)])) - 1 if len(lead) else lead
    return at[lead], offset[lead], offset[end]


_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))])
OUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:bigint,e:bigint>>"


def _marks(notes: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the notes of a group say goes: document (numbered in order of id and text), from, to; overlaps are not joined."""
    by_kind: dict[int, list[tuple[int, bytes]]] = {1: [], 2: []}
    for m, k, x in zip(*(notes.column(c).to_pylist() for c in ("m", "kind", "data")), strict=True):
        by_kind[k].append((m, x))
    if not by_kind[2]:
        return (np.empty(0, np.int64),) * 3
    data = by_kind[2][0][1]
    size = 4 + int(np.frombuffer(data, "<u4", 1)[0])
    owner, first, more, place = _columns(data[4:size], 4)
    first = np.cumsum(first) & 0xFFFFFFFF
    count = np.frombuffer(data[size:], "<u4").reshape(-1, 2).astype(np.int64)
    lead = dict(zip(count[:, 0].tolist(), (np.cumsum(count[:, 1]) - count[:, 1] + 1).tolist(), strict=True))
    told = [(lead[m] + n, a, b) for m, x in by_kind[1] for n, a, b in [_columns(x, 3)]]
    n, a, b = (np.concatenate(c) for c in zip(*told, strict=True)) if told else (np.empty(0, np.int64),) * 3
    order = np.argsort(n, kind="stable")
    n, a, b = n[order], a[order], b[order]
    whole = place == 0
    low, high = np.searchsorted(n, place, "left"), np.searchsorted(n, place, "right")
    many = np.where(whole, 0, high - low)
    run = np.repeat(np.arange(len(place)), many)
    pick = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(run))
    start = np.concatenate((first[whole], first[run] + a[pick]))
    end = np.concatenate((first[whole] + more[whole], first[run] + b[pick])) + length
    return np.concatenate((owner[whole], owner[run])), start, end


def remove(docs: pa.Table, notes: pa.Table, length: int) -> pa.Table:
    """The group's documents with their removed spans."""
    rows = _rows(docs)
    if not rows:
        return _OUT.empty_table()
    spans: dict[tuple[int, bytes], tuple[list[int], list[int]]] = {}
    if notes.num_rows:
        texts = _texts(docs, length)
        base = np.cumsum([0, *(len(t) + 1 for _, t in texts)])  # with a gap, so that no two documents touch
        owner, start, end = _marks(notes, length)
        order = np.argsort(base[owner] + start)
        owner, start, reach = owner[order], (base[owner] + start)[order], np.maximum.accumulate((base[owner] + end)[order])
        lead = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1]))[: len(start)])
        tail = np.concatenate((lead, [len(start)]))[1:] - 1
        for d, s, e in zip(owner[lead].tolist(), (start[lead] - base[owner[lead]]).tolist(), (reach[tail] - base[owner[lead]]).tolist(), strict=True):
            starts_, ends_ = spans.setdefault(texts[d], ([], []))
            starts_.append(s)
            ends_.append(e)
    removed, number, digest, starts, ends = [], [], [], [], []
    for row in rows:
        s, e = spans.get(row, ((), ()))
        sha, at = hashlib.sha256(), 0
        for a, b in zip(s, e, strict=True):
            sha.update(row[1][at:a])
            at = b
        sha.update(row[1][at:])
        removed.append(sum(e) - sum(s))
        number.append(len(s))
        digest.append(sha.hexdigest())
        starts += s
        ends += e
    struct = pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["s", "e"])
    listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *number]), pa.int32()), struct)
    cols = [docs.column("id").to_pylist(), [len(t) for _, t in rows], removed, number, digest]
    return pa.Table.from_arrays([*(pa.array(c, t) for c, t in zip(cols, _OUT.types, strict=False)), listed], names=_OUT.names)


def repeated_bytes(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 4 << 20, least_groups: int = 64, frequent: int = 4096) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<s,e>> (bytes).

    Null texts are empty. A null id is neither earlier nor later than another: its text
    stays whole and removes nothing. Rows that repeat an id don't remove from each other. Strings that
    overlap count; matches never cross documents. Other columns are ignored. ``group_bytes``
    is about what one task handles at a time; ``frequent`` documents make a minimizer a frequent one.
    """
    prepare(docs.sparkSession)
    if length < GRAM + 8:
        raise ValueError(f"length must be at least {GRAM + 8}")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(least_groups, -(-total // group_bytes))
    # null ids are dealt by their texts, as they may be many
    dealt = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(F.col(id_col).cast("long")))
    key = F.pmod(dealt, F.lit(n)).cast("int")
    own = docs.select(key.alias("g"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).groupBy("g")
    sent = own.applyInArrow(lambda d: send_minimizers(d, length, n), NOTE)
    shared = sent.groupBy("m").applyInArrow(lambda x: shared_minimizers(x, frequent), NOTE)
    segments = own.cogroup(shared.groupBy("g")).applyInArrow(lambda d, x: send_segments(d, x, length, n), NOTE)
    smaller = segments.groupBy("m").applyInArrow(lambda x: smallest_ids(x, length), NOTE)
    out = own.cogroup(smaller.groupBy("g")).applyInArrow(lambda d, x: remove(d, x, length), OUT)
    return out.withColumnRenamed("id", id_col)
