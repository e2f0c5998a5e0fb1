"""SimHash near-duplicates: deletion-variant signatures over 64-bit fingerprints.

A fingerprint is cut into two 32-bit halves. If two fingerprints differ in at most
three bits, one half differs in at most one bit. Every fingerprint is therefore
indexed, for each half, under its exact value and under its 32 one-wildcard variants
(one bit deleted). Two equality joins bring together the fingerprints that share an
exact half, and those that share a variant but differ in the deleted bit; the whole
Hamming distance is then verified. Copies (equal fingerprints) are one node, so a
group of copies costs one row.

An index key under which more than ``dense`` different fingerprints meet isn't paired
off: the other half is cut into two quarters, of which one again differs in at most one bit, and
the quarters and their one-wildcard variants join the key. Only where that still
brings more than ``dense`` together are the members linked through variants of the last quarter that leave
open as many bits as may still differ. All members of such a variant differ pairwise in at most three bits, so a star to the
smallest one keeps them connected, and the number of rows stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import only, prepare, text_digest, with_groups
from palimpsest.llm.components import components

#: Hash blocks of this many shingles are counted at a time.
BLOCK = 1 << 16
SEED = 42


def fingerprint(text: str | None, k: int = 3) -> int:
    """Unsigned 64-bit SimHash of a whole text (None: no words, hence 0)."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - k + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[min(k, len(words)) - 1 :].tolist()
    view, digest = memoryview(joined), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        pairs = zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)
        h = np.array([digest(view[a:b], SEED) for a, b in pairs], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, digest: bool = False) -> DataFrame:
    """(id, fp long): the signed form of the fingerprint of each whole text; with ``digest`` also text_sha256."""
    prepare(docs.sparkSession)
    names = ["id", "fp", "text_sha256"][: 3 if digest else 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), k) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names)

    kind = docs.schema[id_col].dataType.simpleString()
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("t"), text_digest(text_col).alias("text_sha256")][: len(names)]
    return docs.select(*cols).mapInArrow(run, f"id {kind}, fp long" + ", text_sha256 string" * digest)


def _half(fp: Column, seg: int) -> Column:
    return (F.shiftright(fp, 32) if seg else fp).bitwiseAND(0xFFFFFFFF)


def _key(slot: int, value: Column) -> Column:
    """One long for (slot, 32-bit value); slots: 33 a half, the last one for its exact value."""
    return value.bitwiseOR(F.lit(slot << 32))


def _variants(fp: Column, seg: int, bit: int) -> Column:
    """Keys of the variants of a half whose deleted bit had the given value (null: another value)."""
    half = _half(fp, seg)
    return F.array_compact(
        F.array(*[F.when(half.bitwiseAND(1 << j) == (bit << j), _key(33 * seg + j, half.bitwiseAND(0xFFFFFFFF ^ (1 << j)))) for j in range(32)])
    )


def _pairs(nodes: DataFrame, dense_keys: DataFrame | None, max_bits: int) -> DataFrame:
    """Links between fingerprints that meet under a key, verified by whole Hamming distance."""

    def side(name: str, bit: int) -> DataFrame:
        fp = F.col("fp")
        keys = F.concat(*[_variants(fp, s, bit) for s in (0, 1)], F.array(*[_key(33 * s + 32, _half(fp, s)) for s in (0, 1)]))
        out = nodes.select(F.explode(keys).alias("key"), fp.alias(name))
        return out if dense_keys is None else out.join(dense_keys, "key", "left_anti")

    met = side("a", 0).join(side("b", 1), "key")
    exact = (F.shiftright("key", 32) % 33) == 32
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return met.where(near & (~exact | (F.col("a") < F.col("b")))).select("a", "b")


def _quarter_keys(half: Column) -> Column:
    """Keys of the quarters of a half: 17 slots each, for one deleted bit or (the last one) for the whole value."""
    keys = []
    for q in (0, 1):
        value = F.shiftright(half, 16 * q).bitwiseAND(0xFFFF)
        keys += [_slot(17 * q + j, value.bitwiseAND(0xFFFF ^ (1 << j))) for j in range(16)] + [_slot(17 * q + 16, value)]
    return F.array(*keys)


def _slot(slot: int, value: Column) -> Column:
    return value.bitwiseOR(F.lit(slot << 16))


def _under_dense(nodes: DataFrame, dense_keys: DataFrame, max_bits: int, dense: int) -> DataFrame:
    """Links under dense keys, by key and quarter; stars where that is crowded too."""
    fp, rows = F.col("fp"), None
    for seg in (0, 1):
        keys = F.concat(_variants(fp, seg, 0), _variants(fp, seg, 1), F.array(_key(33 * seg + 32, _half(fp, seg))))
        own = nodes.select(F.explode(keys).alias("key"), "fp").join(dense_keys, "key", "left_semi")
        own = own.select("key", "fp", F.explode(_quarter_keys(_half(fp, 1 - seg))).alias("sub"))
        rows = own if rows is None else rows.union(own)
    sizes = rows.groupBy("key", "sub").count().where("count > 1")
    rows = rows.join(sizes, ["key", "sub"]).checkpoint()
    few, many = rows.where(F.col("count") <= dense), rows.where(F.col("count") > dense)
    met = few.select("key", "sub", fp.alias("a")).join(few.select("key", "sub", fp.alias("b")), ["key", "sub"])
    found = met.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b").distinct()
    slot, quarter = F.shiftright("key", 32), F.shiftright("sub", 16)
    last = F.when(slot < 33, F.shiftright(fp, 32)).otherwise(fp)
    last = F.when(quarter < 17, F.shiftright(last, 16)).otherwise(last).bitwiseAND(0xFFFF)
    for open_key in (0, 1):
        for open_sub in (0, 1):
            at = many.where(((slot % 33 < 32) == F.lit(bool(open_key))) & ((quarter % 17 < 16) == F.lit(bool(open_sub))))
            masks = F.array(*[F.lit(0xFFFF ^ sum(1 << j for j in js)) for js in combinations(range(16), max_bits - open_key - open_sub)])
            at = at.select("key", "sub", last.alias("last"), "fp", F.explode(masks).alias("mask"))
            # at most 2 ** max_bits different fingerprints agree in all other bits
            star = at.groupBy("key", "sub", "mask", F.col("last").bitwiseAND(F.col("mask"))).agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
            found = found.union(star.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct())
    return found


def links(nodes: DataFrame, max_bits: int = 3, dense: int = 256) -> DataFrame:
    """(a, b) near pairs of the different fingerprints nodes(fp); connected as all near pairs are.

    Keys that more than ``dense`` fingerprints can share are split by quarters, and give stars where these are crowded too.
    A variant is the union of two exact halves, so counts of exact halves tell both.
    """
    halves = nodes.select(F.explode(F.array(*[_key(33 * s + 32, _half(F.col("fp"), s)) for s in (0, 1)])).alias("key"))
    heavy = halves.groupBy("key").count().where(F.col("count") > dense).select("key").checkpoint()
    if heavy.isEmpty():
        return _pairs(nodes, None, max_bits)
    value, slot = F.col("key").bitwiseAND(0xFFFFFFFF), F.shiftright("key", 32) - 32
    wild = F.array(*[value.bitwiseAND(0xFFFFFFFF ^ (1 << j)).bitwiseOR(F.shiftleft(slot + j, 32)) for j in range(32)])
    dense_keys = heavy.select(F.explode(F.concat(F.array("key"), wild)).alias("key")).distinct().checkpoint()
    return _pairs(nodes, dense_keys, max_bits).union(_under_dense(nodes, dense_keys, max_bits, dense))


def _classes(prints: DataFrame, max_bits: int, dense: int) -> DataFrame:
    """(fp, copies, root, component_id) of the different fingerprints of prints(id, fp)."""
    if max_bits not in (2, 3):
        raise ValueError("max_bits must be 2 or 3")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies")).checkpoint()
    linked = components(links(nodes.select("fp"), max_bits, dense)).withColumnRenamed("v", "fp")
    rooted = nodes.join(linked, "fp", "left").select("fp", "copies", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "copies", "root", "component_id").checkpoint()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_bits: int = 3, dense: int = 256) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of ``max_bits`` or fewer
    differing bits (``max_bits`` is 2 or 3: one half then differs in one bit at most).
    Null and empty texts have fingerprint zero and are linked like any other;
    repeated rows come out repeated; a null id is never a component's smallest unless it
    has no other (then null). Other columns of ``docs`` are ignored.
    """
    prints = fingerprints(docs, id_col, text_col, k).checkpoint()
    out = with_groups(prints, _classes(prints, max_bits, dense), "fp", "copies")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, max_bits: int = 3, dense: int = 256) -> DataFrame:
    """The rows of docs, all columns, that stay: of each component one row, that with the smallest id.

    Of rows with that id the one with the smallest digest of its text stays (null counts as empty), of rows with the same id
    and text a text before a null, then the first by the other columns. A null id stays only if its component has no other.
    """
    prints = fingerprints(docs, id_col, text_col, k, digest=True).checkpoint()
    of = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "text_sha256")).alias("first"))
    keys = of.join(_classes(prints, max_bits, dense), "fp").groupBy("root").agg(F.min("first").alias("first"))
    return only(docs, keys.select(F.col("first.id").alias(id_col), F.col("first.text_sha256").alias("text_sha256")), id_col, text_col)
