"""Backup planning: parents, changes, chunks, deduplication, packs and restore."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.glob import matches_list
from palimpsest.functions.scalar import digest_number, entry_length, parent_path
from palimpsest.model import HEADER, PACK_DEFAULT, SNAPSHOTS, conform
from palimpsest.operators.diff import same_node

_KEY = ["blob_type", "blob_id"]


def parents(requests: DataFrame, snapshots: DataFrame, on: tuple[str, ...] = ("hostname",)) -> DataFrame:
    """As-of lookup: for each request(request_id, time, ...) the newest snapshot with equal fields and no later time.

    One union and one window over both sides, no range join.
    """
    cols = [F.col(c) for c in on]
    both = snapshots.select(*cols, "time", F.col("id").alias("snapshot_id"), F.lit(None).cast("string").alias("request_id"), F.lit(0).alias("side"))
    both = both.union(requests.select(*cols, "time", F.lit(None).cast("string"), F.col("request_id").cast("string"), F.lit(1)))
    order = Window.partitionBy(*on).orderBy("time", "side", F.coalesce("snapshot_id", "request_id")).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("snapshot_id", ignorenulls=True).over(order)
    return both.withColumn("parent", last).where("side = 1").select("request_id", "parent")


def changed_file(ignore_ctime: bool = False, ignore_inode: bool = False, old: str = "old", new: str = "new") -> Column:
    """Whether a file must be read again: another type, size, mtime (ctime, inode), or no older one."""
    out = F.col(old).isNull() | (F.col(f"{old}.type") != "file")
    for c in ["size", "mtime", *([] if ignore_ctime else ["ctime"]), *([] if ignore_inode else ["inode"])]:
        out = out | ~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))
    return out


def compare_backup(old: DataFrame, new: DataFrame, columns: list[str], **flags: bool) -> DataFrame:
    """Entries of a new backup by path: state (new, changed, unmodified) and whether the file is read again."""
    a = old.select("path", F.struct(*columns).alias("old"))
    b = new.select("path", F.struct(*columns).alias("new"))
    both = b.join(a, "path", "left")
    state = F.when(F.col("old").isNull(), "new").when(same_node("old", "new", columns), "unmodified").otherwise("changed")
    return both.select("path", F.col("new.type").alias("type"), F.col("new.size").alias("size"), state.alias("state"), ((F.col("new.type") == "file") & changed_file(**flags)).alias("read"))


def backup_summary(compared: DataFrame) -> DataFrame:
    """Files and folders new, changed and unmodified, and bytes read."""
    n = [F.count_if((F.col("type") == k) & (F.col("state") == s)).alias(f"{'files' if k == 'file' else 'dirs'}_{s}") for k in ("file", "dir") for s in ("new", "changed", "unmodified")]
    return compared.agg(*n, F.coalesce(F.sum(F.when(F.col("read"), F.col("size"))), F.lit(0)).cast("long").alias("bytes_read"))


def reusable(files: DataFrame, index: DataFrame) -> DataFrame:
    """files(path, content) with ``complete``: whether all blobs are still indexed."""
    data = index.where("blob_type = 'data'").select("blob_id").distinct().withColumn("there", F.lit(1))
    each = files.select("path", F.explode("content").alias("blob_id")).join(data, "blob_id", "left")
    lost = each.where("there IS NULL").select("path").distinct().withColumn("lost", F.lit(True))
    return files.join(lost, "path", "left").withColumn("complete", F.col("lost").isNull()).drop("lost")


def exclude_large(limit: int) -> Column:
    """Entries that a size limit excludes; folders never."""
    return (F.col("type") != "dir") & (F.col("size") > limit)


def exclude_marked(entries: DataFrame, marker: str) -> DataFrame:
    """Entries without the siblings of a marker file and what lies below them; the marker itself stays."""
    marked = entries.where((F.col("type") == "file") & (F.regexp_extract("path", "([^/]*)$", 1) == marker)).select(parent_path(F.col("path")).alias("folder")).distinct()
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    own = F.regexp_extract("path", "([^/]*)$", 1) == marker
    hit = entries.select("path", own.alias("own"), F.explode(ups).alias("folder")).join(marked, "folder", "left_semi")
    # a marker is kept in its own folder, but not below another marked one
    gone = hit.groupBy("path").agg(F.count("*").alias("n"), F.max("own").alias("own")).where("NOT own OR n > 1").select("path")
    return entries.join(gone, "path", "left_anti")


def exclude_other_devices(entries: DataFrame, allowed: list[int]) -> DataFrame:
    """Entries on allowed devices, and folders on others that are mounted in an allowed one."""
    own = F.col("device_id").isin(allowed)
    folders = entries.where(own & (F.col("type") == "dir")).select(F.col("path").alias("up"))
    mounts = entries.where(~own & (F.col("type") == "dir")).join(folders, parent_path(F.col("path")) == F.col("up"), "left_semi")
    return entries.where(own).unionByName(mounts)


def exclude(entries: DataFrame, patterns: list[str] = (), folded: list[str] = ()) -> DataFrame:
    """Entries that no pattern (or case-folded pattern) matches."""
    path = F.col("path")
    return entries.where(~(matches_list(path, list(patterns)) | matches_list(path, list(folded), fold=True)))


def chunk(files: DataFrame, least: int = 512 << 10, average_bits: int = 20, most: int = 8 << 20, window: int = 64) -> DataFrame:
    """Content-defined chunks of files(path, data): path, pos, start, length, blob_id.

    A cut falls where a rolling hash over ``window`` bytes has ``average_bits`` zero bits, between ``least`` and ``most``
    bytes. The hash is a polynomial modulo 2**64; cut points differ from those of other stores.
    """
    import hashlib

    import numpy as np

    multiplier = 0x9E3779B97F4A7C15
    power = np.array([pow(multiplier, i, 1 << 64) for i in range(window)][::-1], np.uint64)
    mask = np.uint64(((1 << average_bits) - 1) << (64 - average_bits))

    def cuts(data: bytes) -> list[int]:
        n, found = len(data), np.empty(0, np.int64)
        if n > least:
            raw = np.frombuffer(data, np.uint8)
            ends = []
            for at in range(0, n - window + 1, 1 << 18):
                part = raw[at : at + (1 << 18) + window - 1].astype(np.uint64) + np.uint64(1)
                h = np.zeros(len(part) - window + 1, np.uint64)
                for k in range(window):
                    h += part[k : k + len(h)] * power[k]
                ends.append(np.flatnonzero((h & mask) == 0) + at + window)
            found = np.concatenate(ends) if ends else found
        out, start = [], 0
        while n - start > most or (n - start > least and len(found)):
            k = int(np.searchsorted(found, start + least))
            end = int(found[k]) if k < len(found) else n
            end = min(end, start + most, n)
            if end == n:
                break
            out.append(end)
            start = end
        return [*out, n] if n else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, start = data.as_py() or b"", 0
                for pos, end in enumerate(cuts(data)):
                    rows.append((path, pos, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                    start = end
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["path", "pos", "start", "length", "blob_id"])

    return files.select("path", "data").mapInArrow(run, "path string, pos long, start long, length long, blob_id string")


def new_blobs(blobs: DataFrame, index: DataFrame, store_duplicates: bool = False) -> DataFrame:
    """Blobs to write: each once, and only those that the index lacks."""
    return blobs if store_duplicates else blobs.dropDuplicates(_KEY).join(index.select(*_KEY), _KEY, "left_anti")


def assemble_packs(blobs: DataFrame, pack_size: int = PACK_DEFAULT, shards: int | None = None, shard_packs: int = 64) -> DataFrame:
    """Blobs put into packs: pack_id, offset.

    Blobs are dealt to shards by id (unless their number is given, about ``shard_packs`` packs each, so it grows with the bytes) and put one after
    another in id order; a pack ends with the blob that reaches its size. A blob of ``pack_size`` or more gets a pack of its own.
    Pack ids are hashes of what the packs hold.
    """
    if shards is None:
        total = blobs.agg(F.sum("length")).first()[0] or 0
        shards = max(1, -(-int(total) // (pack_size * shard_packs)))
    sized = blobs.withColumns({"_own": F.col("length") >= pack_size, "_shard": digest_number(F.col("blob_id")) % shards})
    deal = ["blob_type", "_own", "_shard"]
    before = F.sum("length").over(Window.partitionBy(*deal).orderBy("blob_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    cut = sized.withColumn("_pack", F.when(F.col("_own"), F.col("blob_id")).otherwise(F.floor(before / pack_size).cast("string")))
    whole = Window.partitionBy(*deal, "_pack")
    offset = F.sum("length").over(whole.orderBy("blob_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    held = [F.min("blob_id").over(whole), F.max("blob_id").over(whole), F.count("*").over(whole), F.sum("length").over(whole), F.bit_xor(F.xxhash64("blob_id", "length")).over(whole)]
    pack_id = F.sha2(F.concat_ws(" ", "blob_type", *(h.cast("string") for h in held)), 256)
    return cut.withColumns({"offset": offset, "pack_id": pack_id}).drop("_own", "_shard", "_pack")


def pack_layout(index: DataFrame, by: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Offsets of a pack's blobs from the order of its header (columns ``by``): the running sum of lengths."""
    order = Window.partitionBy("pack_id").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    return index.withColumn("offset", F.sum("length").over(order) - F.col("length"))


def coalesce_ranges(ranges: DataFrame, gap: int = 1 << 20, most: int = 32 << 20) -> DataFrame:
    """Byte ranges (pack_id, offset, length) joined where the gap is small: reads of a pack. Reads beyond ``most`` are cut."""
    order = Window.partitionBy("pack_id").orderBy("offset")
    end = F.max(F.col("offset") + F.col("length")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(end.isNull() | (F.col("offset") - end > gap), 1).otherwise(0))
    numbered = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    base = F.min("offset").over(Window.partitionBy("pack_id", "_run"))
    part = numbered.withColumn("_part", F.floor((F.col("offset") - base) / most))
    return part.groupBy("pack_id", "_run", "_part").agg(F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("blobs")).select("pack_id", "offset", (F.col("end") - F.col("offset")).alias("length"), "blobs")


def restore_plan(walked: DataFrame, index: DataFrame) -> DataFrame:
    """Packs in the order of their first use, with files, blobs and bytes to write; hard links once."""
    from palimpsest.operators.stats import first_copy

    once = (F.col("links") == 1) | (F.col("inode") == 0)
    order = Window.partitionBy(F.when(~once, F.struct("snapshot_id", "inode", "device_id"))).orderBy("path")
    linked = walked.where((F.col("type") == "file") & ~once).withColumn("_nr", F.row_number().over(order)).where("_nr = 1").drop("_nr")
    files = walked.where((F.col("type") == "file") & once).unionByName(linked)
    each = files.select("snapshot_id", "path", F.posexplode("content").alias("pos", "blob_id"))
    at = first_copy(index.where("blob_type = 'data'")).select("blob_id", "pack_id", "length")
    return each.join(at, "blob_id").groupBy("snapshot_id", "pack_id").agg(F.min(F.struct("path", "pos")).alias("first"), F.count_distinct("path").alias("files"), F.count("*").alias("blobs"), F.sum("length").cast("long").alias("bytes")).select("snapshot_id", "pack_id", F.col("first.path").alias("first_path"), "files", "blobs", "bytes")


def overwrite(policy: str, exists: Column, newer: Column, differs: Column) -> Column:
    """Whether a restore writes a file: always, if-changed, if-newer or never."""
    rules = {"always": F.lit(True), "if-changed": differs, "if-newer": newer, "never": F.lit(False)}
    return ~exists | rules[policy]


def unexpected(target: DataFrame, walked: DataFrame, selected: Column | None = None) -> DataFrame:
    """Target entries (path) that the snapshot lacks."""
    out = target.join(walked.select("path"), "path", "left_anti")
    return out if selected is None else out.where(selected)


def verify(files: DataFrame, blob_data: DataFrame) -> DataFrame:
    """(path, pos) of blobs whose data is missing or has another hash."""
    good = blob_data.where(F.sha2("data", 256) == F.col("blob_id")).select("blob_id")
    return files.select("path", F.posexplode("content").alias("pos", "blob_id")).join(good, "blob_id", "left_anti").select("path", "pos")


def dump_file(files: DataFrame, blob_data: DataFrame) -> DataFrame:
    """(path, data): contents joined in order."""
    each = files.select("path", F.posexplode_outer("content").alias("pos", "blob_id")).join(blob_data.select("blob_id", "data").dropDuplicates(["blob_id"]), "blob_id", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.hex(F.coalesce("data", F.lit(b""))).alias("h"))))
    return each.groupBy("path").agg(F.unhex(F.array_join(F.transform(parts, lambda x: x.h), "")).alias("data"))


def pack_bytes(blobs: DataFrame) -> DataFrame:
    """(pack_id, size) of assembled packs."""
    return blobs.groupBy("pack_id").agg((HEADER + F.sum(F.col("length") + entry_length(F.coalesce("uncompressed_length", F.lit(0))))).cast("long").alias("size"))


def load_blobs(wanted: DataFrame, index: DataFrame, stored: DataFrame) -> DataFrame:
    """wanted(blob_type, blob_id) with data from the first pack (by id) whose copy has the blob's hash, and that pack.

    All copies that the index names are tried; stored(pack_id, blob_type, blob_id, data) is what is there. Both are null
    if no copy is good.
    """
    copies = index.select("pack_id", *_KEY).distinct().join(wanted.select(*_KEY).distinct(), _KEY, "left_semi")
    good = stored.where(F.sha2("data", 256) == F.col("blob_id")).join(copies, ["pack_id", *_KEY], "left_semi")
    first = good.groupBy(*_KEY).agg(F.min("pack_id").alias("pack_id"))
    data = good.join(first, ["pack_id", *_KEY], "left_semi").dropDuplicates(["pack_id", *_KEY])
    return wanted.join(data.select(*_KEY, "pack_id", "data"), _KEY, "left")


def create_snapshots(requests: DataFrame, snapshots: DataFrame, skip_unchanged: bool = False, program: str | None = None) -> DataFrame:
    """Snapshots of finished backups: requests(request_id, time, tree, and any columns of a snapshot; parent from ``parents``).

    The id is the hash of the rest as JSON. With ``skip_unchanged`` a backup whose tree is its parent's gives none.
    """
    if "parent" not in requests.columns:
        found = parents(requests, snapshots, [c for c in ("hostname", "paths") if c in requests.columns])
        requests = requests.join(found, requests["request_id"].cast("string") == found["request_id"], "left").drop(found["request_id"])
    if skip_unchanged:
        before = snapshots.select(F.col("id").alias("parent"), F.col("tree").alias("_before"))
        requests = requests.join(before, "parent", "left").where("NOT (_before <=> tree) OR parent IS NULL").drop("_before")
    rows = conform(requests.withColumn("program_version", F.lit(program).cast("string")), SNAPSHOTS)
    body = F.to_json(F.struct(*[c for c in rows.columns if c != "id"]))
    return rows.withColumn("id", F.sha2(body, 256))
