"""Sinks: canonical trees, snapshots, JSON lines, archives and listings."""

from __future__ import annotations

import io
import tarfile
import zipfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import INDEX_BLOBS_FULL


def canonical_trees(nodes: DataFrame) -> DataFrame:
    """(blob_id, data) of each tree: its nodes as JSON in name order, ended by a line feed; the id is the hash.

    Names must differ within a tree, as the ids are our own and not those of another writer.
    """
    cols = [c for c in nodes.columns if c != "tree_id"]
    ordered = F.array_sort(F.collect_list(F.struct("name", *[c for c in cols if c != "name"])))
    doc = F.concat(F.to_json(F.struct(ordered.alias("nodes"))), F.lit("\n"))
    return nodes.groupBy("tree_id").agg(doc.alias("data")).select("tree_id", F.sha2("data", 256).alias("blob_id"), "data")


def snapshot_rows(snapshots: DataFrame) -> DataFrame:
    """Snapshots with an id that is the hash of their JSON."""
    body = F.to_json(F.struct(*[c for c in snapshots.columns if c != "id"]))
    return snapshots.withColumn("id", F.sha2(body, 256))


def write_index(index: DataFrame, path: str) -> None:
    """Index rows as files of 50,000 blobs at most."""
    index.write.option("maxRecordsPerFile", INDEX_BLOBS_FULL).parquet(path)


def index_files(index: DataFrame, most: int = 5_000) -> DataFrame:
    """(id, data) of index files as JSON, with ``most`` blobs at most; the id is the hash.

    An index is dealt to 64 tasks by pack. A pack's rows follow each other, in two files or more where one is full. Aggregates hold many
    files at once, so ``most`` bounds a task's memory and should stay far below a store's own limit.
    """
    dealt = index.withColumn("_deal", F.pmod(F.xxhash64("pack_id"), F.lit(64)))
    order = Window.partitionBy("index_id", "_deal").orderBy("pack_id", "offset")
    file = ["index_id", "_deal", "_file"]
    filed = dealt.withColumn("_file", F.floor((F.row_number().over(order) - 1) / most))
    blob = F.struct(F.col("blob_id").alias("id"), F.col("blob_type").alias("type"), "offset", "length", "uncompressed_length")
    packs = filed.groupBy(*file, "pack_id").agg(F.collect_list(blob).alias("blobs"))
    docs = packs.groupBy(*file).agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("pack_id").alias("id"), "blobs")).alias("packs"))).alias("data"))
    return docs.select(F.sha2("data", 256).alias("id"), "data")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def ncdu_rows(walked: DataFrame) -> DataFrame:
    """Columns of a disk usage export: apparent size, size in whole 512-byte blocks, mtime not before 1970."""
    size = F.coalesce("size", F.lit(0))
    disk = (F.floor((size + 511) / 512) * 512).cast("long")
    mtime = F.greatest(F.unix_timestamp("mtime"), F.lit(0))
    return walked.select("snapshot_id", "path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), size.alias("asize"), disk.alias("dsize"), "inode", F.col("device_id").alias("dev"), F.col("links").alias("nlink"), mtime.alias("mtime"), (F.col("type") != "dir").alias("notreg"))


def write_archives(files: DataFrame, path: str, kind: str = "tar") -> list[str]:
    """One archive for each archive(archive, path, data), a partition each, streamed to ``path``; gives the file names.

    ``path`` must be a folder that executors share.
    """
    if kind not in ("tar", "zip"):
        raise ValueError(f"unknown archive type {kind!r}")

    def put(rows) -> None:
        current, out = None, None
        for r in rows:
            if r["archive"] != current:
                if out:
                    out.close()
                current = r["archive"]
                name = f"{path}/{current}.{kind}"
                out = tarfile.open(name, "w") if kind == "tar" else zipfile.ZipFile(name, "w")  # noqa: SIM115
            data, at = bytes(r["data"] or b""), r["path"].lstrip("/")
            if kind == "tar":
                info = tarfile.TarInfo(at)
                info.size = len(data)
                out.addfile(info, io.BytesIO(data))
            else:
                out.writestr(at, data)
        if out:
            out.close()

    names = [f"{path}/{r[0]}.{kind}" for r in files.select("archive").distinct().orderBy("archive").collect()]
    files.repartition("archive").sortWithinPartitions("archive", "path").foreachPartition(put)
    return names


def table_text(df: DataFrame, rows: int = 100) -> str:
    """A text table of the first rows, as a report."""
    head = df.limit(rows).collect()
    cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in head]]
    width = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:]])
