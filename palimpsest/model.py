"""Tables of a content-addressed snapshot repository, as explicit schemas (DDL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T



SUMMARY = "struct<files_new:bigint,files_changed:bigint,files_unmodified:bigint,dirs_new:bigint,dirs_changed:bigint,dirs_unmodified:bigint,data_blobs:bigint,tree_blobs:bigint,data_added:bigint,total_files_processed:bigint,total_bytes_processed:bigint>"
SNAPSHOTS = f"id string, time timestamp, parent string, tree string, paths array<string>, hostname string, username string, uid bigint, gid bigint, excludes array<string>, tags array<string>, original string, program_version string, summary {SUMMARY}"
#: ``links``, ``inode`` and ``device_id`` are unsigned in stored trees; decimals keep the large ones.
NODES = (
    "tree_id string, name string, type string, mode bigint, mtime timestamp, atime timestamp, ctime timestamp, uid bigint, gid bigint, user string, `group` string, inode decimal(20,0), device_id decimal(20,0), size bigint, links bigint, "
    "linktarget string, content array<string>, subtree string, device bigint, extended_attributes array<struct<name:string,value:binary>>, generic_attributes map<string,string>, error string"
)
INDEX_BLOBS = "index_id string, pack_id string, blob_type string, blob_id string, offset bigint, length bigint, uncompressed_length bigint"
PACKS = "pack_id string, size bigint"
BLOB_DATA = "blob_type string, blob_id string, data binary"

NODE_TYPES = ("file", "dir", "symlink", "dev", "chardev", "fifo", "socket", "irregular")
#: Bytes that encryption adds to a blob, of a pack's own header, and of a header's entry for a blob.
CRYPTO, HEADER, ENTRY_PLAIN, ENTRY_COMPRESSED = 32, 36, 37, 41
MIB = 1 << 20
#: Pack sizes: least, default, most; blobs of one index file.
PACK_LEAST, PACK_DEFAULT, PACK_MOST, INDEX_BLOBS_FULL = 4 * MIB, 16 * MIB, 128 * MIB, 50_000


class RepositoryError(ValueError):
    """A request that the repository's tables can't answer."""


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with all columns of a schema: missing ones null, others cast, extra ones dropped."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Makes sure of a checkpoint folder: the cluster's, or a temporary one where none is set and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        import tempfile

        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RepositoryError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="palimpsest-"))
    return spark
