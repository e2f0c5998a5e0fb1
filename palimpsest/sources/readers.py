"""Readers of a decrypted repository's files and of plain inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.model import INDEX_BLOBS, NODES, SNAPSHOTS, conform

#: JSON of one index file and of one tree.
INDEX_JSON = "supersedes array<string>, packs array<struct<id:string,blobs:array<struct<id:string,type:string,offset:bigint,length:bigint,uncompressed_length:bigint>>>>"
NODE_JSON = (
    "struct<name:string,type:string,mode:bigint,mtime:string,atime:string,ctime:string,uid:bigint,gid:bigint,user:string,`group`:string,inode:decimal(20,0),device_id:decimal(20,0),size:bigint,links:bigint,"
    "linktarget:string,content:array<string>,subtree:string,device:bigint,extended_attributes:array<struct<name:string,value:binary>>,generic_attributes:map<string,string>,error:string>"
)


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(id, path, size, modified) of the files below a path; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("id"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.regexp_extract(F.col("_metadata.file_path"), "([^/.]*)[^/]*$", 1))


def snapshots(spark: SparkSession, path: str, exclude: DataFrame | None = None) -> DataFrame:
    """Snapshot files (JSON), with the file's name as id, local time and zone kept; without exclude(id)."""
    import re

    fields = re.sub(r"\btime timestamp", "time string", SNAPSHOTS.removeprefix("id string, "))
    raw = _with_id(spark.read.schema(fields).option("multiLine", "true").json(path))
    local = F.regexp_extract("time", r"^(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?)", 1).cast("timestamp_ntz").cast("timestamp")
    out = raw.withColumn("_local", local).withColumn("time", F.col("time").cast("timestamp"))
    out = out if exclude is None else out.join(exclude.select("id"), "id", "left_anti")
    return out.select(*[f.name for f in conform(out, SNAPSHOTS).schema], F.col("_local").alias("local_time"))


def nanoseconds(time: Column) -> Column:
    """The digits of an RFC 3339 time's fraction as nanoseconds, which a timestamp cuts."""
    return F.rpad(F.regexp_extract(time, r"\.(\d+)", 1), 9, "0").cast("long")


def tree_nodes(trees: DataFrame, data_col: str = "data") -> DataFrame:
    """Nodes of trees(tree_id, data): JSON documents {"nodes": [...]}; unknown keys are ignored."""
    parsed = trees.select("tree_id", F.from_json(F.col(data_col).cast("string"), f"nodes array<{NODE_JSON}>").alias("t"))
    flat = parsed.select("tree_id", F.explode("t.nodes").alias("n")).select("tree_id", "n.*")
    return conform(flat, NODES)


def index_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of index files; the file's name is the index id."""
    raw = _with_id(spark.read.schema(INDEX_JSON).option("multiLine", "true").json(path))
    return index_rows(raw)


def index_rows(raw: DataFrame) -> DataFrame:
    """Rows of parsed indexes(id, packs)."""
    each = raw.select(F.col("id").alias("index_id"), F.explode("packs").alias("p")).select("index_id", F.col("p.id").alias("pack_id"), F.explode("p.blobs").alias("b"))
    flat = each.select("index_id", "pack_id", F.col("b.type").alias("blob_type"), F.col("b.id").alias("blob_id"), "b.offset", "b.length", F.coalesce("b.uncompressed_length", F.lit(0)).alias("uncompressed_length"))
    return conform(flat, INDEX_BLOBS)


def master_index(index: DataFrame) -> DataFrame:
    """The union of index files without exact repeats."""
    return index.drop("index_id").distinct()


def target_list(spark: SparkSession, path: str, verbatim: bool = False, nul: bool = False) -> DataFrame:
    """(target) lines of list files: trimmed, blank ones and "#" comments left out, unless verbatim or NUL-separated."""
    lines = spark.read.option("lineSep", "\0" if nul else "\n").text(path).select(F.col("value").alias("target"))
    if verbatim or nul:
        return lines.where("target <> ''")
    return lines.select(F.trim("target").alias("target")).where("target <> '' AND NOT startswith(target, '#')")


def stream_file(spark: SparkSession, name: str, data: bytes) -> DataFrame:
    """One virtual file, as from standard input."""
    return spark.createDataFrame([("/" + name.strip("/"), bytearray(data))], "path string, data binary")


def local_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime, data) of real files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("content").alias("data"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files in UTF-8 or, by their byte-order mark, UTF-16."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    mark = F.hex(F.substring("content", 1, 3))
    body = lambda n: F.substring(F.col("content"), n, 1 << 30)
    text = F.when(mark == "EFBBBF", F.decode(body(4), "UTF-8")).when(mark.startswith("FFFE"), F.decode(body(3), "UTF-16LE")).when(mark.startswith("FEFF"), F.decode(body(3), "UTF-16BE")).otherwise(F.decode("content", "UTF-8"))
    return raw.select("path", text.alias("text"))
