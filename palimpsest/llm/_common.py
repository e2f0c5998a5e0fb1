"""Helpers shared by the training-data operators: table access, checkpoints, Arrow limits."""

from __future__ import annotations

import tempfile
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Rows and bytes of one Arrow batch handed to a Python worker; bounds worker memory.
ARROW_ROWS, ARROW_BYTES = 1024, 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and make sure a checkpoint folder is set.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where
    that is unset and the master is local (tests, one machine) a temporary one is used.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="palimpsest-"))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the decimal text of an id, modulo n; null ids count as remainder -1."""
    return F.coalesce(F.crc32(col.cast("string")) % n, F.lit(-1))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, which driver and executors share."""
    import uuid

    prepare(spark)
    base = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}-{name}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of ``shared_path``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, made longer until no column of df has it (whatever the case of its letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_digest(text_col: str) -> Column:
    """SHA-256 of a text; a null one counts as empty."""
    return F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, parts: int = 64, share: int = 256) -> DataFrame:
    """rows joined with groups (one row a key, ``size``: its number of rows), hot keys dealt to ``parts`` tasks.

    A key is hot if it has over 1/``share`` of all rows, so there are fewer than ``share`` of them and their hashes fit in a
    literal; the rows of groups are repeated for hot keys only. rows must be checkpointed or read from files, as the
    deal goes by their places.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = [r[0] for r in groups.where(F.col(size) * share > total).select(F.xxhash64(key)).distinct().collect()]
    if not hot:
        return rows.join(groups, key)
    is_hot = F.xxhash64(key).isin(hot)
    salt = free_name(rows, "salt")
    dealt = rows.withColumn(salt, F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).otherwise(0))
    copies = groups.withColumn(salt, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, salt]).drop(salt)


def one_of_each(docs: DataFrame, id_col: str, text_col: str, digest: str) -> DataFrame:
    """One row of those with the same id (null included) and text, with the text's digest in column ``digest``.

    Of such rows that differ in other columns the first in their order stays. Repeats go before the shuffle, so a row that
    repeats very often costs a row a task.
    """
    keyed = docs.withColumn(digest, text_digest(text_col))
    rest = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in (id_col, text_col) and not f.dataType.simpleString().startswith(("map", "variant"))]
    order = Window.partitionBy(id_col, digest).orderBy(F.col(text_col).isNull(), *rest)
    nr = free_name(keyed, "nr")
    return keyed.withColumn(nr, F.row_number().over(order)).where(F.col(nr) == 1).drop(nr)


def only(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose id and text's digest are among keys(id, text_sha256), each once."""
    digest = free_name(docs, "text_sha256")
    rows = one_of_each(docs, id_col, text_col, digest)
    mine, theirs = free_name(rows, "kept_id"), free_name(rows, "kept_digest")
    wanted = keys.select(F.col(id_col).alias(mine), F.col("text_sha256").alias(theirs))
    found = F.col(id_col).eqNullSafe(F.col(mine)) & (F.col(digest) == F.col(theirs))
    return rows.join(wanted, found, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def bounded_sample(rows: DataFrame, id_col: str, text_col: str, most_rows: int, most_bytes: int) -> list:
    """Rows for fitting a model: the first in hash order of their id, at most ``most_rows`` and ``most_bytes`` of text.

    Texts of more than a 64th of ``most_bytes`` come after all others, so that a few of them don't take the place of many
    rows; texts of more than ``most_bytes`` are not used. Rows are picked by id and digest before any text moves.
    """
    spark = prepare(rows.sparkSession)
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    keyed = rows.where(F.col(id_col).isNotNull() & (size <= most_bytes))
    keyed = keyed.withColumns({"pick_id": F.col(id_col), "pick_digest": F.xxhash64(text_col), "pick_size": size})
    order = [F.col("pick_size") > most_bytes // 64, F.xxhash64("pick_id"), "pick_id", "pick_digest", "pick_size"]
    picks: Counter = Counter()
    total = 0
    for r in keyed.select("pick_id", "pick_digest", "pick_size").orderBy(*order).limit(most_rows).collect():
        total += r.pick_size
        if total > most_bytes:
            break
        picks[tuple(r)] += 1
    if not picks:
        return []
    fields = keyed.select("pick_id", "pick_digest", "pick_size").schema
    copies = spark.createDataFrame([(*key, n) for key, n in picks.items()], fields.add("pick_n", IntegerType()))
    copy = Window.partitionBy("pick_id", "pick_digest", "pick_size").orderBy(*rows.columns)
    got = keyed.join(F.broadcast(copies), ["pick_id", "pick_digest", "pick_size"])
    got = got.withColumn("pick_nr", F.row_number().over(copy)).where("pick_nr <= pick_n").orderBy(*order, "pick_nr")
    return got.select(*rows.columns).collect()
