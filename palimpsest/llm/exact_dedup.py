"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

Texts are cut where their content says so (a sentence end after certain characters), so
equal texts have equal chunks. Chunks are deduplicated by hash *and* content: a chunk's
identifier is its hash, verified against every other content of the same hash, and
contents that collide get a rank beside it. Equal texts are then those with
equal ordered identifier lists; whole texts never move, distinct chunks do once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm._common import only, prepare, with_groups

#: Least and most characters of a chunk, and the characters before and at a cut.
LEAST, MOST, BEFORE, AT = 256, 4096, "aeinrst", ".!?\\n"


def chunks(text: Column) -> Column:
    """Content-defined chunks of a whole text; joined they give the text again."""
    pattern = f"(?s).{{{LEAST - 2},{MOST - 2}}}?[{BEFORE}][{AT}]|.{{1,{MOST}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _ranks(pieces: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame | None:
    """(h, chunk, rank > 1) of the contents that share a hash with another one; None if none do."""
    book = pieces.select(chunk_hash(F.col("chunk")).alias("h"), "chunk").distinct()
    shared = book.groupBy("h").count().where("count > 1").select("h").checkpoint()
    if shared.isEmpty():
        return None
    order = Window.partitionBy("h").orderBy("chunk")
    return book.join(shared, "h", "left_semi").withColumn("rank", F.row_number().over(order)).where("rank > 1").checkpoint()


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, recipe, text_sha256): ordered verified chunk identifiers of each text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    ranks = _ranks(cut.select(F.explode(chunks(F.col("text"))).alias("chunk")), chunk_hash)
    sha = F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")
    if ranks is None:
        return cut.select("id", F.transform(chunks(F.col("text")), lambda c: chunk_hash(c)).alias("recipe"), sha)
    each = cut.select("id", sha, F.posexplode_outer(chunks(F.col("text"))).alias("pos", "chunk"))
    each = each.withColumn("h", chunk_hash(F.col("chunk"))).join(ranks, ["h", "chunk"], "left")
    part = F.struct("pos", "h", F.coalesce("rank", F.lit(1)).alias("rank"))
    # keyed by the text's digest as well, so that an id that repeats does not mix texts
    whole = each.groupBy("id", "text_sha256", "pos").agg(F.first(part).alias("part"), F.count("*").alias("n"))
    whole = whole.groupBy("id", "text_sha256").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.col("part")))).alias("parts"), F.max("n").alias("n"))
    ids = F.flatten(F.transform("parts", lambda p: F.array(p.h, p.rank.cast("long"))))
    return whole.select("id", ids.alias("recipe"), "text_sha256", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")).drop("copy")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Null texts are empty ones. A null
    id is smaller than any other; in a group of null ids only, keep_id is null and each row
    is kept. Repeated rows (same id and text) count each in group_size and share
    their answer. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    made = recipes(docs, id_col, text_col, chunk_hash).checkpoint()
    groups = made.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).checkpoint()
    out = with_groups(made, groups, "recipe", "group_size")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that stay: of equal texts (null: empty) one row, that with the largest id.

    Of rows with the same id and text one stays, a text before a null, then the first by the other columns. A null id is smaller than any other.
    """
    made = exact_duplicates(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("keep_id")))
    return only(docs, made.select(id_col, "text_sha256").distinct(), id_col, text_col)
