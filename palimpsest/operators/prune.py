"""Planning of garbage collection: which packs stay, go or are repacked.

Everything is a join or an aggregate but for two order-dependent choices, each over a small part: which copy of a
duplicated blob counts (rounds over the blobs that only packs with waste hold), and which candidates fit the repack
budget (a row a candidate pack, for the driver).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scalar import digest_number, entry_length
from palimpsest.model import HEADER, PACK_DEFAULT, PACK_LEAST, RepositoryError, with_checkpoints
from palimpsest.operators.ingest import assemble_packs

_KEY = ["blob_type", "blob_id"]


@dataclass(frozen=True)
class Options:
    """max_unused: bytes, or a share such as "5%", or None for no limit; max_repack: bytes or None."""

    max_unused: int | str | None = "5%"
    max_repack: int | None = None
    cacheable_only: bool = False
    repack_small: bool = False
    repack_uncompressed: bool = False
    smallest: int | None = None

    def unused_limit(self, used: int) -> float:
        if self.max_unused is None:
            return float("inf")
        if isinstance(self.max_unused, int):
            return self.max_unused
        share = float(self.max_unused.removesuffix("%"))
        if not 0 <= share < 100:
            raise RepositoryError("percentage must be at least 0 and below 100")
        return share / (100 - share) * used


def missing_blobs(index: DataFrame, used: DataFrame) -> DataFrame:
    """Used blobs that no index names; a plan needs there to be none."""
    return used.join(index, _KEY, "left_anti")


def classify(index: DataFrame, used: DataFrame) -> DataFrame:
    """Index rows with state: used (the copy that counts), duplicate or unused.

    Blobs with several copies are gone through in order of type and id, their copies by pack id. The first copy in a pack that takes
    it counts, or else the last one. A pack takes copies if it has a blob that counts, or nothing but copies; so
    a copy that counts for want of another makes its pack take those after it.
    """
    rows = index.select("pack_id", *_KEY, "length", "uncompressed_length").distinct()
    marked = rows.join(used.select(*_KEY, F.lit(True).alias("needed")), _KEY, "left").withColumn("copies", F.count("*").over(Window.partitionBy(*_KEY)))
    marked = marked.withColumn("needed", F.coalesce("needed", F.lit(False)))
    chosen = _chosen_copies(marked).withColumn("chosen", F.lit(True))
    state = F.when(~F.col("needed"), "unused").when((F.col("copies") == 1) | F.col("chosen"), "used").otherwise("duplicate")
    return marked.join(chosen, [*_KEY, "pack_id"], "left").select("pack_id", *_KEY, "length", "uncompressed_length", state.alias("state"))


def _chosen_copies(marked: DataFrame) -> DataFrame:
    """(blob_type, blob_id, pack_id) of the copy that counts of each needed blob with several.

    Only blobs without a copy in a pack that takes them from the start can make another pack take copies. When each such pack
    begins to is found in rounds over these blobs alone: a blob is decided once no undecided one before it could open one
    of its packs, so each round decides the first at least, and as a rule nearly all.
    """
    spark = with_checkpoints(marked.sparkSession)
    takes = (F.count_if(F.col("needed") & (F.col("copies") == 1)) > 0) | (F.count_if(~F.col("needed")) == 0)
    packs = marked.groupBy("pack_id").agg(takes.alias("takes"))
    several = marked.where("needed AND copies > 1").select(F.struct(*_KEY).alias("blob"), "pack_id")
    several = several.join(packs, "pack_id").checkpoint()
    closed = several.groupBy("blob").agg(F.max("takes").alias("open"), F.max("pack_id").alias("last")).where("NOT open").drop("open")
    todo = several.select("blob", "pack_id").join(closed, "blob").checkpoint()
    opened = spark.createDataFrame([], several.select("pack_id", F.col("blob").alias("since")).schema)
    while not todo.isEmpty():
        might = todo.select("blob", "last").distinct().groupBy(F.col("last").alias("pack_id")).agg(F.min("blob").alias("might"))
        each = todo.join(opened, "pack_id", "left").join(might, "pack_id", "left")
        before = lambda c: F.max(F.coalesce(F.col(c) < F.col("blob"), F.lit(False)))
        known = each.groupBy("blob", "last").agg(before("since").alias("taken"), before("might").alias("unsure")).checkpoint()
        opens = known.where("NOT taken AND NOT unsure").groupBy(F.col("last").alias("pack_id")).agg(F.min("blob").alias("since"))
        opened = opened.union(opens).groupBy("pack_id").agg(F.min("since").alias("since")).checkpoint()
        todo = todo.join(known.where("NOT taken AND unsure").select("blob"), "blob", "left_semi").checkpoint()
    ready = F.col("takes") | F.coalesce(F.col("since") < F.col("blob"), F.lit(False))
    best = several.join(opened, "pack_id", "left").groupBy("blob").agg(F.min(F.when(ready, F.col("pack_id"))).alias("first"), F.max("pack_id").alias("last"))
    return best.select("blob.*", F.coalesce("first", "last").alias("pack_id"))


def pack_infos(classified: DataFrame) -> DataFrame:
    """Per pack: type, blobs and bytes by state (the header counts as used), and whether anything is uncompressed."""
    size = F.col("length") + entry_length(F.col("uncompressed_length"))
    low, high = F.min("blob_type"), F.max("blob_type")
    n = lambda s: F.count_if(F.col("state") == s).alias(f"{s}_blobs")
    b = lambda s, more=0: (more + F.coalesce(F.sum(F.when(F.col("state") == s, size)), F.lit(0))).cast("long").alias(f"{s}_size")
    return classified.groupBy("pack_id").agg(
        F.when(low == high, low).otherwise("mixed").alias("pack_type"), n("used"), n("duplicate"), n("unused"),
        b("used", HEADER), b("duplicate"), b("unused"), F.max(F.col("uncompressed_length") == 0).alias("plain"),
    )


def target_size(packs: DataFrame) -> int:
    """0.8 of the larger of the least pack size and the third percentile of pack sizes."""
    n = packs.count()
    if not n:
        return int(0.8 * PACK_LEAST)
    got = packs.select("size").orderBy("size").limit(3 * n // 100 + 1).agg(F.max("size")).first()[0]
    return int(0.8 * max(PACK_LEAST, got))


def decide(infos: DataFrame, packs: DataFrame, options: Options = Options()) -> DataFrame:
    """Per pack, indexed or listed: decision.

    unindexed (remove first), missing (needed: fatal), ignore (missing and not needed), damaged (fatal), remove,
    keep, small (kept unless many are small) and candidate (for repacking).
    """
    small_size = options.smallest if options.smallest is not None else target_size(packs)
    both = infos.join(packs, "pack_id", "full_outer")
    full = F.col("used_size") + F.col("duplicate_size") + F.col("unused_size")
    mixed = F.col("pack_type") == "mixed"
    recompress = F.lit(options.repack_uncompressed) & F.col("plain")
    whole = (F.col("unused_blobs") == 0) & (F.col("duplicate_blobs") == 0) & ~mixed & ~recompress
    small = F.col("size") < small_size
    decision = (
        F.when(F.col("pack_type").isNull(), "unindexed")
        .when(F.col("size").isNull(), F.when(F.col("used_blobs") > 0, "missing").otherwise("ignore"))
        .when((F.col("used_blobs") > 0) & (F.col("size") != full), "damaged")
        .when(F.col("used_blobs") == 0, "remove")
        .when(F.lit(options.cacheable_only) & (F.col("pack_type") == "data"), "keep")
        .when(whole, F.when(F.lit(options.repack_small) & small, "small").otherwise("keep"))
        .otherwise("candidate")
    )
    return both.withColumns({"decision": decision, "is_small": F.coalesce(small, F.lit(False))})


def candidates_in_order(decided: DataFrame) -> DataFrame:
    """Candidates with their place: trees first, then small ones, then by unused share, ties by pack id."""
    waste = (F.col("unused_size") + F.col("duplicate_size")) / F.col("used_size")
    order = [(F.col("pack_type") == "data").asc(), F.col("is_small").desc(), waste.desc(), F.col("pack_id").asc()]
    return decided.where("decision = 'candidate'").orderBy(*order)


def plan(index: DataFrame, used: DataFrame, packs: DataFrame, options: Options = Options()) -> DataFrame:
    """Per pack: action (remove_first, remove, repack, keep, ignore) with its sizes.

    Raises if a used blob isn't indexed, or a needed pack is missing or damaged. The
    budget is applied in candidate order; a pack that doesn't fit is skipped, later smaller ones may fit.
    """
    with_checkpoints(index.sparkSession)
    used = used.checkpoint()
    if not missing_blobs(index, used).isEmpty():
        raise RepositoryError("the index is incomplete: used blobs are missing")
    decided = decide(pack_infos(classify(index, used)), packs, options).checkpoint()
    bad = decided.where("decision IN ('missing', 'damaged')").select("pack_id", "decision").limit(5).collect()
    if bad:
        raise RepositoryError("needed packs are missing or damaged: " + ", ".join(f"{r[0]} {r[1]}" for r in bad))
    smalls = decided.where("decision = 'small'").count()
    if smalls >= 10:
        decided = decided.withColumn("decision", F.when(F.col("decision") == "small", "candidate").otherwise(F.col("decision")))
    used_bytes, unused = decided.agg(F.sum(F.when(F.col("decision") != "remove", F.col("used_size"))), F.sum(F.when(F.col("decision").isin("keep", "candidate", "small"), F.col("unused_size") + F.col("duplicate_size")))).first()
    limit = options.unused_limit(used_bytes or 0)
    left, repacked, chosen = unused or 0, 0, []
    for r in candidates_in_order(decided).select("pack_id", "pack_type", "size", "unused_size", "duplicate_size", "is_small", "plain").toLocalIterator():
        must = r.pack_type != "data" or (options.repack_uncompressed and r.plain)
        if options.max_repack is not None and repacked + r.size >= options.max_repack:
            continue
        if must or r.is_small or left >= limit:
            chosen.append((r.pack_id,))
            repacked += r.size
            left -= r.unused_size + r.duplicate_size
    repack = decided.sparkSession.createDataFrame(chosen, "pack_id string").withColumn("_repack", F.lit(True))
    action = F.when(F.col("decision") == "unindexed", "remove_first").when(F.col("_repack"), "repack").when(F.col("decision").isin("candidate", "small"), "keep").otherwise(F.col("decision"))
    return decided.join(repack, "pack_id", "left").withColumn("action", action).drop("_repack", "decision", "is_small")


def totals(planned: DataFrame) -> DataFrame:
    """Packs and bytes by action."""
    size = F.coalesce("size", F.lit(0))
    return planned.groupBy("action").agg(F.count("*").alias("packs"), F.sum(size).cast("long").alias("bytes"), F.coalesce(F.sum("used_size"), F.lit(0)).cast("long").alias("used"), F.coalesce(F.sum(F.col("unused_size") + F.col("duplicate_size")), F.lit(0)).cast("long").alias("waste"))


def blobs_to_copy(classified: DataFrame, planned: DataFrame) -> DataFrame:
    """Used blobs that no kept pack holds: what repacking must write, each once."""
    kept = classified.join(planned.where("action = 'keep'").select("pack_id"), "pack_id", "left_semi").select(*_KEY)
    return classified.where("state <> 'unused'").select(*_KEY).distinct().join(kept, _KEY, "left_anti")


def repack(classified: DataFrame, planned: DataFrame, pack_size: int = PACK_DEFAULT) -> DataFrame:
    """Index rows of the packs to be written: each blob that would be lost with its packs, once, put into new packs.

    pack_id, blob_type, blob_id, offset, length, uncompressed_length. A blob is taken from a copy in a pack that is
    repacked if it has one, then by pack id.
    """
    lost = blobs_to_copy(classified, planned)
    rank = F.when(F.col("action") == "repack", 0).otherwise(1)
    source = classified.join(planned.select("pack_id", "action"), "pack_id").join(lost, _KEY, "left_semi")
    first = source.groupBy(*_KEY).agg(F.min(F.struct(rank.alias("rank"), "pack_id", "length", "uncompressed_length")).alias("s"))
    return assemble_packs(first.select(*_KEY, "s.length", "s.uncompressed_length"), pack_size)


def repacked_index(index: DataFrame, classified: DataFrame, planned: DataFrame, pack_size: int = PACK_DEFAULT) -> DataFrame:
    """The index after a prune: rows of kept packs, and those of the packs written by ``repack`` under index "new"."""
    cols = ["index_id", "pack_id", *_KEY, "length", "uncompressed_length"]
    kept = index.join(planned.where("action = 'keep'").select("pack_id"), "pack_id", "left_semi").select(*cols)
    return kept.union(repack(classified, planned, pack_size).withColumn("index_id", F.lit("new")).select(*cols))


def pack_data(assembled: DataFrame, blob_data: DataFrame) -> DataFrame:
    """(pack_id, blob_type, blob_id, offset, data) of packs to write, from any stored copy whose data has the blob's hash."""
    good = blob_data.where(F.sha2("data", 256) == F.col("blob_id")).select(*_KEY, "data").dropDuplicates(_KEY)
    return assembled.join(good, _KEY).select("pack_id", *_KEY, "offset", "data")


def steps(planned: DataFrame) -> DataFrame:
    """Ordered work: a crash after any step loses nothing."""
    order = F.when(F.col("action") == "remove_first", 1).when(F.col("action") == "repack", 2).when(F.col("action") == "remove", 4)
    return planned.where("action IN ('remove_first', 'repack', 'remove')").select(order.alias("step"), "action", "pack_id")


def rewrite_index(index: DataFrame, removed: DataFrame, full: int = 50_000) -> DataFrame:
    """The index without packs(pack_id), cut anew into files of about ``full`` blobs; indexes that keep all their rows stay."""
    touched = index.join(removed, "pack_id", "left_semi").select("index_id").distinct()
    size = index.groupBy("index_id").count().where(F.col("count") < full).select("index_id")
    redo = touched.union(size).distinct()
    stay = index.join(redo, "index_id", "left_anti")
    rest = index.join(redo, "index_id", "left_semi").join(removed, "pack_id", "left_anti").drop("index_id").distinct()
    per = rest.groupBy("pack_id").agg(F.count("*").alias("n"))
    parts = max(1, -(-rest.count() // full))
    # packs are dealt to parts by hash, so no global order is needed
    cut = per.select("pack_id", F.concat(F.lit("new-"), (digest_number(F.col("pack_id")) % parts).cast("string")).alias("index_id"))
    return stay.unionByName(rest.join(cut, "pack_id").select(*index.columns))
