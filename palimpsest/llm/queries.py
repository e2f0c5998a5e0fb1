"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import langid, quality
from palimpsest.llm._common import crc32_mod, table
from palimpsest.llm.decontaminate import contamination
from palimpsest.llm.exact_dedup import exact_duplicates
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.preference import conversations, format_pairs
from palimpsest.llm.simhash import near_duplicates
from palimpsest.llm.suffix_dedup import repeated_bytes
from palimpsest.llm.token_counts import token_counts
from palimpsest.llm.toxicity import Model, toxicity, train


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc32_mod(F.col("doc_id"), 3) != 1))
    out = langid.language_spans(docs, model)
    digest = [F.size("spans").alias("n_spans"), F.to_json("spans").alias("spans")]
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", *digest)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with its last assistant turn taken from the next one.

    The table marks no preferences, so the rejected side is made up: its last assistant turn
    is that of conversation conv_id + 1, or missing if there is none.
    """
    talks = conversations(table(spark, sf_dir, "conversations"))
    last = F.array_max(F.transform(F.filter("turns", lambda x: x.role == "assistant"), lambda x: F.struct(x.turn.alias("turn"), x.text.alias("text"))))
    talks = talks.withColumn("last", last)
    after = talks.where("last IS NOT NULL").select(F.try_subtract("id", F.lit(1)).alias("id"), F.col("last.text").alias("other"), F.lit(True).alias("there"))
    both = talks.join(after, "id", "left")
    swap = lambda x: F.coalesce((x.turn == F.col("last.turn")) & (x.role == "assistant"), F.lit(False))
    kept = F.filter("turns", lambda x: ~swap(x) | F.col("there").isNotNull())
    rejected = F.array_sort(F.transform(kept, lambda x: F.struct(x.turn.alias("turn"), x.role.alias("role"), F.when(swap(x), F.col("other")).otherwise(x.text).alias("text"))))
    out = format_pairs(both.select(F.col("id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected")))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x.s.cast("string"), x.e.cast("string"))), ",").alias(c)
    return out.select("pair_id", "n_common", "n_chosen", "n_rejected", "prompt", "chosen", "rejected", listed("chosen_loss"), listed("rejected_loss"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> Model:
    """Fit on labelled documents that are not held out."""
    seen = crc32_mod(F.col("doc_id"), 4) != 2
    return train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(seen))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return out.withColumn("held_out", crc32_mod(F.col("doc_id"), 4) == 2)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality, 1 good but toxic, 2 good; rows whose crc32(doc_id) mod 5 is 3 are held out."""
    docs = table(spark, sf_dir, "documents")
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("toxic") == 0, 2)
    rated = table(spark, sf_dir, "labels").where(crc32_mod(F.col("doc_id"), 5) != 3).select("doc_id", grade.alias("grade"))
    out = quality.quality(docs, quality.train(docs, rated, grades=3), tail=1)
    return out.withColumn("held_out", crc32_mod(F.col("doc_id"), 5) == 3)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_token_counts,
        op3_preference_format,
        op4_exact_dedup,
        op5_simhash,
        op6_decontamination,
        op7_toxicity,
        op8_suffix_dedup,
        op9_quality,
        op10_packing,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_preference_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        last AS (SELECT conv_id, max(turn) AS at, max_by(text, turn) AS text FROM t WHERE role = 'assistant' GROUP BY conv_id),
        s AS (SELECT conv_id, 0 AS side, turn, role, text FROM t
              UNION ALL SELECT t.conv_id, 1, t.turn, t.role, CASE WHEN t.turn = l.at AND t.role = 'assistant' THEN n.text ELSE t.text END
              FROM t LEFT JOIN last l ON t.conv_id = l.conv_id LEFT JOIN last n ON n.conv_id = t.conv_id + 1
              WHERE NOT coalesce(t.turn = l.at AND t.role = 'assistant', false) OR n.conv_id IS NOT NULL),
        p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn, role, text) AS pos FROM s),
        m AS (SELECT conv_id, pos, bool_and(role = role0 AND text = text0) AND count(*) = 2 AS same
              FROM (SELECT *, first_value(role) OVER w AS role0, first_value(text) OVER w AS text0 FROM p WINDOW w AS (PARTITION BY conv_id, pos ORDER BY side)) GROUP BY conv_id, pos),
        c AS (SELECT conv_id, coalesce(min(CASE WHEN NOT same THEN pos END) - 1, count(*)) AS n_common FROM m GROUP BY conv_id),
        r AS (SELECT p.*, n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown FROM p JOIN c USING (conv_id)),
        o AS (SELECT *, sum(CASE WHEN pos > n_common THEN length(shown) ELSE 0 END) OVER (PARTITION BY conv_id, side ORDER BY pos) AS e FROM r),
        f AS (SELECT *, (e - length(text) - 8) || '-' || e AS span FROM o)
        SELECT conv_id AS pair_id, any_value(n_common) AS n_common,
               count(*) FILTER (side = 0 AND pos > n_common) AS n_chosen, count(*) FILTER (side = 1 AND pos > n_common) AS n_rejected,
               coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 0 AND pos <= n_common), '') AS prompt,
               coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 0 AND pos > n_common), '') AS chosen,
               coalesce(string_agg(shown, '' ORDER BY pos) FILTER (side = 1 AND pos > n_common), '') AS rejected,
               coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 0 AND pos > n_common AND role = 'assistant'), '') AS chosen_loss,
               coalesce(string_agg(span, ',' ORDER BY pos) FILTER (side = 1 AND pos > n_common AND role = 'assistant'), '') AS rejected_loss
        FROM f GROUP BY conv_id
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, list_aggregate(w[i : i + least(10, len(w)) - 1], 'string_agg', ' ') AS g
               FROM b, unnest(range(1, greatest(len(w) - 8, 2))) AS u(i) WHERE len(w) > 0),
        dw AS (SELECT doc_id, s.n, i, list_aggregate(w[i : i + s.n - 1], 'string_agg', ' ') AS g
               FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, len(w) - s.n + 2)) AS u(i) WHERE len(w) >= s.n),
        m AS (SELECT doc_id, item_id, n, i FROM dw JOIN bw USING (n, g)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op8_suffix_dedup": """
        WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM d, unnest(range(0, n - 49)) AS u(i) WHERE n >= 50),
        f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
        m AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN f USING (s) WHERE doc_id > least),
        r AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
        x AS (SELECT doc_id, run, min(i) AS s, max(i) + 50 AS e FROM r GROUP BY doc_id, run),
        k AS (SELECT doc_id, e AS s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM x
              UNION ALL SELECT doc_id, 0, min(s) FROM x GROUP BY doc_id),
        t AS (SELECT doc_id, string_agg(substr(h, 2 * s + 1, 2 * (coalesce(e, n) - s)), '' ORDER BY s) AS kept FROM k JOIN d USING (doc_id) GROUP BY doc_id),
        c AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM x GROUP BY doc_id)
        SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
}
