"""Token counts by two-tier map-side lookup.

Tier one is a compact table of the lengths of frequent pre-tokens (white-space
separated units, which the tokenizer never joins), broadcast once. Its size is bounded by
``table_size``; it is drawn from a bounded sample of texts and only decides speed, never
a count. Misses are encoded by the library and kept in the worker's cache. There is no
shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import bpe
from palimpsest.llm._common import prepare


def frequent_lengths(docs: DataFrame, path: str, text_col: str = "text", sample_rows: int = 2000, sample_chars: int = 16_384, table_size: int = 1 << 15) -> tuple[bytes, bytes]:
    """Packed table: units joined by newlines, and one length byte each.

    The first ``sample_rows`` texts of at most ``sample_chars`` characters are looked at; only as many partitions are read as
    have them, and nothing is shuffled. ``table_size`` bounds the units kept.
    """
    own, seen = bpe.Units(path), Counter()
    for (text,) in docs.select(text_col).where(F.length(text_col) <= sample_chars).take(sample_rows):
        if own.plain(text):
            seen.update(u for u in text.split() if len(u) <= bpe.LONGEST)
    top = [u for u, _ in seen.most_common(table_size)]
    return "\n".join(top).encode(), bytes(min(255, len(own[u]) // 4) for u in top)


class Counts(dict):
    """Tier one; a miss goes to the worker's cache of ids."""

    def __init__(self, packed: tuple[bytes, bytes], path: str) -> None:
        units, lengths = packed
        super().__init__(zip(units.decode().split("\n"), lengths, strict=True) if lengths else ())
        self.misses = bpe.units(path)

    def __missing__(self, unit: str) -> int:
        return len(self.misses[unit]) // 4

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.misses.plain(text):
            return len(self.misses.whole(text)) // 4
        return sum(map(self.__getitem__, text.split()))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", **table: int) -> DataFrame:
    """One row per document: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Whole texts, without added special tokens; null and empty texts have no bytes and no
    tokens. Repeated rows come out repeated, null ids stay null, other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(frequent_lengths(docs, path, text_col, **table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(sent.value, path)
        for b in batches:
            n = np.fromiter((counts.of(t.as_py()) for t in b.column(2)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n)], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    n_bytes = F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long"))
    out = docs.select(F.col(id_col).alias("id"), n_bytes.alias("n_bytes"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
