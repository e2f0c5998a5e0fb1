"""Order-dependent rules against brute force, and texts of the command line."""

from __future__ import annotations

import datetime as dt
import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.model import RepositoryError
from palimpsest.operators import ingest, prune, tree


def brute_choice(rows, used):
    """Blob by blob: the copy that counts, with packs that begin to take copies on the way."""
    places = {}
    for p, b in sorted(rows):
        places.setdefault(b, []).append(p)
    packs = {p: [b for q, b in rows if q == p] for p, _ in rows}
    takes = {p for p, bs in packs.items() if any(b in used and len(places[b]) == 1 for b in bs) or all(b in used for b in bs)}
    state = {}
    for b, own in sorted(places.items()):
        if b not in used:
            state.update({(p, b): "unused" for p in own})
            continue
        pick = next((p for p in own if p in takes), own[-1])
        if len(own) > 1:
            takes.add(pick)
        state.update({(p, b): "used" if p == pick else "duplicate" for p in own})
    return state


@pytest.mark.parametrize("seed", range(6))
def test_choice_of_copies_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = {(f"p{rng.randrange(9)}", f"b{rng.randrange(40):02}") for _ in range(rng.choice([40, 110]))}
    blobs = sorted({b for _, b in rows})
    used = set(rng.sample(blobs, int(len(blobs) * rng.choice([0.3, 0.6, 0.9]))))
    index = spark.createDataFrame([(p, "data", b, 100, 0) for p, b in rows], "pack_id string, blob_type string, blob_id string, length long, uncompressed_length long")
    need = spark.createDataFrame([("data", b) for b in used], "blob_type string, blob_id string")
    got = {(r.pack_id, r.blob_id): r.state for r in prune.classify(index, need).collect()}
    assert got == brute_choice(rows, used)


def brute_cuts(data, least, bits, most, window=64):
    power = [pow(0x9E3779B97F4A7C15, window - 1 - i, 1 << 64) for i in range(window)]
    zero = [e for e in range(window, len(data) + 1) if sum((c + 1) * m for c, m in zip(data[e - window : e], power, strict=True)) % (1 << 64) >> (64 - bits) == 0]
    out, start = [], 0
    while start < len(data):
        end = next((e for e in zero if e >= start + least), len(data))
        end = min(end, start + most, len(data))
        out.append((start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
        start = end
    return out


def test_chunks_match_brute_force(spark):
    rng = random.Random(8)
    base = bytes(rng.randrange(256) for _ in range(4000))
    files = [("a", base), ("b", b"new beginning" + base), ("c", b""), ("d", b"x" * 3000), ("e", None), ("f", base[:100])]
    got = {}
    for r in ingest.chunk(spark.createDataFrame(files, "path string, data binary"), least=100, average_bits=6, most=700).collect():
        got.setdefault(r.path, []).append((r.pos, r.start, r.length, r.blob_id))
    for path, data in files:
        want = [(i, *c) for i, c in enumerate(brute_cuts(data or b"", 100, 6, 700))]
        assert sorted(got.get(path, [])) == want
    shared = {c[3] for c in got["a"]} & {c[3] for c in got["b"]}
    assert len(shared) >= len(got["a"]) - 3  # a new beginning moves no later cut


def test_large_blobs_get_packs_of_their_own(spark):
    rng = random.Random(9)
    rows = [("data", f"b{i}", rng.choice([10, 300, 999, 1000, 5000]), 0) for i in range(500)]
    df = spark.createDataFrame(rows, "blob_type string, blob_id string, length long, uncompressed_length long")
    packs = {}
    for r in ingest.assemble_packs(df, pack_size=1000, shard_packs=8).collect():
        packs.setdefault(r.pack_id, []).append((r.offset, r.length, r.blob_id))
    assert sum(map(len, packs.values())) == 500
    for own in packs.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at < 1000
            at += length
        assert len(own) == 1 or max(n for _, n, _ in own) < 1000
    assert len(packs) < 500


def test_unknown_packs_are_an_error(spark):
    index = spark.createDataFrame([("0123456789ab", "data", "b1")], "pack_id string, blob_type string, blob_id string")
    ask = lambda *ids: tree.blobs_of_packs(index, spark.createDataFrame([(i,) for i in ids], "pack_id string")).collect()
    assert len(ask("01234567")) == len(ask("0123456789ab", "01234567")) == 1
    with pytest.raises(RepositoryError, match="ffffffff"):
        ask("01234567", "ffffffff")


@pytest.mark.parametrize("given, want", [
    ("2024-05-06", dt.datetime(2024, 5, 6)), ("2024-05-06 07:08", dt.datetime(2024, 5, 6, 7, 8)), ("06.05.2024 07:08:09", dt.datetime(2024, 5, 6, 7, 8, 9)),
    ("2024-05-06 07:08:09 +0200", dt.datetime(2024, 5, 6, 5, 8, 9)), ("2024-05-06 07:08:09 UTC", dt.datetime(2024, 5, 6, 7, 8, 9)),
    ("Mon May 6 07:08:09 -0100 AZOT 2024", dt.datetime(2024, 5, 6, 8, 8, 9)), ("2024-5-6", None), ("yesterday", None), ("2024-13-01", None), (" 2024-05-06", None),
])
def test_times(spark, given, want):
    got = spark.range(1).select(text.parse_time(F.lit(given)).cast("string").alias("t")).first().t
    assert got == (want and str(want))


def test_a_search_by_a_time_that_is_none_fails(spark):
    with pytest.raises(Exception, match="unable to parse time"):
        spark.range(1).select(text.required_time("soon")).collect()


def test_terminal_texts(spark):
    lines = ["plain", "tab\there", "wide 中文", "\x1b[1m", 'a "b"\n', "café", None, "", "​\U000e0001"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = [tuple(r) for r in df.select(text.quote(F.col("x")), text.display_width(F.col("x")), text.truncate(F.col("x"), 6)).collect()]
    assert [g[0] for g in got] == ["plain", '"tab\\there"', "wide 中文", '"\\x1b[1m"', '"a \\"b\\"\\n"', "café", None, "", '"\\u200b\\U000e0001"']
    assert [got[i][1] for i in (0, 2, 5, 6, 7)] == [5, 9, 4, None, 0]
    assert [got[i][2] for i in (0, 1, 2, 5, 6)] == ["plain", "tab\the", "wide ", "café", None]


def test_access_lists(spark):
    entry = lambda *rows: struct.pack("<I", 2) + b"".join(struct.pack("<HHI", *r) for r in rows)
    none = 0xFFFFFFFF
    good = entry((1, 7, none), (2, 5, 1000), (4, 4, none), (8, 0, 33), (16, 6, none), (32, 1, none))
    df = spark.createDataFrame([(good,), (b"",), (good[:-1],), (entry((3, 7, none)),), (entry(),), (None,)], "x binary")
    got = [r[0] for r in df.select(text.acl(F.col("x"))).collect()]
    assert got == ["user::rwx\nuser:1000:r-x\ngroup::r--\ngroup:33:---\nmask::rw-\nother::--x\n", None, None, None, "", None]


def test_tag_lists(spark):
    row = spark.range(1).select(text.split_tags(F.lit(" a, b c ,,d")).alias("t"), text.flatten_tags(F.array(text.split_tags(F.lit("a,")), text.split_tags(F.lit("b")))).alias("f")).first()
    assert row.t == ["a", "b c", "", "d"] and row.f == ["a", "b"]


def test_repacked_blobs_are_written_once(spark):
    rows = [("p1", "data", f"b{i}", 100, 0) for i in range(6)] + [("p2", "data", f"b{i}", 100, 0) for i in range(4, 12)]
    index = spark.createDataFrame([("i", *r) for r in rows], "index_id string, pack_id string, blob_type string, blob_id string, length long, uncompressed_length long")
    used = spark.createDataFrame([("data", f"b{i}") for i in (0, 1, 4, 5, 10)], "blob_type string, blob_id string")
    from palimpsest.operators.stats import pack_sizes

    planned = prune.plan(index, used, pack_sizes(index), prune.Options(max_unused=0))
    after = prune.repacked_index(index, prune.classify(index, used), planned, pack_size=250).collect()
    assert sorted(r.blob_id for r in after) == ["b0", "b1", "b10", "b4", "b5"] and {r.index_id for r in after} == {"new"}
    data = {b: b.encode() for b in ("b0", "b1")}
    store = spark.createDataFrame([("data", hashlib.sha256(d).hexdigest(), d) for d in data.values()] + [("data", "f" * 64, b"damaged")], "blob_type string, blob_id string, data binary")
    made = ingest.assemble_packs(store.select("blob_type", "blob_id", F.lit(10).cast("long").alias("length"), F.lit(0).alias("uncompressed_length")))
    assert sorted(bytes(r.data) for r in prune.pack_data(made, store).collect()) == [b"b0", b"b1"]


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 100"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
