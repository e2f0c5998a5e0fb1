"""Exact dedup, SimHash and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import simhash, suffix_dedup
from palimpsest.llm.components import components
from palimpsest.llm.exact_dedup import chunks, exact_duplicates


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_matches_brute_force(spark, docs_of, awkward, weak):
    rng = random.Random(4)
    pool = ["".join(rng.choice("ab e.\n") for _ in range(rng.randint(0, 3000))) for _ in range(20)]
    rows = awkward + [(100 + k, rng.choice(pool)) for k in range(60)]
    how = {"chunk_hash": lambda c: F.xxhash64(c) % 3} if weak else {}
    got = exact_duplicates(docs_of(rows), **how).collect()
    assert sorted(map(tuple, got), key=str) == brute_exact(rows)


def test_chunks_join_to_the_text(spark, awkward):
    df = spark.createDataFrame([(t,) for _, t in awkward if t], "t string")
    assert df.where(F.array_join(chunks(F.col("t")), "") != F.col("t")).count() == 0
    assert df.select(F.max(F.size(chunks(F.col("t"))))).first()[0] > 20


def test_exact_on_an_empty_table(spark, docs_of):
    assert exact_duplicates(docs_of([]).where("false")).count() == 0


def brute_print(text, k=3):
    words = []
    word = ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    words += [word] if word else []
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aB é\n中.", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_matches_brute_force(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_a_fingerprint_counts_every_block(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=500))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == brute_print(text)


def classes(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return {x: find(x) for x in list(up)}


def same_partition(a, b):
    return len(set(a.values())) == len(set(b.values())) == len({(a[x], b[x]) for x in a}) and a.keys() == b.keys()


@pytest.mark.parametrize("dense", [256, 8, 2])
def test_links_connect_what_is_near(spark, dense):
    rng = random.Random(dense)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints.add(base)
        for _ in range(12):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
            prints.add(base)
    half = rng.getrandbits(32) << 32
    prints |= {half | sum(1 << b for b in rng.sample(range(32), rng.randint(0, 6))) for _ in range(40)}
    prints = [int(np.uint64(x).astype(np.int64)) for x in prints]
    bits = lambda a, b: (int(np.int64(a) ^ np.int64(b)) & (2**64 - 1)).bit_count()
    want = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if bits(a, b) <= 3]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), dense=dense).collect()]
    assert all(bits(a, b) <= 3 for a, b in got)
    assert same_partition(classes(got), classes(want))
    if dense == 256:
        assert {frozenset(p) for p in got} == {frozenset(p) for p in want}


def test_components_of_paths_and_stars(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(50)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.v: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert same_partition(got, classes(p for p in pairs if p[0] != p[1]))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_matches_brute_force(spark, docs_of, awkward):
    rng = random.Random(9)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(120)] for _ in range(6)]
    rows = list(awkward)
    for k in range(50):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "zz"
        rows.append((100 + k, " ".join(words)))
    fp = [brute_print(t) for _, t in rows]
    root = classes([(i, i) for i in range(len(rows))] + [(i, j) for i in range(len(rows)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(d, least.get(root[i], d))
    want = sorted(((d, f"{fp[i]:016x}", least.get(root[i])) for i, (d, _) in enumerate(rows)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(docs_of(rows)).collect()), key=str) == want
    assert simhash.near_duplicates(docs_of(rows).where("false")).count() == 0


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(100):
        body = bytes(rng.choice(b"ab\x00\xffc") for _ in range(rng.randint(60, 200)))
        depth = rng.choice([24, 50])
        text = np.frombuffer(body + b"\x00\xff" + bytes(depth + 8), np.uint8)
        wanted = np.zeros(len(text) - depth, bool)
        wanted[rng.sample(range(len(body) - 5), 20)] = True
        order = suffix_dedup.suffix_order(text, wanted, depth)
        keys = [text[i : i + depth].tobytes() for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist() and keys == sorted(keys)


def brute_repeats(rows, length):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1 if i is not None else 0):
            s = b[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1 if i is not None else 0):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("frequent", [2, 4096])
def test_repeated_bytes_match_brute_force(spark, docs_of, awkward, frequent):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abé \n") for _ in range(rng.randint(10, 150))) for _ in range(8)] + ["-" * 120, "ab" * 70]
    rows = [(i, t if t is None or len(t) < 10_000 else t[88_000:92_000]) for i, t in awkward]
    rows += [(20 + k, "".join(rng.choice(pool) for _ in range(rng.randint(1, 5)))) for k in range(60)]
    out = suffix_dedup.repeated_bytes(docs_of(rows), least_groups=5, frequent=frequent)
    assert sorted(map(tuple, out.drop("spans").collect()), key=str) == brute_repeats(rows, 50)
    assert suffix_dedup.repeated_bytes(docs_of(rows).where("false"), least_groups=5).count() == 0
