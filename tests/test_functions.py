"""Patterns, durations and scalar functions."""

from __future__ import annotations

import datetime as dt
import random
import re
from fnmatch import fnmatchcase

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import glob, scalar
from palimpsest.functions.durations import Duration, before
from palimpsest.model import RepositoryError

# pattern, path, matches, may match below
CASES = [
    ("", "/any/where", True, True),
    ("*.py", "/src/run.py", True, True),
    ("*.py", "/src", False, True),
    ("src", "/home/src/deep/run.c", True, True),
    ("src", "/home/source", False, True),
    ("src/*.c", "/home/src/run.c", True, True),
    ("src/*.c", "/home/src/deep/run.c", False, True),
    ("src/**/*.c", "/home/src/a/b/run.c", True, True),
    ("src/**/*.c", "/home/src/run.c", True, True),
    ("/home", "/home/user/x", True, True),
    ("/home", "/srv/home", False, False),
    ("/home/*/x", "/home", False, True),
    ("/home/*/x", "/home/user/x/y", True, True),
    ("/home/*/x", "/home/user/y", False, False),
    ("/home/**/x", "/home/a/b/c", False, True),
    ("/a//b/../c/", "/a/c/d", True, True),
    ("[a-c]?[^x]", "/q/bzy", True, True),
    ("[a-c]?[^x]", "/q/bzx", False, True),
    (r"a\*b", "/a*b", True, True),
    ("HOME", "/home", False, True),
]


@pytest.mark.parametrize(("pattern", "path", "match", "below"), CASES)
def test_patterns(pattern, path, match, below):
    assert bool(re.search(glob.regex(pattern), path)) == match
    assert bool(re.search(glob.child_regex(pattern), path)) == below


def test_patterns_in_spark_equal_python(spark):
    df = spark.createDataFrame([(c[1],) for c in CASES], "path string").distinct()
    for pattern in {c[0] for c in CASES}:
        for fold in (False, True):
            got = {r[0]: (r[1], r[2]) for r in df.select("path", glob.matches(F.col("path"), pattern, fold), glob.child_may_match(F.col("path"), pattern, fold)).collect()}
            for path, (a, b) in got.items():
                p = path.lower() if fold else path
                assert (a, b) == (bool(re.search(glob.regex(pattern, fold), p)), bool(re.search(glob.child_regex(pattern, fold), p)))


@given(st.text(alphabet="ab/", min_size=1, max_size=8), st.lists(st.sampled_from(["a", "b", "*", "?", "ab", "[a]"]), min_size=1, max_size=3), st.booleans())
@settings(max_examples=300, deadline=None)
def test_patterns_match_brute_force(path, parts, rooted):
    pieces = [p for p in path.split("/") if p]
    path = "/" + "/".join(pieces)
    starts = [0] if rooted else range(len(pieces))
    want = any(len(pieces) - s >= len(parts) and all(fnmatchcase(x, p) for x, p in zip(pieces[s:], parts, strict=False)) for s in starts)
    assert bool(re.search(glob.regex(("/" if rooted else "") + "/".join(parts)), path)) == want


def test_pattern_lists(spark):
    path = F.col("path")
    df = spark.createDataFrame([("/a/keep/x.c",), ("/a/drop/x.c",), ("/a/drop/y.h",), ("/b",)], "path string")
    rules = ["/a", "!drop", "*.h"]
    assert [r[0] for r in df.where(glob.matches_list(path, rules)).orderBy("path").collect()] == ["/a/drop/y.h", "/a/keep/x.c"]
    assert df.where(glob.matches_list(path, [])).count() == 0
    assert df.where(glob.child_may_match_list(path, ["/a", "!keep"])).count() == 2


def test_bad_patterns_are_all_named():
    with pytest.raises(RepositoryError, match=r"\[a, .*b\\"):
        glob.validate(["ok", "[a", "!x", "b\\"])


def test_patterns_of_a_file():
    assert glob.patterns_of("# no\n\n  a/$X/b \n$$c\n${X}d", {"X": "1"}) == ["a/1/b", "$c", "1d"]


@pytest.mark.parametrize(("text", "want"), [("2y5m7d3h", Duration(3, 7, 5, 2)), ("5d3h2d", Duration(3, 2)), ("-4h", Duration(-4)), ("", Duration())])
def test_durations(text, want):
    assert Duration.parse(text) == want and Duration.parse(str(want)) == want


@pytest.mark.parametrize("text", ["3w", "3", "d", "2d x"])
def test_bad_durations(text):
    with pytest.raises(RepositoryError):
        Duration.parse(text)


def test_going_back_runs_on_over_short_months(spark):
    df = spark.createDataFrame([(dt.datetime(2023, 3, 31, 10, 20, 30, 100000),), (dt.datetime(2024, 2, 29, 1),)], "t timestamp")
    assert [r[0] for r in df.select(before(F.col("t"), Duration(months=1))).collect()] == [dt.datetime(2023, 3, 3, 10, 20, 30, 100000), dt.datetime(2024, 1, 29, 1)]
    assert [r[0] for r in df.select(before(F.col("t"), Duration(hours=25, days=1, years=1))).collect()] == [dt.datetime(2022, 3, 29, 9, 20, 30, 100000), dt.datetime(2023, 2, 27, 0)]


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_bytes_round_exactly(spark):
    rng = random.Random(5)
    ns = [rng.getrandbits(rng.randrange(1, 63)) for _ in range(500)] + [125 * k << 6 for k in range(1, 200)] + [(1 << 20) - 1, (1 << 30) - 1, 19299647**2, 190315000**2, (1 << 63) - 1]
    df = spark.createDataFrame([(n,) for n in ns], "n bigint")
    for units in (["KiB", "MiB"], ["KiB", "MiB", "GiB", "TiB"]):
        fits = [max((k for k in range(len(units) + 1) if n >= 1 << 10 * k), default=0) for n in ns]
        want = [f"{float(n) / (1 << 10 * k):.3f} {units[k - 1]}" if k else f"{n} B" for n, k in zip(ns, fits, strict=True)]
        assert [r[0] for r in df.select(scalar.format_bytes(F.col("n"), units[-1])).collect()] == want


def test_scalars(spark):
    L = F.lit
    assert [one(spark, scalar.format_bytes(L(n))) for n in (0, 1023, 1024, 1 << 20, 5 << 40)] == ["0 B", "1023 B", "1.000 KiB", "1.000 MiB", "5.000 TiB"]
    assert [scalar.parse_bytes(t) for t in ("7", "2k", "3M", "1t")] == [7, 2048, 3 << 20, 1 << 40]
    for bad in ("", "1.5k", "k", "9999999999t"):
        with pytest.raises(RepositoryError):
            scalar.parse_bytes(bad)
    assert [one(spark, scalar.format_percent(L(a), L(b))) for a, b in ((1, 3), (5, 4), (1, 0))] == ["33.33%", "100.00%", ""]
    assert [one(spark, scalar.format_seconds(L(n))) for n in (5, 65, 3725)] == ["0:05", "1:05", "1:02:05"]
    assert one(spark, scalar.permissions(L(0o754), L("dir"))) == "drwxr-xr--"
    assert [one(spark, scalar.extension(L(p))) for p in ("/a/b.tar.gz", "/a.d/b", "/x/.rc")] == [".gz", "", ".rc"]
    assert one(spark, scalar.zero_prefix(L(b"\0\0a\0"))) == 2 and one(spark, scalar.zero_prefix(L(b"\0\0"))) == 2
    assert [one(spark, scalar.tag_file_name(L(t))) for t in ("a/b", "..", "x")] == ["a_b", "_..", "x"]
    assert [one(spark, scalar.plain_length(L(a), L(b))) for a, b in ((100, 0), (100, 150))] == [68, 150]
    assert [one(spark, scalar.within_directory(L(p), "/a")) for p in ("/a", "/a/b", "/ab")] == [True, True, False]
    assert [one(spark, scalar.parent_path(L(p))) for p in ("/a", "/a/b")] == ["/", "/a"]
