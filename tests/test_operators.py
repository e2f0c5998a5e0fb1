"""Operators on small repositories with known answers."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.durations import Duration
from palimpsest.model import INDEX_BLOBS, NODES, SNAPSHOTS, RepositoryError, conform, empty
from palimpsest.operators import check, diff, ingest, prune, retention, rewrite, select, stats, tree
from palimpsest.operators.retention import Policy
from palimpsest.sources import readers, writers
from palimpsest.streaming import arrivals


def brute_policy(times, policy):
    """Kept positions, by going through the snapshots newest first with counters."""
    value = {"last": lambda t, i: i, "hourly": lambda t, i: t.strftime("%Y%m%d%H"), "daily": lambda t, i: t.strftime("%Y%m%d"), "weekly": lambda t, i: t.isocalendar()[:2], "monthly": lambda t, i: t.strftime("%Y%m"), "yearly": lambda t, i: t.year}
    rows = sorted(enumerate(times), key=lambda r: (-r[1].timestamp(), r[0]))
    left, seen, kept = {n: getattr(policy, n) for n in value}, {}, {}
    for k, (i, t) in enumerate(rows):
        why = []
        for n, f in value.items():
            if left[n]:
                new = n not in seen or seen[n] != f(t, i)
                if new or k == len(rows) - 1:
                    why.append(("" if new else "oldest ") + f"{n} snapshot")
                    seen[n] = f(t, i)
                    left[n] -= left[n] > 0
        if why:
            kept[i] = (why, tuple(left.values()))
    return kept


@pytest.mark.parametrize("policy", [Policy(last=3), Policy(hourly=5, daily=4), Policy(weekly=6, monthly=-1), Policy(yearly=10), Policy(last=1, hourly=1, daily=2, weekly=2, monthly=3, yearly=-1), Policy(daily=500)])
def test_counted_rules_match_brute_force(spark, policy):
    rng = random.Random(str(policy))
    times = [dt.datetime(2016, 1, 1) - dt.timedelta(hours=rng.choice([0, 1, 2, 30, 200, 5000]) * rng.randint(0, 9)) for _ in range(70)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(times)], "pos long, time timestamp, tags array<string>")
    got = {r.pos: (r.reasons, tuple(r.counters)) for r in retention.apply_policy(df, policy).where("kept").collect()}
    assert got == brute_policy(times, policy)


def snaps(spark, rows):
    return spark.createDataFrame(rows, "id string, pos long, time timestamp, hostname string, paths array<string>, tags array<string>")


DAY = [dt.datetime(2024, 3, d, 12) for d in range(1, 32)]


def test_durations_tags_and_future(spark):
    df = snaps(spark, [(f"s{d}", d, DAY[d], "h", None, ["a"] if d == 3 else ["a", "b"] if d == 4 else []) for d in range(31)])
    kept = lambda p, **k: [r.pos for r in retention.apply_policy(df, p, **k).where("kept").orderBy("pos").collect()]
    assert kept(Policy(within=Duration.parse("2d"))) == [29, 30]
    assert kept(Policy(within=Duration.parse("2d")), now="2024-03-11 00:00:00") == list(range(8, 31))
    assert kept(Policy(within=Duration.parse("1m"))) == list(range(2, 31))  # 31 February is 2 March
    assert kept(Policy(tags=[["a"], ["b", "c"]])) == [3, 4] and kept(Policy(tags=[["a", "b"]])) == [4]
    assert kept(Policy(within_weekly=Duration.parse("8d"))) == [23, 30]
    assert kept(Policy()) == []
    assert str(Policy(daily=7, last=-1, tags=[["a", "b"]], within=Duration(days=1))) == "keep all latest, 7 daily snapshots and all snapshots with tags [[a, b]] and all snapshots within 1d of the newest"
    with pytest.raises(RepositoryError):
        Policy(daily=-2)
    with pytest.raises(RepositoryError):
        Policy(within=Duration(days=-1))


def test_own_zone_decides_the_day(spark):
    rows = [(0, dt.datetime(2024, 1, 2, 1), dt.datetime(2024, 1, 1, 20), None), (1, dt.datetime(2024, 1, 1, 23), dt.datetime(2024, 1, 1, 18), None), (2, dt.datetime(2023, 12, 30), dt.datetime(2023, 12, 30), None)]
    df = spark.createDataFrame(rows, "pos long, time timestamp, local_time timestamp, tags array<string>")
    assert [r.pos for r in retention.apply_policy(df, Policy(daily=2)).where("kept").orderBy("pos").collect()] == [0, 2]
    assert [r.pos for r in retention.apply_policy(df.drop("local_time"), Policy(daily=2)).where("kept").orderBy("pos").collect()] == [0, 1]


def test_forget_guards(spark):
    df = snaps(spark, [("a", 1, DAY[0], "h", ["/x"], None), ("b", 2, DAY[1], "h", ["/y"], ["t"])])
    with pytest.raises(RepositoryError):
        retention.forget(df, Policy())
    with pytest.raises(RepositoryError):
        retention.forget(df, Policy(tags=[["t"]]))
    rows = retention.forget(df, Policy(last=1), by="host").orderBy("id").collect()
    assert [(r.id, r.action) for r in rows] == [("a", "remove"), ("b", "keep")]
    assert retention.forget(df.where("false"), Policy(last=1)).count() == 0


def test_selection(spark):
    df = snaps(spark, [("aa1", 1, DAY[0], "h1", ["/b", "/a"], None), ("ab2", 2, DAY[1], "h2", [], ["x", ""]), ("ab3", 3, DAY[1], "h1", None, ["x", "y"]), ("b4", 4, DAY[2], "h1", ["/a", "/b"], [])])
    ids = lambda d: [r.id for r in d.orderBy("id").collect()]
    assert ids(select.find_snapshots(df)) == ["aa1", "ab2", "ab3", "b4"]
    assert ids(select.find_snapshots(df, tags=[["", "x"]])) == ["aa1", "ab2", "b4"]
    assert ids(select.find_snapshots(df, tags=[["x", ""]])) == ["ab2"]
    assert ids(select.find_snapshots(df, hosts=["h1"], paths=["/a"])) == ["aa1", "b4"]
    assert select.latest(df.where("pos < 4")).first().id == "ab3"
    assert select.resolve_id(df, "aa") == "aa1"
    for bad in ("ab", "zz"):
        with pytest.raises(RepositoryError):
            select.resolve_id(df, bad)
    assert [r.id for r in select.explicit(df, ["b4", "latest", "aa", "b"]).collect()] == ["b4", "aa1"]
    with pytest.raises(RepositoryError):
        select.explicit(df, ["aa1"], hosts=["h1"])
    assert select.split_id("aa:/x/y/") == ("aa", "x/y")
    with pytest.raises(RepositoryError):
        select.split_id("aa:x", several=True)
    with pytest.raises(RepositoryError):
        select.parse_group_by("host,what")
    assert select.parse_group_by("tags,host") == (True, False, True) and select.parse_group_by("") == (False, False, False)
    assert select.group_snapshots(df, "paths").count() == 3  # null and empty differ, order doesn't matter
    assert [r.id for r in select.latest_per_group(df, 1, "host").orderBy("id").collect()] == ["ab2", "b4"]
    assert select.default_hosts(None, "me") == ["me"] and select.default_hosts([""], "me") == [] and select.default_hosts(["x"], "me") == ["x"]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [
        ("R", "docs", "dir", 0, None, "D", 1, 0), ("R", "a.txt", "file", 10, ["b1", "b2"], None, 1, 0), ("R", "link", "symlink", 0, None, None, 1, 0),
        ("D", "deep", "dir", 0, None, "E", 1, 0), ("D", "b.txt", "file", 5, ["b2"], None, 2, 7), ("D", "c.txt", "file", 5, ["b2"], None, 2, 7),
        ("E", "z.bin", "file", 0, [], None, 1, 0), ("X", "lost", "file", 3, ["b9"], None, 1, 0),
    ]
    return spark.createDataFrame([(*r, 0) for r in rows], "tree_id string, name string, type string, size long, content array<string>, subtree string, links long, inode long, device_id long")


@pytest.fixture(scope="module")
def roots(spark):
    return spark.createDataFrame([("s1", "R"), ("s2", "D")], "id string, tree string")


def test_walks(spark, nodes, roots):
    w = tree.walk(roots, nodes)
    paths = sorted((r.snapshot_id, r.path) for r in w.collect())
    assert paths == [("s1", p) for p in ["/a.txt", "/docs", "/docs/b.txt", "/docs/c.txt", "/docs/deep", "/docs/deep/z.bin", "/link"]] + [("s2", p) for p in ["/b.txt", "/c.txt", "/deep", "/deep/z.bin"]]
    pruned = tree.walk(roots, nodes, F.col("name") != "docs")
    assert pruned.where("snapshot_id = 's1'").count() == 3
    assert tree.walk(roots.where("false"), nodes).count() == 0
    assert sorted(r[0] for r in tree.reachable_trees(roots.select(F.col("tree").alias("tree_id")), nodes).collect()) == ["D", "E", "R"]
    used = {tuple(r) for r in tree.used_blobs(roots.select(F.col("tree").alias("tree_id")), nodes).collect()}
    assert used == {("tree", "R"), ("tree", "D"), ("tree", "E"), ("data", "b1"), ("data", "b2")}
    assert tree.resolve_folder("R", "docs/deep", nodes) == "E"
    for bad in ("docs/none", "a.txt"):
        with pytest.raises(RepositoryError):
            tree.resolve_folder("R", bad, nodes)
    assert [r.path for r in tree.hardlinks(w).orderBy("path").collect()] == ["/b.txt", "/docs/b.txt"]
    assert [r.path for r in tree.list_tree(w.where("snapshot_id = 's1'"), ("/docs",)).orderBy("path").collect()] == ["/docs", "/docs/b.txt", "/docs/c.txt", "/docs/deep"]
    assert {r.path for r in tree.find_paths(roots, nodes, ["/docs/*.txt", "!c*"]).collect()} == {"/docs/b.txt"}
    order = [r.path for r in select.sort_entries(w.where("snapshot_id = 's1'").withColumn("mtime", F.lit(None).cast("timestamp"))).collect()]
    assert order == ["/a.txt", "/docs", "/docs/b.txt", "/docs/c.txt", "/docs/deep", "/docs/deep/z.bin", "/link"]
    total = {r.snapshot_id: (r.total_file_count, r.total_size) for r in stats.restore_size(w).collect()}
    assert total == {"s1": (7, 15), "s2": (4, 5)}


def test_diffs(spark, nodes):
    changed = nodes.where("name <> 'b.txt'").withColumn("content", F.when(F.col("name") == "a.txt", F.array(F.lit("b1"))).otherwise(F.col("content")))
    changed = changed.withColumn("size", F.when(F.col("name") == "a.txt", 4).otherwise(F.col("size")).cast("long")).withColumn("type", F.when(F.col("name") == "deep", "file").otherwise(F.col("type")))
    own = lambda d: d.withColumn("subtree", F.when(F.col("subtree") == "D", "D2").otherwise(F.col("subtree"))).withColumn("tree_id", F.when(F.col("tree_id") == "D", "D2").otherwise(F.col("tree_id")))
    changed = own(changed)
    rows = {r.path: r.change for r in diff.diff_trees("R", "R", nodes, changed).collect()}
    assert rows == {"/a.txt": "M", "/docs/b.txt": "-", "/docs/deep": "T"}
    back = {r.path: r.change for r in diff.diff_trees("R", "R", changed, nodes).collect()}
    assert back == {"/a.txt": "M", "/docs/b.txt": "+", "/docs/deep/": "T"}
    assert diff.diff_trees("R", "R", nodes, nodes, metadata=True).count() == 0
    rotten = nodes.withColumn("content", F.when(F.col("name") == "a.txt", F.array(F.lit("b1"))).otherwise(F.col("content")))
    assert [r.change for r in diff.diff_trees("R", "R", nodes, rotten).collect()] == ["M?"]
    touched = own(nodes).withColumn("links", F.lit(9).cast("long"))
    assert {r.change for r in diff.diff_trees("R", "R", nodes, touched, metadata=True).where("type_a = 'file'").collect()} == {"U"}
    assert diff.diff_counts(diff.diff_trees("D", "E", nodes, nodes)).first().asDict() == {"changed_files": 0, "files_added": 1, "dirs_added": 0, "others_added": 0, "files_removed": 3, "dirs_removed": 1, "others_removed": 0}


INDEX = "index_id string, pack_id string, blob_type string, blob_id string, length long, uncompressed_length long"


@pytest.fixture(scope="module")
def index(spark):
    rows = [("i", "p1", "data", "b1", 132, 0), ("i", "p1", "data", "b2", 50, 200), ("i", "p2", "data", "b2", 60, 200), ("i", "p3", "data", "u1", 70, 0), ("i", "t1", "tree", "R", 40, 0), ("i", "t1", "tree", "D", 40, 0), ("i", "t1", "tree", "E", 40, 0), ("i", "t1", "tree", "X", 40, 0)]
    return spark.createDataFrame(rows, INDEX)


def test_checks(spark, nodes, roots, index):
    sizes = {r.pack_id: r.size for r in stats.pack_sizes(index).collect()}
    assert sizes["p1"] == 36 + 132 + 37 + 50 + 41
    packs = spark.createDataFrame([("p1", sizes["p1"]), ("p2", 1), ("zz", 5), ("t1", sizes["t1"])], "pack_id string, size long")
    assert {(r.pack_id, r.finding) for r in check.pack_findings(index, packs).collect()} == {("p2", "truncated"), ("p3", "missing"), ("zz", "orphaned")}
    at = roots.select(F.col("tree").alias("tree_id"))
    assert check.tree_findings(at, nodes, index).count() == 0
    bad = nodes.withColumn("content", F.when(F.col("name") == "a.txt", F.array(F.lit("nope"), F.lit(check.NULL_ID))).when(F.col("name") == "z.bin", F.lit(None)).otherwise(F.col("content")))
    bad = bad.withColumn("subtree", F.when(F.col("name") == "docs", F.lit(check.NULL_ID)).otherwise(F.col("subtree"))).withColumn("type", F.when(F.col("name") == "link", "weird").otherwise(F.col("type")))
    found = {(r.name, r.finding) for r in check.tree_findings(at, bad, index.where("blob_id <> 'E'")).collect()}
    assert found == {("a.txt", "blob not in index"), ("a.txt", "null blob"), ("z.bin", "no content"), ("docs", "null subtree"), ("link", "invalid type"), (None, "tree not in index")}
    assert {r.blob_id for r in check.unused_blobs(index, tree.used_blobs(at, nodes)).collect()} == {"u1", "X"}
    wrong_type = index.withColumn("blob_type", F.when(F.col("blob_id") == "b1", "tree").otherwise(F.col("blob_type")))
    assert {r.finding for r in check.tree_findings(at, nodes, wrong_type).collect()} == {"blob not in index"}
    again = index.union(index.where("pack_id = 'p1'").withColumn("index_id", F.lit("j")))
    assert {(r.pack_id, r.finding) for r in check.index_findings(again).collect()} == {("p1", "several indexes")}
    ids = spark.createDataFrame([(f"{b:02x}",) for b in range(256)], "id string")
    assert sum(ids.where(check.pack_bucket(F.col("id"), n, 5)).count() for n in range(1, 6)) == 256
    with pytest.raises(RepositoryError):
        check.pack_bucket(F.col("id"), 6, 5)
    assert check.random_packs(packs, share=0.0).count() == 1 and check.random_packs(packs, share=0.5).count() == 2
    laid = spark.createDataFrame([("p", "a", 0, 10), ("p", "b", 10, 5), ("p", "c", 20, 5)], "pack_id string, blob_id string, offset long, length long")
    assert [tuple(r) for r in check.layout_findings(laid).collect()] == [("p", "c", 5)]
    assert check.summary(index, packs, at, nodes).count() >= 4


def test_prune_plans(spark, nodes, roots, index):
    used = tree.used_blobs(roots.select(F.col("tree").alias("tree_id")), nodes).checkpoint()
    packs = stats.pack_sizes(index)
    state = {(r.pack_id, r.blob_id): r.state for r in prune.classify(index, used).collect()}
    assert state[("p1", "b2")] == "used" and state[("p2", "b2")] == "duplicate" and state[("p3", "u1")] == "unused"
    planned = prune.plan(index, used, packs, prune.Options(max_unused=0)).checkpoint()
    assert {r.pack_id: r.action for r in planned.collect()} == {"p1": "keep", "p2": "remove", "p3": "remove", "t1": "repack"}
    assert {r.blob_id for r in prune.blobs_to_copy(prune.classify(index, used), planned).collect()} == {"R", "D", "E"}
    kept = {r.blob_id for r in index.join(planned.where("action = 'keep'"), "pack_id", "left_semi").collect()} | {"R", "D", "E"}
    assert kept == {r.blob_id for r in used.collect()}
    with pytest.raises(RepositoryError):
        prune.plan(index.where("blob_id <> 'b1'"), used, packs)
    with pytest.raises(RepositoryError):
        prune.plan(index, used, packs.where("pack_id <> 'p1'"))
    extra = packs.union(spark.createDataFrame([("zz", 9)], "pack_id string, size long"))
    assert [tuple(r) for r in prune.steps(prune.plan(index, used, extra, prune.Options(max_unused=None))).orderBy("step", "pack_id").collect()] == [(1, "remove_first", "zz"), (2, "repack", "t1"), (4, "remove", "p2"), (4, "remove", "p3")]
    assert prune.Options(max_unused="20%").unused_limit(100) == 25
    with pytest.raises(RepositoryError):
        prune.Options(max_unused="100%").unused_limit(1)


def test_rewrites(spark, nodes, roots, index):
    w = tree.walk(roots.where("id = 's1'"), nodes)
    left = lambda **k: sorted(r.path for r in rewrite.rewrite_entries(w, **k).collect())
    assert left(exclude=F.col("name") == "docs") == ["/a.txt", "/link"]
    assert left(include=F.col("name") == "b.txt") == ["/docs", "/docs/b.txt"]
    assert left(exclude=F.col("name").isin("z.bin", "link"), drop_empty=True) == ["/a.txt", "/docs", "/docs/b.txt", "/docs/c.txt"]
    with pytest.raises(RepositoryError):
        rewrite.rewrite_entries(w)
    a, b = (rewrite.assemble_trees(x) for x in (w, w.withColumn("size", F.when(F.col("name") == "z.bin", 1).otherwise(F.col("size")).cast("long"))))
    ids = lambda d: {r.path: r.tree_id for r in d.collect()}
    x, y = ids(a), ids(b)
    assert x.keys() == {"/", "/docs", "/docs/deep"} and all(x[p] != y[p] for p in x)
    fixed = {r.name: r for r in rewrite.repair_nodes(nodes.where("tree_id = 'R'"), index.where("blob_id <> 'b1' AND blob_id <> 'D'")).collect()}
    assert fixed["a.txt"].content == ["b2"] and fixed["a.txt"].size == 200 and fixed["docs"].subtree is None and not fixed["link"].repaired
    assert [r.subtree for r in rewrite.recover(index, nodes, roots).collect()] == ["X"]
    tags = snaps(spark, [("a", 1, DAY[0], "h", None, ["x", "y"]), ("b", 2, DAY[0], "h", None, None)])
    assert {r.id: (r.tags, r.changed) for r in rewrite.change_tags(tags, add=["z", "x"], remove=["y"]).collect()} == {"a": (["x", "z"], True), "b": (["z", "x"], True)}
    assert {r.id: (r.tags, r.original) for r in rewrite.change_tags(tags, set_=[""]).collect()} == {"a": ([], "a"), "b": ([], None)}
    assert {r.pack_id: r.action for r in rewrite.repair_index(index, spark.createDataFrame([("p2", 1), ("n", 2)], "pack_id string, size long")).collect()} == {"p1": "drop", "p2": "read", "p3": "drop", "t1": "drop", "n": "read"}


def test_ingest(spark, nodes, roots, index):
    data = bytes(random.Random(1).randbytes(60_000))
    files = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"head" + data)), ("c", bytearray()), ("d", None), ("e", bytearray(b"\0" * 5000))], "path string, data binary")
    rows = ingest.chunk(files, least=256, average_bits=8, most=2048).collect()
    for name, whole in (("a", data), ("b", b"head" + data), ("e", b"\0" * 5000)):
        own = sorted((r.start, r.length, r.pos) for r in rows if r.path == name)
        assert [p for _, _, p in own] == list(range(len(own))) and own[-1][0] + own[-1][1] == len(whole)
        assert all(s + n == t for (s, n, _), (t, _, _) in zip(own, own[1:], strict=False)) and max(n for _, n, _ in own) <= 2048
    ids = lambda n: {r.blob_id for r in rows if r.path == n}
    assert len(ids("a") & ids("b")) > 0.9 * len(ids("a")) > 20 and not ids("c") and not ids("d")
    asks = spark.createDataFrame([("q1", DAY[1], "h"), ("q2", DAY[0] - dt.timedelta(days=1), "h"), ("q3", DAY[5], "other")], "request_id string, time timestamp, hostname string")
    df = snaps(spark, [("a", 1, DAY[0], "h", None, None), ("b", 2, DAY[1], "h", None, None)])
    assert {r.request_id: r.parent for r in ingest.parents(asks, df).collect()} == {"q1": "b", "q2": None, "q3": None}
    w = tree.walk(roots.where("id = 's1'"), nodes)
    assert {r.path for r in ingest.exclude_marked(w, "b.txt").collect()} == {"/a.txt", "/docs", "/docs/b.txt", "/link"}
    blobs = index.select("blob_type", "blob_id", "length", "uncompressed_length").dropDuplicates(["blob_type", "blob_id"])
    packed = ingest.assemble_packs(blobs, pack_size=60, shards=1)
    assert packed.groupBy("pack_id").agg(F.count_distinct("blob_type").alias("n")).where("n > 1").count() == 0 and packed.count() == blobs.count()
    ranges = spark.createDataFrame([("p", 0, 10), ("p", 12, 5), ("p", 100, 5)], "pack_id string, offset long, length long")
    assert sorted(tuple(r) for r in ingest.coalesce_ranges(ranges, gap=5).collect()) == [("p", 0, 17, 2), ("p", 100, 5, 1)]
    parts = {r.pos: (r.start, r.stop) for r in tree.read_range(spark.createDataFrame([("f", i, f"b{i}") for i in range(4)], "file_id string, pos int, blob_id string"), spark.createDataFrame([(f"b{i}", 10) for i in range(4)], "blob_id string, size long"), 5, 20).collect()}
    assert parts == {0: (5, 10), 1: (0, 10), 2: (0, 5)}
    lit = F.lit
    assert [spark.range(1).select(ingest.overwrite(p, lit(True), lit(False), lit(True))).first()[0] for p in ("always", "if-changed", "if-newer", "never")] == [True, True, False, False]


def test_index_files_are_bounded_and_whole(spark):
    rows = [(f"i{p % 2}", f"p{p}", "data", f"b{n}", 10 * n, 10, n % 3) for p in range(200) for n in range(41 if p == 7 else 4)]
    index = spark.createDataFrame(rows, INDEX_BLOBS)
    raw = writers.index_files(index, 10).select("id", F.from_json("data", readers.INDEX_JSON).alias("d")).select("id", "d.packs")
    files = [[(p.id, len(p.blobs)) for p in r.packs] for r in raw.collect()]
    assert max(sum(n for _, n in f) for f in files) == 10 and max(len(f) for f in files) > 1
    assert sum(any(p == "p7" for p, _ in f) for f in files) >= 5
    back = readers.index_rows(raw).drop("index_id")
    assert sorted(back.collect()) == sorted(index.drop("index_id").collect())


def test_readers_and_writers(spark, nodes, tmp_path):
    (tmp_path / "snapshots").mkdir()
    (tmp_path / "snapshots" / ("ab" * 32)).write_text('{"time": "2024-01-02T03:04:05.123456789+02:00", "tree": "R", "hostname": "h", "paths": ["/x"], "odd": 1}')
    s = readers.snapshots(spark, str(tmp_path / "snapshots"))
    row = s.first()
    assert row.id == "ab" * 32 and row.time == dt.datetime(2024, 1, 2, 1, 4, 5, 123456) and row.local_time.hour == 3 and row.tags is None
    assert readers.snapshots(spark, str(tmp_path / "snapshots"), exclude=s.select("id")).count() == 0
    assert spark.range(1).select(readers.nanoseconds(F.lit("2024-01-02T03:04:05.5Z"))).first()[0] == 500_000_000
    docs = writers.canonical_trees(nodes.select("tree_id", "name", "type", "size", "content", "subtree"))
    assert docs.select("blob_id").distinct().count() == 4
    back = readers.tree_nodes(docs).select("tree_id", "name", "size", "content", "subtree")
    assert sorted(map(str, back.collect())) == sorted(map(str, nodes.select(back.columns).collect()))
    (tmp_path / "list").write_text("a\n\n# no\n  b \n")
    assert [r[0] for r in readers.target_list(spark, str(tmp_path / "list")).collect()] == ["a", "b"]
    (tmp_path / "t16").write_bytes("hé".encode("utf-16"))
    assert readers.text_files(spark, str(tmp_path / "t16")).first().text == "hé"
    assert readers.list_files(spark, str(tmp_path / "snapshots")).first().size > 10
    assert conform(nodes, NODES).columns == empty(spark, NODES).columns and empty(spark, SNAPSHOTS).count() == empty(spark, INDEX_BLOBS).count() == 0
    files = spark.createDataFrame([("x", "/d/a", bytearray(b"1")), ("x", "/b", bytearray(b"22")), ("y", "/c", None)], "archive string, path string, data binary")
    for kind in ("tar", "zip"):
        import tarfile
        import zipfile

        first = writers.write_archives(files, str(tmp_path), kind)[0]
        names = tarfile.open(first).getnames() if kind == "tar" else zipfile.ZipFile(first).namelist()
        assert names == ["b", "d/a"]
    assert writers.table_text(files.select("path").orderBy("path")).splitlines()[0] == "path"


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "ck")
    rows = [("data", "b1", DAY[0]), ("data", "b1", DAY[0]), ("data", "b2", DAY[1])]
    spark.createDataFrame(rows, "blob_type string, blob_id string, time timestamp").write.parquet(src)
    s = arrivals.snapshot_stream(spark, src, "blob_type string, blob_id string, time timestamp")
    arrivals.new_blob_stream(s, "30 days").writeStream.format("memory").queryName("fresh").option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.blob_id for r in spark.table("fresh").collect()) == ["b1", "b2"]
