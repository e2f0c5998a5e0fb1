"""Pipeline stages against brute force: rows that repeat, null ids, clashing columns, and the whole run."""

from __future__ import annotations

import hashlib
import importlib
import random

import pytest

from palimpsest.llm import _common, decontaminate, exact_dedup, simhash
from palimpsest.llm.simhash import fingerprint
from test_dedup import classes
from test_text_models import brute_contamination

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def one_of_each(rows):
    """The first of the rows with the same id and text: a text before a null, then nulls before others in order."""
    out = {}
    for r in sorted(rows, key=lambda r: (r[1] is None, [(x is not None, str(x)) for x in r[2:]])):
        out.setdefault((r[0], sha(r[1])), r)
    return out


def brute_exact(rows):
    groups = {}
    for key, r in one_of_each(rows).items():
        best = groups.get(key[1])
        if best is None or (r[0] is not None, r[0] or 0) > (best[0] is not None, best[0] or 0):
            groups[key[1]] = r
    return list(groups.values())


def brute_near(rows):
    firsts = list(one_of_each(rows).values())
    fp = [fingerprint(r[1]) for r in firsts]
    root = classes([(i, i) for i in range(len(firsts))] + [(i, j) for i in range(len(firsts)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    best = {}
    for i, r in enumerate(firsts):
        key = (r[0] is None, r[0] or 0, sha(r[1]))
        if root[i] not in best or key < best[root[i]][0]:
            best[root[i]] = (key, r)
    return [r for _, r in best.values()]


def brute_clean(rows, items):
    return [r for r in rows if not brute_contamination([(1, r[1])], items)[0][5]]


def table(awkward):
    rng = random.Random(6)
    rows = [(i, t, None, rng.choice([None, "a", "b"]), len(t or "")) for i, t in awkward * 2]
    base = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(100)) for _ in range(4)]
    for k in range(80):
        words = rng.choice(base).split()
        if rng.random() < 0.5:
            words[rng.randrange(100)] = "zz"
        rows.append((rng.choice([None, k % 9, k]), " ".join(words), rng.choice(["x", "y"]), None, rng.choice([1, 2, None])))
    return rows + rows[-20:]


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_match_brute_force(spark, awkward):
    rows = table(awkward)
    items = [(1, " ".join(rows[30][1].split()[5:25])), (2, "wort")]
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert found(exact_dedup.keep_one(docs)) == sorted(brute_exact(rows), key=str)
    assert found(simhash.keep_first(docs)) == sorted(brute_near(rows), key=str)
    for size in (8 << 20, 40):
        assert found(decontaminate.keep_clean(docs, bench, block_bytes=size)) == sorted(brute_clean(rows, items), key=str)
    for stage in (exact_dedup.keep_one, simhash.keep_first, lambda d: decontaminate.keep_clean(d, bench)):
        assert stage(docs.where("false")).count() == 0


def test_stages_bear_clashing_columns(docs_of, awkward):
    docs = docs_of(awkward).selectExpr("*", "1 AS keep", "2 AS text_sha256", "3 AS nr", "4 AS kept_id", "5 AS salt", "map(1, 2) AS m")
    for stage in (exact_dedup.keep_one, simhash.keep_first):
        out = stage(docs)
        assert out.columns == docs.columns
        assert 0 < out.count() < docs.count()


def test_run_is_its_stages_one_after_another(spark, tmp_path, awkward):
    pipeline = importlib.import_module("corpus_pipeline")
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet").where("doc_id < 150")
    folder = str(tmp_path)
    spark.createDataFrame(table(awkward), SCHEMA).union(docs.select("doc_id", "text", "lang", "source", "n_chars")).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = found(pipeline.nontoxic(spark, docs, folder))
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    rows = brute_clean(brute_near(brute_exact(rows)), items)
    got = pipeline.run(spark, folder).groupBy("doc_id").sum("length").collect()
    want = {}
    for r in pipeline.pack(spark, spark.createDataFrame(rows, SCHEMA), folder).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.length
    assert {r[0]: r[1] for r in got} == want


@pytest.mark.parametrize("hot", [1, 90])
def test_hot_keys_are_dealt_out(spark, tmp_path, hot):
    rows = spark.range(1000).selectExpr("id", f"CASE WHEN id % 100 < {hot} THEN -1 ELSE id END AS key")
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    groups = rows.groupBy("key").count().withColumnRenamed("count", "size")
    got = _common.with_groups(rows, groups, "key", "size", parts=8)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rows.join(groups, "key").collect()}
    assert got.count() == 1000


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            set = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        _common.prepare(Session())
