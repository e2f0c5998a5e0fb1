"""Preference formatting and the pipeline."""

from __future__ import annotations

import importlib

import pytest

from palimpsest.llm.preference import Template, preference_pairs
from palimpsest.llm.queries import QUERIES


def brute_pair(chosen, rejected, t=Template()):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def shown(turns):
        text, spans = "", []
        for role, x in turns:
            s = len(text) + len(t.head + role + t.neck)
            text += t.head + role + t.neck + x + t.tail
            spans += [(s, len(text))] if role == t.learnt else []
        return text, spans

    (c, cl), (r, rl) = shown(chosen[n:]), shown(rejected[n:])
    return n, len(chosen) - n, len(rejected) - n, shown(chosen[:n])[0], c, r, cl, rl


def test_preference_pairs_match_brute_force(spark):
    talks = {
        1: [("system", "s"), ("user", "hé"), ("assistant", "yes")],
        2: [("system", "s"), ("user", "hé"), ("assistant", "no"), ("user", "why")],
        3: [("user", "hé")],
        4: [("unknown", ""), ("assistant", "")],
        5: [],
    }
    rows = [(c, k * 3, r if r != "unknown" else None, x or None, "z") for c, own in talks.items() for k, (r, x) in enumerate(own)]
    turns = spark.createDataFrame([*rows, (None, 0, "user", "lost", "z")], "conv_id long, turn long, role string, text string, turns string")
    pairs = [(10, 1, 2), (11, 2, 1), (12, 1, 1), (13, 3, 4), (14, 3, 5), (15, None, 1), (16, 99, None), (10, 1, 2)]
    got = preference_pairs(turns, spark.createDataFrame(pairs, "pair_id long, chosen_id long, rejected_id long")).collect()
    want = sorted((p, *brute_pair(talks.get(a, []), talks.get(b, []))) for p, a, b in pairs)
    flat = sorted((*r[:7], [tuple(s) for s in r.chosen_loss], [tuple(s) for s in r.rejected_loss]) for r in got)
    assert flat == want
    for r in got:
        for text, loss in ((r.chosen, r.chosen_loss), (r.rejected, r.rejected_loss)):
            assert all(text[s.s : s.e].endswith("<|end|>\n") for s in loss)


def test_preference_of_empty_tables(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([], "pair_id long, chosen_id long, rejected_id long")
    assert preference_pairs(turns, pairs).count() == 0


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages_take_effect(spark, pipeline, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, ids = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = set(ids)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        path = str(tmp_path / f"{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= kept
        if name == "exact_dedup":
            assert now == {max(i for i in kept if ids[i] == ids[j]) for j in kept}
        if name == "packing":
            assert now == kept
        else:
            assert docs.columns == names
        kept = now
    assert 0 < len(kept) < len(ids)


def test_run_gives_the_last_stage(spark, pipeline, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    assert rows and {"doc_id", "start", "sequence_id"} <= set(rows[0].asDict())


def test_stages_on_awkward_rows(spark, pipeline, sf_dir, docs_of, awkward):
    for rows in (awkward, []):
        docs = docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf_dir).checkpoint()
        assert (docs.count() > 0) == bool(rows)


def test_all_ten_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{n}" for n in range(1, 11)]
