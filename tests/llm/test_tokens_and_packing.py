"""Token counts and packing against the library and by round trip."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from palimpsest.llm import bpe
from palimpsest.llm.packing import Limits, pack_documents, pack_examples
from palimpsest.llm.queries import tokenizer_path
from palimpsest.llm.token_counts import token_counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def texts(spark, sf_dir, awkward):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    return [(i + 1000, t) for i, t in rows] + awkward + [(50, "don't I'll THE The,the; O'Ré'lly's a b\x1cc é é İstanbul ΣΑΣ 12three 1/2½ <|startoftext|>")]


def test_counts_and_ids_are_the_librarys(spark, sf_dir, docs_of, awkward, library):
    rows = texts(spark, sf_dir, awkward)
    units = bpe.Units(tokenizer_path())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(units.ids(t), "<u4").tolist() == ids
        want.append((i, len((t or "").encode()), len(ids), len(ids) > 2048))
    for table in ({}, {"sample_rows": 3, "table_size": 10}):
        got = token_counts(docs_of(rows), tokenizer_path(), **table).collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(docs_of(rows).where("false"), tokenizer_path()).count() == 0


def test_a_full_cache_starts_anew(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT", 3)
    units = bpe.Units(tokenizer_path())
    text = "one two, Three four five. six " * 3
    assert np.frombuffer(units.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(units) <= 4


def test_units_of_plain_characters_are_the_librarys(library):
    units = bpe.Units(tokenizer_path())
    rng = random.Random(4)
    plain = [c for c in map(chr, range(0x20C0)) if bpe.ODD.search(c) is None]
    for _ in range(3000):
        text = "".join(rng.choice(plain) if rng.random() < 0.4 else rng.choice("abC'sStTdDlLrReEvVmM 01 \n-.,!") for _ in range(rng.randint(1, 30)))
        assert np.frombuffer(units.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_tokenizer_with_other_rules_encodes_whole_texts(library, tmp_path):
    from tokenizers import Tokenizer, pre_tokenizers

    other = Tokenizer.from_str(library.to_str())
    other.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    path = str(tmp_path / "other.json")
    other.save(path)
    units = bpe.Units(path)
    for text in ("one,two three's", "x\ty z9z"):
        assert not units.plain(text) and np.frombuffer(units.ids(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("limits", [Limits(), Limits(64, 3, 64)])
def test_packed_documents_give_the_texts_again(spark, sf_dir, docs_of, awkward, library, limits):
    rows = [(k, t) for k, (_, t) in enumerate(texts(spark, sf_dir, awkward))]
    got = pack_documents(docs_of(rows), tokenizer_path(), limits).collect()
    ids = {k: library.encode(t or "", add_special_tokens=False).ids + [1] for k, t in rows}
    by_doc, by_seq = {}, {}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for k, parts in by_doc.items():
        assert gapless(parts) == len(ids[k])
    sizes = [gapless(parts) for parts in by_seq.values()]
    assert max(sizes) <= limits.tokens and max(map(len, by_seq.values())) <= limits.segments
    padding = sum(limits.tokens - n for n in sizes if n & (n - 1))
    assert padding <= 0.1 * sum(sizes)


@pytest.mark.parametrize("words", [20, 4])
def test_short_texts_need_little_padding(spark, docs_of, words):
    rng = random.Random(words)
    rows = [(k, " ".join(rng.choices(["a", "of", "the", "word"], k=rng.randint(0, words)))) for k in range(20_000)]
    got = pack_documents(docs_of(rows).repartition(2), tokenizer_path()).groupBy("sequence_id").agg({"length": "sum", "*": "count"}).collect()
    sizes = [r["sum(length)"] for r in got]
    assert max(sizes) <= 2048 and max(r["count(1)"] for r in got) <= 64
    assert sum(2048 - n for n in sizes if n & (n - 1)) <= 0.05 * sum(sizes)


def gapless(parts):
    at = 0
    for start, length in sorted(parts):
        assert start == at
        at += length
    return at


def test_examples_keep_all_three_limits(spark):
    rng = random.Random(2)
    rows = [(k, rng.randint(0, 900), rng.randint(1, 5), None) for k in range(3000)] + [(3000, 5000, 1, 1), (3001, 1, 99, 0), (None, None, None, None)]
    rows = [(k, t, s, m if m is not None else (None if t is None else rng.randint(0, t))) for k, t, s, m in rows]
    limits = Limits(2048, 12, 1000)
    got = pack_examples(spark.createDataFrame(rows, "id long, n_tokens long, n_segments long, n_loss long"), limits, buffer=64).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(r[0]) for r in rows)
    size = {r[0]: (r[1] or 0, 1 if r[2] is None else r[2], r[3] or 0) for r in rows}
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r)
    for own in bins.values():
        total = np.sum([size[r.id] for r in own], axis=0)
        if own[0].oversize:
            assert len(own) == 1
        else:
            assert (total <= [2048, 12, 1000]).all()
        at = 0
        for r in sorted(own, key=lambda r: r.slot):
            assert r.offset == at
            at += size[r.id][0]
    assert {r.id for r in got if r.oversize} == {3000, 3001}
    total = np.sum(list(size.values()), axis=0) / [2048, 12, 1000]
    assert len(bins) <= 1.25 * total.max() + 10


def test_small_caches_give_the_same_ids():
    from palimpsest.llm import bpe
    from palimpsest.llm.queries import tokenizer_path

    small = bpe.Units(tokenizer_path())
    small.most, small.parts.most = 5, 3
    for i in range(200):
        text = " ".join(f"word{(i * j) % 37} Ab-{j % 11}x's" for j in range(12))
        assert small.ids(text) == small.whole(text)
        assert len(small) <= 5 and len(small.older) <= 5 and len(small.parts) <= 3
