"""Decontamination by brute force; language, toxicity and quality by held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from itertools import product

import numpy as np
import pytest

from palimpsest.llm import decontaminate, langid, quality, toxicity
from palimpsest.llm._common import bounded_sample
from palimpsest.llm.queries import QUERIES

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_contamination(docs, items, window=10):
    out = []
    for i, t in docs:
        w = words(t)
        hit, names = set(), set()
        for name, text in items:
            v = words(text)
            n = min(window, len(v))
            grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    names.add("" if name is None else str(name))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_contamination_matches_brute_force(spark, docs_of, awkward, block_bytes):
    rng = random.Random(3)
    vocabulary = ["la", "wort", "x", "É", "b1", "c", "d"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 30]))) for k in range(12)] + [(3, "x"), (None, text(10)), (77, None), (78, ""), (79, "!")]
    docs = list(awkward)
    for k in range(60):
        cut = rng.choice(items)[1] or ""
        at = rng.randint(0, 5)
        docs.append((100 + k, f"{text(rng.randint(0, 12)).upper()}. {' '.join(cut.split()[at : at + 20])}, {text(3)}"))
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_of(docs), table, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute_contamination(docs, items)


@pytest.mark.parametrize("pairs", [1 << 20, 7])
def test_repeated_words_match_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(decontaminate, "PAIRS", pairs)
    rng = random.Random(5)
    for _ in range(150):
        vocabulary = ["a", "b", "c"][: rng.randint(1, 3)]
        text = lambda most: " ".join(w for _ in range(rng.randint(0, 6)) for w in [rng.choice(vocabulary)] * rng.randint(1, most))  # noqa: E731, B023
        items = [(str(i), text(rng.choice([2, 30]))) for i in range(3)]
        bench = decontaminate.Benchmark(items, 10, 5)
        doc = text(rng.choice([3, 40])) + " z " + text(20)
        ids = np.array([0, *(bench.vocabulary.get(w, 0) for w in decontaminate.words(doc)), 0], np.int32)
        start, end, item = bench.spans(ids)
        hit = {p - 1 for s, e in zip(start.tolist(), end.tolist(), strict=True) for p in range(s, e)}
        names = {bench.names[i] for i in item.tolist()}
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert brute_contamination([(1, doc)], items) == [(1, len(ids) - 2, len(hit), len(names), digest, bool(hit))]


def test_very_many_repeated_words_are_extended_once():
    n = 30_000
    bench = decontaminate.Benchmark([("1", "la " * n), ("2", "la li " * n)], 10, 5)
    began = time.perf_counter()
    for text in ("la " * n, "la li " * n, "la " * n + "li la " * n):
        ids = np.array([0, *(bench.vocabulary[w.encode()] for w in text.split()), 0], np.int32)
        start, end, _ = bench.spans(ids)
        assert start.min() == 1 and end.max() == len(ids) - 1
    assert time.perf_counter() - began < 20


def test_contamination_of_empty_tables(spark, docs_of, awkward):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs_of(awkward), none).where("contaminated").count() == 0
    assert decontaminate.contamination(docs_of(awkward).where("false"), none).count() == 0


def test_winnowing_keeps_the_rightmost_smallest():
    h = np.array([5, 1, 1, 7, 9, 3, 3, 3], np.uint64)
    assert decontaminate.winnow(h, 3).tolist() == [2, 5, 6, 7]


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(30):
        size = rng.integers(1, 6, 3)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        scores = rng.normal(0, 2, (int(size.sum()), 3)).astype(np.float32)
        got = langid.viterbi(scores, first, size, 1.5)
        value = lambda p, s: sum(s[t, x] for t, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        for f, n in zip(first, size, strict=True):
            best = max(product(range(3), repeat=int(n)), key=lambda p: value(p, scores[f : f + n]))
            assert value(got[f : f + n], scores[f : f + n]) == pytest.approx(value(best, scores[f : f + n]), abs=1e-5)


def test_language_spans(spark, docs_of, awkward):
    model = langid.fit([("the cat and the dog of this house with that", "en"), ("der hund und die katze von diesem haus mit", "de"), ("кот и собака этого дома", "ru")] * 3)
    mixed = "the dog and the cat of this house der hund und die katze von diesem haus кот и собака"
    rows = {r.doc_id: r for r in langid.language_spans(docs_of([*awkward, (60, mixed)]), model).collect()}
    assert [s.lang for s in rows[60].spans] == ["en", "de", "ru"] and rows[60].spans[0].last == 7
    assert rows[1].lang_pred == rows[2].lang_pred == rows[9].lang_pred == "und" and rows[9].score == 0
    assert len(rows) == len({i for i, _ in awkward}) + 1
    nothing = langid.language_spans(docs_of(awkward), langid.fit([])).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and len(nothing) == len(awkward)


def test_blocks_of_a_long_text_join():
    model = langid.fit([("the cat and", "en"), ("der hund und", "de")] * 3)
    text = "the cat and " * 900 + "der hund und " * 900
    (at, labels), = langid.Labeller(model).label([text])
    assert len(at) == 5400 and [s["lang"] for s in langid.spans_of(at, labels, model.langs)] == ["en", "de"]


def test_language_on_held_out_documents(spark):
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = got.where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and len(rows) > 250


def labelled(sf, mod, rest, grade):
    import pyarrow.parquet as pq

    text = {r["doc_id"]: r["text"] for r in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    both = ([], [])
    for r in pq.read_table(f"/root/testdata/{sf}/labels.parquet").to_pylist():
        if r["doc_id"] in text:
            both[zlib.crc32(str(r["doc_id"]).encode()) % mod == rest].append((text[r["doc_id"]], grade(r)))
    return both


def test_toxicity_on_held_out_documents():
    seen, held = labelled("sf0.1", 4, 2, lambda r: r["toxic"])
    scorer = toxicity.fit(seen).scorer()
    p, y = scorer.scores([t for t, _ in held]) >= 0.3, np.array([v for _, v in held])
    assert (p & (y == 1)).sum() >= 0.85 * y.sum() and (p & (y == 0)).sum() <= 0.03 * (y == 0).sum()


def test_misspelt_words_share_vectors():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(" ".join([word() for _ in range(30)] + ["worthless"] * (k % 2) + [word() for _ in range(9)]), k % 2) for k in range(400)]
    s = toxicity.fit(rows, negatives=4000).scorer().scores(["worthlesss " + "abcde fghab " * 4, "abcde fghab " * 5])
    assert s[0] > 0.3 > s[1]


def test_toxicity_of_awkward_rows(spark, docs_of, awkward):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (6, 1), (6, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs_of(awkward), labels)
    rows = toxicity.toxicity(docs_of(awkward), model).collect()
    assert len(rows) == len(awkward) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    empty = docs_of(awkward).where("false")
    assert toxicity.toxicity(empty, toxicity.train(empty, labels)).count() == 0
    assert toxicity.keep_clean(docs_of(awkward), model, threshold=2.0).columns == docs_of(awkward).columns


def test_quality_on_held_out_documents():
    seen, held = labelled("sf0.1", 5, 3, lambda r: 0 if not r["quality"] else 1 if r["toxic"] else 2)
    model = quality.fit(seen, 3)
    assert (np.diff(model.thresholds) > 0).all()
    p, y = model.tails(quality.Scorer(model).latent([t for t, _ in held])), np.array([v for _, v in held])
    assert ((p[:, 0] >= 0.5) == (y > 0)).mean() >= 0.94
    assert (p[:, 0] >= p[:, 1]).all()


def test_quality_of_awkward_rows(spark, docs_of, awkward):
    grades = spark.createDataFrame([(1, 0), (6, 1), (6, 2), (9, 7), (None, 1), (8, None)], "doc_id long, grade int")
    model = quality.train(docs_of(awkward), grades, 3)
    rows = quality.quality(docs_of(awkward), model, tail=2).collect()
    assert len(rows) == len(awkward) and all(0 <= r.tail_prob <= r.expected_grade <= 2 for r in rows)
    empty = docs_of(awkward).where("false")
    assert quality.quality(empty, quality.train(empty, grades, 3), tail=1).count() == 0


def test_toxic_word_in_a_long_unit():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(" ".join([word() for _ in range(30)] + ["worthless"] * (k % 2) + [word() for _ in range(9)]), k % 2) for k in range(400)]
    plain = "".join(word() for _ in range(60))
    toxic = plain[:150] + "worthless" + plain[150:]
    s = toxicity.fit(rows, negatives=4000).scorer().scores([toxic, plain])
    assert s[0] > 0.3 > s[1]
    s = toxicity.fit([(t.replace(" ", ""), y) for t, y in rows], negatives=4000).scorer().scores([toxic, plain])
    assert s[0] > 0.5 > s[1]


@pytest.mark.parametrize("size", [63, 64, 65, 70, 71, 72, 73, 500])
def test_pieces_hold_every_n_gram_once(size):
    rng = random.Random(size)
    word = "q" + "".join(rng.choice("ab-_中") for _ in range(size - 2)) + "z"
    pieces, marked = toxicity.units(f"..{word}!"), f"<{word}>"
    assert (len(pieces) == 1) == (size <= 64)
    got = sorted(g for p in map(toxicity.bare, pieces) for g in toxicity.grams(p, 1 << 30)[1:])
    assert got == sorted(zlib.crc32(marked[i : i + n].encode()) % (1 << 30) for n in (3, 4, 5) for i in range(len(marked) - n + 1))
    assert all(len(toxicity.grams(p, 99)) == toxicity.n_grams(p) for p in map(toxicity.bare, pieces))


def test_quality_reads_long_units_whole():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    rows = [("".join(word() for _ in range(8)) + ("XX##11!!" if k % 2 else "") + "".join(word() for _ in range(8)), 1 - k % 2) for k in range(300)]
    model = quality.fit(rows, 2)
    head = "".join(word() for _ in range(8))
    good, bad = (model.tails(quality.Scorer(model).latent([head + x + word()]))[0, 0] for x in ("", "XX##11!!"))
    assert good > 0.5 > bad
    cut = lambda t: " ".join(t[i : i + 64] for i in range(0, len(t), 64))
    scorer = quality.Scorer(model)
    assert scorer.latent([head + "XX##11!!" * 30]) == scorer.latent([cut(head + "XX##11!!" * 30)])


def test_a_rare_language_is_found():
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(3, 7)))
    text = lambda letters: " ".join(word(letters) for _ in range(40))
    rows = [(text("aeioubcdfgh"), "big") for _ in range(600)] + [(text("aeiouklmnpr"), "rare") for _ in range(4)] + [("кот " * 2 + text("aeioubcdfgh"), "big")]
    model = langid.fit(rows)
    held = [text("aeiouklmnpr") for _ in range(20)] + [text("aeioubcdfgh") for _ in range(20)] + ["кот кот"]
    got = [model.langs[np.bincount(y).argmax()] for _, y in langid.Labeller(model).label(held)]
    assert got == ["rare"] * 20 + ["big"] * 21


def test_blocks_decode_as_the_whole_text():
    model = langid.fit([("the cat and", "en"), ("der hund und", "de")] * 3)
    labeller = langid.Labeller(model)
    rng = random.Random(5)
    units = [f"q{chr(97 + k)}" for k in range(20)]
    labeller.learn(set(units))
    table = np.random.default_rng(5).choice([-1.0, -0.5, 0.0], (labeller.n, 2)).astype(np.float32)
    labeller.table[1 : labeller.n] = (table - table.max(axis=1, keepdims=True))[1:]
    texts = [" ".join(rng.choices(units, k=n)) for n in (langid.BLOCK * 9, 0, 5, langid.BLOCK, langid.BLOCK * 30 + 1, 3)]
    for t, (at, labels) in zip(texts, labeller.label(texts), strict=True):
        own = labeller.table[[labeller[u] for u in t.split()]]
        assert len(at) == len(own) and (not len(at) or (labels == langid.viterbi(own, np.zeros(1, int), np.array([len(own)]), model.penalty)).all())


def test_a_very_long_text_does_not_shrink_the_sample(spark):
    rows = [(k, "x" * 100) for k in range(300)] + [(1000 + k, "y" * 20_000) for k in range(30)]
    got = bounded_sample(spark.createDataFrame(rows, "i long, t string"), "i", "t", 400, 100_000)
    assert sum(r.t[0] == "x" for r in got) == 300 and sum(len(r.t) for r in got) <= 100_000
    assert bounded_sample(spark.createDataFrame([(1, "z" * 100_001)], "i long, t string"), "i", "t", 400, 100_000) == []


def test_a_sample_of_one_repeated_id_ends(spark):
    rows = spark.createDataFrame([(1, f"{k}" + "x" * 900) for k in range(50)] + [(1, "y")] * 3, "i long, t string")
    assert 1 <= len(bounded_sample(rows, "i", "t", 400, 10_000)) <= 14
    same = spark.createDataFrame([(1, "x" * 900)] * 50, "i long, t string")
    assert len(bounded_sample(same, "i", "t", 400, 10_000)) == 11


def brute_language(model, text):
    """Scores word by word and the best path by plain dynamic programming over whole texts."""
    pieces = [u[i : i + 64] for u in (text or "").split() for i in range(0, len(u), 64)]
    at, scores = [], []
    for i, u in enumerate(pieces):
        if w := langid.letters(u):
            row = np.zeros(len(model.langs))
            for k in range(len(w)):
                row += model.gram_scores[model.grams.get(f"<{w}>"[k : k + 3], 0)]
            row = row * min(len(w), 6) / len(w) + model.word_scores[model.words.get(w, 0)]
            allowed = model.scripts.get(langid.script(w))
            if allowed is not None:
                row[~allowed] = -np.inf
            scores.append(np.maximum(row - row.max(), -8))
            at.append(i)
    if not at:
        return "und", 0.0, []
    best, back = scores[0].copy(), []
    for row in scores[1:]:
        top = best.argmax()
        stay = best >= best[top] - model.penalty
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - model.penalty) + row
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    n = np.bincount(path, minlength=len(model.langs))
    spans = []
    for i, k in zip(at, path, strict=True):
        if spans and spans[-1][2] == model.langs[k]:
            spans[-1] = (spans[-1][0], i, spans[-1][2])
        else:
            spans.append((i, i, model.langs[k]))
    return model.langs[int(n.argmax())], n.max() / n.sum(), spans


@pytest.mark.parametrize("languages", [3, 200])
def test_languages_match_brute_force(spark, docs_of, awkward, languages, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 64)
    rng = random.Random(languages)
    vocabulary = [["".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randint(2, 8))) for _ in range(12)] for _ in range(languages)]
    text = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    model = langid.fit([(text(k, 60) + " " + "слово" * (k == 1), f"l{k:03}") for k in range(languages) for _ in range(2)])
    assert len(model.langs) == languages and np.isfinite(model.gram_scores).all()
    rows = awkward[:6] + awkward[9:] if languages == 3 else []
    rows = rows + [(100 + i, " ".join(text(rng.randrange(languages), rng.randint(1, 90)) for _ in range(rng.randint(1, 4)))) for i in range(20)]
    rows += [(200, text(0, 40).replace(" ", "") + " слово, " + "".join(vocabulary[1])), (201, "слово " * 300)]
    got = {r.doc_id: r for r in langid.language_spans(docs_of(rows), model).collect()}
    for i, t in rows:
        lang, score, spans = brute_language(model, t)
        assert (got[i].lang_pred, [tuple(s) for s in got[i].spans]) == (lang, spans)
        assert got[i].score == pytest.approx(score)


def test_toxicity_scores_match_brute_force(spark, docs_of, awkward):
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=997), -0.3, 8, 1.7, 0.2)
    words = ["you", "fool!!", "...", "Ärger", "x" * 70, "joined_" * 20, "中文" * 50]
    rows = awkward + [(100 + i, " ".join(rng.choice(words, rng.integers(1, 40)))) for i in range(30)]
    got = toxicity.toxicity(docs_of(rows), model).collect()
    want = []
    for i, t in rows:
        parts = []
        for u in toxicity.units(t):
            w = toxicity.bare(u)
            g = toxicity.grams(w, 997) if w else []
            parts.append((sum(model.logits[g]), len(g)))
        windows = [parts[k : k + 8] for k in range(max(1, len(parts) - 7))] if parts else [[]]
        z = model.bias + max(sum(p[0] for p in w) / max(1, sum(p[1] for p in w)) for w in windows)
        want.append((i, 1 / (1 + np.exp(-(z * 1.7 + 0.2)))))
    assert len(got) == len(rows)
    for a, b in zip(sorted(got, key=lambda r: (str(r.doc_id), r.score)), sorted(want, key=lambda r: (str(r[0]), r[1])), strict=True):
        assert a.doc_id == b[0] and a.score == pytest.approx(b[1], abs=1e-9) and a.predicted == (a.score >= 0.3)


def test_quality_matches_brute_force(spark, docs_of, awkward):
    rng = np.random.default_rng(6)
    model = quality.Model(rng.normal(size=499), np.array([-0.5, 0.1, 0.9]))
    rows = awkward + [(100 + i, " ".join(rng.choice(["Good", "text.", "x" * 150, "É9", "!!"], rng.integers(1, 20)))) for i in range(20)]
    got = quality.quality(docs_of(rows), model, tail=2).collect()
    want = []
    for i, t in rows:
        pieces = [u[k : k + 64] for u in (t or "").split() for k in range(0, len(u), 64)]
        z = sum(model.weights[f] for u in pieces for f in quality.features(u, 499)) / max(1, len(pieces))
        p = [1 / (1 + np.exp(-(z - k))) for k in model.thresholds]
        want.append((i, sum(p), p[1]))
    for a, b in zip(sorted(got, key=lambda r: (str(r.doc_id), r.tail_prob)), sorted(want, key=lambda r: (str(r[0]), r[2])), strict=True):
        assert a.doc_id == b[0] and (a.expected_grade, a.tail_prob) == pytest.approx(b[1:], abs=1e-9) and a.selected == (a.tail_prob >= 0.5)


def test_quality_gradients_lower_the_loss():
    rng = random.Random(7)
    rows = [(" ".join(rng.choice(["bad", "poor", "so"] if y == 0 else ["fine", "so", "ok"] if y == 1 else ["great", "fine", "best"]) for _ in range(12)), y) for y in [0, 1, 2] * 60]
    loss = lambda m: -np.mean([np.log(max(1e-12, (1 if y == 0 else p[y - 1]) - (0 if y == 2 else p[y]))) for (_, y), p in zip(rows, m.tails(quality.Scorer(m).latent([t for t, _ in rows])), strict=True)])
    first, later = quality.fit(rows, 3, epochs=1), quality.fit(rows, 3, epochs=30)
    assert loss(later) < 0.5 * loss(first) and (np.diff(later.thresholds) > 0).all()


def test_toxicity_scores_do_not_depend_on_the_split(monkeypatch):
    rng = np.random.default_rng(5)
    scorer = toxicity.Model(rng.normal(size=997), 0.1, 8, 1.3, -0.4).scorer()
    texts = [None, "", " ".join("abcdefgh"[: 1 + i % 8] for i in range(500)), "x" * 300, "one two", None, "three " * 40]
    whole = scorer.scores(texts)
    for size in (1, 7, 300, 100_000):
        monkeypatch.setattr(toxicity, "SPLIT", size)
        assert np.allclose(toxicity.Scorer(scorer.model).scores(texts), whole)
    assert len(scorer.scores([])) == 0
