"""Language identification of mixed-language text.

The script of a word (Unicode ranges) narrows the candidate languages to those seen in
that script. Each candidate scores the word: known words by their frequency in the
language, all words by their character trigrams. Viterbi over the words of a text, with a
penalty for each change of language, labels spans; the text's language is the one that
most of its words are labelled with.

Texts of a batch are decoded in step, those of more than ``BLOCK`` words in blocks: each
block gives the best score from every language before it to every one at its end, these
make the scores that each block starts from, and labels are followed back from every language at
a block's end, to be joined from the last block on. The path is that of the whole text, and
a very long text costs no more steps than one block.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm._common import bounded_sample, prepare

UNDETERMINED = "und"
BLOCK = 2048
#: Most words a worker keeps scores of, and characters of a unit that is taken whole; longer ones count as several.
KEPT, LONGEST = 1 << 20, 64
#: First code points of script ranges (fixed values) and their names; others are "other".
SCRIPTS = [
    (0x0041, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "other"),
    (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
]
_FROM = np.array([a for a, _ in SCRIPTS])
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def script(word: str) -> str:
    """Script of the first letter of a word."""
    at = int(np.searchsorted(_FROM, ord(word[0]), "right")) - 1
    return SCRIPTS[at][1] if at >= 0 else "other"


def split(text: str | None) -> list[str]:
    """White-space separated units of a whole text; longer ones are cut to pieces."""
    units = (text or "").split()
    if not units or max(map(len, units)) <= LONGEST:
        return units
    return [u[i : i + LONGEST] for u in units for i in range(0, len(u), LONGEST)]


def letters(unit: str) -> str:
    """The letters of a white-space separated unit in lower case, parts joined by a hyphen; empty without letters."""
    bare = unit.strip(".,;:!?()\"")
    if bare.isalpha():
        return bare.lower()
    return "-".join(LETTERS.findall(unit.lower()))


def trigrams(word: str) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + 3] for i in range(len(marked) - 2)]


@dataclass
class Model:
    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    word_scores: np.ndarray | None = None
    grams: dict[str, int] = field(default_factory=dict)
    gram_scores: np.ndarray | None = None
    scripts: dict[str, np.ndarray] = field(default_factory=dict)
    penalty: float = 4.0

    def score(self, words: list[str]) -> np.ndarray:
        """Log scores of words in each language, the best 0; the floor bounds what one word can say."""
        get = self.grams.get
        n = np.array([len(w) for w in words])  # as many trigrams as letters
        flat = np.fromiter((get(t, 0) for w in words for t in trigrams(w)), np.int64, int(n.sum()))
        s = np.add.reduceat(self.gram_scores[flat], np.concatenate(([0], np.cumsum(n)[:-1])))
        s *= (np.minimum(n, 6) / n)[:, None]
        s += self.word_scores[[self.words.get(w, 0) for w in words]]
        free = np.ones(len(self.langs), bool)
        s[~np.array([self.scripts.get(script(w), free) for w in words])] = -np.inf
        return np.maximum(s - s.max(axis=1, keepdims=True), -8.0)


def fit(rows: list[tuple[str, str]], penalty: float = 4.0, least: int = 2, most_words: int = 50_000) -> Model:
    """Learn from (text, lang) rows; ``most_words`` bounds the known words and trigrams kept."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], penalty=penalty)
    index = {lang: i for i, lang in enumerate(langs)}
    words: list[Counter] = [Counter() for _ in langs]
    for text, lang in rows:
        words[index[lang]].update(w for w in map(letters, split(text)) if w)
    model = Model(langs, penalty=penalty)
    grams: list[Counter] = [Counter() for _ in langs]
    seen: dict[str, np.ndarray] = {}
    for i, c in enumerate(words):
        for w, n in c.items():
            for t in trigrams(w):
                grams[i][t] += n
            seen.setdefault(script(w), np.zeros(len(langs), np.int64))[i] += n
    # a language belongs to a script that at least a hundredth of its own words are in, however few they are among
    # the script's words; a script that is so rare in all its languages belongs to all of them
    total = np.array([sum(c.values()) for c in words])
    for s, n in seen.items():
        own = (n > 0) & (n * 100 >= total)
        model.scripts[s] = own if own.any() else n > 0

    def tables(counts: list[Counter]) -> tuple[dict[str, int], np.ndarray]:
        """Numbers from 1 of what is kept, and smoothed log shares; row 0 is what isn't kept."""
        total = np.array([sum(c.values()) for c in counts], float)
        both: Counter = Counter()
        for c in counts:
            both.update(c)
        top = [w for w, n in both.most_common(most_words) if n >= least]
        found = np.array([[0] * len(langs)] + [[c[w] for c in counts] for w in top], float)
        return {w: i + 1 for i, w in enumerate(top)}, np.log((found + 0.5) / (total + 0.5 * (len(top) + 1)))

    model.grams, model.gram_scores = tables(grams)
    model.words, known = tables(words)
    known -= known.max(axis=1, keepdims=True)
    known[0] = 0
    model.word_scores = known.clip(-4, 0)
    return model


def viterbi(scores: np.ndarray, first: np.ndarray, size: np.ndarray, penalty: float, start: np.ndarray | None = None, every_end: bool = False) -> np.ndarray:
    """Best labels of sequences of rows of ``scores`` (each first..first+size), decoded in step.

    ``start`` has the scores before each sequence. With ``every_end`` there is a column of labels for each label that
    the last row may have.
    """
    k = scores.shape[1]
    kind = np.int8 if k <= 128 else np.int32
    out = np.zeros((len(scores), k if every_end else 1), kind)
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = [int(n) for n in np.searchsorted(-size, -np.arange(longest), "left")]  # sequences longer than t
    v = np.zeros((len(size), k)) if start is None else start[order]
    own = np.arange(k, dtype=kind)
    back = []
    for t in range(longest):
        n = active[t]
        u = v[:n]
        best = u.argmax(axis=1)
        jump = u[np.arange(n), best] - penalty
        stay = u >= jump[:, None]
        back.append(np.where(stay, own, best.astype(kind)[:, None]))
        u = np.where(stay, u, jump[:, None]) + scores[first[:n] + t]
        v[:n] = u - u.max(axis=1, keepdims=True)
    state = np.tile(own, (len(size), 1)) if every_end else v.argmax(axis=1).astype(kind)[:, None]
    for t in range(longest - 1, -1, -1):
        n = active[t]
        out[first[:n] + t] = state[:n]
        state[:n] = back[t][np.arange(n)[:, None], state[:n]]
    return out if every_end else out[:, 0]


def passages(scores: np.ndarray, first: np.ndarray, size: int, penalty: float) -> np.ndarray:
    """[sequence, a, b]: best scores of ``size`` rows from first on, from label a before them to label b at their end."""
    k = scores.shape[1]
    u = np.where(np.eye(k, dtype=bool), 0.0, -np.inf) + np.zeros((len(first), 1, 1))
    for t in range(size):
        u = np.maximum(u, u.max(axis=2, keepdims=True) - penalty) + scores[first + t][:, None]
        u -= u.max(axis=(1, 2), keepdims=True)
    return u


def decode(scores: np.ndarray, size: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of sequences that follow one another in ``scores``, the long ones in blocks, as if decoded whole."""
    n = np.maximum(-(-size // BLOCK), 1)  # blocks of each sequence
    last = np.cumsum(n) - 1
    seq = np.repeat(np.arange(len(size)), n)
    nr = np.arange(len(seq)) - (last - n + 1)[seq]
    first = (np.cumsum(size) - size)[seq] + nr * BLOCK
    length = np.minimum(size[seq] - nr * BLOCK, BLOCK)
    start = np.zeros((len(seq), scores.shape[1]))
    inner = np.ones(len(seq), bool)
    inner[last] = False
    inner = np.flatnonzero(inner)
    for b, way in zip(inner.tolist(), passages(scores, first[inner], BLOCK, penalty) if len(inner) else (), strict=True):
        v = (start[b][:, None] + way).max(axis=0)
        start[b + 1] = v - v.max()
    out = viterbi(scores, first[last], length[last], penalty, start[last])
    if len(inner):
        ends = viterbi(scores, first[inner], length[inner], penalty, start[inner], every_end=True)
        for b in inner[::-1].tolist():
            v, label = start[b + 1], out[first[b + 1]]
            end = label if v[label] >= v.max() - penalty else v.argmax()
            out[first[b] : first[b + 1]] = ends[first[b] : first[b + 1], end]
    return out


class Labeller(dict):
    """unit -> row of ``table`` with its scores (0: no letters)."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.table = np.zeros((1024, max(1, len(model.langs))), np.float32)
        self.n = 1

    def learn(self, units: set[str]) -> None:
        """Rows for units that are not known yet."""
        if self.n + len(units) > KEPT:
            self.clear()
            self.n = 1
        word = {u: letters(u) for u in units if u not in self}
        self.update(dict.fromkeys((u for u, w in word.items() if not w), 0))
        new = [(u, w) for u, w in word.items() if w]
        if not new:
            return
        while self.n + len(new) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[self.n : self.n + len(new)] = self.model.score([w for _, w in new])
        self.update((u, self.n + i) for i, (u, _) in enumerate(new))
        self.n += len(new)

    def label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(numbers of the units that have letters, their labels) of each whole text."""
        units = [split(t) for t in texts]
        self.learn(set().union(*units))
        rows = [np.fromiter(map(self.__getitem__, u), np.int64, len(u)) for u in units]
        at = [np.flatnonzero(r) for r in rows]
        size = np.array([len(a) for a in at], np.int64)
        labels = decode(self.table[np.concatenate([r[a] for r, a in zip(rows, at, strict=True)])], size, self.model.penalty) if size.sum() else np.empty(0, np.int8)
        out = np.split(labels, np.cumsum(size)[:-1])
        return list(zip(at, out, strict=True))


def spans_of(at: np.ndarray, labels: np.ndarray, langs: list[str]) -> list[dict]:
    """Maximal runs of one language: first and last unit (counted from 0) and language."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(labels)) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(at)]))
    return [{"first": int(at[a]), "last": int(at[b - 1]), "lang": langs[labels[a]]} for a, b in zip(begin, end, strict=True)]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 4000, most_bytes: int = 16 << 20, **options: float) -> Model:
    """Fit on a bounded sample of rows with text and language: ``most_rows``, about ``most_bytes`` of text."""
    rows = docs.select(id_col, text_col, lang_col).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return fit([(r[text_col], r[lang_col]) for r in bounded_sample(rows, id_col, text_col, most_rows, most_bytes)], **options)


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, spans array<struct<first,last,lang>>.

    Units are separated by white space; those of more than ``LONGEST`` characters (text without white space) count as consecutive
    pieces, in training and here, and spans count units and pieces.

    ``score`` is the share of the text's words (units with letters) in the predicted
    language; ties go to the first name. Null texts and texts without letters, and all
    texts if nothing was learned, are ``und`` with score 0 and no spans. Repeated rows
    come out repeated, null ids stay null, other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)
    span = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sent.value.langs
        labeller = Labeller(sent.value)
        for b in batches:
            names, scores, spans = [], [], []
            for at, labels in labeller.label(b.column(1).to_pylist() if langs else [None] * b.num_rows):
                n = np.bincount(labels, minlength=len(langs)) if len(at) else None
                names.append(UNDETERMINED if n is None else langs[int(n.argmax())])
                scores.append(0.0 if n is None else float(n.max() / n.sum()))
                spans.append(spans_of(at, labels, langs))
            cols = [b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "lang_pred", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = "lang_pred string, score double, spans array<struct<first:bigint,last:bigint,lang:string>>"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, {made}")
    return out.withColumnRenamed("id", id_col)
