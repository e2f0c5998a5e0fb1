"""Token ids and counts of a public BPE tokenizer, unit by unit.

The word BPE splits at white space before anything else, so the ids of a text are
those of its white-space separated units, one after another. Units repeat, so each is
encoded once and kept in a worker's cache; a unit that isn't is cut into the tokenizer's own
pre-tokens, whose ids are kept as well and come from the library's model. Texts for which this
could differ from the library (special strings, characters beyond a plain set), and all texts under a
tokenizer file with other rules, go to the library whole.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np

#: Characters for which white space, case and composition are the same in Python as in the library.
ODD = re.compile("[^\t\n\r -~¡-¬®-İĲ-ž‐-‧‰-⁞₠-₿]")
#: Most units and most pre-tokens in each half of a worker's caches, and the longest ones that are kept.
KEPT, PARTS_KEPT, LONGEST = 1 << 19, 1 << 17, 48
#: The normalizers and the splitting pattern under which units may be encoded one by one.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _class(kind: str) -> str:
    """Lower-cased plain characters of a Unicode main class, beyond ASCII."""
    plain = [c for c in map(chr, range(0x80, 0x20C0)) if ODD.search(c) is None]
    return "".join(sorted({x for c in plain for x in c.lower() if unicodedata.category(x)[0] == kind and not x.isascii()}))


#: SPLIT for lower-cased plain units.
PARTS = re.compile(f"'(?:[stmd]|re|ve|ll)|[a-z{_class('L')}]+|[0-9{_class('N')}]|[^a-z{_class('L')}0-9{_class('N')}]+")


def _byte_names() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else the next one from 256 on."""
    names, free = [], 256
    for b in range(256):
        visible = 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE
        names.append(chr(b if visible else free))
        free += not visible
    return names


BYTES = dict(enumerate(_byte_names()))


def _known(rules: dict) -> bool:
    """Whether a tokenizer file has the rules that this module applies itself."""
    parts = [(p.get("type"), p.get("pattern", {}).get("Regex"), p.get("behavior"), p.get("invert"), p.get("add_prefix_space"), p.get("use_regex")) for p in (rules["pre_tokenizer"] or {}).get("pretokenizers", ())]
    own = [("Split", SPLIT, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
    return [n.get("type") for n in (rules["normalizer"] or {}).get("normalizers", ())] == NORMALIZERS and parts == own


class Kept(dict):
    """A cache in two halves: a full one becomes the older half, of which what is used again is taken over."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.older = most, {}

    def made(self, key: str) -> bytes:
        raise KeyError(key)

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.made(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids


class Parts(Kept):
    """lower-cased pre-token -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, model) -> None:
        super().__init__(PARTS_KEPT)
        self.model = model

    def made(self, part: str) -> bytes:
        named = part if part.isascii() else part.encode("utf-8").decode("latin-1").translate(BYTES)
        got = [t.id for t in self.model.tokenize(named)]
        return struct.pack(f"<{len(got)}I", *got)


_open: dict[str, Units] = {}


class Units(Kept):
    """unit -> its ids as little-endian unsigned 32-bit bytes; misses are encoded by the library's model."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__(KEPT)
        self.library = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.known = _known(json.loads(self.library.to_str()))
        self.parts = Parts(self.library.model)

    def made(self, unit: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, PARTS.findall(unit.lower())))

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def plain(self, text: str) -> bool:
        return self.known and ODD.search(text) is None and not any(s in text for s in self.special)

    def ids(self, text: str | None) -> bytes:
        """Ids of a whole text, 4 bytes each (None: empty)."""
        if not text:
            return b""
        if not self.plain(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def units(path: str) -> Units:
    """The worker's cache for a tokenizer file."""
    if path not in _open:
        _open[path] = Units(path)
    return _open[path]
