"""Texts of the command line and the terminal: times, tag lists, quoting, widths and access lists."""

from __future__ import annotations

import struct
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted shapes of a time, and the patterns that read them. A zone is an offset or a name.
TIMES = [
    (r"\d{4}-\d\d-\d\d", "yyyy-MM-dd"),
    (r"\d{4}-\d\d-\d\d \d\d:\d\d", "yyyy-MM-dd HH:mm"),
    (r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d", "yyyy-MM-dd HH:mm:ss"),
    (r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d [+-]\d{4}", "yyyy-MM-dd HH:mm:ss xx"),
    (r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d [A-Z]{3,4}", "yyyy-MM-dd HH:mm:ss z"),
    (r"\d\d\.\d\d\.\d{4}", "dd.MM.yyyy"),
    (r"\d\d\.\d\d\.\d{4} \d\d:\d\d", "dd.MM.yyyy HH:mm"),
    (r"\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d", "dd.MM.yyyy HH:mm:ss"),
    (r"\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d [+-]\d{4}", "dd.MM.yyyy HH:mm:ss xx"),
    (r"\d\d\.\d\d\.\d{4} \d\d:\d\d:\d\d [A-Z]{3,4}", "dd.MM.yyyy HH:mm:ss z"),
    (r"[A-Z][a-z]{2} [A-Z][a-z]{2} \d{1,2} \d\d:\d\d:\d\d [+-]\d{4} \d{4}", "MMM d HH:mm:ss xx yyyy"),
]
#: Tags of access list entries (fixed values): owner, user, owning group, group, mask, others.
ACL_TAGS = {0x01: "user", 0x02: "user", 0x04: "group", 0x08: "group", 0x10: "mask", 0x20: "other"}


def parse_time(text: Column) -> Column:
    """The time that a text in one of the shapes of ``TIMES`` means; null for others. Without a zone it is in the session's."""
    # the long shape also names its zone, which the offset before it settles, and the day of the week
    text = F.regexp_replace(text, r"^([A-Z][a-z]{2} [A-Z][a-z]{2} .*[+-]\d{4}) [A-Z]{3,4} (\d{4})$", "$1 $2")
    out = F.lit(None).cast("timestamp")
    for shape, pattern in TIMES:
        plain = F.regexp_replace(text, "^[A-Z][a-z]{2} ", "") if pattern.startswith("MMM") else text
        out = F.when(text.rlike(f"^{shape}$"), F.try_to_timestamp(plain, F.lit(pattern))).otherwise(out)
    return out


def required_time(text: str) -> Column:
    """``parse_time`` of a literal; a query over it fails if it can't be parsed."""
    return F.coalesce(parse_time(F.lit(text)), F.raise_error(F.lit(f"unable to parse time: {text!r}")).cast("timestamp"))


def split_tags(text: Column) -> Column:
    """Tags of a comma-separated list, without white space around them; empty ones stay."""
    return F.transform(F.split(text, ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""))


def flatten_tags(lists: Column) -> Column:
    """All tags of several lists, in order and without empty ones."""
    return F.filter(F.flatten(lists), lambda t: t != "")


def quoted(line: str) -> str:
    """The line as it is, or in quotes with escapes if it has characters that would upset a terminal."""
    if all(c.isprintable() and c != "\ufffd" for c in line):
        return line
    short = {"\a": "\\a", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\v": "\\v", '"': '\\"', "\\": "\\\\"}

    def shown(c: str) -> str:
        n = ord(c)
        if c in short or c.isprintable():
            return short.get(c, c)
        return f"\\x{n:02x}" if n < 0x80 else f"\\u{n:04x}" if n < 0x10000 else f"\\U{n:08x}"

    return '"' + "".join(map(shown, line)) + '"'


def cells(line: str) -> int:
    """Terminal cells that a line takes: two for wide characters."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def cut_to(line: str, width: int) -> str:
    """The longest beginning that fits into ``width`` cells, where a character that could be wide counts as wide."""
    for i, c in enumerate(line):
        width -= 2 if not c.isascii() and unicodedata.east_asian_width(c) not in ("N", "Na") else 1
        if width < 0:
            return line[:i]
    return line


def acl_text(data: bytes) -> str | None:
    """POSIX long text of a Linux access list of version 2, ids in decimal; None if it isn't one."""
    if len(data) < 4 or (len(data) - 4) % 8 or struct.unpack_from("<I", data)[0] != 2:
        return None
    lines = []
    for tag, bits, who in struct.iter_unpack("<HHI", data[4:]):
        if tag not in ACL_TAGS:
            return None
        named = str(who) if tag in (0x02, 0x08) else ""
        allowed = "".join(c if bits & b else "-" for c, b in (("r", 4), ("w", 2), ("x", 1)))
        lines.append(f"{ACL_TAGS[tag]}:{named}:{allowed}\n")
    return "".join(lines)


def _each(f, kind: str):
    """A column function that applies f to each value, in Arrow batches; null stays null."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else f(x))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def quote(line: Column) -> Column:
    return _each(quoted, "string")(line)


def display_width(line: Column) -> Column:
    return _each(cells, "long")(line)


def truncate(line: Column, width: int) -> Column:
    return _each(lambda x: cut_to(x, width), "string")(line)


def acl(data: Column) -> Column:
    return _each(lambda x: acl_text(bytes(x)), "string")(data)
