"""Scalar functions on ids, sizes, times, modes and names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.model import CRYPTO, ENTRY_COMPRESSED, ENTRY_PLAIN, RepositoryError

_UNITS = {"": 1, "B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def blob_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def short_id(col: Column) -> Column:
    return F.substring(col, 1, 8)


def format_bytes(n: Column, largest: str = "TiB") -> Column:
    """Three decimals in the largest binary unit that gives 1 or more, up to ``largest``, ties to even; plain bytes below 1024.

    What is rounded is the number as a double, by whole numbers, as a quotient's shortest digits can look like a tie that it isn't.
    """
    out, exact = F.format_string("%d B", n.cast("long")), n.cast("double").cast("long")
    units = ["KiB", "MiB", "GiB", "TiB"]
    for i, unit in enumerate(units[: units.index(largest) + 1]):
        power = 10 * (i + 1)
        low, half = F.lit((1 << power) - 1), 1 << (power - 1)
        whole, part = F.shiftright(exact, power), exact.bitwiseAND(low) * 1000
        cut, rest = F.shiftright(part, power), part.bitwiseAND(low)
        milli = cut + F.when((rest > half) | ((rest == half) & (cut % 2 == 1)), 1).otherwise(0)
        text = F.format_string(f"%d.%03d {unit}", whole + F.when(milli == 1000, 1).otherwise(0), milli % 1000)
        out = F.when(n >= (1 << power), text).otherwise(out)
    return out


def parse_bytes(text: str) -> int:
    """An integer with an optional unit b, k, m, g or t (steps of 1024)."""
    m = re.fullmatch(r"(\d+)([bkmgtBKMGT]?)", text)
    if not m:
        raise RepositoryError(f"invalid size {text!r}")
    n = int(m[1]) * _UNITS[m[2].upper()]
    if n >= 1 << 63:
        raise RepositoryError(f"size {text!r} is too large")
    return n


def format_percent(part: Column, whole: Column) -> Column:
    """Two decimals, at most 100; empty for nothing."""
    return F.when(whole == 0, "").otherwise(F.format_string("%3.2f%%", F.bround(F.least(F.lit(100.0), 100.0 * part / whole), 2)))


def format_seconds(n: Column) -> Column:
    """h:mm:ss, or m:ss below an hour."""
    h, m, s = F.floor(n / 3600), F.floor(n / 60) % 60, n % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s.cast("long"))).otherwise(F.format_string("%d:%02d", m, s.cast("long")))


def permissions(mode: Column, kind: Column) -> Column:
    """ls-like text of the nine permission bits, led by the node's type letter."""
    letter = F.when(kind == "dir", "d").when(kind == "symlink", "L").when(kind == "dev", "D").when(kind == "chardev", "Dc").when(kind == "fifo", "p").when(kind == "socket", "S").otherwise("-")
    bits = [F.when(F.shiftright(mode, 8 - i).bitwiseAND(1) == 1, "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.concat(letter, *bits)


def extension(path: Column) -> Column:
    """From the last dot of the last component on; empty without one."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def join_path(parent: Column, name: Column) -> Column:
    return F.when(parent == "/", F.concat(F.lit("/"), name)).otherwise(F.concat(parent, F.lit("/"), name))


def parent_path(path: Column) -> Column:
    up = F.regexp_replace(path, "/[^/]*$", "")
    return F.when(up == "", "/").otherwise(up)


def within_directory(path: Column, base: str) -> Column:
    """Whether a path is ``base`` or lies below it."""
    if base == "/":
        return path.startswith("/")
    return (path == base) | path.startswith(base + "/")


def zero_prefix(data: Column) -> Column:
    """Number of zero bytes that a binary begins with."""
    rest = F.regexp_replace(F.hex(data), "^(00)+", "")
    return (F.octet_length(data) - F.length(rest) / 2).cast("long")


def tag_file_name(tag: Column) -> Column:
    """A tag as a file name: separators become underscores."""
    clean = F.regexp_replace(tag, "[/\\\\]", "_")
    return F.when(clean.isin(".", "..", ""), F.concat(F.lit("_"), clean)).otherwise(clean)


def plain_length(length: Column, uncompressed: Column) -> Column:
    """Plaintext bytes of a stored blob."""
    return F.when(uncompressed > 0, uncompressed).otherwise(length - CRYPTO)


def cipher_length(plain: Column) -> Column:
    return plain + CRYPTO


def entry_length(uncompressed: Column) -> Column:
    """Bytes that a blob's entry takes in the header of its pack."""
    return F.when(uncompressed > 0, ENTRY_COMPRESSED).otherwise(ENTRY_PLAIN)


def digest_number(c: Column) -> Column:
    """The first 32 bits of the SHA-256 of a string, as a number to deal rows by."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long")
