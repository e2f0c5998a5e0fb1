"""Path patterns compiled to regular expressions, so that Catalyst sees a filter.

A pattern is split at "/"; "*", "?", and "[...]" match inside one part and "**" any number
of parts. A rooted pattern must match from the root on, another from any part on; neither
needs to reach the end of the path, so "foo" matches "/a/foo/b".
"""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.model import RepositoryError


def part_regex(part: str) -> str:
    """Regular expression of one part of a pattern."""
    out, i = [], 0
    while i < len(part):
        c = part[i]
        i += 1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            if i == len(part):
                raise RepositoryError(f"bad pattern {part!r}: ends in a backslash")
            out.append(re.escape(part[i]))
            i += 1
        elif c == "[":
            negated = part[i : i + 1] == "^"
            i += negated
            ranges = []
            while True:
                if i >= len(part) or (part[i] == "]" and not ranges):
                    raise RepositoryError(f"bad pattern {part!r}: class without end")
                if part[i] == "]":
                    i += 1
                    break
                ends = []
                for _ in range(2):
                    if part[i] in "-]":
                        raise RepositoryError(f"bad pattern {part!r}: bad range")
                    i += part[i] == "\\"
                    if i >= len(part):
                        raise RepositoryError(f"bad pattern {part!r}: class without end")
                    ends.append(part[i])
                    i += 1
                    if len(ends) == 1 and part[i : i + 1] != "-":
                        break
                    if len(ends) == 1:
                        i += 1
                        if i >= len(part):
                            raise RepositoryError(f"bad pattern {part!r}: class without end")
                if ends[0] <= ends[-1]:
                    ranges.append("-".join(re.escape(x) if x.isascii() else x for x in (ends[0], ends[-1])))
                else:
                    ranges.append("")
            body = "".join(ranges)
            out.append(f"[^/{body}]" if negated else f"(?!/)[{body}]" if body else "(?!)")
        else:
            out.append(re.escape(c))
    return "".join(out)


def clean(path: str) -> str:
    """A lexically shortened path: no empty, "." or inner ".." parts."""
    rooted = path.startswith("/")
    out = posixpath.normpath(path)
    return "/" + out.lstrip("/") if rooted else out


def _parts(pattern: str) -> tuple[bool, list[str]]:
    shortened = clean(pattern)
    rooted = shortened.startswith("/")
    return rooted, [p for p in shortened.split("/") if p] if shortened != "/" else []


def regex(pattern: str, fold: bool = False) -> str:
    """Java and Python regular expression that finds the paths a pattern matches."""
    if pattern == "":
        return "(?s)^.*$"
    rooted, parts = _parts(pattern.lower() if fold else pattern)
    while not rooted and parts and parts[0] == "**":
        parts = parts[1:]
    body = "".join("(?:/[^/]+)*" if p == "**" else "/(?=[^/])" + part_regex(p) for p in parts)
    if not rooted:
        body = "(?:.*/)?" + body[1:]
    return f"(?s)^{body}(?:/.*)?$"


def matches(path: Column, pattern: str, fold: bool = False) -> Column:
    """Whether a pattern matches a path."""
    path = F.lower(path) if fold else path
    return path.rlike(regex(pattern, fold))


def child_regex(pattern: str, fold: bool = False) -> str:
    """The same for the directories below which the pattern may match."""
    rooted, parts = _parts(pattern.lower() if fold else pattern) if pattern else (False, [])
    if "**" in parts:
        parts = parts[: parts.index("**")]
    if not rooted or not parts:
        return "(?s)^.*$"
    body = ""
    for p in reversed(parts):
        # the path may end here, or go on as the pattern does, or below the whole pattern
        body = f"(?:/(?=[^/]){part_regex(p)}(?:{body or '/.*'})?)"
    return f"(?s)^(?:/|{body})$"


def child_may_match(path: Column, pattern: str, fold: bool = False) -> Column:
    """Whether something below a directory can match."""
    path = F.lower(path) if fold else path
    return path.rlike(child_regex(pattern, fold))


def matches_list(path: Column, patterns: list[str], fold: bool = False) -> Column:
    """Whether the last pattern that says something says yes; "!p" takes back what p matches."""
    found = F.lit(False)
    for p in patterns:
        if p.startswith("!"):
            found = found & ~matches(path, p[1:], fold)
        elif p.strip():
            found = found | matches(path, p, fold)
    return found


def child_may_match_list(path: Column, patterns: list[str], fold: bool = False) -> Column:
    """Whether something below can match; "!p" only takes back what matches p whole."""
    found = F.lit(False)
    for p in patterns:
        if p.startswith("!"):
            found = found & ~matches(path, p[1:], fold)
        elif p.strip():
            found = found | child_may_match(path, p, fold)
    return found


def validate(patterns: list[str]) -> None:
    """Raises one error that names every bad pattern."""
    bad = []
    for p in patterns:
        try:
            regex(p.removeprefix("!"))
        except RepositoryError:
            bad.append(p)
    if bad:
        raise RepositoryError("bad patterns: " + ", ".join(bad))


def patterns_of(text: str, env: Mapping[str, str] | None = None) -> list[str]:
    """Patterns of a file: a line each, trimmed; blank lines and "#" left out, $VAR filled in, "$$" is "$"."""
    env = os.environ if env is None else env
    out = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith("#"):
            out.append(re.sub(r"\$(\$|\w+|\{\w+\})", lambda m: "$" if m[1] == "$" else env.get(m[1].strip("{}"), ""), line))
    return out
