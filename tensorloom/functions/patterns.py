"""Name patterns: globs whose captures can be substituted, and a regex subset."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(glob: str) -> str:
    """A glob as a regex with a group per wildcard.

    ``*`` stops at a dot, ``**`` does not, ``?`` is one character.
    """
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + "(.*)", i + 2
        elif glob[i] == "*":
            out, i = out + "([^.]*)", i + 1
        elif glob[i] == "?":
            out, i = out + "(.)", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def matches(name: Column, glob: str) -> Column:
    return name.rlike(f"^{to_regex(glob)}$")


def captures(name: Column, glob: str) -> Column:
    """An array of what the wildcards took; null without a match."""
    pattern = f"^{to_regex(glob)}$"
    n = re.compile(pattern).groups
    return F.when(name.rlike(pattern), F.array(*(F.regexp_extract(name, pattern, k + 1) for k in range(n))).cast("array<string>"))


def substitute(name: Column, glob: str, template: str) -> Column:
    """The template with {1}, {2} ... replaced by what the wildcards took."""
    pattern = f"^{to_regex(glob)}$"
    n = re.compile(pattern).groups
    parts = [F.regexp_extract(name, pattern, int(p[1:-1])) if re.fullmatch(r"\{\d+\}", p) else F.lit(p) for p in re.split(r"(\{\d+\})", template) if p]
    for p in re.findall(r"\{(\d+)\}", template):
        if not 1 <= int(p) <= n:
            raise ValueError(f"{template!r} names capture {p} of {n}")
    return F.when(name.rlike(pattern), F.concat(*parts) if parts else F.lit(""))


#: What the regex subset leaves out: look-around, back references, possessive and lazy marks.
_OUTSIDE = re.compile(r"\(\?[^:]|\\[1-9]|[*+?}][+?]|\\[bBAZzG]")


def checked_regex(pattern: str) -> str:
    """The pattern, if it keeps to literals, classes, repeats, choices, groups and anchors."""
    if _OUTSIDE.search(pattern):
        raise ValueError(f"{pattern!r} is outside the subset")
    re.compile(pattern)
    return pattern


def regex_matches(name: Column, pattern: str) -> Column:
    return name.rlike(checked_regex(pattern))
