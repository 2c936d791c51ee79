"""Three dialects of path patterns, each translated to a regular expression that Spark evaluates.

``suffix``: ``**/`` any folders, ``**`` anything, ``*`` within a folder, all else literal but ``?``, which stays a
quantifier; matches a path or its tail after a slash. ``classes`` adds ``[abc]`` and ``[!abc]``. ``full`` matches the
whole path, or the last part if the pattern has no slash, and knows ``?``, classes and ``{a,b}``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _body(pattern: str, classes: bool, full: bool = False) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?" and full:
            out, i = out + "[^/]", i + 1
        elif c == "[" and classes and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            negated, inner = inner[:1] in "!^", inner.lstrip("!^") if inner[:1] in "!^" else inner
            inner = re.sub(r"([\\\[\]&^])", r"\\\1", inner)
            out, i = out + f"[{'^/' if negated else ''}{inner}]", end + 1
        elif c == "{" and full and (end := pattern.find("}", i)) > 0 and "," in pattern[i:end]:
            out += "(?:" + "|".join(_body(p, classes, full) for p in pattern[i + 1 : end].split(",")) + ")"
            i = end + 1
        else:
            out, i = out + (c if c == "?" else re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", c)), i + 1
    return out


def suffix_regex(pattern: str, classes: bool = False) -> str:
    return rf"(?s)(?:^|/){_body(pattern, classes)}\z"


def full_regex(pattern: str) -> str:
    pattern = pattern.removeprefix("./")
    head = "(?:.*/)?" if "/" not in pattern else ""
    return rf"(?s)\A{head}{_body(pattern, True, True)}\z"


def matches(value: Column, pattern: str, dialect: str = "suffix") -> Column:
    """Cheap forms first, which can be pushed to the scan: a literal, ``*.ext`` or ``dir/**``."""
    special = set("*?[]{}")
    if dialect != "full":
        if not special & set(pattern):
            return (value == pattern) | value.endswith("/" + pattern)
        if pattern.startswith("*.") and not special & set(pattern[2:]) and "/" not in pattern:
            return value.endswith(pattern[1:])
        if pattern.endswith("/**") and not special & set(pattern[:-3]):
            stem = pattern[:-2]
            return value.startswith(stem) | value.contains("/" + stem)
    return value.rlike(full_regex(pattern) if dialect == "full" else suffix_regex(pattern, dialect == "classes"))


def matches_any(value: Column, patterns: list[str], dialect: str = "suffix") -> Column:
    """OR of the cheap forms and one alternation of the rest."""
    if not patterns:
        return F.lit(False)
    cheap, rest = [], []
    for p in dict.fromkeys(patterns):
        easy = dialect != "full" and (not set("*?[]{}") & set(p) or (p.startswith("*.") and not set("*?[]{}/") & set(p[2:])) or (p.endswith("/**") and not set("*?[]{}") & set(p[:-3])))
        (cheap if easy else rest).append(p)
    tests = [matches(value, p, dialect) for p in cheap]
    if rest:
        each = [(full_regex(p) if dialect == "full" else suffix_regex(p, dialect == "classes")).removeprefix("(?s)") for p in rest]
        tests.append(value.rlike("(?s)" + "|".join(f"(?:{e})" for e in each)))
    return reduce(lambda a, b: a | b, tests)
