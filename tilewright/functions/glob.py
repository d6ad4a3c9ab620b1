"""File name patterns as regular expressions, and the part of a pattern that a listing can start from.

``*`` stays in a folder, ``**/`` is any number of folders, ``**`` anything, ``?`` one character, ``[a-c]`` and
``[!x]`` classes that never hold a slash, ``{a,b}`` alternatives. An unclosed bracket or brace stands for itself.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"[*?\[{]")


def to_regex(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        rest = pattern[i:]
        if rest.startswith("**/"):
            out.append("(?:.*/)?")
            i += 3
        elif rest.startswith("**"):
            out.append(".*")
            i += 2
        elif rest[0] == "*":
            out.append("[^/]*")
            i += 1
        elif rest[0] == "?":
            out.append("[^/]")
            i += 1
        elif rest[0] == "[" and (end := rest.find("]", 2 + rest.startswith("[!"))) > 0:
            body = rest[1:end]
            negated = body.startswith("!")
            inner = re.sub(r"([\\\[\]^&~|])", r"\\\1", body[negated:])
            out.append(f"[^/{inner}]" if negated else f"(?!/)[{inner}]")
            i += end + 1
        elif rest[0] == "{" and (end := rest.find("}")) > 0:
            options = rest[1:end].split(",")
            while len(options) > 1 and not options[-1]:
                options.pop()
            out.append("(?:" + "|".join(map(to_regex, options)) + ")")
            i += end + 1
        else:
            out.append(re.sub(r"([\\.^$|()+{}\[\]*?])", r"\\\1", rest[0]))
            i += 1
    return "".join(out)


def matches(key: Column, pattern: str) -> Column:
    return key.rlike(f"^(?s:{to_regex(pattern)})$")


def prefix(pattern: str) -> str:
    """The folders before the first special character; a listing needs nothing outside."""
    first = _SPECIAL.search(pattern)
    return pattern if not first else pattern[: first.start()].rpartition("/")[0]


def recursive(pattern: str) -> bool:
    """Whether what follows the prefix can reach into folders."""
    rest = pattern[len(prefix(pattern)) :].lstrip("/")
    return "**" in rest or "/" in rest


def pruned(key: Column, pattern: str) -> Column:
    """The match behind a plain prefix test, which file formats can use to skip data."""
    start = prefix(pattern)
    return (F.startswith(key, F.lit(start)) if start else F.lit(True)) & matches(key, pattern)
