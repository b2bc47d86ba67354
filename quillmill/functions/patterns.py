"""User-given patterns, checked by the engine that runs them."""

from __future__ import annotations

import itertools
import re
from re import _constants as sre
from re import _parser as parser

from pyspark import SparkContext


def groups(pattern: str) -> int | None:
    """How many capturing groups the regex engine of the executors sees; None if it rejects the pattern."""
    try:
        return SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except Exception as e:  # noqa: BLE001  the engine's own error class lives in the JVM
        if type(e).__name__ == "IllegalArgumentException" or "PatternSyntaxException" in str(e) or "StackOverflow" in str(e):
            return None
        raise


def alternation(patterns: dict[str, str], begins: dict[str, str] | None = None) -> tuple[str, list[int]]:
    """One pattern with a capturing group for each part, and the groups' numbers.

    Parts may have groups and numbered back references of their own; the latter
    are moved to where their groups are now.  ``begins`` has a class of characters
    for parts whose matches all begin with one of it: neighbours of one class
    are tried only where such a character comes.
    """
    parts, at, places = [], 1, []
    for name, p in patterns.items():
        places.append(at)
        moved = re.sub(r"(\\\\)|\\([1-9])", lambda m, at=at: m.group(1) or f"\\{int(m.group(2)) + at}", p)
        parts.append(((begins or {}).get(name), f"({moved})"))
        at += 1 + (groups(p) or 0)
    joined = [(begin, "|".join(part for _, part in own)) for begin, own in itertools.groupby(parts, key=lambda x: x[0])]
    return "|".join(part if begin is None else f"(?={begin})(?:{part})" for begin, part in joined), places


# Syntax that this parser and the executors' engine read alike, and flags that leave letters what they are.
_PLAIN = re.compile(r"(?:[A-Za-z0-9 ',:&-]|\\[bs.?+*()|-]|\((?:\?:|(?!\?))|[)|?*+.!]|\[\^?(?:\\s|[A-Za-z0-9 !,.?])+\])*")
_FLAGS = re.compile(r"(?:\(\?[imU]+\))*")
MOST_NEEDED = 8


def needed(pattern: str) -> list[str] | None:
    """Runs of small letters of which every match holds one, in any case; None where that cannot be told."""
    body = pattern[_FLAGS.match(pattern).end():]
    if not _PLAIN.fullmatch(body):
        return None
    try:
        found = _needed(parser.parse(body))
    except re.error:
        return None
    return sorted(found) if found and len(found) <= MOST_NEEDED else None


def _needed(items) -> set[str] | None:
    choices, run = [], ""
    for op, arg in [*items, (None, None)]:
        if op is sre.LITERAL and chr(arg).isascii() and chr(arg).isalpha():
            run += chr(arg).lower()
            continue
        choices.append({run})
        run = ""
        if op is sre.SUBPATTERN:
            choices.append(_needed(arg[3]))
        elif op is sre.BRANCH:
            parts = [_needed(x) for x in arg[1]]
            choices.append(None if None in parts else set().union(*parts))
        elif op is sre.MAX_REPEAT and arg[0] > 0:
            choices.append(_needed(arg[2]))
    known = [c for c in choices if c and min(map(len, c)) > 2]
    return min(known, key=lambda c: (len(c), -min(map(len, c)))) if known else None
