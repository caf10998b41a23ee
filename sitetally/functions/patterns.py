"""What a pattern requires at the start of a text: the index that keeps most patterns from being tried at all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: Letters of a head, heads of a pattern: a longer head says little more, a pattern with more heads is tried on every text.
HEAD_LETTERS = 12
HEADS = 64
_CLASS_LETTERS = 8
_FOLD = {c: c + 32 for c in range(65, 91)}


class _Unclear(Exception):
    """The pattern uses something whose meaning for the start isn't known here."""


def _alternatives(p: str, i: int) -> tuple[list[tuple[str, bool]], int]:
    """Heads of the alternatives from i up to the closing bracket or the end; each with whether text may follow it directly."""
    found, branch = [], [("", True)]
    while i < len(p) and p[i] != ")":
        if p[i] == "|":
            found, branch, i = found + branch, [("", True)], i + 1
            continue
        atom, i = _atom(p, i)
        least, i = _repeats(p, i)
        if atom is None or least == 0:
            branch = [(h, False) for h, _ in branch]
            continue
        joined = [(h + a, go and least == 1) for h, more in branch if more for a, go in atom]
        branch = joined + [(h, False) for h, more in branch if not more]
        if len(branch) > HEADS:
            raise _Unclear
    return found + branch, i


def _atom(p: str, i: int) -> tuple[list[tuple[str, bool]] | None, int]:
    """The texts one atom stands for, None if they are many; and where it ends."""
    c = p[i]
    if c == "^":
        return [("", True)], i + 1
    if c == "(":
        if p.startswith("(?:", i):
            i += 3
        elif p.startswith("(?", i):
            raise _Unclear
        else:
            i += 1
        inner, i = _alternatives(p, i)
        if i >= len(p):
            raise _Unclear
        return inner, i + 1
    if c == "[":
        end = p.find("]", i + 2)
        inside = p[i + 1 : end]
        if end < 0 or any(x in inside for x in "[&\\"):
            raise _Unclear
        plain = "-" not in inside and inside[0] != "^" and len(inside) <= _CLASS_LETTERS
        return ([(x, True) for x in inside] if plain else None), end + 1
    if c == "\\":
        if i + 1 >= len(p):
            raise _Unclear
        if p[i + 1] in "bB":
            return [("", True)], i + 2
        if p[i + 1] in "dDwWsShHvV":
            return None, i + 2
        if p[i + 1].isalnum():
            raise _Unclear
        return [(p[i + 1], True)], i + 2
    return (None if c in ".$" else [(c, True)]), i + 1


def _repeats(p: str, i: int) -> tuple[int, int]:
    """How often the atom before i must occur (2 stands for once and perhaps more), and where the quantifier ends."""
    if i >= len(p) or p[i] not in "?*+{":
        return 1, i
    if p[i] == "{":
        end = p.find("}", i)
        least = p[i + 1 : end].split(",")[0]
        if end < 0 or not least.isdigit():
            raise _Unclear
        least, i = (0 if int(least) == 0 else 2), end + 1
    else:
        least, i = (2 if p[i] == "+" else 0), i + 1
    return least, i + 1 if i < len(p) and p[i] in "?+" else i


def heads_of(pattern: str) -> list[str]:
    """Texts one of which every match from the start begins with, in lower case (A-Z), none the start of another; [''] if nothing is known."""
    try:
        found, end = _alternatives(pattern, 0)
        if end < len(pattern):
            raise _Unclear
    except _Unclear:
        return [""]
    least: list[str] = []
    for head in sorted({h[:HEAD_LETTERS].translate(_FOLD) for h, _ in found}):
        if not (least and head.startswith(least[-1])):
            least.append(head)
    return least


@pandas_udf(ArrayType(StringType()))
def pattern_heads(pattern: pd.Series) -> pd.Series:
    return pattern.map(lambda p: [] if p is None else heads_of(p))
