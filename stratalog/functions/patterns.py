"""Python regular expressions as Spark (Java) ones."""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnsupportedPattern(ValueError):
    """The pattern is valid, but has a construct without a counterpart in Java."""


def to_java(pattern: str, anchored: bool = False) -> str:
    """A Java pattern that matches as pattern does in Python, its named groups by number.

    Unicode classes and line ends are Python's: flags U and d. anchored: at the start of the
    text, as re.match.
    """
    compiled = re.compile(pattern)
    if re.search(r"(?<!\\)\(\?\(", pattern):
        raise UnsupportedPattern(f"conditional group in {pattern!r}")
    out = re.sub(r"\(\?P<\w+>", "(", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"(?:\\{compiled.groupindex[m[1]]})", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", out)
    out = re.sub(r"(?<!\\)((?:\\\\)*)\[\[", r"\1[\\[", out)
    flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S), ("x", re.X)) if compiled.flags & bit)
    out = re.sub(r"\A\(\?[aiLmsux]+\)", "", out)
    if anchored:  # a comment that ends the pattern ends before the bracket
        out = rf"\A(?:{out}" + ("\n)" if "x" in flags else ")")
    return f"(?dU{flags})" + out


def _may_be_unmatched(parsed, inside: bool = False) -> set[int]:
    """Numbers of the groups that a match can leave out."""
    found: set[int] = set()
    for op, arg in parsed:
        if op is C.SUBPATTERN:
            if inside and arg[0] is not None:
                found.add(arg[0])
            found |= _may_be_unmatched(arg[3], inside)
        elif op is C.BRANCH:
            for branch in arg[1]:
                found |= _may_be_unmatched(branch, True)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            found |= _may_be_unmatched(arg[2], inside or arg[0] == 0)
        elif op in (C.ASSERT, C.ASSERT_NOT):
            found |= _may_be_unmatched(arg[1], inside or op is C.ASSERT_NOT)
        elif op is C.ATOMIC_GROUP:
            found |= _may_be_unmatched(arg, inside)
    return found


def group_names(pattern: str) -> list[str]:
    """The named groups, in order."""
    index = re.compile(pattern).groupindex
    return sorted(index, key=index.get)


#: Separates groups while they are one text: not a character.
_SEPARATOR = "\uFDD1"


def match_groups(text: Column, pattern: str) -> Column:
    """An array whose elements from 1 on are the named groups of a match at the start of text,
    in order; of one element where there is none. The pattern runs once for all groups."""
    java, index = to_java(pattern, anchored=True), re.compile(pattern).groupindex
    numbers = [index[n] for n in group_names(pattern)]
    each = F.array(F.lit(""), *(F.regexp_extract(text, java, i) for i in numbers))
    one_by_one = F.when(matches(text, pattern), each).otherwise(F.array(F.lit("")))
    if re.compile(pattern).flags & re.X:
        return one_by_one
    joined = F.regexp_replace(text, rf"{java}(?s:.*)\z", "".join(f"{_SEPARATOR}${i}" for i in numbers))
    return F.when(F.contains(text, F.lit(_SEPARATOR)), one_by_one).otherwise(F.split(joined, _SEPARATOR))


def named_groups(groups: Column, pattern: str) -> dict[str, Column]:
    """A column for each named group of what match_groups gave; null where it is unmatched."""
    optional, index = _may_be_unmatched(P.parse(pattern)), re.compile(pattern).groupindex
    out = {}
    for at, name in enumerate(group_names(pattern), 1):
        value = F.get(groups, F.lit(at))
        out[name] = F.nullif(value, F.lit("")) if index[name] in optional else value
    return out


def matches(text: Column, pattern: str) -> Column:
    """Whether pattern matches at the start of text."""
    return text.rlike(to_java(pattern, anchored=True))


def strip(text: Column) -> Column:
    """text without white space, Unicode's too, at either end."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
