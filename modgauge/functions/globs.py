"""File globs as native column predicates.

A glob is split once, on the driver, into literal and wildcard pieces.  Common
shapes turn into ==, startswith, endswith or contains, which Spark can push
into a Parquet scan; the rest turn into one anchored regular expression.

`?` is any character, `*` any run of characters (it crosses folders), `**` a
whole path component standing for any number of folders, `[abc]`, `[a-z]` and
`[!a]` are character sets.  Braces and backslashes are plain characters.  A
malformed glob matches nothing.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

log = logging.getLogger(__name__)

_PIECE = re.compile(
    r"(?P<stars>\*+)|(?P<one>\?)|\[(?P<negated>!?+)(?P<members>.[^\]]*)\]|(?P<char>.)",
    re.DOTALL,
)
_MEMBER = re.compile(r"(?P<low>.)-(?P<high>.)|(?P<single>.)", re.DOTALL)

# Kinds of piece.
_LITERAL, _REGEX, _RUN, _FOLDERS = "literal", "regex", "run", "folders"


def _escape(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/" else f"\\x{{{ord(c):x}}}" for c in text)


def _character_set(members: str, negated: bool) -> str:
    ranges = []
    for m in _MEMBER.finditer(members):
        if m["single"] is not None:
            ranges.append(_escape(m["single"]))
        elif m["low"] <= m["high"]:
            ranges.append(f"{_escape(m['low'])}-{_escape(m['high'])}")
    if not ranges:
        return "." if negated else "(?!)"
    return f"[{'^' if negated else ''}{''.join(ranges)}]"


def _pieces(glob: str) -> list[tuple[str, str]] | None:
    """Pieces of a glob, or None when it is malformed."""
    pieces: list[tuple[str, str]] = []

    def add(kind: str, text: str = "") -> None:
        if pieces and kind == _LITERAL == pieces[-1][0]:
            pieces[-1] = (_LITERAL, pieces[-1][1] + text)
        elif kind == _RUN and pieces and pieces[-1][0] in (_RUN, _FOLDERS):
            pieces[-1] = (_RUN, "")  # any folders, then anything: anything
        elif kind == _FOLDERS and pieces and pieces[-1][0] == _FOLDERS:
            pass
        else:
            pieces.append((kind, text))

    position = 0
    while position < len(glob):
        m = _PIECE.match(glob, position)
        start, position = position, m.end()
        if m["stars"] == "*":
            add(_RUN)
        elif m["stars"] == "**":
            at_start = start == 0 or glob[start - 1] == "/"
            if at_start and position == len(glob):
                add(_RUN)
            elif at_start and glob[position] == "/":
                position += 1
                add(_RUN if position == len(glob) else _FOLDERS)
            else:
                return None
        elif m["stars"]:
            return None
        elif m["one"]:
            add(_REGEX, ".")
        elif m["members"]:
            add(_REGEX, _character_set(m["members"], bool(m["negated"])))
        elif m["char"] == "[":
            return None
        else:
            add(_LITERAL, m["char"])
    return pieces


def _regex(pieces: list[tuple[str, str]]) -> str:
    parts = {_RUN: ".*", _FOLDERS: "(?:.*/)?"}
    return "".join(
        _escape(text) if kind == _LITERAL else parts.get(kind, text)
        for kind, text in pieces
    )


def glob_to_regex(glob: str) -> str | None:
    """Anchored Java regular expression for a glob; None when it is malformed."""
    pieces = _pieces(glob)
    return None if pieces is None else rf"(?s)\A(?:{_regex(pieces)})\z"


# How a glob is tested against a path; the text goes with it.
EQUAL, ANY, PREFIX, SUFFIX, NAME, CONTAINS, REGEX = (
    "equal", "any", "prefix", "suffix", "name", "contains", "regex"
)

_SHAPES = {
    (): EQUAL,
    (_LITERAL,): EQUAL,
    (_RUN,): ANY,
    (_LITERAL, _RUN): PREFIX,
    (_RUN, _LITERAL): SUFFIX,
    (_FOLDERS, _LITERAL): NAME,
    (_RUN, _LITERAL, _RUN): CONTAINS,
}


def shape_of(glob: str) -> tuple[str, str] | None:
    """(test, text) of a glob; None when it is malformed."""
    pieces = _pieces(glob)
    if pieces is None:
        log.warning("malformed glob %r matches nothing", glob)
        return None
    test = _SHAPES.get(tuple(kind for kind, _ in pieces), REGEX)
    if test == REGEX:
        return REGEX, _regex(pieces)
    return test, "".join(text for _, text in pieces)


def fixed_ends(glob: str) -> tuple[str, str]:
    """The plain text that every path the glob matches begins with, and that it ends with."""
    pieces = _pieces(glob) or [(_RUN, "")]
    (first, head), (last, tail) = pieces[0], pieces[-1]
    return (head if first == _LITERAL else "", tail if last == _LITERAL else "")


def any_glob(path: Column, globs: Iterable[str]) -> Column:
    """True where at least one glob matches the path as it is written."""
    native: list[Column] = []
    expressions: list[str] = []
    for glob in globs:
        shape = shape_of(glob)
        if shape is None:
            continue
        test, text = shape
        if test == EQUAL:
            native.append(path == text)
        elif test == ANY:
            native.append(path.isNotNull())
        elif test == PREFIX:
            native.append(path.startswith(text))
        elif test == SUFFIX:
            native.append(path.endswith(text))
        elif test == NAME:
            native.append((path == text) | path.endswith("/" + text))
        elif test == CONTAINS:
            native.append(path.contains(text))
        else:
            expressions.append(text)
    if expressions:
        native.append(path.rlike(rf"(?s)\A(?:{'|'.join(expressions)})\z"))
    if not native:
        return F.lit(False)
    return reduce(or_, native)


def matches_glob(path: Column, glob: str) -> Column:
    return any_glob(path, [glob])
