"""A text that a pattern matches, made from the pattern: rules are tried on what they must find."""

from __future__ import annotations

import re._constants as sre
import re._parser as parser

_CATEGORY = {sre.CATEGORY_DIGIT: "7", sre.CATEGORY_WORD: "w", sre.CATEGORY_SPACE: " ", sre.CATEGORY_NOT_SPACE: "x", sre.CATEGORY_NOT_DIGIT: "x", sre.CATEGORY_NOT_WORD: "-"}


def _one_of(items: list, turn: int) -> str:
    """A character of a set, another one each turn, so that samples are not one letter over and over."""
    if items[0][0] is sre.NEGATE:
        banned = {v for kind, v in items[1:] if kind is sre.LITERAL}
        spaces = any(kind is sre.CATEGORY and v is sre.CATEGORY_SPACE for kind, v in items[1:])
        allowed = [c for c in "abcdefghijkmnpqrstuvwxyz0123456789" if ord(c) not in banned and not (spaces and c.isspace())]
        return allowed[turn % len(allowed)]
    some = []
    for kind, v in items:
        some += [chr(v)] if kind is sre.LITERAL else [chr(c) for c in range(v[0], v[1] + 1)] if kind is sre.RANGE else [_CATEGORY[v]]
    words = [c for c in some if c.isalnum()] or some
    return words[turn * 7 % len(words)]


def _of(tree, turn: list[int]) -> str:
    out = []
    for kind, value in tree:
        turn[0] += 1
        if kind is sre.LITERAL:
            out.append(chr(value))
        elif kind is sre.IN:
            out.append(_one_of(value, turn[0]))
        elif kind in (sre.ANY, sre.NOT_LITERAL):
            out.append("y" if value == ord("x") else "x")
        elif kind is sre.CATEGORY:
            out.append(_CATEGORY[value])
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, _, inner = value
            separator = not least and inner[0][0] is sre.IN and (sre.LITERAL, ord("_")) in inner[0][1] and len(inner[0][1]) < 6
            out += ["_"] if separator else [_of(inner, turn) for _ in range(least)]  # words of a name stand apart, as gates have them
        elif kind is sre.SUBPATTERN:
            out.append(_of(value[-1], turn))
        elif kind is sre.BRANCH:
            out.append(_of(value[1][0], turn))
        elif kind is not sre.AT:  # places take no characters
            raise ValueError(f"no sample for {kind}")
    return "".join(out)


def sample(pattern: str) -> str:
    """A short match, with varied characters."""
    return _of(parser.parse(pattern), [0])
