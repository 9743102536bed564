"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError

_TOKEN = re.compile(
    r"""(?P<hint>/\*\+.*?\*/)
    |(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^'\\]|\\.)*')
    |(?P<float>-?\d+\.\d+(?:[eE][+-]?\d+)?)
    |(?P<int>-?\d+)
    |(?P<name>[a-zA-Z_][a-zA-Z0-9_]*)
    |(?P<mark>->|<-|!=|<=|>=|\.\.|[()\[\]:;,=<>*.-])""",
    re.S | re.X,
)


@dataclass(frozen=True)
class Token:
    kind: str  # hint, string, float, int, name, mark, end
    value: object
    at: int

    def __str__(self) -> str:
        return "the end" if self.kind == "end" else repr(self.value)


def tokens(text: str) -> list[Token]:
    found, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise ParseError(f"unexpected character {text[at]!r} at {at}")
        kind, raw = m.lastgroup, m[0]
        if kind == "string":
            found.append(Token(kind, re.sub(r"\\(['\\])", r"\1", raw[1:-1]), at))
        elif kind == "float":
            found.append(Token(kind, float(raw), at))
        elif kind == "int":
            found.append(Token(kind, int(raw), at))
        elif kind == "hint":
            found.append(Token(kind, raw[3:-2].strip(), at))
        elif kind != "skip":
            found.append(Token(kind, raw, at))
        at = m.end()
    found.append(Token("end", None, len(text)))
    return found
