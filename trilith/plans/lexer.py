"""Tokens of the SQL and Cypher front ends."""

from __future__ import annotations

import re
from typing import NamedTuple


class QueryError(ValueError):
    """A query that can't be parsed or isn't supported."""


class Token(NamedTuple):
    kind: str  # name, quoted, string, number, param, op, end
    text: str
    start: int
    end: int


def _pattern(comment: str, param: str, strings: str) -> re.Pattern:
    return re.compile(
    rf"""(?P<space>\s+|{comment}[^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^'\\]|''|\\.)*'{strings}|\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)
    |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    |(?P<number>0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|(?:\d+(?:\.(?!\.)\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<param>{param})
    |(?P<name>[A-Za-z_]\w*)
    |(?P<op>::|<>|!=|<=|>=|\|\||->|<-|@>|//|\.\.|=~|[-+*/%^=<>(),.;\[\]{{}}|:?!])""",
        re.X | re.S,
    )


_SQL = _pattern("--", r"[:?](?=[A-Za-z_])(?<!\w:)\w+", "")
_CYPHER = _pattern("//", r"\$[A-Za-z_]\w*", r'|"(?:[^"\\]|\\.)*"')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


def unquote(text: str) -> str:
    """The value of a string literal: doubled quotes, backslash escapes, or dollar quoting as it stands."""
    if text[0] == "$":
        tag = text[: text.index("$", 1) + 1]
        return text[len(tag) : -len(tag)]
    body = text[1:-1].replace(text[0] * 2, text[0])
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], "\\" + m[1] if m[1] in "%_" else m[1]), body, flags=re.S)


_SWITCH = re.compile(r"\s+([A-Za-z]\w*)")
_EXIT = re.compile(r"LANG\s+EXIT\b", re.I)


def block_end(text: str, at: int) -> int:
    """Where the text of another language ends: at its LANG EXIT, at the bracket that closes around it, or at the end."""
    depth, quote, inner = 0, "", 0
    while at < len(text):
        ch = text[at]
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            if depth == 0:
                return at
            depth -= 1
        elif ch in "lL" and not (at and (text[at - 1].isalnum() or text[at - 1] in "_$")):
            if _EXIT.match(text, at):
                if inner == 0:
                    return at
                inner -= 1
            elif re.match(r"LANG\s+\w", text[at : at + 12], re.I) and depth == 0:
                inner += 1
        at += 1
    return at


def tokens(text: str, cypher: bool = False) -> list[Token]:
    """All tokens and an end."""
    out, at, pattern = [], 0, _CYPHER if cypher else _SQL
    while at < len(text):
        m = pattern.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at]!r} at {at}")
        kind = m.lastgroup if m.lastgroup != "tag" else "string"
        if kind != "space":
            out.append(Token(kind, m[0], at, m.end()))
        at = m.end()
        switch = kind == "name" and m[0].upper() == "LANG" and _SWITCH.match(text, at)
        if switch and switch[1].upper() != "EXIT":
            out.append(Token("name", switch[1], switch.start(1), switch.end(1)))
            at = block_end(text, switch.end())
            out.append(Token("raw", text[switch.end() : at], switch.end(), at))
    return [*out, Token("end", "", at, at)]


class Cursor:
    """A place among tokens."""

    def __init__(self, text: str, cypher: bool = False) -> None:
        self.text, self.toks, self.i = text, tokens(text, cypher), 0

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def next(self) -> Token:
        self.i += 1
        return self.toks[self.i - 1]

    def is_(self, *words: str) -> bool:
        return self.tok.kind in ("name", "op") and self.tok.text.upper() in words

    def are(self, *words: str) -> bool:
        return all(t.kind in ("name", "op") and t.text.upper() == w for t, w in zip(self.toks[self.i :], words))

    def take(self, *words: str) -> str | None:
        """The next token, if it is one of the words."""
        return self.next().text.upper() if self.is_(*words) else None

    def all_(self, *words: str) -> bool:
        """Whether these words come next; then they are taken."""
        if self.are(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> str:
        got = self.take(*words)
        if not got:
            raise QueryError(f"expected {' or '.join(words)} at {self.tok.text!r} ({self.tok.start})")
        return got
