"""Splits SQL text into tokens."""

from __future__ import annotations

import re
from typing import NamedTuple


class SqlError(ValueError):
    """The text is not in the dialect."""


class Token(NamedTuple):
    kind: str  # number, string, name, quoted, op, hint, end
    text: str
    at: int

    @property
    def word(self) -> str:
        """Lower-case text of an unquoted word or operator, '' for others."""
        return self.text.lower() if self.kind in ("name", "op") else ""


_TOKEN = re.compile(
    r"""(?P<hint>/\*\+.*?\*/)
    |(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"\\]|\\.|"")*")
    |(?P<name>[^\W\d]\w*)
    |(?P<op>\|\|/|->>|\#>>|\#>|::|\|\||\|/|<>|!=|<=|>=|!>|!<|<<|>>|!!|->|!~\*|!~|~\*|[-+*/%^&|\#~<>=(),.;:\[\]!@])""",
    re.VERBOSE | re.DOTALL,
)


def tokenize(text: str) -> list[Token]:
    """All tokens, with an end token last; comments and white space are left out."""
    out, at = [], 0
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found:
            raise SqlError(f"unexpected {text[at]!r} at {at}")
        # a hint counts behind SELECT, and is a comment elsewhere
        if found.lastgroup != "skip" and (found.lastgroup != "hint" or out and out[-1].word == "select"):
            out.append(Token(found.lastgroup, found.group(), at))
        at = found.end()
    out.append(Token("end", "", at))
    return out


def unquoted(token: Token) -> str:
    """The value of a string or quoted name."""
    body = token.text[1:-1]
    if token.kind == "string":
        return body.replace("''", "'")
    return re.sub(r"\\(.)|\"\"", lambda m: m[1] or '"', body)
