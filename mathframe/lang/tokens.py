"""One scanner for both languages."""

from __future__ import annotations

import re
from dataclasses import dataclass

# The tokens, longest first where one begins another.
_TOKEN = re.compile(
    r"""\s*(?:
    (?P<real>\d+\.\d*(?:[eE][+-]?\d+)?)
  | (?P<integer>\d+)
  | (?P<infinity>\.inf\b)
  | (?P<name>[a-zA-Z_][a-zA-Z0-9_]*)
  | (?P<sign>\*\*|<=|>=|==|!=|[-+*/<>(),=])
  | (?P<end>$)
)""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def scan(text: str) -> list[Token]:
    """All tokens of a text, ended by one of kind "end"."""
    out, at = [], 0
    while True:
        found = _TOKEN.match(text, at)
        if not found:
            raise SyntaxError(f"unexpected character at {at}: {text[at : at + 10]!r}")
        out.append(Token(found.lastgroup, found.group(found.lastgroup), found.start(found.lastgroup)))
        if found.lastgroup == "end":
            return out
        at = found.end()


class Cursor:
    """A place in the tokens of a text."""

    def __init__(self, text: str):
        self.tokens, self.place = scan(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.place]

    @property
    def after(self) -> Token:
        return self.tokens[min(self.place + 1, len(self.tokens) - 1)]

    def step(self) -> Token:
        token = self.now
        self.place += 1
        return token

    def take(self, text: str) -> bool:
        """Step over the sign ``text`` if it stands here."""
        if self.now.kind == "sign" and self.now.text == text:
            self.place += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SyntaxError(f"expected {text!r} at {self.now.at}, found {self.now.text or 'the end'!r}")
