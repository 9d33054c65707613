"""The declaration grammar: ``users(id) { name age }``, ``allOrgs()``, ``{ a b }``, ``(id) { a }``.

White space and commas separate names.  Ids may be empty, braces may be missing, but not empty; what follows the
closing brace is ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*|[(){}]|[\s,]+|.")


@dataclass(frozen=True)
class Schema:
    name: str | None = None
    ids: tuple[str, ...] = ()
    values: tuple[str, ...] = field(default=())

    @property
    def fields(self) -> tuple[str, ...]:
        return self.ids + self.values

    def __str__(self) -> str:
        braces = f" {{ {' '.join(self.values)} }}" if self.values else ""
        return f"{self.name or ''}({' '.join(self.ids)}){braces}"


class _Reader:
    def __init__(self, text: str):
        self.text = text
        self.tokens = [t for t in _TOKEN.findall(text) if not re.fullmatch(r"[\s,]+", t)]
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def fail(self, wanted: str) -> ValueError:
        return ValueError(f"expected {wanted} but found {self.peek() or 'the end'} in {self.text!r}")

    def take(self, token: str) -> None:
        if self.peek() != token:
            raise self.fail(repr(token))
        self.at += 1

    def names(self, close: str) -> tuple[str, ...]:
        out = []
        while self.peek() != close:
            if not re.match(r"[A-Za-z_$]", self.peek()):
                raise self.fail(f"a name or {close!r}")
            out.append(self.peek())
            self.at += 1
        self.at += 1
        return tuple(out)

    def ids(self) -> tuple[str, ...]:
        self.take("(")
        return self.names(")")

    def values(self) -> tuple[str, ...]:
        if not self.peek():
            return ()
        self.take("{")
        found = self.names("}")
        if not found:
            raise ValueError(f"at least one column is required in {self.text!r}")
        return found


def parse(text: str) -> Schema:
    """A named declaration: name(ids) with optional { values }."""
    r = _Reader(text)
    if not re.match(r"[A-Za-z_$]", r.peek()):
        raise r.fail("a table name")
    name = r.peek()
    r.at += 1
    return Schema(name, r.ids(), r.values())


def parse_signature(text: str) -> Schema:
    """{ values }, with optional (ids) before."""
    r = _Reader(text)
    ids = r.ids() if r.peek() == "(" else ()
    values = r.values()
    if not values:
        raise r.fail("'{'")
    return Schema(None, ids, values)
