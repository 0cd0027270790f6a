"""A small scanner that the three query parsers share, and their error."""

from __future__ import annotations

import re


class QueryError(ValueError):
    """A query that does not parse; carries the position and, where there is one, a hint."""

    def __init__(self, message: str, at: int, hint: str = ""):
        super().__init__(f"{message} at position {at}" + (f" ({hint})" if hint else ""))
        self.at, self.hint = at, hint


class Unsupported(ValueError):
    """A query that parses but that the engine does not evaluate."""


class Scanner:
    def __init__(self, source: str):
        self.source, self.at = source, 0

    def space(self) -> None:
        while self.at < len(self.source) and self.source[self.at].isspace():
            self.at += 1

    def end(self) -> bool:
        self.space()
        return self.at >= len(self.source)

    def match(self, pattern: str, skip: bool = True) -> str | None:
        if skip:
            self.space()
        m = re.compile(pattern).match(self.source, self.at)
        if not m:
            return None
        self.at = m.end()
        return m[0]

    def peek(self, pattern: str) -> str | None:
        at = self.at
        out = self.match(pattern)
        self.at = at
        return out

    def need(self, pattern: str, what: str, hint: str = "") -> str:
        out = self.match(pattern)
        if out is None:
            raise self.error(f"expected {what}", hint)
        return out

    def error(self, message: str, hint: str = "") -> QueryError:
        return QueryError(f"{message}, found {self.source[self.at : self.at + 30]!r}", self.at, hint)

    def quoted(self, marks: str = '"', keep_unknown: bool = True) -> str:
        """A quoted string with the escapes \\n, \\t, \\r, \\\\ and the quote."""
        self.space()
        mark = self.source[self.at : self.at + 1]
        if not mark or mark not in marks:
            raise self.error("expected a quoted string")
        i, out = self.at + 1, []
        while i < len(self.source) and self.source[i] != mark:
            c = self.source[i]
            if c == "\\" and mark != "`" and i + 1 < len(self.source):
                n = self.source[i + 1]
                known = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", mark: mark}.get(n)
                out.append(known if known is not None else "\\" + n if keep_unknown else n)
                i += 2
                continue
            out.append(c)
            i += 1
        if i >= len(self.source):
            raise self.error("unterminated string")
        self.at = i + 1
        return "".join(out)
