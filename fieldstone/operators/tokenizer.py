"""The exact tokenizer: text to records of fields, in Python.

One compiled pattern matches a field with what ends it, so the work per field is
one regular-expression step. `expression.py` has the same grammar as Columns for
text whose records are lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from fieldstone.plans.spec import Dialect


class MalformedError(ValueError):
    """Text that the dialect's grammar does not derive."""


@dataclass
class Token:
    """A field: its text without quotes or brackets, not unescaped."""

    value: str
    quoted: bool = False
    escaped: bool = False
    children: list[Token] | None = None
    raw: str = ""


@dataclass
class Record:
    """number: 1-based among the records after the header, comments included."""

    number: int
    raw: str
    tokens: list[Token] = field(default_factory=list)
    comment: bool = False
    error: str | None = None


@dataclass(frozen=True)
class Grammar:
    token: re.Pattern
    has_array: bool


def _set(*chars: str | None) -> str:
    return "".join(re.escape(c) for c in chars if c)


@lru_cache(maxsize=64)
def grammar(d: Dialect) -> Grammar:
    """Groups: quoted, array, raw, end. A field that none matches is malformed."""
    t = d.line_terminator
    escaped = f"|{re.escape(d.escape)}[\\s\\S]" if d.escape else ""
    doubled = f"|{re.escape(d.quote)}{{2}}" if d.quote and d.double_quote else ""
    parts = []
    if d.quote:
        q = re.escape(d.quote)
        parts.append(f"{q}(?P<quoted>(?:[^{_set(d.quote, d.escape)}]{escaped}{doubled})*+){q}")
    if d.array and d.array.prefix:
        a = d.array
        item = f"{q}(?:[^{_set(d.quote, d.escape)}]{escaped}{doubled})*+{q}|" if d.quote else ""
        parts.append(f"{re.escape(a.prefix)}(?P<array>(?:{item}[^{_set(a.suffix, d.escape, d.quote)}]{escaped})*+){re.escape(a.suffix)}")
    else:
        parts.append("(?P<array>(?!))")
    if not d.quote:
        parts.append("(?P<quoted>(?!))")
    starts = "".join(f"(?!{re.escape(c)})" for c in (d.quote, d.array.prefix if d.array else None) if c)
    more = f"|(?!{re.escape(t)}){re.escape(t[0])}" if len(t) > 1 else ""
    parts.append(f"{starts}(?P<raw>(?:[^{_set(d.delimiter, d.escape, t[0])}]{more}{escaped})*+)")
    space = " *+" if d.skip_initial_space else ""
    return Grammar(re.compile(f"{space}(?:{'|'.join(parts)})(?P<end>{re.escape(d.delimiter)}|{re.escape(t)}|\\Z)"), bool(d.array and d.array.prefix))


def _token(d: Dialect, m: re.Match) -> Token:
    if (v := m["raw"]) is not None:
        return Token(v, False, d.escape is not None and d.escape in v, raw=v)
    if (v := m["quoted"]) is not None:
        return Token(v, True, d.escape is not None and d.escape in v or d.double_quote and d.quote in v, raw=f"{d.quote}{v}{d.quote}")
    v = m["array"]
    return Token(v, True, False, _children(d, v), raw=f"{d.array.prefix}{v}{d.array.suffix}")


def _children(d: Dialect, text: str) -> list[Token]:
    """Items of an array's inside; an empty inside has none."""
    return [t for r in records(text, d.inner().without_header()) for t in r.tokens] if text else []


def records(text: str, d: Dialect, mode: str = "failfast", first: int = 1) -> Iterator[Record]:
    """Records of a text, blank ones and comments included; the header is not treated apart.

    A comment starts a record. A terminator at the end of the text adds no
    record. A malformed record raises with its character and place, or in the
    other modes is one Record with an error, up to the next terminator.
    """
    return records_of((text,), d, mode, first)


def records_of(pieces: Iterable[str], d: Dialect, mode: str = "failfast", first: int = 1) -> Iterator[Record]:
    """The records of a text that comes in pieces, holding a piece and an open record.

    A record that ends before the end of the text at hand is the same whatever
    follows. One that reaches the end, or seems malformed, is matched again with
    more text, at least twice as much, until no piece is left.
    """
    g, t, number = grammar(d).token, d.line_terminator, first
    match, left, more = g.match, iter(pieces), True
    text, pos, base = "", 0, 0
    while True:
        size = len(text)
        while pos < size:
            start = pos
            if d.comment and text.startswith(d.comment, pos):
                end = text.find(t, pos)
                if end < 0 and more:
                    break
                pos = size if end < 0 else end + len(t)
                yield Record(number, text[start : size if end < 0 else end], comment=True)
                number += 1
                continue
            tokens: list[Token] = []
            error = None
            while True:
                m = match(text, pos)
                if m is None:
                    error = "" if more else _malformed(text, pos, d, base)
                    end = text.find(t, pos)
                    stop, pos = (size, size) if end < 0 else (end, end + len(t))
                    break
                tokens.append(_token(d, m))
                pos, end = m.end(), m["end"]
                if end != d.delimiter or not end:
                    stop = pos - len(end)
                    break
            if more and (error is not None or pos == size):
                pos = start
                break
            if error and mode == "failfast":
                raise MalformedError(error)
            if not error or mode == "permissive":
                yield Record(number, text[start:stop], [] if error else tokens, error=error)
            number += 1
        if not more:
            return
        base, grown, added, wanted = base + pos, [text[pos:]], 0, max(size - pos, 1)
        while more and added < wanted:
            piece = next(left, None)
            more = piece is not None
            grown.append(piece or "")
            added += len(grown[-1])
        text, pos = "".join(grown), 0


def _malformed(text: str, pos: int, d: Dialect, base: int = 0) -> str:
    """The message for the field at `pos`: the first character that cannot follow. `base`: characters before the text."""
    i = pos
    while d.skip_initial_space and text.startswith(" ", i):
        i += 1
    if d.quote and text.startswith(d.quote, i):
        esc = f"|{re.escape(d.escape)}[\\s\\S]" if d.escape else ""
        dbl = f"|{re.escape(d.quote)}{{2}}" if d.double_quote else ""
        q = re.escape(d.quote)
        closed = re.compile(f"{q}(?:[^{_set(d.quote, d.escape)}]{esc}{dbl})*+{q}").match(text, i)
        if closed and closed.end() < len(text):
            return f"Invalid character '{text[closed.end()]}' at position {base + closed.end()}."
    return "Invalid character End-of-File."


def header_names(rows: list[list[str]], d: Dialect, width: int) -> list[str]:
    """Field names: header rows joined cell by cell; without a header field_0, field_1, ...

    In a row a blank cell repeats the cell before it; cells still blank are
    named field_N by their place, counted from 1.
    """
    if not d.header:
        return [f"field_{i}" for i in range(width)]
    names = [""] * max((len(r) for r in rows), default=0)
    for row in rows:
        last = ""
        for i in range(len(names)):
            last = row[i] if i < len(row) and row[i] else last
            names[i] = f"{names[i]}{d.header_join}{last}" if names[i] else last
    return [n if n.strip() else f"field_{i + 1}" for i, n in enumerate(names)]


def split_header(found: Iterator[Record], d: Dialect) -> tuple[list[list[str]], Iterator[Record]]:
    """The chosen header rows as raw cells, and the records after them, numbered from 1.

    Comments before and within the header are skipped and not numbered.
    """
    rows: list[list[str]] = []
    last, at = max(d.header_rows, default=0), 0
    while at < last:
        r = next(found, None)
        if r is None:
            break
        if r.comment:
            continue
        at += 1
        if at in d.header_rows:
            rows.append([t.value for t in r.tokens])
    return rows, _renumbered(found)


def _renumbered(found: Iterator[Record]) -> Iterator[Record]:
    for n, r in enumerate(found, 1):
        r.number = n
        yield r


def count_records(text: str, d: Dialect) -> int:
    """Records without the header; comments do not count."""
    n = sum(not r.comment for r in records(text, d))
    return max(0, n - len(range(max(d.header_rows, default=0))))
