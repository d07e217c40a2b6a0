"""Delimited text of any length: the separator found and the records split by one pass over the characters.

A field that begins with a quote goes on to the quote that closes it, over separators and line breaks, and two quotes in it
are one; what follows the closing quote belongs to the field.  A quote that nothing closes takes all that is left.  A quote
within a field that doesn't begin with one is a character like any other.  Records end with a line feed, a carriage return
or both.  Each step jumps to the next character that matters, so the time grows with the text, whatever is in it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

SEPARATORS = ",\t;|"
_ENDS = {s: re.compile(f"[{re.escape(s)}\r\n]") for s in SEPARATORS}
#: What quotes hold, quotes in it being doubled, and empty lines; both without going back.
_INSIDE, _BREAKS = re.compile(r'[^"]*+(?:""[^"]*+)*+'), re.compile("[\r\n]*+")
_ANY_END = re.compile(f"[{re.escape(SEPARATORS)}\r\n]")


def _quoted(text: str, at: int) -> tuple[str, int]:
    """(what the quotes that open at `at` hold, the place after them)."""
    inside = _INSIDE.match(text, at + 1)
    return inside[0].replace('""', '"'), inside.end() + 1


def find_separator(text: str) -> str:
    """Comma, tab, semicolon or bar, from the first record alone: the one that stands beside quoted fields most often; else
    the first of them, in this order, that the record has; a record with none of them is one column (comma)."""
    seen, beside, at, n = set(), Counter(), 0, len(text)
    while at < n:
        before = text[at - 1] if at else ""
        quoted = text.startswith('"', at)
        if quoted:
            if before:
                beside[before] += 1
            at = _quoted(text, at)[1]
        met = _ANY_END.search(text, at)
        if met is None or met[0] in "\r\n":
            break
        seen.add(met[0])
        if quoted and met.start() == at:
            beside[met[0]] += 1
        at = met.end()
    if beside:
        return max(SEPARATORS, key=lambda s: beside[s])
    return next((s for s in SEPARATORS if s in seen), ",")


def records(text: str, separator: str) -> Iterator[list[str]]:
    """The records' fields; blank lines are left out."""
    ends, row, n = _ENDS[separator], [], len(text)
    at = _BREAKS.match(text).end()
    blank = True
    while at < n or row:
        if text.startswith('"', at):
            value, at = _quoted(text, at)
            blank = False
        else:
            value = ""
        met = ends.search(text, at)
        stop = met.start() if met else n
        value += text[at:stop]
        row.append(value)
        blank = blank and not value.strip()
        at = stop + 1
        if met and met[0] == separator:
            if at >= n:
                row.append("")
            else:
                continue
        if not blank or len(row) > 1:
            yield row
        row, blank = [], True
        at = _BREAKS.match(text, at).end() if at < n else n

