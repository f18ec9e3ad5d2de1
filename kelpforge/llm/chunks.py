"""Splitting text for byte-level BPE where the split cannot change the tokens, and remembering the ids of what recurs.

The usual pattern for byte-level vocabularies gives a space to the word behind it. So a text may be cut
before any space that stands before something other than white space: no match of the pattern reaches across.
The parts recur a great deal; their ids are remembered per Python process, within a bound.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

#: Entries that a memo holds before it starts anew, the longest part that it keeps, and the characters encoded at a time.
MEMO_ENTRIES = 250_000
MEMO_CHARS = 48
CHARS_AT_ONCE = 2_000_000

_WIDE = re.compile(r" \s")
_CUT = re.compile(r" (?=\S)")


def split_parts(text: str) -> list[str]:
    """The parts between cuts; every part but the first has lost the space before it."""
    return _CUT.split(text) if _WIDE.search(text) else text.split(" ")


class Memo:
    """ids (bytes, four for each id) of parts. encode: gives the ids of each of a list of strings; encode_parts, if given, does so for parts with the space before them."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], encode_parts: Callable[[list[str]], Iterable[bytes]] | None = None, entries: int = MEMO_ENTRIES):
        self.encode, self.encode_parts, self.entries, self.known = encode, encode_parts or encode, entries, {}

    def texts(self, texts: list[str]) -> list[bytes]:
        split = [split_parts(t) for t in texts]
        if len(self.known) > self.entries:
            self.known = {}
        wanted: set[str] = set()
        for parts in split:
            wanted.update(parts[1:])
        new = [p for p in wanted if p not in self.known]
        got = dict(zip(new, self.encode_parts([" " + p for p in new]), strict=True)) if new else {}
        heads = self.encode([parts[0] for parts in split])
        known = self.known
        known.update((p, ids) for p, ids in got.items() if len(p) <= MEMO_CHARS)
        out = []
        for head, parts in zip(heads, split, strict=True):
            try:
                out.append(head + b"".join(map(known.__getitem__, parts[1:])))
            except KeyError:
                out.append(head + b"".join(known[p] if p in known else got[p] for p in parts[1:]))
        return out


def grouped(texts: Iterable[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHARS_AT_ONCE characters."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= CHARS_AT_ONCE:
            yield run
            run, n = [], 0
    if run:
        yield run
