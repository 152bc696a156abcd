"""Cutting texts into chunks that a subword tokenizer never joins across, so each distinct chunk is encoded once.

Both tokenizers used here start a new unit at a single space between two characters that aren't white space. A worker
keeps the encoded bytes of the chunks it has met; a text's ids are then a join of bytes. The kept chunks are bounded
(MOST_KEPT); past that the later half is dropped and encoded again when met, which changes nothing but time."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import islice

MOST_KEPT = 600_000
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])")
#: White space but for space and line feed, in any reading of it.
_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_WIDE = "\x85\xa0                　"
#: ``is_odd`` as a pattern for Arrow.
ODD = f"  | \n|\n |^ | $|[{_ASCII}{_WIDE}]"


def is_odd(text: str) -> bool:
    """Whether text has white space other than line feeds and single spaces between characters that aren't white space."""
    odd = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or any(c in text for c in _ASCII)
    return odd or not text.isascii() and any(c in text for c in _WIDE)


def cut(text: str) -> list[str]:
    """The chunks of text, without the single space that each but the first begins with."""
    return _CUT.split(text) if is_odd(text) else text.split(" ")


class Encoder:
    """The ids of texts as bytes. encode: chunks with their space -> one bytes value each; dummy_space: a text that
    isn't empty is read as if a space came before it."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], dummy_space: bool = False):
        self.encode, self.dummy_space = encode, dummy_space
        self.kept: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        if len(self.kept) + len(chunks) > MOST_KEPT:  # the first half holds what came early, so what is common
            self.kept = dict(islice(self.kept.items(), MOST_KEPT // 2))
        new = list(chunks)
        self.kept.update(zip(new, self.encode([" " + x for x in new]), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [cut(x) for x in texts]
        tails = parts if self.dummy_space else [p[1:] for p in parts]
        found = [list(map(self.kept.get, p)) for p in tails]
        lacking = [i for i, f in enumerate(found) if None in f]
        if lacking:
            self._learn({x for i in lacking for x, y in zip(tails[i], found[i], strict=True) if y is None})
            for i in lacking:
                kept = self.kept
                found[i] = [kept[x] if y is None else y for x, y in zip(tails[i], found[i], strict=True)]
        if self.dummy_space:
            return [b"".join(f) if len(p) > 1 or p[0] else b"" for f, p in zip(found, parts, strict=True)]
        starts = self.encode([p[0] for p in parts])
        return [a + b"".join(f) for a, f in zip(starts, found, strict=True)]
