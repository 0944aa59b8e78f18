"""Terms of a text as bytes: the maximal runs of letters (or of letters and digits), only A to Z lower-cased.

Bytes above 0x7F belong to characters outside ASCII, which are all letters here.  So a text is cut in UTF-8 as it stands,
and the order of terms as bytes is that of their code points.
"""

from __future__ import annotations

from collections.abc import Iterator

_UPPER, _LOWER, _DIGITS = range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A)


def _table(digits: bool) -> bytes:
    kept = lambda b: b > 0x7F or b in _LOWER or (digits and b in _DIGITS)
    return bytes(b + 32 if b in _UPPER else b if kept(b) else 0x20 for b in range(256))


#: What each byte of a text becomes: itself, its lower case, or a blank.
LETTERS, LETTERS_AND_DIGITS = _table(False), _table(True)


def cut_terms(text: bytes, table: bytes, *, most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists from about ``most`` bytes each: a very long text is never one list."""
    plain = text.translate(table)
    at = 0
    while len(plain) - at > most:
        stop = plain.find(b" ", at + most)
        if stop < 0:
            break
        yield plain[at:stop].split()
        at = stop
    yield (plain[at:] if at else plain).split()
