"""Pieces of a very long text, cut where nothing is cut in two."""

from __future__ import annotations

from collections.abc import Iterator

STRETCH = 1 << 22


def stretches(body: bytes, mark: bytes = b" ", size: int = STRETCH) -> Iterator[bytes]:
    """``body`` in order, in pieces of about ``size`` bytes that begin at a ``mark``; one run without marks stays whole."""
    begin = 0
    while len(body) - begin > size:
        cut = body.rfind(mark, begin + 1, begin + size)
        if cut < 0:
            cut = body.find(mark, begin + size)
        if cut < 0:
            break
        yield body[begin:cut]
        begin = cut
    yield body[begin:] if begin else body
