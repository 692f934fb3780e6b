"""What surrounds a text decoder: bytes that come in parts, and rollback of unstable tokens."""

from __future__ import annotations

import codecs


class Utf8Parts:
    """UTF-8 that comes in parts; bytes of an unfinished character wait for the next part."""

    def __init__(self):
        self._decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, part: bytes, last: bool = False) -> str:
        return self._decoder.decode(part, last)


def rollback(tokens: list[int], k: int, decode, finish: bool = False) -> list[int]:
    """The tokens less the last ``k``, and less more of them while the text would end in a broken character. At the ``finish`` of a
    session the first token stays, and broken characters too."""
    n = max(1 if finish else 0, len(tokens) - k)
    while n and not finish and "\ufffd" in decode(tokens[:n]):
        n -= 1
    return tokens[:n]
