"""Cut texts at places that no token can cross, so that pieces can be cached."""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space between two white-space characters, or after one at the end, may join its neighbours.
_JOINED = re.compile(r"\s (?:\s|$)")
_CUT = re.compile(r"(?<=\S) ")


def pieces(text: str) -> list[str]:
    """Pieces whose join by single spaces is the text; every piece but the first begins with that space.

    A cut lies before a space that follows a character which is no white space, or
    precedes one.  Patterns that take at most one space before a word, and white space
    up to it otherwise, end a match there whatever stands around.
    """
    return _CUT.split(text) if _JOINED.search(text) else text.split(" ")


class Cache(dict):
    """Results by piece; emptied when it holds too many, so that memory stays bounded."""

    def __init__(self, make: Callable, most: int = 400_000) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
