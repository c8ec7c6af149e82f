"""Parts of a text that byte-level pre-tokenization treats on their own."""

from __future__ import annotations

import re
from collections.abc import Callable

#: A lone space between two characters that aren't white space always begins a new pre-token.
_CUT = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> list[str]:
    """The text cut before each such space; joined with a space, the parts give the text again. '' gives ['']."""
    return _CUT.split(text)


class ChunkCache:
    """What a function makes of each part, kept for parts seen before; shared by the tasks of one Python worker.

    Two generations of `most` parts at most are kept; parts used again move to the newer one.
    """

    def __init__(self, make: Callable[[str], bytes], most: int = 400_000, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def keep(self, part: str, made: bytes) -> bytes:
        if len(part) <= self.longest:
            if len(self.new) >= self.most:
                self.old, self.new = self.new, {}
            self.new[part] = made
        return made

    def known(self, part: str) -> bytes | None:
        found = self.old.get(part)
        return found if found is None else self.keep(part, found)

    def _miss(self, part: str) -> bytes:
        found = self.known(part)
        return self.keep(part, self.make(" " + part)) if found is None else found

    def of(self, text: str) -> list[bytes]:
        """One result for each part; all but the first are made with their leading space."""
        if not text:
            return []
        parts = chunks(text)
        new, miss = self.new, self._miss
        out = [self.make(parts[0])]
        for p in parts[1:]:
            made = new.get(p)
            if made is None:
                made = miss(p)
                new = self.new
            out.append(made)
        return out
