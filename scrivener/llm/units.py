"""White-space units of a text and a bounded per-worker memo of their ids.

``word_bpe`` style tokenizers drop white space and never merge across it, so
a text's ids are those of its white-space units in order.  Units repeat, so
each worker encodes a unit once and looks it up afterwards.  The memo is a
cache: past its bound further units are encoded anew in each batch, with the
same result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

#: str.split() also splits at these four; the tokenizers' \s does not.
ODD = re.compile("[\x1c-\x1f]")
#: Bytes of a dictionary entry, its key and its value without their content.
ENTRY = 200
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def units(text: str) -> list[str]:
    if ODD.search(text):
        return [u for u in SPACE.split(text) if u]
    return text.split()


class Memo:
    """unit -> value, by ``encode(list of units)`` for those not yet known.

    ``size(value)``: bytes of a value.  The memo holds at most ``most`` bytes,
    object overhead included, and no unit longer than ``long`` characters."""

    def __init__(self, encode: Callable[[Sequence[str]], Sequence], size: Callable, most: int = 32 << 20, long: int = 64):
        self.encode, self.size, self.most, self.long, self.known, self.held = encode, size, most, long, {}, 0

    def lookup(self, lists: Sequence[list[str]]) -> Callable:
        """A function unit -> value that knows every unit of ``lists``."""
        new: set[str] = set()
        for xs in lists:
            new.update(xs)
        new = [u for u in new if u not in self.known]
        values = dict(zip(new, self.encode(new))) if new else {}
        rest = {}
        for u, v in values.items():
            if self.held < self.most and len(u) <= self.long:
                self.known[u] = v
                self.held += ENTRY + len(u) + self.size(v)
            else:
                rest[u] = v
        if not rest:
            return self.known.__getitem__
        known = self.known
        return lambda u: known[u] if u in known else rest[u]
