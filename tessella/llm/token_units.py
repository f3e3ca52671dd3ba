"""Byte-level BPE text encoding by cached units, for use inside tasks.

Under the byte-level patterns white space only ever begins a token's match, so
a match always ends where white space follows something else.  A text cut there
falls into units that encode one by one; frequent units are encoded once.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from types import ModuleType

import numpy as np

#: Unicode White_Space, as the pattern's \s sees it.
_RARE = "\t\x0b\x0c\r\x85\xa0  -     　"
_WS = "\n " + _RARE
_UNIT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_PAIRS = ("  ", " \n", "\n ", "\n\n")
_LONGEST = 48
_SPACES = [c.encode() for c in map(chr, range(0x3001)) if re.match(f"[{_WS}]", c)]
_NARROW = np.isin(np.arange(256), [c[0] for c in _SPACES if len(c) == 1])
_WIDE = {n: [int.from_bytes(c) for c in _SPACES if len(c) == n] for n in (2, 3)}


def units(text: str) -> list[str]:
    """The units of a text; joined they are the text again."""
    return _UNIT.findall(text)


def unit_begins(text: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which UTF-8 bytes of whole texts begin a unit; the texts begin at ``rows``."""
    space = _NARROW[text]
    for n, wide in _WIDE.items():
        lead = np.isin(np.arange(256), [w >> 8 * (n - 1) for w in wide])
        at = np.flatnonzero(lead[text])
        code = sum(text[at + i].astype(np.uint32) << np.uint32(8 * (n - 1 - i)) for i in range(n))
        at = at[np.isin(code, wide)]
        for i in range(n):
            space[at + i] = True
    begins = np.append(False, space[1:] & ~space[:-1])[: len(text)]
    begins[rows[rows < len(text)]] = True
    return begins


class _Kept(dict):
    """Values by unit; what is missing is made, and kept while there is room."""

    def __init__(self, make: Callable[[str], object], size: int) -> None:
        self.make, self.size = make, size

    def __missing__(self, unit: str) -> object:
        got = self.make(unit)
        if len(unit) <= _LONGEST and len(self) < self.size:
            self[unit] = got
        return got


class Units:
    """Encodes texts unit by unit: ``encode(unit)`` gives what is kept per unit.

    At most ``size`` units are kept; all others are encoded where they occur.
    """

    def __init__(self, encode: Callable[[str], object], size: int = 300_000) -> None:
        self.raw = _Kept(encode, size)
        # units after a space go by what follows it, those after a line feed with it
        self.plain = _Kept(lambda p: encode(p if p[:1] == "\n" else " " + p), size)

    def __call__(self, text: str) -> list:
        if any(p in text for p in _PAIRS) or any(c in text for c in _RARE):
            return list(map(self.raw.__getitem__, _UNIT.findall(text)))
        pieces = text.replace("\n", " \n").split(" ")
        if text[:1] == "\n":  # the space before a leading line feed is not in the text
            del pieces[0]
        out = list(map(self.plain.__getitem__, pieces))
        out[0] = self.raw[pieces[0]]
        return out


def kept_in_worker(name: tuple, make: Callable[[], object]) -> object:
    """A value that the tasks of one Python worker share; it lives as long as the
    worker does."""
    holder = sys.modules.setdefault("tessella_worker", ModuleType("tessella_worker"))
    values = holder.__dict__.setdefault("values", {})
    if name not in values:
        values[name] = make()
    return values[name]
