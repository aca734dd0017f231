"""Seekable compressed frames: a text as independent zstandard frames.

Every frame can be decompressed by itself. Beside it stand the counts of what
lies before it (units, code points, bytes), so a place given in units is found
by bisection and one decompressed frame, and a text is read as a stream of
frames, never as a whole.

A unit is a run of non-blanks with the blanks before it; blanks at the end of a
text are one unit. So units begin at the first byte and wherever a blank
follows a non-blank; blanks are ASCII, whose bytes occur in no longer character.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

SIZE = 1 << 16  # bytes of text in a frame, at most
LEVEL = 3

KIND = "struct<n: long, chars: long, bytes: long, frames: array<struct<units: long, chars: long, bytes: long, data: binary>>>"
ARROW = pa.struct([
    ("n", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()),
    ("frames", pa.list_(pa.struct([("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())]))),
])


def _blank(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return (b == 32) | ((b >= 9) & (b <= 13))


def _inner_starts(data: bytes) -> np.ndarray:
    """Places after the first byte at which units begin."""
    blank = _blank(data)
    return np.flatnonzero(blank[1:] & ~blank[:-1]) + 1


def _chars(data: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def write(pieces: Iterable[bytes], size: int = SIZE, level: int = LEVEL) -> dict:
    """A stream of UTF-8 as frames of at most ``size`` bytes, which never cut a code point."""
    press = zstandard.ZstdCompressor(level=level)
    out = {"n": 0, "chars": 0, "bytes": 0, "frames": []}
    before_blank = True  # of the byte before; at the very start a unit begins anyway
    held = bytearray()

    def add(data: bytes) -> None:
        nonlocal before_blank
        blank = _blank(data)
        out["frames"].append({"units": out["n"], "chars": out["chars"], "bytes": out["bytes"], "data": press.compress(data)})
        out["n"] += len(_inner_starts(data)) + (out["bytes"] == 0 or bool(blank[0] and not before_blank))
        out["chars"] += _chars(data)
        out["bytes"] += len(data)
        before_blank = bool(blank[-1])

    for piece in pieces:
        held += piece
        while len(held) > size:
            cut = size
            while cut > 1 and held[cut] & 0xC0 == 0x80:
                cut -= 1
            add(bytes(held[:cut]))
            del held[:cut]
    if held:
        add(bytes(held))
    return out


class Text:
    """Reads a framed text (see ``write``) by places and as a stream."""

    def __init__(self, framed: dict):
        self.n, self.chars, self.bytes, self.frames = framed["n"], framed["chars"], framed["bytes"], framed["frames"]
        self.units = [f["units"] for f in self.frames]
        self.starts = [f["bytes"] for f in self.frames]
        self.press = zstandard.ZstdDecompressor()

    def data(self, k: int) -> bytes:
        return self.press.decompress(self.frames[k]["data"])

    def place(self, unit: int) -> tuple[int, int]:
        """Bytes and code points before a unit, from 0; of unit n, those of the text."""
        if unit >= self.n:
            return self.bytes, self.chars
        k = bisect_right(self.units, unit) - 1
        data, frame = self.data(k), self.frames[k]
        inner = _inner_starts(data)
        total = (self.units[k + 1] if k + 1 < len(self.units) else self.n) - frame["units"]
        order = unit - frame["units"] - (total - len(inner))  # -1: the frame's first byte begins the unit
        at = int(inner[order]) if order >= 0 else 0
        return frame["bytes"] + at, frame["chars"] + _chars(data[:at])

    def read(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """Bytes from start to end, a piece for each frame, in order."""
        end = self.bytes if end is None else end
        k = max(0, bisect_right(self.starts, start) - 1)
        while k < len(self.frames) and self.starts[k] < end:
            data = self.data(k)
            yield data[max(0, start - self.starts[k]) : end - self.starts[k]]
            k += 1

    def find(self, marks: list[bytes]) -> dict[bytes, int]:
        """First place of each mark (all of one length), in one pass over the frames."""
        found, rest, at = {}, b"", 0
        for piece in self.read():
            data = rest + piece
            for mark in marks:
                if mark not in found and (p := data.find(mark)) >= 0:
                    found[mark] = at + p
            rest = data[max(0, len(data) - len(marks[0]) + 1) :]
            at += len(data) - len(rest)
        return found
