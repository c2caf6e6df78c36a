"""Named arrays in one file that is mapped into memory, and a hash table of 64-bit keys made of such arrays."""

from __future__ import annotations

import io
import json

import numpy as np


def to_bytes(arrays: dict[str, np.ndarray], **notes) -> bytes:
    """A JSON head with each array's type, shape and place, then the arrays at multiples of 64 bytes; ``notes`` travel in the head."""
    body, head = io.BytesIO(), {}
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        body.write(b"\0" * (-body.tell() % 64))
        head[name] = (a.dtype.str, a.shape, body.tell())
        body.write(a.tobytes())
    text = json.dumps({"arrays": head, "notes": notes}).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return len(text).to_bytes(8, "little") + text + body.getvalue()


def mapped(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """(arrays, notes) of a file; processes on one machine share its pages."""
    raw = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    out = {}
    for name, (kind, shape, at) in head["arrays"].items():
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = raw[8 + n + at : 8 + n + at + size].view(kind).reshape(shape)
    return out, head["notes"]


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One well-spread 64-bit key for each row of several int64 columns."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ p.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


class Index:
    """Distinct int64 keys, well spread, to their places; open addressing, looked up for many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.slots = keys, _filled(keys)
        self.mask = len(self.slots) - 1

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, or -1."""
        at = wanted & self.mask
        out = np.asarray(self.slots[at]).astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.keys[np.maximum(out, 0)] != wanted)) if len(self.keys) else out[:0]
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.slots[at[todo]].astype(np.int64)
            out[todo] = found
            todo = todo[(found >= 0) & (self.keys[np.maximum(found, 0)] != wanted[todo])]
        return out


def _filled(keys: np.ndarray) -> np.ndarray:
    size = 1 << max(4, (4 * len(keys)).bit_length())
    slots = np.full(size, -1, np.int32)
    todo, at = np.arange(len(keys)), keys & (size - 1)
    while len(todo):
        free = slots[at[todo]] < 0
        slots[at[todo[free]]] = todo[free]  # of several for one slot the last stays
        todo = todo[slots[at[todo]] != todo]
        at[todo] = (at[todo] + 1) & (size - 1)
    return slots
