"""A minimal acyclic transducer from words to token ids, as flat arrays that are memory-mapped.

States share suffixes; each arc carries the number of words that come before it in order, so the sum along a word is its place
among the words, which points to its ids. The arrays: ``first[s] .. first[s+1]`` are the arcs of state s, ``label`` (a byte, sorted),
``target``, ``skip``; ``final[s]``; ``start[w] .. start[w+1]`` are word w's places in ``ids``.
"""

from __future__ import annotations

import io
from bisect import bisect_left

import numpy as np

NAMES = ("first", "label", "target", "skip", "final", "start", "ids")


def build(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """The transducer of ``entries``, built word by word in sorted order with a register of finished states."""
    register: dict[tuple, int] = {}
    done: list[tuple[bool, tuple]] = []

    def finish(node) -> int:
        key = (node[0], tuple(node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(done)
            done.append(key)
        return at

    path: list[list] = [[False, []]]  # the open states of the word so far: final, arcs (label, state)
    labels: list[int] = []
    words = sorted(entries)
    for word in words:
        common = 0
        while common < len(labels) and common < len(word) and labels[common] == word[common]:
            common += 1
        while len(labels) > common:
            state = finish(path.pop())
            path[-1][1].append((labels.pop(), state))
        for byte in word[common:]:
            labels.append(byte)
            path.append([False, []])
        path[-1][0] = True
    while labels:
        state = finish(path.pop())
        path[-1][1].append((labels.pop(), state))
    root = finish(path[0])
    count = np.zeros(len(done), np.int64)
    first, label, target, skip = [0], [], [], []
    for at, (final, arcs) in enumerate(done):  # targets are finished before their sources
        seen = int(final)
        for byte, to in arcs:
            label.append(byte)
            target.append(to)
            skip.append(seen)
            seen += int(count[to])
        count[at] = seen
        first.append(len(label))
    sizes = [len(entries[w]) for w in words]
    return {
        "first": np.array([*first, root], np.int32),
        "label": np.array(label, np.uint8),
        "target": np.array(target, np.int32),
        "skip": np.array(skip, np.int32),
        "final": np.array([f for f, _ in done], np.bool_),
        "start": np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
        "ids": np.array([i for w in words for i in entries[w]], np.int32),
    }


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a table of (dtype, length, offset) as a numpy header, then the arrays at multiples of 64 bytes."""
    head = np.zeros((len(NAMES), 3), np.int64)
    body = io.BytesIO()
    for k, name in enumerate(NAMES):
        a = arrays[name]
        body.write(b"\0" * (-body.tell() % 64))
        head[k] = (ord(a.dtype.char), len(a), body.tell())
        body.write(a.tobytes())
    return head.tobytes() + body.getvalue()


class Lexicon:
    """A transducer file, mapped into memory; processes on one machine share its pages."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        base = len(NAMES) * 24
        for name, (kind, length, offset) in zip(NAMES, raw[:base].view(np.int64).reshape(-1, 3).tolist()):
            dtype = np.dtype(chr(kind))
            setattr(self, name, memoryview(np.asarray(raw[base + offset : base + offset + length * dtype.itemsize].view(dtype))))  # plain numbers at each place
        self.root = self.first[-1]

    def get(self, word: bytes) -> list[int] | None:
        """The ids of ``word``, or None if it is not in the lexicon."""
        state, place = self.root, 0
        first, label, target, skip = self.first, self.label, self.target, self.skip
        for byte in word:
            b = first[state + 1]
            at = bisect_left(label, byte, first[state], b)
            if at == b or label[at] != byte:
                return None
            place += skip[at]
            state = target[at]
        if not self.final[state]:
            return None
        return self.ids[self.start[place] : self.start[place + 1]].tolist()
