"""Sequences of different lengths side by side, for recursions that walk whole documents token by token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Packed:
    """Sequences longest first; the tokens that stand at place t of all those longer than t lie together.

    A recursion over t then works on one slice a step, and those that end drop off the end of the slice."""

    def __init__(self, sequences: list[np.ndarray]):
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.lengths = sizes[self.order]
        steps = int(self.lengths.max(initial=0))
        self.active = np.searchsorted(-self.lengths, -np.arange(steps), "left")
        self.begin = np.cumsum(self.active) - self.active
        self.row = np.repeat(np.arange(len(sizes)), self.lengths)
        within = np.arange(len(self.row)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        #: Where each token of the sequences, one after the other in `order`, lies in a packed array.
        self.place = self.begin[within] + self.row
        flat = np.concatenate([sequences[i] for i in self.order]) if len(sequences) else np.zeros(0, np.int64)
        self.values = np.empty_like(flat)
        self.values[self.place] = flat

    def steps(self) -> list[tuple[int, int, int]]:
        """(t, first token, end) of each place t."""
        return [(t, int(a), int(a + n)) for t, (a, n) in enumerate(zip(self.begin, self.active))]

    def unpacked(self, packed: np.ndarray) -> list[np.ndarray]:
        """The parts of a packed array that belong to each sequence, in the sequences' own order."""
        out: list[np.ndarray] = [packed[:0]] * len(self.order)
        for i, part in zip(self.order, np.split(packed[self.place], np.cumsum(self.lengths)[:-1])):
            out[i] = part
        return out


def alike(sequences: list[np.ndarray], at_most: int) -> Iterator[list[int]]:
    """Positions of sequences in groups of similar length, of about at_most tokens each."""
    group, tokens = [], 0
    for i in sorted(range(len(sequences)), key=lambda i: -len(sequences[i])):
        group.append(i)
        tokens += len(sequences[i])
        if tokens >= at_most:
            yield group
            group, tokens = [], 0
    if group:
        yield group
