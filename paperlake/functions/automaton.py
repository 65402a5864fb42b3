"""Find many terms in many texts at once: an Aho-Corasick automaton in flat arrays, run over UTF-8 bytes.

The automaton is a table of next states by byte class, so its size is known before it is built. It reads all texts of a
batch in lockstep: they are cut into windows of one length, which overlap by as much as the longest term needs, and
each step moves every window by one byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_CELLS = 1 << 24  # of a table of next states: 64 MB
WINDOW = 1024  # bytes that a window adds
BATCH_BYTES = 8 << 20  # of text read in lockstep


@dataclass
class Automaton:
    classes: np.ndarray  # of each byte; 0 for bytes in no term
    n_classes: int
    next: np.ndarray  # next state, by state * n_classes + class
    term: np.ndarray  # number of the term that ends in a state, or -1
    suffix: np.ndarray  # the longest proper suffix of a state in which a term ends, or 0
    longest: int  # bytes of the longest term


def _spans(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and where each begins; nulls are empty."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    body = array.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def build(terms: pa.Array) -> Automaton:
    """An automaton for distinct, non-empty terms; they are told apart by their place."""
    data, offsets = _spans(terms)
    present = np.unique(data)
    classes = np.zeros(256, dtype=np.int64)
    classes[present] = np.arange(1, len(present) + 1)
    width = len(present) + 1
    starts, lengths = offsets[:-1], np.diff(offsets)
    state = np.zeros(len(starts), dtype=np.int64)
    ends = np.zeros(len(starts), dtype=np.int64)
    levels, made = [], 1  # of a level: parent and class of each new state
    for depth in range(int(lengths.max(initial=0))):
        alive = np.flatnonzero(lengths > depth)
        edges, which = np.unique(state[alive] * width + classes[data[starts[alive] + depth]], return_inverse=True)
        state[alive] = made + which
        done = alive[lengths[alive] == depth + 1]
        ends[done] = state[done]
        levels.append((edges // width, edges % width))
        made += len(edges)
    term = np.full(made, -1, dtype=np.int64)
    term[ends] = np.arange(len(ends))
    term[0] = -1
    table = np.zeros((made, width), dtype=np.int32)
    fail, suffix = np.zeros(made, dtype=np.int64), np.zeros(made, dtype=np.int64)
    first = 1
    for depth, (parent, cls) in enumerate(levels):
        child = np.arange(first, first + len(parent))
        if depth:  # what a state lacks, the state of its longest suffix has
            fail[child] = table[fail[parent], cls]
        table[parent, cls] = child
        suffix[child] = np.where(term[fail[child]] >= 0, fail[child], suffix[fail[child]])
        if depth + 1 < len(levels):
            table[child] = table[fail[child]]
        first += len(parent)
    if levels:
        table[child] = table[fail[child]]
    return Automaton(classes.astype(np.int32), width, table.reshape(-1), term, suffix, int(lengths.max(initial=0)))


def _windows(offsets: np.ndarray, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, bytes) of windows that together hold every stretch of ``overlap + 1`` bytes of a text."""
    lengths = np.diff(offsets)
    count = np.maximum(-(-(lengths - overlap) // WINDOW), (lengths > 0).astype(np.int64))
    row = np.repeat(np.arange(len(lengths)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + place * WINDOW
    return row, start, np.minimum(WINDOW + overlap, offsets[row + 1] - start)


def _read(automaton: Automaton, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every term that occurs in a row, once."""
    row, start, size = _windows(offsets, automaton.longest - 1)
    order = np.argsort(-size, kind="stable")
    row, start, size = row[order], start[order], size[order]
    read = automaton.classes[data]
    ending = (automaton.term >= 0) | (automaton.suffix > 0)
    state = np.zeros(len(row), dtype=np.int32)
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")  # windows with a byte there
    found = [np.zeros(0, dtype=np.int64)]
    made, held = len(automaton.term), 0
    for at, n in enumerate(alive.tolist()):
        state = automaton.next[state[:n].astype(np.int64) * automaton.n_classes + read[start[:n] + at]]
        hit = np.flatnonzero(ending[state])
        if len(hit):
            found.append(row[hit] * made + state[hit])
            held += len(hit)
            if held > 4_000_000:
                found, held = [np.unique(np.concatenate(found))], 0
    pairs = np.unique(np.concatenate(found))
    rows, terms = [], []
    while len(pairs):
        at, state_ = pairs // made, pairs % made
        ends = automaton.term[state_] >= 0
        rows.append(at[ends])
        terms.append(automaton.term[state_[ends]])
        shorter = automaton.suffix[state_]
        pairs = np.unique(at[shorter > 0] * made + shorter[shorter > 0])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(rows) * len(automaton.term) + np.concatenate(terms))
    return both // len(automaton.term), both % len(automaton.term)


def hits(automaton: Automaton, texts: pa.Array) -> pa.Array:
    """For each text the numbers of the terms that occur in it, as list<int>; none for a null."""
    data, offsets = _spans(texts)
    lists, sizes, row = [], [], 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + BATCH_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(texts))
        part = offsets[row : end + 1] - offsets[row]
        if automaton.longest and part[-1]:
            at, term = _read(automaton, data[offsets[row] : offsets[end]], part)
        else:
            at, term = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lists.append(term.astype(np.int32))
        sizes.append(np.bincount(at, minlength=end - row))
        row = end
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
    values = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int32()))
