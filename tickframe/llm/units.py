"""Splitting texts at boundaries that no token crosses, so that a text's tokens are those of its distinct parts.

A unit starts before each space or newline that follows a character which isn't white space. Natural text repeats its
units, so each distinct unit is encoded once a batch and remembered (in a memory of bounded size), and a very long text
costs no more than its units.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Some white space (by any library's rule) before a space or newline: such texts are split by the slower, exact rule.
_RUN = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}][ \n]"
_SPLIT = re.compile(r"(?<=\S)(?=[ \n])")

#: Texts are gathered to batches of about this many bytes before they are encoded.
BATCH_BYTES = 3 << 20


def balanced(batches, column: str = "text", most: int = BATCH_BYTES):
    """The record batches cut into slices of about `most` bytes of text, however long single texts are."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size) // most
        for at in np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []:
            yield b.slice(at, int(np.searchsorted(part, part[at], "right")) - at)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct units, the units of all texts as numbers of these, offsets of the texts in that)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    slow = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
    offsets, flat = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
    offsets = offsets - offsets[0]
    # each part but a text's first had a space before it, unless that space was put there for a newline
    spaced = pc.starts_with(flat, "\n").to_numpy(zero_copy_only=False) == 0
    spaced[offsets[:-1][np.diff(offsets) > 0]] = False
    flat = pc.if_else(pa.array(spaced), pc.binary_join_element_wise(pa.scalar("", pa.large_string()), flat, pa.scalar(" ", pa.large_string())), flat)
    if slow.any():
        lists = [_SPLIT.split(t) if s else None for t, s in zip(texts.to_pylist(), slow)]
        pieces, sizes = [], []
        for i, x in enumerate(lists):
            pieces.append(pa.array(x, pa.large_string()) if x is not None else flat.slice(offsets[i], offsets[i + 1] - offsets[i]))
            sizes.append(len(pieces[-1]))
        flat, offsets = pa.concat_arrays(pieces), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    coded = pc.dictionary_encode(flat)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values in each range between offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


#: Bytes that a remembered entry takes beside its key and value, about.
ENTRY = 150


class Memory:
    """A cache of bounded bytes in two generations: when the young one is full it becomes the old one, which is dropped."""

    def __init__(self, most: int = 20 << 20):
        self.most = most
        self.clear()

    def clear(self) -> None:
        """Forget all: a task's memory ends with it."""
        self.young, self.old, self.size = {}, {}, 0

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        self.size += ENTRY + (len(key) if isinstance(key, str) else 0) + (len(value) if isinstance(value, bytes) else 0)
        self.young[key] = value
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
