"""Token ids of texts by way of their distinct stretches, a whole Arrow batch at a time.

Where a text's ids are those of its stretches one after the other, a batch is
split and dictionary-encoded by Arrow, each stretch that is new is encoded once,
and the ids are gathered by NumPy.  Python touches distinct stretches only.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a longer text is cut into chunks of about as many characters.
TOGETHER = 4 << 20
#: Stretches that are remembered: two generations of so many, some 70 MB each.
HELD = 1 << 19
#: Stretches that outlast a task.
KEPT = 1 << 16
#: Closing punctuation between a letter or digit of the Latin blocks (but for one that lower-cases to two) and white space.
CLOSING = "([0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f])([.,;:!?]+)([ \\n\\t\\r]|$)"


def gathered_ranges(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[s : s + n] for each (s, n), one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


class Stretches:
    """learn gives the ids (little-endian unsigned 32-bit integers) of each of a list of distinct stretches."""

    def __init__(self, learn: Callable[[list[str]], list[bytes]], held: int = HELD):
        self.learn, self.held = learn, held
        self.known: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    def forget(self) -> None:
        """All but the KEPT that were met first, which the frequent ones are among."""
        self.known, self.elder = dict(itertools.islice(self.known.items(), KEPT)), {}

    def _found(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.held:  # the younger becomes the elder, so what is in use stays
            self.known, self.elder, new = {}, self.known, words
        known, elder = self.known, self.elder
        known.update((w, elder[w]) for w in new if w in elder)
        unknown = [w for w in new if w not in elder]
        if unknown:
            known.update(zip(unknown, self.learn(unknown), strict=True))
        return [known[w] for w in words]

    def ids(self, parts: pa.ListArray) -> list[np.ndarray]:
        """The ids of each list of stretches."""
        d = parts.flatten().dictionary_encode()
        table = self._found(d.dictionary.to_pylist())
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        at = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat = gathered_ranges(np.frombuffer(b"".join(table), "<u4"), (np.cumsum(sizes) - sizes)[at], sizes[at])
        offsets = parts.offsets.to_numpy().astype(np.int64)
        ends = np.concatenate(([0], np.cumsum(sizes[at])))[offsets - offsets[0]]
        return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def regrouped(batches: Iterable[pa.RecordBatch], text: int, together: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of the text column; a longer text is alone in its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        for k, n in enumerate(sizes.tolist()):
            if size and size + n > together:
                yield _joined([*held, b.slice(start, k - start)])
                held, size, start = [], 0, k
            size += n
        if start < len(sizes):
            held.append(b.slice(start))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    found = [b for b in batches if b.num_rows]
    return found[0] if len(found) == 1 else pa.concat_batches(found)
