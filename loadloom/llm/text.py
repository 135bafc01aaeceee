"""Words, shingles and hashes shared by the text operators. Nothing here touches Spark."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Rows, and bytes of text, that a task holds as Python values at a time.
PORTION = (2048, 4 << 20)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Odd multipliers, one for each place of a word in a shingle; the last is mixed in for texts of under five words.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def portions(batch: pa.RecordBatch, text: int = 1, most: tuple[int, int] = PORTION) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most so many rows and bytes of column ``text``; a longer text is one by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        end = min(max(int(np.searchsorted(ends, before + most[1], "right")), at + 1), at + most[0])
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])


_held: dict[Hashable, object] = {}


def held[T](name: Hashable, make: Callable[[], T]) -> T:
    """What a worker holds from task to task, of one operator at a time: another one's is let go first, as workers outlive stages."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]


def space_words(text: str | None) -> list[bytes]:
    """Maximal runs without space, tab, line feed, vertical tab, form feed or carriage return; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


class WordHashes(dict):
    """64-bit word hashes, remembered; emptied when large, so a task's memory is bounded."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(words: list[bytes], hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``k`` words; of the whole sequence where there are fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    n = len(words) - k + 1
    s = h[:n] * PLACES[0]
    for j in range(1, k):
        s = s + h[j : n + j] * PLACES[j]
    return np.unique(mix(s))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())
