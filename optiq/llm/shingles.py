"""Word shingles of whole texts as 64-bit hashes, vectorised over the bytes.

Words are maximal runs of bytes other than space and the controls 9 to 13;
A-Z are lower-cased, other characters stay. A word's hash is a polynomial in
an odd base over a table of random 64-bit values, read off prefix sums, so no
Python runs per word. A shingle is a window of ``width`` words; a text with
fewer words is one shingle of all of them, and one without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from optiq.llm import vocab

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
SLICE_BYTES = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (in place)."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def table64(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same on every machine."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * BASE + np.uint64(seed))


class Shingler:
    """Reusable tables; one per task."""

    def __init__(self, width: int = 5):
        self.width = width
        byte = np.arange(256)
        lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
        self.byte_value = table64(7, 256)[lower]
        self.space = np.isin(byte, [9, 10, 11, 12, 13, 32])
        self.place = table64(11, width + 1) | np.uint64(1)
        self.power = self.back = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * SLICE_BYTES)
            grow = np.full(n, BASE, dtype=np.uint64)
            grow[0] = 1
            self.power = np.multiply.accumulate(grow)
            grow[1:] = INVERSE
            self.back = np.multiply.accumulate(grow)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each word, index of its text), in order."""
        buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self._powers(len(buf))
        space = self.space[buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, end = edge[::2], edge[1::2]
        total = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(self.byte_value[buf] * self.power[:len(buf)], out=total[1:])
        hashes = mix64((total[end] - total[start]) * self.back[start])
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        return hashes, np.searchsorted(ends, start, side="right")

    def shingles(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(shingle hashes, offsets): text i has hashes[offsets[i]:offsets[i+1]]."""
        w, n = self.width, len(texts)
        hashes, owner = self.words(texts)
        per_text = np.bincount(owner, minlength=n)
        made = np.where(per_text >= w, per_text - w + 1, (per_text > 0).astype(np.int64))
        offsets = np.concatenate(([0], np.cumsum(made)))
        if not len(hashes):
            return np.empty(0, dtype=np.uint64), offsets
        # windows may run into the next text; those are dropped, short texts redone
        padded = np.concatenate((hashes, np.zeros(w - 1, dtype=np.uint64)))
        window = np.zeros(len(hashes), dtype=np.uint64)
        for j in range(w):
            window += padded[j:j + len(hashes)] * self.place[j]
        first = np.concatenate(([0], np.cumsum(per_text)))
        place_in_text = np.arange(len(hashes)) - first[owner]
        keep = place_in_text < made[owner]
        short = np.flatnonzero((per_text > 0) & (per_text < w))
        for i in short:
            words = hashes[first[i]:first[i + 1]]
            window[first[i]:first[i] + 1] = (words * self.place[:len(words)]).sum(
                keepdims=True, dtype=np.uint64) + self.place[w:] * np.uint64(len(words))
        return mix64(window[keep]), offsets

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The distinct shingles of each text, sorted."""
        hashes, offsets = self.shingles(texts)
        return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(first row, end row, bytes of each text) over an Arrow column of strings in
    slices of about ``limit`` bytes, so no batch is copied whole; null: empty."""
    vocab.worker_cache("shingles")
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = size = 0
    for i, n in enumerate(sizes.tolist()):
        if size and size + n > limit:
            yield at, i, [t or b"" for t in texts.slice(at, i - at).cast(pa.binary()).to_pylist()]
            at, size = i, 0
        size += n + 1
    if at < len(sizes):
        yield at, len(sizes), [t or b"" for t in texts.slice(at).cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """Ranges of texts of about ``limit`` bytes; a longer text is a range alone."""
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)
