"""Two Bloom filters over packed 64-bit hashes: what was seen once, and what was seen twice.

A task fills its own pair; pairs merge as ``twice = twice1 | twice2 | (once1 & once2)``,
``once = once1 | once2``, so a hash that stands in two places is always in the second
filter, and one that stands in one place is there only by chance. Filters travel in
segments of 2**16 bits, as the positions set, so a task sends two bytes a bit; a
segment's pair is merged from a sorted stream. Only the second filter goes to the driver
and is broadcast: ``MOST_BITS`` bits (32 MB) at most. Two bits are set for each hash.

With more hashes than ``MOST_BITS`` a filter of that size would hold nearly everything:
``filter_bits`` is then 0, callers make none and pass all hashes on to the exact step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from optiq.llm.shingles import BASE

SEGMENT = 1 << 16
LEAST_BITS, MOST_BITS, BITS_A_HASH = 1 << 20, 1 << 28, 16
#: Hashes whose bits a task holds before it sends them on.
FLUSH = 1 << 20

PAIR = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The two bits of each hash, as two columns."""
    both = np.empty((len(hashes), 2), dtype=np.uint64)
    both[:, 0] = hashes
    both[:, 1] = (hashes * BASE) >> np.uint64(16)
    both &= np.uint64(bits - 1)
    return both


def _segments(positions: np.ndarray) -> dict[int, bytes]:
    """segment -> its set positions, as sorted unsigned 16-bit integers."""
    if not len(positions):
        return {}
    positions = np.unique(positions)
    segment = (positions >> np.uint64(16)).astype(np.int64)
    at = np.flatnonzero(np.diff(segment, prepend=-1))
    low = (positions & np.uint64(SEGMENT - 1)).astype("<u2")
    return {int(segment[a]): low[a:b].tobytes() for a, b in zip(at, [*at[1:], len(low)], strict=True)}


def _own_pairs(batches, bits: int, stride: int):
    """What a task has seen once and twice, by segment, for every ``FLUSH`` hashes."""
    def pairs(parts):
        hashes, count = np.unique(np.concatenate(parts), return_counts=True)
        once = _segments(places(hashes, bits).ravel())
        twice = _segments(places(hashes[count > 1], bits).ravel())
        names = list(once)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int32()), pa.array([once[s] for s in names], pa.binary()),
             pa.array([twice.get(s, b"") for s in names], pa.binary())], schema=PAIR)

    held, n = [], 0
    for batch in batches:
        own = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u8")[::stride]
        if len(own):
            held.append(own)
            n += len(own)
        if n >= FLUSH:
            yield pairs(held)
            held, n = [], 0
    if held:
        yield pairs(held)


def _merged(batches):
    """The twice-seen bits of each segment, from a stream in order of segments."""
    def packed(segment, twice):
        return pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()),
                                           "twice": [np.packbits(twice, bitorder="little").tobytes()]})

    now, once, twice = None, None, None
    for batch in batches:
        for segment, one, two in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if segment != now:
                if now is not None and twice.any():
                    yield packed(now, twice)
                now, once, twice = segment, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
            one, two = np.frombuffer(one, dtype="<u2"), np.frombuffer(two, dtype="<u2")
            twice[one[once[one]]] = True
            twice[two] = True
            once[one] = True
    if now is not None and twice.any():
        yield packed(now, twice)


def filter_bits(n: int) -> int:
    """Bits of each filter for so many hashes; 0: more than ``MOST_BITS``, no filter."""
    if n > MOST_BITS:
        return 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, BITS_A_HASH * n - 1).bit_length()))


def seen_twice(df: DataFrame, column: str, bits: int, stride: int = 1) -> Broadcast[bytes]:
    """The filter of hashes that may stand in two places or more. ``column`` holds packed
    64-bit integers; every ``stride``-th is a hash."""
    pairs = df.select(column).mapInArrow(lambda b: _own_pairs(b, bits, stride),
                                         "segment int, once binary, twice binary")
    merged = (pairs.repartition("segment").sortWithinPartitions("segment")
              .mapInArrow(_merged, "segment int, twice binary"))
    whole = np.zeros(bits // 8, dtype=np.uint8)
    for r in merged.toLocalIterator():
        at = r.segment * SEGMENT // 8
        whole[at:at + SEGMENT // 8] = np.frombuffer(r.twice, dtype=np.uint8)
    return df.sparkSession.sparkContext.broadcast(whole.tobytes())


def holds(twice: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may have been seen twice."""
    held = np.frombuffer(twice, dtype=np.uint8)
    place = places(hashes, len(held) * 8)
    bit = held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)
    return bit.all(axis=1)
