"""Greedy word alignment of a pair of token lists, linear in their length.

The hypothesis is read from its last token on; each token takes the last free
reference token that is equal to it, then (second pass over what is left) the last
one of equal stem, then the last one that shares a synset. Runs over Arrow batches;
what one pair needs at a time is its own tokens.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from optiq.functions.stemmer import porter_stem

Match = tuple[int, int]


def last_to_last(h: Sequence, r: Sequence, at_h: Sequence[int], at_r: Sequence[int]) -> list[Match]:
    """Matches of equal entries among the places ``at_h`` and ``at_r`` (ascending)."""
    places = defaultdict(list)
    for j in at_r:
        places[r[j]].append(j)
    found = []
    for i in reversed(at_h):
        if held := places.get(h[i]):
            found.append((i, held.pop()))
    return found


def by_members(h: list[tuple[int, list]], r: list[tuple[int, list]]) -> list[Match]:
    """Matches of entries (place, members) that share a member: every h entry, from the
    last on, takes the last free r entry among its members' ones."""
    places = defaultdict(list)
    for j, members in sorted(r):
        for m in set(members):
            places[m].append(j)
    used, found = set(), []
    for i, members in sorted(h, reverse=True):
        best = -1
        for m in set(members):
            held = places.get(m, [])
            while held and held[-1] in used:
                held.pop()
            if held:
                best = max(best, held[-1])
        if best >= 0:
            used.add(best)
            found.append((i, best))
    return found


def n_chunks(matches: list[Match]) -> int:
    """Runs of matches that go on in both texts."""
    matches = sorted(matches)
    return sum(k == 0 or matches[k - 1] != (i - 1, j - 1) for k, (i, j) in enumerate(matches))


def _offsets(lists: pa.Array) -> list[int]:
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(size))).tolist()


def _aligned(hs: pa.Array, rs: pa.Array, stems: bool):
    """For each pair: matches, and the places that stay free on either side."""
    h_at, r_at = _offsets(hs), _offsets(rs)
    words = pa.concat_arrays([pc.list_flatten(hs), pc.list_flatten(rs)]).dictionary_encode()
    ids = words.indices.to_numpy(zero_copy_only=False)
    stem_ids = ids
    if stems and len(ids):
        stem_ids = pa.array([porter_stem(w) for w in words.dictionary.to_pylist()]).dictionary_encode() \
            .indices.to_numpy(zero_copy_only=False)[ids]
    n = h_at[-1]
    for a, b, c, d in zip(h_at[:-1], h_at[1:], r_at[:-1], r_at[1:], strict=True):
        h, r = ids[a:b].tolist(), ids[n + c:n + d].tolist()
        found = last_to_last(h, r, range(len(h)), range(len(r)))
        if stems:
            taken_h, taken_r = {i for i, _ in found}, {j for _, j in found}
            free_h = [i for i in range(len(h)) if i not in taken_h]
            free_r = [j for j in range(len(r)) if j not in taken_r]
            if free_h and free_r:
                found += last_to_last(stem_ids[a:b].tolist(), stem_ids[n + c:n + d].tolist(), free_h, free_r)
        yield found, len(h), len(r)


def token_lists(hs: pa.Array, rs: pa.Array, words: Callable[[pa.Array], pa.ListArray]) -> tuple[pa.Array, pa.Array]:
    """The token lists of both sides' texts; equal texts are cut once."""
    texts = pa.concat_arrays([hs.cast(pa.string()), rs.cast(pa.string())]).dictionary_encode()
    lists = words(texts.dictionary).take(texts.indices)
    return lists.slice(0, len(hs)), lists.slice(len(hs))


COUNTS = pa.struct([("m", pa.int64()), ("chunks", pa.int64())])
MATCHES = pa.struct([("h", pa.list_(pa.int32())), ("r", pa.list_(pa.int32()))])


def match_counts(h: Column, r: Column, stems: bool, words: Callable[[pa.Array], pa.ListArray] | None = None) -> Column:
    """struct<m, chunks, h_len, r_len> of two token lists (a null list: no tokens), or of
    two texts that ``words`` makes token lists of, each text of a batch once.

    Marked non-deterministic only so that the optimizer never evaluates it, and the
    token lists, once for each field used."""
    def run(hs: pa.Array, rs: pa.Array) -> pa.Array:
        if words is not None:
            hs, rs = token_lists(hs, rs, words)
        return pa.array([{"m": len(f), "chunks": n_chunks(f), "h_len": n, "r_len": m}
                         for f, n, m in _aligned(hs, rs, stems)],
                        type=pa.struct([*COUNTS, ("h_len", pa.int64()), ("r_len", pa.int64())]))

    return F.arrow_udf(run, "m long, chunks long, h_len long, r_len long").asNondeterministic()(h, r)


def matched_places(h: Column, r: Column, stems: bool) -> Column:
    """struct<h, r>: the places of the matches."""
    def run(hs: pa.Array, rs: pa.Array) -> pa.Array:
        return pa.array([{"h": [i for i, _ in f], "r": [j for _, j in f]} for f, _, _ in _aligned(hs, rs, stems)],
                        type=MATCHES)

    return F.arrow_udf(run, "h array<int>, r array<int>").asNondeterministic()(h, r)


def with_members(matches: Column, left: Column) -> Column:
    """struct<m, chunks> of matches and of what ``left`` (array of side, p, members) adds."""
    return F.arrow_udf(lambda found, rest: added(found, rest), "m long, chunks long")(matches, left)


def added(found: pa.Array, rest: pa.Array) -> pa.Array:
    """COUNTS of each pair, taken one by one: a batch as Python objects is many times its bytes."""
    out = []
    for a, b in zip(found, rest, strict=True):
        f, x = a.as_py(), b.as_py()
        sides = [[(e["p"], e["members"]) for e in x or () if e["side"] == s] for s in (1, 2)]
        all_ = list(zip(f["h"], f["r"], strict=True)) + by_members(*sides)
        out.append({"m": len(all_), "chunks": n_chunks(all_)})
    return pa.array(out, type=COUNTS)
