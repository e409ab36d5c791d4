"""Conversation structure repair by Wagner-Fischer alignment to the turn grammar.

A conversation is well formed when its role initials match ``(s?(ua)+)?``: an
optional system turn, then user and assistant in turns. Each turn is kept (K, cost
0), gets the other role (R, 1) or is deleted (D, 2); empty turns are inserted
(I, 5). Blank and duplicate turns must be deleted; a truncated one adds 5 unless it
is deleted.

The target of each feasible length is a string of the alternating grammar. Targets
are suffixes of one another, so one matrix ``S[i][k]``, the cost of aligning the
turns from ``i`` on to the last ``k`` symbols, holds all of them; a leading system
turn is kept at any place before which all turns are deleted. Its rows are filled
from the last turn on in Ukkonen bands: with an incumbent cost C, a cell whose
length differs from the number of remaining turns by more than (C - required
deletions) / 5 above or / 2 below cannot lie on a cheaper path. A narrow band gives
the first incumbent; bands grow until one is as wide as its own incumbent implies,
which proves it. Every length of least cost is traced back, choosing the ASCII-least edit at each step, and the
least of these audits is taken.

Rows are vectors over the band; only every ``KEEP``-th is held and the ones
between are computed again in the trace, so memory goes with band times square
root of the number of turns.

Scale: faults, equal rows and order are found by Spark over all rows; what a
conversation brings into one task is a few bytes a turn, never its texts. Repaired
texts are hashed from a sorted stream, so a long conversation is never held whole.
Equal rows are counted before they are shuffled.

Null roles and texts are one space, so such texts are blank. Rows are ordered by
turn (nulls first), then role, then text; equal rows after the first are
duplicates. Null conversation ids are one conversation. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optiq.llm import vocab
from optiq.session import cut_lineage
from optiq.sources.tables import table

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NARROW, WIDEN, KEEP = 8, 3, 256
FAR = np.int64(1) << 60
ROLE = {"u": "user", "a": "assistant"}
SPACE = " \t\n\v\f\r"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``rows`` with planted faults, by a checksum of id and turn."""
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    h = F.crc32(named.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (rows.select("conv_id", "turn", h.alias("h"), role.alias("role"), text.alias("text")).where("h <> 0")
            .select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1)))
                              .otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy"))


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _truncated(text: Column) -> Column:
    last = F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))
    return ~last.isin(".", "!", "?")


def sequence(rows: DataFrame) -> DataFrame:
    """Distinct rows with ``n``, how often each stands, ``rank`` among those of one
    turn and role, and ``blank``, ``truncated`` and ``seen`` (its role and text
    stand at an earlier turn)."""
    plain = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"))
    once = (plain.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
            .withColumn("same", F.sha2("text", 256)))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    said = W.partitionBy("conv_id", "role", "same").orderBy(place)
    rank = W.partitionBy("conv_id", "turn", "role").orderBy("text")
    return (once.withColumn("seen", F.row_number().over(said) > 1)
            .withColumn("rank", F.row_number().over(rank)).drop("same")
            .withColumns({"blank": _blank(F.col("text")), "truncated": _truncated(F.col("text"))}))


def _band(required: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number of remaining symbols in each row."""
    n = len(required)
    free = np.concatenate((np.cumsum(~required[::-1])[::-1], [0]))
    low = np.maximum(0, free - budget // DELETE)
    high = free + budget // INSERT
    return low.astype(np.int64), np.minimum(high, n + 2 + budget // INSERT).astype(np.int64)


class Alignment:
    """S over the band of one incumbent cost, every ``KEEP``-th row held."""

    def __init__(self, initials: np.ndarray, required: np.ndarray, truncated: np.ndarray, budget: int):
        self.initials, self.required, self.truncated = initials, required, truncated
        self.low, self.high = _band(required, budget)
        n = len(initials)
        row = INSERT * np.arange(self.low[n], self.high[n] + 1, dtype=np.int64)
        self.held = {n: row}
        for i in range(n - 1, -1, -1):
            row = self._above(i, row)
            if i % KEEP == 0:
                self.held[i] = row
        self.first = row

    def _part(self, row: np.ndarray, i: int, low: int, high: int) -> np.ndarray:
        """Row i over the symbols low..high; beyond its band: FAR."""
        out = np.full(high - low + 1, FAR)
        a, b = max(low, self.low[i]), min(high, self.high[i])
        if a <= b:
            out[a - low:b - low + 1] = row[a - self.low[i]:b - self.low[i] + 1]
        return out

    def _above(self, i: int, below: np.ndarray) -> np.ndarray:
        low, high = self.low[i], self.high[i]
        k = np.arange(low, high + 1)
        best = self._part(below, i + 1, low, high) + DELETE
        if not self.required[i]:
            wanted = np.where(k % 2 == 1, ord("a"), ord("u"))
            change = np.where(wanted == self.initials[i], 0, REROLE) + TRUNCATED * self.truncated[i]
            best = np.minimum(best, self._part(below, i + 1, low - 1, high - 1) + change)
        return np.minimum(np.minimum.accumulate(best - INSERT * k) + INSERT * k, FAR)

    def rows(self, block: int) -> dict[int, np.ndarray]:
        """All rows of block ``block`` and the one below it."""
        n = len(self.initials)
        last = min(n, (block + 1) * KEEP)
        out = {last: self.held[last]}
        for i in range(last - 1, block * KEEP - 1, -1):
            out[i] = self._above(i, out[i + 1])
        return out

    def starts(self) -> tuple[int, list[tuple[int, int, bool]]]:
        """(least cost, [(first turn, remaining symbols, after a system turn)])."""
        n, (low, high) = len(self.initials), (self.low[0], self.high[0])
        k = np.arange(low, high + 1)
        cost = np.where(k % 2 == 0, self.first, FAR)
        best = int(cost.min(initial=FAR))
        found = [(0, int(x), False) for x in k[cost == best]] if best < FAR else []
        # a system turn that is kept after i deletions; more deletions first sort lower
        system: dict[int, int] = {}
        for i in np.flatnonzero((self.initials == ord("s")) & ~self.required).tolist():
            lead = DELETE * i + TRUNCATED * int(self.truncated[i])
            if DELETE * i > best:
                break
            row = self.held[i + 1] if i + 1 in self.held else self.rows((i + 1) // KEEP)[i + 1]
            k = np.arange(self.low[i + 1], self.high[i + 1] + 1)
            cost = np.where((k % 2 == 0) & (k >= 2), row, FAR) + lead
            now = int(cost.min(initial=FAR))
            if now < best:
                best, found, system = now, [], {}
            if now == best < FAR:
                system.update({int(x): i for x in k[cost == now]})
        return best, found + [(i, x, True) for x, i in system.items()]

    def traces(self, starts: list[tuple[int, int, bool]]) -> list[bytes]:
        """The ASCII-least edits of least cost for each target, block by block."""
        n = len(self.initials)
        going = [(i + system, k, bytearray(b"D" * i + b"K" * system)) for i, k, system in starts]
        for block in range(n // KEEP + 1):
            rows = self.rows(block)
            end = n if (block + 1) * KEEP > n else (block + 1) * KEEP - 1
            going = [self._along(t, rows, end) if t[0] <= end else t for t in going]
        return [bytes(out) for _, _, out in going]

    def _along(self, traced, rows: dict[int, np.ndarray], end: int):
        """The trace as far as it stays at turns up to ``end``."""
        i, k, out = traced
        n = len(self.initials)
        while i <= end and (i < n or k):
            here = rows[i]
            now = here[k - self.low[i]]
            if i < n:
                below, at = rows[i + 1], k - self.low[i + 1]
                if 0 <= at < len(below) and below[at] + DELETE == now:
                    out += b"D"
                    i += 1
                    continue
            at = k - 1 - self.low[i]
            if k and at >= 0 and here[at] + INSERT == now:
                out += b"I"
                k -= 1
                continue
            out += b"K" if self.initials[i] == (ord("a") if k % 2 else ord("u")) else b"R"
            i, k = i + 1, k - 1
        return i, k, out


def audit(initials: np.ndarray, required: np.ndarray, truncated: np.ndarray) -> tuple[int, str]:
    """(cost, edits) of the cheapest repair, ASCII-least among those of equal cost."""
    need = DELETE * int(required.sum())
    budget = NARROW
    while True:
        made = Alignment(initials, required, truncated, budget)
        cost, starts = made.starts()
        if cost - need <= budget:
            return cost, min(made.traces(starts)).decode()
        # at most the band that the incumbent implies; a wider one may find a better incumbent
        budget = min(WIDEN * budget, cost - need, DELETE * len(initials))


def repaired_roles(edits: str, initials: bytes) -> list[tuple[int, int, str]]:
    """(place, index of the turn or -1, new role or '') of each turn after the edits."""
    length = sum(e != "D" for e in edits)
    out, i = [], 0
    for e in edits:
        if e == "D":
            i += 1
            continue
        role = ROLE["a" if (length - len(out)) % 2 else "u"]
        out.append((len(out), -1 if e == "I" else i, "" if e == "K" else role))
        i += e != "I"
    return out


LONG_MAX = (1 << 63) - 1


def _audited(turns: list[dict]) -> dict:
    turns.sort(key=lambda t: (t["known"], t["turn"], t["role"], t["rank"]))
    repeat = np.array([t["n"] for t in turns])
    def each(name):
        return np.repeat(np.array([t[name] for t in turns]), repeat)
    later = np.ones(int(repeat.sum()), dtype=bool)
    later[np.cumsum(repeat) - repeat] = False
    blank, initials = each("blank"), np.repeat(np.array([ord(t["role"][:1] or "\0") for t in turns]), repeat)
    duplicate = ~blank & (each("seen") | later)
    cut = ~blank & ~duplicate & each("truncated")
    cost, edits = audit(initials, blank | duplicate, cut)
    known = [t["turn"] for t in turns if t["known"]]
    pairs = list(zip(initials[:-1].tolist(), initials[1:].tolist(), strict=True))
    legal = {(ord(a), ord(b)) for a, b in ("su", "ua", "au")}
    which = np.repeat(np.arange(len(turns)), repeat)
    made = repaired_roles(edits, initials)
    return {"gaps": min(max(known) - min(known) + 1 - len(set(known)), LONG_MAX) if known else 0,
            "blank": int(blank.sum()), "duplicate": int(duplicate.sum()), "truncated": int(cut.sum()),
            "illegal": sum(p not in legal for p in pairs), "cost": cost, "audit": edits,
            "turns": [{"place": p, "at": int(which[i]) if i >= 0 else -1, "role": r} for p, i, r in made],
            "order": [(t["known"], t["turn"], t["role"], t["rank"]) for t in turns]}


def audits(seq: DataFrame) -> DataFrame:
    """One row a conversation of ``sequence``: gaps, the faults, ``illegal`` neighbours,
    cost, audit, and ``turns``: the repaired turns, as place, known, turn, role and rank of the
    row that stays there (null: inserted) and the new role (null: its own)."""
    kind = pa.struct([("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                      ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
                      ("turns", pa.list_(pa.struct([
                          ("place", pa.int64()), ("known", pa.bool_()), ("turn", pa.int64()),
                          ("role", pa.string()), ("rank", pa.int64()), ("new_role", pa.string())])))])

    def run(values: pa.Array) -> pa.Array:
        vocab.worker_cache("turns")
        out = []
        for v in values:
            got = _audited(v.as_py())
            order = got.pop("order")
            got["turns"] = [dict(zip(("known", "turn", "role", "rank"),
                                     order[t["at"]] if t["at"] >= 0 else (None,) * 4, strict=True),
                                 place=t["place"], new_role=t["role"] or None) for t in got["turns"]]
            out.append(got)
        return pa.array(out, type=kind)

    ddl = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns "
           "array<struct<place: bigint, known: boolean, turn: bigint, role: string, rank: bigint, new_role: string>>")
    code = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                    "role", F.col("rank").cast("long").alias("rank"), "n", "blank", "truncated", "seen")
    gathered = seq.groupBy("conv_id").agg(F.collect_list(code).alias("codes"))
    return gathered.select("conv_id", F.arrow_udf(run, ddl).asNondeterministic()("codes").alias("a")) \
        .select("conv_id", "a.*")


def repaired(seq: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, role, text and ``edit`` (K, R or I) of the repaired turns."""
    turns = found.select("conv_id", F.explode("turns").alias("t")).select("conv_id", "t.*")
    texts = seq.select("conv_id", F.col("turn").isNotNull().alias("known"),
                       F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), "role",
                       F.col("rank").cast("long").alias("rank"), "text")
    new = turns.where("known IS NULL").select("conv_id", "place", F.col("new_role").alias("role"),
                                              F.lit("").alias("text"), F.lit("I").alias("edit"))
    on = F.expr("l.conv_id <=> r.conv_id AND l.known = r.known AND l.turn = r.turn AND l.role = r.role AND l.rank = r.rank")
    old = (turns.where("known IS NOT NULL").alias("l").join(texts.alias("r"), on)
           .select("l.conv_id", "l.place", F.coalesce("l.new_role", "l.role").alias("role"), "r.text",
                   F.when(F.col("l.new_role").isNull(), "K").otherwise("R").alias("edit")))
    return old.unionByName(new)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, from a stream sorted by place."""
    def run(batches):
        now, sha, none = object(), None, True
        for batch in batches:
            ids, done = [], []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if none or conv != now:
                    if not none:
                        ids.append(now)
                        done.append(sha.hexdigest())
                    now, sha, none = conv, hashlib.sha256(), False
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(done, pa.string())],
                                             names=["conv_id", "repaired_sha256"])
        if not none:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()])],
                                             names=["conv_id", "repaired_sha256"])

    return (turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
            .select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text")
            .mapInArrow(run, "conv_id long, repaired_sha256 string"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired turns) of conversations (conv_id, turn, role, text)."""
    seq = cut_lineage(sequence(rows))
    found = cut_lineage(audits(seq))
    return found, repaired(seq, found)


def summary(ids: DataFrame, found: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each conversation of ``ids``; those without turns have zeros."""
    nothing = hashlib.sha256().hexdigest()
    of = ids.select(F.col("conv_id").alias("id")).distinct()
    sums = digests(turns).withColumnRenamed("conv_id", "hashed")
    both = (of.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
            .join(sums, F.col("id").eqNullSafe(F.col("hashed")), "left"))
    count = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("id").alias("conv_id"), *count, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found, turns = repair(damaged(conversations))
    return summary(conversations, found, turns)
