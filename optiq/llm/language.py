"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of labelled text.
A text is parsed greedily against each automaton: a phrase is the longest match
of the text's next characters anywhere in the sample, then the next phrase
begins; a byte that the sample doesn't have opens a phrase. Text of the
sample's language falls into few, long phrases. A phrase costs
log2(sample length) bits (a pointer into the sample), a byte that the sample
lacks ``LITERAL`` bits more (it has to be spelled out, so a tiny sample gains
nothing by failing to match), and the language that needs the fewest bits wins; ``score`` is its share of the likelihood,
1 / sum over languages of 2 ** (its bits - their bits).

Texts are lower-cased and reduced to runs of letters joined by one space. They
are parsed whole, in blocks of ``BLOCK`` bytes that advance side by side
through a dense transition table, so a very long text is just many blocks.

The sample is bounded by parameters: per language ``rows`` labelled rows, those
of smallest hash, with a window of ``chars`` characters from each (default 64
thousand characters a language, about 17 MB of table in each worker). It is
the only thing that reaches the driver; it is broadcast as text and each worker
builds the automata once. Languages are the distinct non-null labels of the
training rows, so labels must come from a code list.

Null texts and texts without a letter give ``und`` with score 0; so does every
text when nothing was learned. Equal bits are settled by the smaller label.
Repeated rows get equal results. Extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from optiq.llm import vocab
from optiq.sources.tables import table

BLOCK = 256
LANES = 8192
LETTERS = regex.compile(r"\p{L}+")
#: Bits of a byte that a sample lacks.
LITERAL = 8
#: Set on a transition that ends a phrase.
BREAK = 1 << 30


def letters(text: str) -> bytes:
    """Lower-cased runs of letters, joined by one space, in UTF-8."""
    return " ".join(LETTERS.findall(text.lower())).encode("utf-8", "surrogatepass")


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


class Parser:
    """Automata of all languages over one alphabet of byte symbols."""

    def __init__(self, samples: list[tuple[str, list[bytes]]]):
        seen = sorted({b for _, texts in samples for t in texts for b in t})
        # 0: a byte of no sample; then the bytes seen; then the sample separator; padding
        self.symbol = np.zeros(256, dtype=np.int32)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        self.separator, self.padding = len(seen) + 1, len(seen) + 2
        self.width = len(seen) + 3
        self.languages, self.tables, self.cost = [], [], []
        self.lacks = np.ones((self.width, len(samples)), dtype=np.int64)
        for lang, texts in samples:
            symbols: list[int] = []
            for t in texts:
                symbols.extend(self.symbol[np.frombuffer(t, dtype=np.uint8)].tolist())
                symbols.append(self.separator)
            self.lacks[symbols, len(self.languages)] = 0
            self.languages.append(lang)
            self.tables.append(self._dense(suffix_automaton(symbols)))
            self.cost.append(np.log2(max(len(symbols), 2)))

    def _dense(self, moves: list[dict[int, int]]) -> np.ndarray:
        """Row offsets of the next state; without a transition, a new phrase
        begins with the symbol (or, if no sample has it, after it)."""
        w = self.width
        root = np.full(w, BREAK, dtype=np.int32)
        for c, s in moves[0].items():
            root[c] = s * w + BREAK
        out = np.tile(root, (len(moves), 1))
        at = np.array([i for i, m in enumerate(moves) for _ in m], dtype=np.int64)
        by = np.array([c for m in moves for c in m], dtype=np.int64)
        out[at, by] = np.array([s * w for m in moves for s in m.values()], dtype=np.int32)
        out[:, self.padding] = np.arange(len(moves), dtype=np.int32) * w
        return out.ravel()

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases of each text (row) by language (column)."""
        blocks = [-(-len(t) // BLOCK) for t in texts]
        owner = np.repeat(np.arange(len(texts)), blocks)
        flat = np.full(len(owner) * BLOCK, self.padding, dtype=np.int32)
        at = 0
        for t, n in zip(texts, blocks, strict=True):
            flat[at:at + len(t)] = self.symbol[np.frombuffer(t, dtype=np.uint8)]
            at += n * BLOCK
        lanes = flat.reshape(-1, BLOCK)
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        for a in range(0, len(lanes), LANES):
            steps = np.ascontiguousarray(lanes[a:a + LANES].T)
            for j, dense in enumerate(self.tables):
                state = np.zeros(steps.shape[1], dtype=np.int32)
                ended = np.ones(steps.shape[1], dtype=np.int32)  # the phrase open at the end
                move, flag = np.empty_like(state), np.empty_like(state)
                for row in steps:
                    np.add(state, row, out=state)
                    np.take(dense, state, out=move, mode="clip")
                    np.right_shift(move, 30, out=flag)
                    np.add(ended, flag, out=ended)
                    np.bitwise_and(move, BREAK - 1, out=state)
                out[:, j] += np.bincount(owner[a:a + LANES], ended, len(texts)).astype(np.int64)
        return out

    def literals(self, texts: list[bytes]) -> np.ndarray:
        """Number of bytes of each text (row) that a language's sample lacks (column)."""
        counts = np.zeros((len(texts), self.width), dtype=np.int64)
        for i, t in enumerate(texts):
            counts[i] = np.bincount(self.symbol[np.frombuffer(t, dtype=np.uint8)], minlength=self.width)
        return counts @ self.lacks

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        plain = [letters(t) if t else b"" for t in texts]
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        bits = self.phrases(plain) * np.array(self.cost) + LITERAL * self.literals(plain)
        best = bits.argmin(axis=1)
        gap = bits.min(axis=1, keepdims=True) - bits
        score = 1.0 / np.exp2(np.maximum(gap, -1000.0)).sum(axis=1)
        return [(self.languages[b], float(s)) if p else ("und", 0.0)
                for p, b, s in zip(plain, best, score, strict=True)]


class Model:
    """The bounded sample of labelled text, broadcast to the tasks."""

    def __init__(self, spark: SparkSession, samples: list[tuple[str, list[bytes]]]):
        self.samples = spark.sparkContext.broadcast(samples)
        self.key = hashlib.sha256(repr(samples).encode()).hexdigest()
        self.languages = [lang for lang, _ in samples]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, rows: int = 256, chars: int = 256) -> Model:
    """A model from the labelled rows of ``docs`` (doc_id, text, lang) outside
    the held-out quarter: at most ``rows`` windows of ``chars`` a language."""
    n = F.char_length("text")
    begin = F.pmod(F.xxhash64("doc_id", F.lit("begin")), F.greatest(n - chars, F.lit(0)) + 1) + 1
    known = (docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
                        & F.coalesce(~held_out(F.col("doc_id")), F.lit(True)))
             .select("lang", "doc_id", F.xxhash64("doc_id", F.lit("rows")).alias("h"),
                     F.substring(F.col("text"), begin.cast("int"), F.lit(chars)).alias("t")))
    pick = W.partitionBy("lang").orderBy("h", "doc_id", "t")
    kept = known.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= rows)
    found: dict[str, list[bytes]] = {}
    for lang, text in kept.orderBy("lang", "r").select("lang", "t").collect():
        found.setdefault(lang, []).append(letters(text))
    samples = [(lang, [t for t in found[lang] if t]) for lang in sorted(found)]
    return Model(docs.sparkSession, [s for s in samples if s[1]])


def _parser(samples, key) -> Parser:
    cache = vocab.worker_cache("language")
    if key not in cache:
        cache.clear()
        cache[key] = Parser(samples.value)
    return cache[key]


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with columns ``lang_pred`` and ``score``."""
    samples, key = model.samples, model.key
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def run(texts: pa.Array) -> pa.Array:
        parser = _parser(samples, key)
        out = []
        for a in range(0, len(texts), 512):
            out.extend(parser.predict(texts.slice(a, 512).to_pylist()))
        return pa.array([{"lang_pred": p, "score": s} for p, s in out], type=kind)

    found = F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()
    rows = docs.drop("lang_pred", "score")
    return (rows.select(F.struct("*").alias("row"), found(F.col(text)).alias("found"))
            .select("row.*", "found.lang_pred", "found.score"))


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` in a learned language, with their own columns: all
    but ``und``, however close the languages are."""
    found = identify(docs.select(F.struct("*").alias("row"), "text"), model)
    return found.where(F.col("lang_pred") != "und").select("row.*")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "lang_pred", "score")
