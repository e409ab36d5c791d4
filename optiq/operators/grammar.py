"""Grammar checks as token patterns: rules are data, compiled to one automaton.

A rule is a name, a pattern and exceptions. A pattern is a list of elements, each
matching one token: words (``should|would``, any case) or a shape (``@lower``, see
``SHAPES``); ``@same`` is the token before once more. ``?`` after an element makes it
optional, ``+`` lets it repeat. Exceptions are word sequences that are no fault.

All rules run at once, in one pass over a text's tokens: the automaton holds, for
every place in a pattern that it has reached, the leftmost start. A match is a rule,
a start and an end; for each end the leftmost start counts, and of matches of one rule
that overlap the first one stays, the longest of those with its start.

Texts are rows of Arrow batches; what a token can match is looked up once per
distinct token of a batch, and pairs of neighbours tell where a match can begin: only
there the automaton runs. Null texts have no tokens.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optiq.operators.textsim import treebank

SHAPES: dict[str, Callable[[str], bool]] = {
    "word": lambda t: t[:1].isalpha(),
    "lower": lambda t: t[:1].islower(),
    "upper": lambda t: t[:1].isupper(),
    "vowel": lambda t: t[:1].lower() in set("aeio"),
    "consonant": lambda t: t[:1].isalpha() and t[:1].lower() in set("bcdfgjklmnpqrstvwxyz"),
    "number": lambda t: re.fullmatch(r"[0-9][0-9.,]*", t) is not None,
    "end": lambda t: t in {".", "!", "?"},
    "mark": lambda t: t in {",", ";", ":", ".", "!", "?"},
    "clause": lambda t: t in {",", ";", ":"},
    "ly": lambda t: len(t) > 4 and t.lower().endswith("ly"),
    "er": lambda t: t.lower() in {"better", "worse", "bigger", "smaller", "easier", "larger", "older", "faster", "higher", "lower"},
}


class Rule(NamedTuple):
    name: str
    pattern: str
    exceptions: tuple[str, ...] = ()


# ---- the rule table -------------------------------------------------------------
RULES = (
    Rule("doubled_word", "@word @same", ("had had", "that that", "very very")),
    Rule("a_before_vowel", "a @vowel", ("a one", "a once", "a european", "a euro")),
    Rule("an_before_consonant", "an @consonant", ("an x", "an mp", "an nfl", "an fbi", "an sms")),
    Rule("modal_of", "should|would|could|must|might not? of", ("must of course", "could of course")),
    Rule("modal_to", "must|should|could|would|might @ly? to"),
    Rule("double_comparative", "more|most @er"),
    Rule("then_for_than", "@er then"),
    Rule("more_then", "more|less|rather|other then"),
    Rule("singular_after_number", "two|three|four|five|six|seven|eight|nine|ten|many|several @ly? person|child|man|woman|foot|mouse"),
    Rule("lower_after_stop", "@end @lower"),
    Rule("marks_in_a_row", "@clause @mark+"),
    Rule("to_past", "to went|took|gave|made|saw|knew|came|told"),
    Rule("did_past", "did|does|do not|n't? went|took|gave|saw|knew|came|told"),
    Rule("their_is", "their|your is|are|was|were"),
    Rule("very_run", "very very very+"),
)
# ---------------------------------------------------------------------------------


class Element(NamedTuple):
    words: frozenset[str]
    shape: str | None
    optional: bool
    repeats: bool


def element(text: str) -> Element:
    optional, repeats = text.endswith("?") and len(text) > 1, text.endswith("+") and len(text) > 1
    text = text[:-1] if optional or repeats else text
    if text.startswith("@"):
        if text[1:] != "same" and text[1:] not in SHAPES:
            raise ValueError(f"unknown shape {text}")
        return Element(frozenset(), text[1:], optional, repeats)
    return Element(frozenset(w.lower() for w in text.split("|")), None, optional, repeats)


def fits(e: Element, token: str, before: str | None) -> bool:
    if e.shape == "same":
        return before is not None and token.lower() == before.lower()
    return SHAPES[e.shape](token) if e.shape else token.lower() in e.words


class Automaton:
    """All rules compiled: places are numbered over all patterns."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = tuple(rules)
        self.elements: list[Element] = []
        self.follow: list[list[int]] = []     # places that wait after this place has matched
        self.accepts: list[int | None] = []   # the rule that is complete then
        self.first: list[int] = []
        self.exceptions = [frozenset(tuple(x.split()) for x in r.exceptions) for r in self.rules]
        for n, rule in enumerate(self.rules):
            elements = [element(x) for x in rule.pattern.split()]
            if all(e.optional for e in elements):
                raise ValueError(f"rule {rule.name} matches nothing")
            base = len(self.elements)

            def waiting(p: int, elements=elements, base=base) -> list[int]:
                """Places that can match next, from p on."""
                out = []
                while p < len(elements):
                    out.append(base + p)
                    if not elements[p].optional:
                        break
                    p += 1
                return out

            for p, e in enumerate(elements):
                self.elements.append(e)
                self.follow.append(([base + p] if e.repeats else []) + waiting(p + 1))
                self.accepts.append(n if all(x.optional for x in elements[p + 1:]) else None)
            self.first += waiting(0)
        self.relative = [p for p, e in enumerate(self.elements) if e.shape == "same"]
        self.by_word: dict[str, list[int]] = {}
        self.by_shape: dict[str, list[int]] = {}
        for p, e in enumerate(self.elements):
            for w in e.words:
                self.by_word.setdefault(w, []).append(p)
            if e.shape and e.shape != "same":
                self.by_shape.setdefault(e.shape, []).append(p)
        # tokens that match the same places are of one kind
        self.kinds: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.known: dict[str, int] = {}

    def kind(self, token: str) -> int:
        held = self.known.get(token)
        if held is None:
            if len(self.known) >= 200_000:
                self.known.clear()
            places = frozenset(self.by_word.get(token.lower(), [])).union(
                *[p for shape, p in self.by_shape.items() if SHAPES[shape](token)])
            held = self.known[token] = self.kinds.setdefault(places, len(self.sets))
            if held == len(self.sets):
                self.sets.append(places)
        return held

    def places(self, token: str) -> frozenset[int]:
        """Places that the token matches whatever stands before it."""
        return self.sets[self.kind(token)]

    def live(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Places in the flat tokens of all lists where a match can begin: the token fits a
        first place, and it ends a rule or the next token of its list fits what follows.
        Then the lists' offsets, and the tokens as places in their vocabulary."""
        offsets = tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
        words = tokens.flatten().dictionary_encode()
        ids, known, n = words.indices.to_numpy(), words.dictionary.to_pylist(), len(words)
        if not n:
            return np.empty(0, np.int64), offsets, ids, known
        kind = np.array([self.kind(t) for t in known])
        lowered = pc.ascii_lower(words.dictionary)
        other = pc.invert(pc.string_is_ascii(words.dictionary))
        lowered = pc.replace_with_mask(lowered, other, pa.array([t.lower() for t in lowered.filter(other).to_pylist()], pa.string()))
        low = lowered.dictionary_encode().indices.to_numpy()
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        same = np.zeros(n, bool)
        if self.relative:
            same[1:] = low[ids[1:]] == low[ids[:-1]]
            same &= ~first[:n]
        # a row for each kind of token, then the same ones as repeated tokens, then none
        kinds = len(self.sets)
        fit = np.zeros((2 * kinds + 1, len(self.elements)), bool)
        for k, held in enumerate(self.sets):
            fit[[k, k + kinds], :] = [p in held for p in range(len(self.elements))]
        fit[kinds:-1, self.relative] = True
        begins = np.zeros((len(fit), len(fit)), bool)
        for p in self.first:
            goes_on = fit[:, self.follow[p]].any(axis=1) | (self.accepts[p] is not None)
            begins |= fit[:, p][:, None] & goes_on[None, :]
        own = kind[ids] + same * kinds
        after = np.where(first[1:], len(fit) - 1, np.append(own[1:], 0))
        return np.flatnonzero(begins[own, after]), offsets, ids, known

    def batch_matches(self, tokens: pa.ListArray) -> Iterator[tuple[int, list[str], list[tuple[int, int, int]]]]:
        """(row, tokens, matches) of the lists that have any."""
        at, offsets, ids, known = self.live(tokens)
        if not len(at):
            return
        rows = np.searchsorted(offsets, at, "right") - 1
        cuts = np.flatnonzero(np.diff(rows, prepend=-1))
        for a, b in zip(cuts, np.append(cuts[1:], len(at)), strict=True):
            row = int(rows[a])
            low, high = offsets[row], offsets[row + 1]
            own = [known[k] for k in ids[low:high].tolist()]
            if found := self.matches(own, (at[a:b] - low).tolist()):
                yield row, own, found

    def matches(self, tokens: list[str], starts: Iterable[int] | None = None) -> list[tuple[int, int, int]]:
        """(rule, start, end) in order of start; ends are exclusive. With ``starts``
        (ascending) matches begin at these places only."""
        waits: dict[int, int] = {}
        found: dict[tuple[int, int], int] = {}
        begin = iter(range(len(tokens)) if starts is None else starts)
        start_at, i = next(begin, None), 0
        while waits or start_at is not None:
            if not waits:
                i = start_at
            if i >= len(tokens):
                break
            token = tokens[i]
            hits = self.places(token)
            if self.relative and i and token.lower() == tokens[i - 1].lower():
                hits = hits.union(self.relative)
            after: dict[int, int] = {}
            if i == start_at:
                start_at = next(begin, None)
                for p in self.first:
                    if p in hits and p not in waits:
                        self._step(p, i, i, after, found)
            for p, start in waits.items():
                if p in hits:
                    self._step(p, start, i, after, found)
            waits, i = after, i + 1
        return self._kept(tokens, found)

    def _step(self, p: int, start: int, i: int, after: dict[int, int], found: dict[tuple[int, int], int]) -> None:
        for q in self.follow[p]:
            after[q] = min(start, after.get(q, start))
        if (rule := self.accepts[p]) is not None:
            found[rule, i + 1] = min(start, found.get((rule, i + 1), start))

    def _kept(self, tokens: list[str], found: dict[tuple[int, int], int]) -> list[tuple[int, int, int]]:
        spans = sorted((rule, start, -end) for (rule, end), start in found.items())
        out, last, reach = [], None, 0
        for rule, start, end in spans:
            if rule != last:
                last, reach = rule, 0
            if start >= reach and tuple(t.lower() for t in tokens[start:-end]) not in self.exceptions[rule]:
                out.append((rule, start, -end))
                reach = -end
        return sorted(out, key=lambda m: (m[1], m[0]))


SPAN = "array<struct<rule: string, start: int, n_tokens: int, words: string>>"
_SPANS = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("n_tokens", pa.int32()), ("words", pa.string())]))


def rule_spans(text: Column, rules: Iterable[Rule] = RULES) -> Column:
    """The matches in a text: rule, first token, number of tokens, and the words."""
    rules = tuple(rules)
    automaton, words = Automaton(rules), treebank("treebank_cased")  # a broken rule is an error here
    names = [r.name for r in rules]

    def run(batch: pa.Array) -> pa.Array:
        tokens = words(batch)
        size, rows = np.zeros(len(tokens), np.int64), []
        for row, own, found in automaton.batch_matches(tokens):
            size[row] = len(found)
            rows += [(names[r], a, b - a, " ".join(own[a:b])) for r, a, b in found]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SPANS.value_type, strict=True)],
                                          fields=list(_SPANS.value_type))
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), flat)

    return F.arrow_udf(lambda batch: run(batch), SPAN).asNondeterministic()(text)


def rule_counts(text: Column, rules: Iterable[Rule] = RULES) -> Column:
    """struct<n, n_faults>: number of tokens of a text, and of its matches."""
    automaton, words = Automaton(rules), treebank("treebank_cased")

    def run(batch: pa.Array) -> pa.Array:
        tokens = words(batch)
        faults = np.zeros(len(tokens), np.int32)
        for row, _, found in automaton.batch_matches(tokens):
            faults[row] = len(found)
        return pa.StructArray.from_arrays([pc.fill_null(pc.list_value_length(tokens), 0), pa.array(faults)], names=["n", "n_faults"])

    return F.arrow_udf(lambda batch: run(batch), "n int, n_faults int").asNondeterministic()(text)


def grammar_spans(df: DataFrame, keys: list[str], text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """keys, rule, start, n_tokens, words: a row for each match."""
    found = df.select(*keys, rule_spans(F.col(text), rules).alias("_spans"))
    return found.select(*keys, F.inline("_spans"))


def grammar_scores(df: DataFrame, keys: list[str], text: str = "text", rules: Iterable[Rule] = RULES) -> DataFrame:
    """keys, n_faults, ``inverse`` = 1 / (1 + faults) and ``ratio`` = 1 - faults / tokens
    (faults at most one a token; 1 for no tokens)."""
    found = df.select(*keys, rule_counts(F.col(text), rules).alias("_c")).select(*keys, F.col("_c.n").alias("_n"), "_c.n_faults")
    n = F.col("_n")
    return found.select(*keys, "n_faults", (F.lit(1.0) / (F.lit(1.0) + F.col("n_faults"))).alias("inverse"),
                        F.when(n > 0, F.lit(1.0) - F.least(F.col("n_faults"), n) / n).otherwise(F.lit(1.0)).alias("ratio"))
