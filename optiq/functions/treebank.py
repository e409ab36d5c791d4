"""Treebank word tokens of whole Arrow batches.

Texts without marks (quotes, brackets, clitics, ...) need few rewrites, which RE2 makes
over the batch; the others take all rewrites, one by one. ``\\s``, ``$`` and ``^`` mean
what they mean to Java's expressions. Equal texts of a batch are cut into words once.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Rules = list[tuple[str, str]]
BLANKS = r"[ \t\n\x0b\f\r]"
# ends of lines that are no white space to the rewrites but that ``$`` may stand before
LINE_ENDS = "[\u0085  ]"
_END = "(?:(?=(?:\r\n|[\r\u0085  ])\\Z)|(?<!\r)(?=\n\\Z)|\\Z)"


def _python(rules: Rules) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(p.removesuffix("$") + _END if p.endswith("$") else p, re.ASCII), by) for p, by in rules]


def tokenizer(rules: Rules, ends: Rules, marks: str, plain: tuple[int, ...], stops: str,
              lower: bool) -> Callable[[pa.Array], pa.ListArray]:
    """Texts -> lists of tokens (null: null)."""
    few = [(rules[i][0].replace(r"\s", BLANKS), rules[i][1]) for i in plain]
    all_, last = _python(rules), _python(ends)

    def rewritten(text: str) -> str:
        for pattern, by in all_:
            text = pattern.sub(by, text)
        text = f" {text} "
        for pattern, by in last:
            text = pattern.sub(by, text)
        return text

    def run(texts: pa.Array) -> pa.ListArray:
        texts = texts.cast(pa.string())
        marked = pc.fill_null(pc.or_(pc.match_substring_regex(texts, marks), pc.match_substring_regex(texts, LINE_ENDS)), False)
        simple = pc.fill_null(pc.and_not(pc.match_substring_regex(texts, stops), marked), False)
        if pc.any(simple).as_py():
            some = texts.filter(simple)
            for pattern, by in few:
                some = pc.replace_substring_regex(some, pattern, by)
            texts = pc.replace_with_mask(texts, simple, some)
        if pc.any(marked).as_py():
            texts = pc.replace_with_mask(texts, marked, pa.array([rewritten(x) for x in texts.filter(marked).to_pylist()], pa.string()))
        if lower:
            ascii_ = pc.string_is_ascii(texts)
            rest = pc.fill_null(pc.invert(ascii_), False)
            small = pc.ascii_lower(texts)
            texts = pc.replace_with_mask(small, rest, pa.array([x.lower() for x in texts.filter(rest).to_pylist()], pa.string()))
        if pc.any(pc.match_substring_regex(texts, r"[\t\n\x0b\f\r]")).as_py():
            texts = pc.replace_substring_regex(texts, BLANKS, " ")
        return _words(texts)

    return run


def _words(texts: pa.Array) -> pa.ListArray:
    """Split at spaces, without empty words."""
    cut = pc.split_pattern(texts, " ")
    words = cut.flatten()
    full = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    size = pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate(([0], np.cumsum(full)))
    offsets = upto[np.concatenate(([0], np.cumsum(size)))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(full)), mask=texts.is_null())
