"""Vocabulary files of public tokenizers, and cutting texts where a byte-level
pre-tokenizer always ends a token.

A vocabulary file is a parameter of the operators (a path the driver can
read). Its bytes, bounded by the vocabulary size (under 4 MB for the files
used here), are broadcast, so executors need no file of their own and a
replaced executor fetches them again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
from collections.abc import Callable

import pyarrow as pa

# The byte-level patterns have no alternative that crosses the places below,
# and none that looks back, so the text on either side can be matched alone:
# - a plain space after a character that is no white space;
# - in pieces without such spaces, other white space after a letter or digit,
#   and between a letter and a digit or closing punctuation.
SPACE_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85᠎])(?= )")
LONG_CUT = re.compile(r"(?<=[A-Za-z])(?=[0-9\n\t\r.,;:!?])|(?<=[0-9])(?=[A-Za-z\n\t\r.,;:!?])")
ONE_SPACE = re.compile(r" ?[^ ]+")
SPACE_AFTER_SPACE = re.compile(r"[\s\x1c-\x1f\x85᠎] ")
LONG_PIECE = 4096


def default_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def worker_cache(operator: str) -> dict:
    """A dict that outlives the tasks of one Python worker (built tokenizers). It
    holds nothing but values that can be computed again, and those of one
    operator only: a worker that is used for another one lets go of them."""
    held = sys.__dict__.setdefault("_optiq_llm_cache", {})
    if operator not in held:
        held.clear()
        pa.default_memory_pool().release_unused()
        held[operator] = {}
    return held[operator]


def rank_table(data: bytes) -> dict[bytes, int]:
    """token bytes -> id from a rank file (base64 token, space, id per line)."""
    return {base64.b64decode(tok): int(rank)
            for tok, rank in (line.split() for line in data.splitlines() if line.strip())}


def units(text: str) -> list[str]:
    """``text`` cut at safe places; the pieces joined give the text again.

    Usual prose is cut at every space; a space after another white-space
    character is no safe place and stays inside its piece. Pieces over
    ``LONG_PIECE`` characters are cut further at the other safe places; only a
    run without any of them stays as long as it is."""
    if text[-1:] == " " or SPACE_AFTER_SPACE.search(text):
        pieces = SPACE_CUT.split(text)
    else:
        pieces = ONE_SPACE.findall(text)
    if len(text) > LONG_PIECE and max(map(len, pieces)) > LONG_PIECE:
        pieces = [p for piece in pieces
                  for p in (LONG_CUT.split(piece) if len(piece) > LONG_PIECE else (piece,))]
    return pieces


class Memo(dict):
    """piece -> value, computed on first use. Bounded: long pieces are not kept,
    and a full table starts anew, so it changes speed and never results."""

    def __init__(self, compute: Callable[[str], object], entries: int = 250_000, longest: int = 40):
        super().__init__()
        self.compute, self.entries, self.longest = compute, entries, longest

    def __missing__(self, piece: str):
        value = self.compute(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[piece] = value
        return value
