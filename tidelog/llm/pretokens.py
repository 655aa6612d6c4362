"""Ids of white-space chunks, each made once and kept.

No token of the vocabularies used here crosses ASCII white space, so a text's ids are
those of its chunks in order. A chunk that is one run of Latin letters, with a full stop or
comma after it at most, is a pre-token or two: the run in lower case goes straight to the
library's model, under the byte-level alphabet. All other chunks, and all chunks if the
library's own answer to a set of probes differs, go to the library whole.
"""

from __future__ import annotations

import re
from array import array

_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")
_PROBES = "a the Quick zxqvw Été größe Ñandú naïve, End. Ångström thntblere þðÿ Øre. of, I".split()
#: Entries that a worker keeps in either table; beyond it a table starts anew. Results don't depend on it.
KEPT = 300_000


def byte_alphabet() -> dict[int, str]:
    """The character of each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class PreTokens:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.alphabet = byte_alphabet()
        self.runs: dict[str, bytes] = {}
        self.marks = {"": b"", ".": self.whole("."), ",": self.whole(",")}
        self.plain = True
        self.plain = all(self.of(p) == self.whole(p) for p in _PROBES)

    def whole(self, chunk: str) -> bytes:
        return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def parts(self, chunk: str) -> tuple[str, ...]:
        """The pre-tokens of a chunk: a run of letters in lower case and the mark after it; a chunk of any other kind is its own part."""
        m = self.plain and _PLAIN.fullmatch(chunk)
        return (chunk,) if not m else (m[1].lower(), m[2]) if m[2] else (m[1].lower(),)

    def count(self, part: str) -> int:
        """How many pieces one of parts() has; no ids are made of a run of letters."""
        m = self.plain and _PLAIN.fullmatch(part)
        if not m or m[2]:
            return len(self.library.encode(part, add_special_tokens=False))
        return len(self.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(self.alphabet)))

    def of(self, chunk: str) -> bytes:
        """The ids of a chunk, 4 bytes each."""
        m = self.plain and _PLAIN.fullmatch(chunk)
        if not m:
            return self.whole(chunk)
        run = m[1].lower()
        ids = self.runs.get(run)
        if ids is None:
            if len(self.runs) > KEPT:
                self.runs = {}
            spelt = run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
            ids = self.runs[run] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return ids + self.marks[m[2]]
