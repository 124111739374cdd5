"""Token ids of whole texts with the tokenizers library, one encoder per Python worker.

Encoding speed is bound by the merge loop of the library, and prose repeats its words. Both vocabularies used here split
a text before they merge, and never merge over a space that is followed by a non-space. So a text is cut at its spaces,
every different field is encoded once by the library and kept in a bounded cache, and the ids of the fields are joined.
A text for which that cut is not safe (two spaces in a row, a space beside other white space, a special token's
string) is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np

CACHED_FIELDS = 400_000
KEPT_LENGTH = 12  # longer fields seldom come back
ID = np.dtype("<u4")
UNSAFE = re.compile(r" (?=\s|\Z)")  # the next field is empty or begins with white space


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if visible, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


BYTE_LETTERS = _byte_letters()
MARKS = ".,;:!?#%&*$@+=-_/|~^()[]{}\""


class FieldEncoder:
    """Little-endian unsigned 32-bit ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merge = self.library.model.tokenize
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        steps = spec.get("pre_tokenizer") or {}
        parts = steps.get("pretokenizers", [steps])
        byte_level = [p for p in parts if p.get("type") == "ByteLevel"]
        if not byte_level or byte_level[0].get("add_prefix_space"):
            raise ValueError(f"{path}: not a vocabulary whose texts can be cut at spaces")
        # The space belongs to the field after it, unless the pre-tokenizer removes white space.
        self.lead = "" if any(p.get("type") == "Split" and p.get("behavior") == "Removed" for p in parts) else " "
        self.normalise = self.library.normalizer.normalize_str if self.library.normalizer else str
        # What the normaliser makes of ASCII letters: itself, or lower case, which then is done for a whole text at once.
        letters = "AbCxYZ"
        self.lower = self.normalise(letters) == letters.lower()
        self.plain = self.lower or self.normalise(letters) == letters
        self.fields: dict[str, bytes] = {}
        self.halves: dict[str, bytes] = {}  # words after a line break; no field of a text starts with white space
        self.line_break = self._library(["\n"])[0]
        self.runs: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=ID).tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _normal(self, word: str) -> str:
        return self.normalise(word) if not self.plain or not word.isascii() else word.lower() if self.lower else word

    def _word(self, lead: str, word: str) -> bytes:
        """Ids of normalised letters only: one piece, so the model's merges alone decide."""
        word = lead + word
        piece = BYTE_LETTERS[32] * len(lead) + word[len(lead):] if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.merge(piece)]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; ``None`` counts as an empty text."""
        if len(self.fields) + len(self.halves) > CACHED_FIELDS:
            self.fields, self.halves = {}, {}
        known, fresh, cut, whole = self.fields.get, set(), [], []
        for at, text in enumerate(texts):
            text = text or ""
            if self.lower and text.isascii():
                text = text.lower()
            head, *rest = text.split(" ")
            ids = list(map(known, rest))
            new = [f for f, i in zip(rest, ids) if i is None] if None in ids else []
            if any(s in text for s in self.special) or new and UNSAFE.search(text):
                whole.append(at)
                cut.append(None)
                continue
            fresh.update(new)
            cut.append((head, rest, ids, bool(new)))
        fresh = self._learn(fresh)
        heads = iter(self._library([c[0] for c in cut if c is not None]))
        wholes = iter(self._library([texts[at] for at in whole]))
        out = []
        for c in cut:
            if c is None:
                out.append(next(wholes))
                continue
            _, rest, ids, new = c
            if new:
                ids = [i if i is not None else fresh[f] for f, i in zip(rest, ids)]
            out.append(next(heads) + b"".join(ids))
        return out

    def _learn(self, fields: set[str]) -> dict[str, bytes]:
        """Ids of new fields; short ones are kept. Letters and a run of marks after them are always two pieces, and so
        are a single line break and what stands on either side of it."""
        fresh, halves, other, kept, runs, lead = {}, {}, [], self.fields, self.runs, self.lead
        for f in fields:
            if f.isascii() and f.isalpha():  # no marks, no line break, and letters stay letters
                if f not in fresh:
                    fresh[f] = self._word(lead, self._normal(f))
                continue
            line, broken, after = f.partition("\n")
            ids = b""
            for side, space in ((line, lead), (after, "")) if broken else ((f, lead),):
                word = side.rstrip(MARKS)
                run = side[len(word):]
                if not word.isalpha() or run and run not in runs and not self._run(run):
                    other.append(f)
                    break
                old, new = (kept, fresh) if space == lead else (self.halves, halves)
                known = old.get(word) or new.get(word)
                if known is None:
                    normal = self._normal(word)
                    if not normal.isalpha():  # a letter that became a letter and a mark
                        other.append(f)
                        break
                    known = new[word] = (b"" if space == lead else self.line_break) + self._word(space, normal)
                ids += known + runs[run] if run else known
            else:
                fresh[f] = ids
        fresh.update(zip(other, self._library([lead + f for f in other])))
        kept.update((f, i) for f, i in fresh.items() if len(f) <= KEPT_LENGTH)
        self.halves.update((w, i) for w, i in halves.items() if len(w) < KEPT_LENGTH)
        return fresh

    def _run(self, run: str) -> bytes:
        """Ids of a run of marks, kept if short."""
        ids = self._library([run])[0] if len(run) <= 8 else b""
        if ids:
            self.runs[run] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> FieldEncoder:
    """The worker's encoder for a vocabulary file; it outlives a task where Spark reuses workers."""
    return FieldEncoder(path)
