"""Token ids of whole texts, with a bounded memory of what was encoded before."""

from __future__ import annotations

import os
import re
from array import array

#: White space as Unicode has it, which the vocabularies' own patterns mean by \s.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: What the byte-level pre-tokenizer cuts apart at white space: a space goes with what follows it, other white space
#: stands alone, of several the last one apart if something follows.
_PIECES = re.compile(rf" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: Marks that often end a word, none of which begins a contraction.
_MARKS = ".,;:!?#$%&*"
#: Letters that no normalization changes but for their case, each of which has one lower-case letter.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f"
_WORD, _WORD_OR_SPACED = re.compile(f"[{_LETTERS}]+"), re.compile(f" ?[{_LETTERS}]+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The character by which byte-level vocabularies name each byte: itself if it can be printed, else 256 and on.
_BYTE_NAMES = {b: b if b in _PRINTABLE else 256 + b - sum(p < b for p in _PRINTABLE) for b in range(256)}
_encoders: dict[tuple[str, int], "Encoder"] = {}


class Encoder:
    """Encodes texts through the tokenizers library, unit by unit.

    Strings of special tokens, which the library cuts out first, are units.
    Else a unit is a run of characters between spaces (``keeps_space`` False:
    the vocabulary drops white space, so units are independent) or a piece
    that a byte-level vocabulary's own pre-tokenizer cuts at white space. The
    units' ids are remembered: twice ``memory`` of them at most, beside those
    of the texts at hand.
    """

    def __init__(self, path: str, memory: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.keeps_space = bool(self.tokenizer.encode("a b", add_special_tokens=False).ids != self.tokenizer.encode("a  b", add_special_tokens=False).ids)
        # The shortcut is for the two kinds of vocabulary that it was written for; it has to give the library's own ids.
        self._word = _WORD_OR_SPACED if self.keeps_space else _WORD
        tried = ["Zebra", " quartz" if self.keeps_space else "quartz", "Straße", "naïveté"]
        if any([t.id for t in self.tokenizer.model.tokenize((u if self.keeps_space else u.lower()).encode().decode("latin-1").translate(_BYTE_NAMES))] != self.tokenizer.encode(u, add_special_tokens=False).ids for u in tried):
            self._word = re.compile(r"(?!)")
        self.memory, self.known = memory, {}

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """A unit of plain Latin letters is one word to the vocabulary's pre-tokenizer, so the library's model gets it
        at once; others go through all of the library."""
        words = [u for u in units if self._word.fullmatch(u)]
        if len(words) < len(units):
            plain = set(words)
            others = [u for u in units if u not in plain]
            found = {u: array("I", e.ids).tobytes() for u, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False))}
        else:
            found = {}
        tokenize = self.tokenizer.model.tokenize
        for u in words:
            w = u if self.keeps_space else u.lower()
            w = (w if w.isascii() else w.encode().decode("latin-1")).translate(_BYTE_NAMES)
            found[u] = array("I", [t.id for t in tokenize(w)]).tobytes()
        return found

    def units(self, text: str) -> list[str]:
        """The text in units; joined, they have its ids."""
        if self.special and self.special.search(text):
            return [u for part in self.special.split(text) for u in ([part] if self.special.fullmatch(part) else self._between(part))]
        return self._between(text)

    def _between(self, text: str) -> list[str]:
        return _PIECES.findall(text) if self.keeps_space else text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [self.units(text or "") for text in texts]
        self._learn_all(set().union(*cut))
        ids = self.known
        if len(ids) > 2 * self.memory:  # one group of texts had more units than are to be remembered
            self.known = {}
        return [b"".join(map(ids.__getitem__, units)) for units in cut]

    def _learn_all(self, units: set[str]) -> None:
        """A run of marks after a letter is a token run of its own, so the letters
        before it and the marks are looked up apart. (Not so after letters that
        lower-casing turns into several characters, nor is it sure in all scripts.)"""
        known = self.known
        new = units.difference(known)
        if len(known) + len(new) > self.memory:
            known, new = {u: known[u] for u in units if u in known}, new
            self.known = known
        cores = [u.rstrip(_MARKS) for u in new]
        cores = [c if len(c) < len(u) and c[-1:].isalpha() and c[-1] < "\u0250" and c[-1] != "\u0130" else u for c, u in zip(cores, new)]
        tails = [u[len(c):] for c, u in zip(cores, new)]
        known.update(self._learn(list({x for x in (*cores, *tails) if x not in known})))
        for u, c, t in zip(new, cores, tails):
            if t:
                known[u] = known[c] + known[t]


def encoder(path: str, memory: int = 400_000) -> Encoder:
    """One for each Python worker."""
    if (path, memory) not in _encoders:
        _encoders[path, memory] = Encoder(path, memory)
    return _encoders[path, memory]


#: Characters that the hashing operators take at a time.
GROUP_CHARS = 400_000


def in_groups(texts: list[str | None], chars: int = 1_000_000):
    """Slices of the list with about so many characters each, so that memory doesn't follow the batch."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
