"""Whole texts to token ids with a public tokenizer of the ``tokenizers`` library, word by word.

The tokenizer drops white space and never joins two words, so a text's ids are those of its words put together.
Each task keeps a bounded cache of words, and asks the library only for words it doesn't hold.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

assert array("I").itemsize == 4 and sys.byteorder == "little"
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words a cache holds at most; it then becomes the older of two, and a new one begins. It never changes a result.
CACHE_WORDS = 250_000
_BEYOND = re.compile(r"[^\x00-ɏ]")
_MARKED = re.compile(r"([a-zß-öø-ɏ]+)([].,;:!?%&*#$@()[{}|/-]+)")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder(dict):
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes; the dictionary maps words to theirs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = [p.get("type") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        removed = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p.get("type") == "Split"]
        self.by_word = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and steps == ["Split", "ByteLevel"]
            and all(p.get("behavior") == "Removed" and p.get("invert") for p in removed)
            and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", []))
        )
        self.before: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        out = self.before.get(word)
        if out is None:
            folded = word == word.lower()  # folding a case can make marks of letters
            if folded and word.isalpha() and not _BEYOND.search(word):
                shown = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
                out = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
            elif folded and (found := _MARKED.fullmatch(word)):
                # Letters and a run of marks are two words to the tokenizer.
                out = self[found[1]] + self[found[2]]
            else:
                out = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self) >= CACHE_WORDS:
            self.before = dict(self)
            self.clear()
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if "<" not in text and (text.isascii() or not _BEYOND.search(text)):
            text = text.lower()  # the tokenizer does so too; more words are alike then
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").split(" ")))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker and path; workers outlive tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
