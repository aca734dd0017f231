"""Token ids of whole texts inside tasks."""

from __future__ import annotations

import json
import re
from array import array

REMEMBERED = 180_000  # words of a generation, at each of two levels in a worker

_encoders: dict[str, Encoder] = {}


class _Memory(dict):
    """A dict that computes what it lacks. When it is full it starts anew, but
    takes over from its last generation what is asked for again."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.before = compute, {}

    def __missing__(self, word):
        found = self.before.get(word)
        self[word] = found = self.compute(word) if found is None else found
        return found

    def renew(self):
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()


class Encoder:
    """Ids of one tokenizer file, as little-endian unsigned 32-bit integers.

    Where the file's rules treat every word alone (lower case, white space
    dropped, words cut by one pattern), ids of words are remembered, which
    gives the same ids as encoding the whole text. Texts with characters whose
    treatment could differ, or with special tokens, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        steps = [s.get("type") for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [c.get("type") for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0].get("behavior") == "Removed"
            and not cuts[1].get("add_prefix_space")
            and spec["model"].get("type") == "BPE"
            and spec.get("post_processor") is None
        )
        if self.by_word:
            import regex

            self.cut = regex.compile(cuts[0]["pattern"]["Regex"])
            self.unsafe = re.compile("[^\t\n\r -~¡-¬®-ÿ]")
            plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
            rest = (b for b in range(256) if b not in plain)
            self.shown = {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}
            self.pieces, self.words = _Memory(self._piece), _Memory(self._word)

    def _piece(self, piece: str) -> bytes:
        # printable ASCII stands for itself in the vocabulary's spelling of bytes
        spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha():  # letters alone are one piece, and so is one mark after them
            return self.pieces[word]
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return self.pieces[word[:-1]] + self.pieces[word[-1]]
        return b"".join([self.pieces[p] for p in self.cut.findall(word)])

    def encode(self, text: str) -> bytes:
        if not self.by_word or self.unsafe.search(text) or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self.words.renew()
        self.pieces.renew()
        return b"".join(map(self.words.__getitem__, text.lower().split()))

    def forget(self) -> None:
        """Drop the remembered words."""
        if self.by_word:
            for memory in (self.words, self.pieces):
                memory.clear()
                memory.before = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
