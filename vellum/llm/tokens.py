"""Whole documents to token ids, with a memory of the words that a worker has met.

The tokenizer splits at white space, so a text's ids are its chunks' ids in order.  Chunks are cut
at ASCII white space only; every other character is left to the tokenizer.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np

#: Entries of a worker's memory; it is emptied when full.  A matter of speed and memory only.
REMEMBERED = 400_000
#: Longer chunks aren't remembered.
LONGEST = 64
#: Steps of a tokenizer that leave a word of letters whole, in this order.
WHOLE_WORDS = ("NFC", "Replace", "Lowercase", "Split", "ByteLevel")


def _byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class Encoder(dict):
    """Ids of texts as little-endian unsigned 32-bit bytes; as a dictionary, the ids of chunks."""

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # chunks can't see a special token that holds white space, nor may case be folded into one
        self.by_chunk = not any(t.split() != [t] for t in added)
        self.marks = tuple({t[:1].encode() for t in added})
        shape = json.loads(self.tokenizer.to_str())
        steps = [*(shape["normalizer"] or {}).get("normalizers", []), *(shape["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.folds = any(s["type"] == "Lowercase" for s in steps)
        self.letters = _byte_letters() if tuple(s["type"] for s in steps) == WHOLE_WORDS else None
        if self.letters and any(t.isalpha() for t in added):
            self.letters = None

    def _word(self, word: bytes) -> bytes | None:
        """Ids of a word of letters, which is one piece to the vocabulary; None if it may not be."""
        if word.isalpha():  # ASCII letters
            if not word.islower():
                word = word.lower()
            spelt = word.decode()
        else:
            spelt = unicodedata.normalize("NFC", word.decode())
            spelt = "".join([c.lower() for c in spelt])
            if not spelt.isalpha() or unicodedata.normalize("NFC", spelt) != spelt:
                return None
            spelt = "".join([self.letters[b] for b in spelt.encode()])
        return np.array([t.id for t in self.model.tokenize(spelt)], dtype="<u4").tobytes()

    def _whole(self, chunk: bytes) -> bytes:
        return np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        found = None
        if self.letters:
            if chunk[-1:] in (b".", b",") and len(chunk) > 1:
                stem = chunk[:-1]
                known = self.get(stem) if stem.isalpha() else None
                found = known if known is not None else self._word(stem)
                if found is not None:
                    if len(stem) <= LONGEST:
                        self[stem] = found
                    found += self[chunk[-1:]]
            elif len(chunk) > 1:
                found = self._word(chunk)
        if found is None:
            found = self._whole(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = found
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_chunk:
            return [self._whole(t) for t in texts]
        get, out = self.__getitem__, []
        for t in texts:
            if len(self) > REMEMBERED:
                self.clear()
            if self.folds and not any(m in t for m in self.marks):
                t = t.lower()
            out.append(b"".join(map(get, t.split())))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
