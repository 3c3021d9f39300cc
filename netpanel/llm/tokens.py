"""Token ids of whole texts by the tokenizers library, with a bounded cache of white-space chunks.

A tokenizer whose pre-tokenizer never joins across white space gives the ids of a text as the
ids of its white-space chunks, one after the other. Natural text repeats its chunks, so each Python
worker keeps the ids of the chunks it has seen (at most CACHE_CHUNKS) and asks the library for the
others only. Whether a tokenizer behaves so is tried on probes when it is loaded; one that does not
encodes whole texts.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np

#: Chunks whose ids a Python worker keeps; at this number it starts anew.
CACHE_CHUNKS = 600_000
#: Longer chunks are not kept.
CACHE_LENGTH = 64

_LETTERS_THEN_MARKS = re.compile(r"([a-zà-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_PROBES = ("ab", "Ab", "ab,", "1", "ab's", "x1.5", "...", "éa", "Éa", "á", "'", "d'A", "ab**", "!?", "zz-top")
_LETTER_PROBES = ("a", "the", "zyxwvut", "été", "àöøÿþß", "abcdefghijklmnopqrstuvwxyz" * 2)
_MARK_PROBES = (",", ".", "**", "!?", "(&", "%%%", "`~{|}", "<=>@[]^_", "#$+-/:;")


class _Kept(dict):
    """Chunk to ids, as bytes; finds what it does not hold."""

    def __init__(self, enc: Encoder):
        super().__init__({"": b""})
        self.enc = enc

    def __missing__(self, chunk: str) -> bytes:
        ids = self.enc.chunk(chunk)
        if len(chunk) <= CACHE_LENGTH:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
                self[""] = b""
            self[chunk] = ids
        return ids


class Encoder:
    """Texts to arrays of ids; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        self.lib = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.lib.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        ids = self._ids
        self.by_chunk = all(ids(f"{a}{gap}{b}") == ids(a) + ids(b) for a in _PROBES for b in _PROBES for gap in (" ", "\n", "\t"))
        #: Case and end marks of a word of Latin letters change nothing but the marks' own ids.
        self.by_word = self.by_chunk and all(ids(p) == ids(p.lower()) for p in _PROBES) and all(ids(f"{p}{m}") == ids(p) + ids(m) for p in _LETTER_PROBES for m in _MARK_PROBES)
        #: The bare model, for words that its normaliser and pre-tokenizer leave as they are but for the letters of bytes.
        self.model = self.lib.model if self.by_word else None
        self.letters = _byte_letters()
        if self.model and any(self._word(w) != self._raw(w) for w in _LETTER_PROBES):
            self.model = None
        self.kept = _Kept(self)

    def _ids(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def _raw(self, text: str) -> bytes:
        return np.array(self._ids(text), self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        """Ids of a chunk without white space."""
        if self.model and (chunk.isascii() or _latin(chunk)):
            m = _LETTERS_THEN_MARKS.fullmatch(chunk.lower())
            if m:
                word, marks = m.groups()
                if marks:
                    return self.kept[word] + self.kept[marks]
                return self._word(word) if word == chunk else self.kept[word]
        return self._raw(chunk)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text, of this encoder's dtype; null counts as empty."""
        if not self.by_chunk:
            return [self._raw(t or "") for t in texts]
        get, join = self.kept.__getitem__, b"".join
        return [join(map(get, (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, once for each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
