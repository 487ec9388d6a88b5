"""Token ids of public tokenizers, fast enough for whole corpora.

`Encoder` gives for a text exactly the ids of `Tokenizer.encode(text, add_special_tokens=False)`.
The vocabulary lower-cases, drops white space and never merges across it, so the ids of a text are
those of its pieces in order. A text of ASCII and Latin letters is cut into pieces as a whole, and they go
straight to the library's BPE model; a cache of bounded size keeps what recent pieces gave. In other texts
each word of such letters is looked up in a cache of words first, and any other word goes through the
library's whole encoder.
"""

from __future__ import annotations

import re
import struct

import numpy as np

from traceloom.llm import common

END_ID = 1
PIECES = 400_000  # in the cache, about 90 MB
WORDS = 100_000

_SAFE = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*")
_PIECE = re.compile(r"[a-zß-öø-ÿ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s0-9a-zß-öø-ÿ]+")
_CHUNK = re.compile(r"[^\t\n\r ]+")
_encoders: dict[str, "Encoder"] = {}


def _byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


#: By count: packs ids; longer pieces are rare.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


class _Pieces(dict):
    def __init__(self, model):
        self.model, self.alphabet = model, _byte_alphabet()

    def __missing__(self, piece: str) -> bytes:
        word = piece if piece.isascii() else "".join([self.alphabet[b] for b in piece.encode()])
        found = [t.id for t in self.model.tokenize(word)]
        n = len(found)
        ids = _PACK[n](*found) if n < len(_PACK) else struct.pack(f"<{n}I", *found)
        if len(self) >= PIECES:
            self.clear()
        self[piece] = ids
        return ids


class _Words(dict):
    """Lower-cased words without white space, of _SAFE characters."""

    def __init__(self, pieces: _Pieces):
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(map(self.pieces.__getitem__, _PIECE.findall(word)))
        if len(self) >= WORDS:
            self.clear()
        self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.model._resize_cache(0)  # ours stands before it
        self.pieces = _Pieces(self.model)
        self.words = _Words(self.pieces)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; none for null or empty."""
        if not text:
            return b""
        if _SAFE.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text.lower())))
        out = []
        for chunk in _CHUNK.findall(text):
            if _SAFE.fullmatch(chunk) and "<|" not in chunk:
                out.append(self.words[chunk.lower()])
            else:
                out.append(np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes())
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """One for each path and Python worker."""
    common.claim("tokens", _encoders.clear)
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
