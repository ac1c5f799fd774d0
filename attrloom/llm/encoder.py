"""Whole-text encoding with a public vocabulary file, for operators that only need the ids.

Texts are cut at single blanks between two non-blank characters. No match of the split pattern crosses
such a blank (it belongs to what follows), so the pieces encode on their own and repeat often; their
ids are remembered in a table of bounded size. The result equals encoding the whole text.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers
import tiktoken

RANKS = "byte_bpe_50k.tiktoken"
REMEMBERED = 200_000
#: A blank with white space (or the end) on both sides; the plain split at blanks is wrong there.
ODD_SPACE = re.compile(r"\s (?:\s|$)")
CUT = re.compile(r"(?<=\S) (?=\S)")


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def pieces(text: str) -> list[str]:
    """Independent pieces; all but the first have lost one leading blank."""
    return CUT.split(text) if ODD_SPACE.search(text) else text.split(" ")


class Encoder:
    def __init__(self, path: str | None = None):
        path = path or public_tokenizers.path(RANKS)
        known = ranks(path)
        self.library = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.sizes = np.zeros(max(known.values()) + 1, dtype=np.int64)
        for token, rank in known.items():
            self.sizes[rank] = len(token)
        self.memory: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """Ids of a stretch of text as 32-bit integers."""
        return np.array(self.library.encode_ordinary(text), dtype="<i4").tobytes()

    def behind_blank(self, piece: str) -> bytes:
        """Ids of a piece that has lost its leading blank; remembered."""
        ids = self.memory.get(piece)
        if ids is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            ids = self.memory[piece] = self.piece(" " + piece)
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The token ids of ``text``, without special tokens."""
        first, *rest = pieces(text)
        known, other = self.memory.get, self.behind_blank
        return np.frombuffer(b"".join([self.piece(first), *[known(p) or other(p) for p in rest]]), dtype="<i4")


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
