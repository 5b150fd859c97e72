"""Token ids of whole texts, fast: each distinct word is encoded once.

Byte-pair encoding treats the pieces that the pre-tokenizer cuts one by one,
so a text's ids are those of its pieces in order. The encoder keeps the ids of
the pieces it has met in a bounded table and asks the tokenizers library only
for new ones. Texts with characters beyond Latin-1, and texts that hold the name
of a special token (which the library turns into that token's id), go to the
library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import cache

import numpy as np

#: Letters of Latin-1, on which Python's and the library's classes agree.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: Fixed: characters for which the two patterns below cut as the library does.
UNUSUAL = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]")
#: Fixed: the published pre-tokenizer patterns of the two vocabularies.
BYTE_PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
)
WORD_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+")

ENTRIES = 500_000


class Known(dict):
    """Ids by piece; a piece that is missing is encoded, and kept while there is room."""

    def __init__(self, encode: Callable[[str], bytes], entries: int):
        self.encode, self.entries = encode, entries

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < self.entries:
            self[piece] = ids
        return ids


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes.

    ``kind`` is ``"byte"`` (pieces keep white space and case) or ``"word"``
    (lower case, white space dropped); it must suit the vocabulary file.
    At most ``entries`` pieces are remembered, so memory is bounded. ``top`` is
    the largest id of the vocabulary.
    """

    def __init__(self, path: str, kind: str, entries: int = ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind, self.known = kind, Known(self.whole, entries)
        self.top = max(self.library.get_vocab().values(), default=0)
        self.pieces = {"byte": BYTE_PIECES, "word": WORD_PIECES}[kind]

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        get, pieces, special = self.known.__getitem__, self.pieces.findall, self.special
        return [
            self.whole(text) if UNUSUAL.search(text) or any(name in text for name in special) else b"".join(map(get, pieces(text.lower() if self.kind == "word" else text)))
            for text in texts
        ]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@cache
def encoder(path: str, kind: str) -> Encoder:
    """The process's own encoder: tasks that follow each other share what it learnt."""
    return Encoder(path, kind)
