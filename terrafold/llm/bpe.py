"""Byte-pair encoding by backtracking over longest matches; decoding by an offset table.

Encoding. A piece (a word, as the vocabulary's own pre-tokenizer cuts it) is
encoded without replaying its merges. Two facts make that exact:

* a row of tokens is what the merges would give if, and only if, every token is
  what the merges make of its own letters, and every two neighbours are
  *compatible*: no merge across their border would have come before the merges
  that built them;
* so the encoder goes from left to right, takes the longest token at each
  place, and where it does not go with the token before, the next shorter one.
  Where none is left, it steps back and marks the place as a dead end. No place
  is marked twice, so time is linear in the length of the piece.

The longest token at every place comes from one pass of an Aho-Corasick
automaton of the reversed tokens over the reversed piece. Compatible pairs are
kept in a table of at most ``ENTRIES`` pairs, filled as pairs are met; pairs
beyond that are worked out anew, with the same result. So are pieces.

Compatibility of (a, b): at the time before the merge of rank m, the border
lies between the largest part at the end of ``a`` and the largest part at the
beginning of ``b`` that exist by then. Both are taken apart again, the later
one first. If some pair met on the way has a merge that is earlier than the one
just undone, that merge would have crossed the border. Of two equal ranks the
left one comes first.

Decoding. All token names lie in one byte string, each followed by the joining
space; offsets by id give their places, and the names of a row of ids are
gathered at once.

Defined cases: a null text is an empty one, which has no tokens and decodes to
an empty text. Null and repeated ids of documents and repeated rows stay as
they are, one row each. Further columns are not read, whatever their names. An
empty table gives an empty one. A text's length is not limited: pieces are
linear in time, ids are hashed in blocks of ``BLOCK``. The names of special
tokens in a text are those tokens, as in the library. Letters that are no valid
Unicode do not occur in Spark's strings.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices
from .tokens import UNUSUAL, WORD_PIECES, Known

ENTRIES = 500_000
#: Ids that are turned into text at a time.
BLOCK = 65_536
#: Stands for the end of a word in names of tokens; no byte has it as its letter.
END = " "


def byte_letters() -> str:
    """The letter of each byte: itself where it is printable, otherwise the next one from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in own else next(others)) for b in range(256))


class Merges:
    """A vocabulary whose ids follow the order of its merges: names, parts and pairs.

    ``left`` and ``right`` are the two parts of a merged token, ``first`` is
    the id of the first merged one. Anything that the encoder's reasoning does
    not cover (two merges for one token, ids in another order, dropout) is an
    error here rather than a wrong result later.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, pairs = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-pair vocabulary")
        self.first = min((vocab[a + b] for a, b in pairs), default=len(vocab))
        if [vocab[a + b] for a, b in pairs] != [*range(self.first, self.first + len(pairs))]:
            raise ValueError("ids must follow the order of merges, one merge for each token")
        self.left = [vocab[a] for a, _ in pairs]
        self.right = [vocab[b] for _, b in pairs]
        self.id_of = {(a, b): self.first + k for k, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.names: list[str] = [""] * self.first
        for name, i in vocab.items():
            if i < self.first:
                if len(name) != 1 and name[1:] != suffix:
                    raise ValueError(f"{name!r} is neither a byte nor the last byte of a word")
                self.names[i] = name[0] + END * (len(name) > 1)
        for a, b in zip(self.left, self.right, strict=True):
            self.names.append(self.names[a] + self.names[b])
        self.ends_words = bool(suffix)

    def crossed(self, a: int, b: int, limit: float = float("inf")) -> bool:
        """Whether, of ``a`` beside ``b``, a merge before ``limit`` would have crossed the border."""
        first, left, right, id_of = self.first, self.left, self.right, self.id_of
        while True:
            made = id_of.get((a, b))
            if made is not None and made < limit:
                return True
            if a > b:
                if a < first:
                    return False
                limit, a = a, right[a - first]
            else:
                if b < first:
                    return False
                limit, b = b + 1, left[b - first]


class BacktrackingEncoder:
    """``encode(text)`` gives ids as little-endian unsigned 32-bit bytes, ``decode(ids)`` the text in UTF-8."""

    def __init__(self, path: str, entries: int = ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # Only its normalizer and its pre-tokenizer are used, for texts beyond Latin-1.
        self.library = Tokenizer.from_file(path)
        self.merges = merges = Merges(spec)
        # A token that merges would not make of its own letters never occurs.
        occurs = [True] * merges.first
        for k, (a, b) in enumerate(zip(merges.left, merges.right, strict=True)):
            occurs.append(occurs[a] and occurs[b] and not merges.crossed(a, b, merges.first + k))
        by_name = {name: i for i, name in enumerate(merges.names) if occurs[i]}
        self.lengths = [len(name) for name in merges.names]
        self.shorter = [-1] * len(merges.names)
        self.automaton = ahocorasick.Automaton()
        for name, i in by_name.items():
            self.automaton.add_word(name[::-1], i)
            self.shorter[i] = next((by_name[name[:k]] for k in range(len(name) - 1, 0, -1) if name[:k] in by_name), -1)
        self.automaton.make_automaton()
        self.entries, self.compatible = entries, {}
        self.known = Known(lambda piece: self.tokens(self.letters(piece)), entries)
        letters = byte_letters()
        self.translation = {b: letters[b] for b in range(256)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        self.special = {name: np.asarray([i], dtype="<u4").tobytes() for name, i in added.items()}
        self.split = re.compile(f"({'|'.join(map(re.escape, sorted(added, key=len, reverse=True)))})")
        named = {i: name for name, i in [*spec["model"]["vocab"].items(), *added.items()]}
        places = [f"{named[i]} ".encode() if i in named else b"" for i in range(max(named, default=-1) + 1)]
        self.blob = np.frombuffer(b"".join(places), dtype=np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in places], dtype=np.int64)])

    def letters(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.translation)

    def tokens(self, letters: str) -> bytes:
        """Ids of one piece, given as the letters of its bytes."""
        if not letters:
            return b""
        text = letters + END if self.merges.ends_words else letters
        n, lengths, shorter, table, crossed = len(text), self.lengths, self.shorter, self.compatible, self.merges.crossed
        longest = [-1] * n
        for end, i in self.automaton.iter(text[::-1]):
            at = n - 1 - end
            if longest[at] < 0 or lengths[i] > lengths[longest[at]]:
                longest[at] = i
        alive = bytearray(b"\1") * (n + 1)
        if self.merges.ends_words:
            alive[n - 1] = 0  # the last byte and the end of the word are one token
        row, at, token = [], 0, longest[0]
        while at < n:
            before = row[-1] if row else -1
            while token >= 0:
                if alive[at + lengths[token]]:
                    if before < 0:
                        break
                    pair = before << 32 | token
                    good = table.get(pair)
                    if good is None:
                        good = not crossed(before, token)
                        if len(table) < self.entries:
                            table[pair] = good
                    if good:
                        break
                token = shorter[token]
            if token >= 0:
                row.append(token)
                at += lengths[token]
                token = longest[at] if at < n else -1
            elif row:
                alive[at] = 0
                token = row.pop()
                at -= lengths[token]
            else:
                raise ValueError("the vocabulary has no token for some byte")
        return np.asarray(row, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        parts = self.split.split(text) if any(name in text for name in self.special) else [text]
        known, out = self.known.__getitem__, []
        for part in filter(None, parts):
            if part in self.special:
                out.append(self.special[part])
            elif UNUSUAL.search(part):
                whole = self.library.normalizer.normalize_str(part)
                out += [self.tokens(letters) for letters, _ in self.library.pre_tokenizer.pre_tokenize_str(whole)]
            else:
                out += map(known, WORD_PIECES.findall(part.lower()))
        return b"".join(out)

    def decode_blocks(self, ids: np.ndarray) -> Iterator[bytes]:
        """The text of ``ids`` in UTF-8, block by block."""
        for k in range(0, len(ids), BLOCK):
            some = ids[k : k + BLOCK].astype(np.int64)
            some = some[some < len(self.offsets) - 1]
            starts, sizes = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            places = np.repeat(starts - (ends - sizes), sizes) + np.arange(total)
            text = self.blob[places].tobytes()
            yield text if k + BLOCK < len(ids) else text[:-1]

    def decode(self, ids: bytes) -> str:
        return b"".join(self.decode_blocks(np.frombuffer(ids, dtype="<u4"))).decode("utf-8")


@cache
def encoder(path: str) -> BacktrackingEncoder:
    """The process's own encoder: tasks that follow each other share what it learnt."""
    return BacktrackingEncoder(path)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return ["" if t is None else t for t in batch.column(1).to_pylist()]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of every whole text, as little-endian unsigned 32-bit bytes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(encode, _texts(batch)), pa.binary())], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): what rows of ids stand for; null ids give an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).decode
        for batch in slices(batches):
            texts = [decode(ids or b"") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded again.

    Both happen in the same task, so that neither ids nor texts are shuffled or
    written. ``ids_sha256`` is of the decimal ids joined by one space.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def digests(text: str, own: BacktrackingEncoder, numbers: np.ndarray) -> tuple[int, str, str]:
        ids = np.frombuffer(own.encode(text), dtype="<u4")
        decimal, decoded = hashlib.sha256(), hashlib.sha256()
        for k in range(0, len(ids), BLOCK):
            decimal.update((" " * (k > 0) + " ".join(numbers[ids[k : k + BLOCK]].tolist())).encode())
        for block in own.decode_blocks(ids):
            decoded.update(block)
        return len(ids), decimal.hexdigest(), decoded.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        numbers = np.array([str(i) for i in range(len(own.offsets) - 1)], dtype=object)
        for batch in slices(batches):
            found = [digests(text, own, numbers) for text in _texts(batch)]
            columns = zip(*found, strict=True) if found else ((), (), ())
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
