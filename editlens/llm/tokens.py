"""Tokenising whole texts with a public byte-level BPE file, one library call for each new piece of text."""

from __future__ import annotations

import array
import functools
import os
import re
from collections.abc import Iterable, Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Where a piece of text can begin: a space before something else than white space starts a word of the tokenizer.
CUT = re.compile(r" (?=\S)")
ODD = re.compile(r" (?!\S)")
LONG_PIECE = 48
CACHE_PIECES = 600_000
SEGMENT = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of a text as bytes (little-endian unsigned 32-bit integers).

    The byte-level BPE splits a text into words before it merges, and a space followed by something else than white
    space always begins a word. So a text is cut there, and the ids of the pieces, each from the library, are put
    together; pieces seen before come from a bounded cache. A piece of letters is one word, so the library's BPE model
    gets it without the steps before. A text that holds the string of a special token goes to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.cache: dict[str, bytes] = {}
        self.marks = {m: self.direct(m) for m in ",."}

    def direct(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, piece: str) -> bytes:
        """Ids of a piece and the space before it. A comma or full stop after a letter or digit is a word of its own."""
        if piece.isalpha():
            word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = array.array("I", [t.id for t in self.model.tokenize(self.letters[32] + word)]).tobytes()
        elif piece[-1:] in self.marks and piece[-2:-1].isalnum():
            ids = (self.cache.get(piece[:-1]) or self._new(piece[:-1])) + self.marks[piece[-1]]
        else:
            ids = self.direct(" " + piece)
        if len(piece) <= LONG_PIECE:
            self.cache[piece] = ids
        return ids

    def _body(self, text: str) -> bytes:
        """Ids of a part of a text that follows a cut; the space before a piece is left out."""
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        pieces = CUT.split(text) if ODD.search(text) else text.split(" ")
        ids = list(map(self.cache.get, pieces))
        if None in ids:
            get, new = self.cache.get, self._new
            ids = [v if v is not None else get(p) or new(p) for p, v in zip(pieces, ids, strict=True)]
        return b"".join(ids)

    def encode(self, text: str | None) -> bytes:
        if not text or any(s in text for s in self.special):
            return self.direct(text or "")
        head, *rest = CUT.split(text, maxsplit=1)
        out, at = [self.direct(head) if head else b""], 0
        body = rest[0] if rest else ""
        while at < len(body):
            cut = CUT.search(body, at + SEGMENT)
            end = cut.start() if cut else len(body)
            out.append(self._body(body[at:end]))
            at = end + 1
        return b"".join(out)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        return map(self.encode, texts)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process, so that its cache serves all tasks of the worker."""
    return Encoder(path)
