"""Token ids of whole texts by a public byte-level tokenizer, with a bounded memory of chunks.

The splitting pattern of byte-level vocabularies always breaks before a lone space that follows a non-space. A text is
therefore cut there, and each distinct chunk is encoded once. Where the vocabulary also comes as a rank file, tiktoken
encodes the chunks (its ids are the same, tests compare them) and texts in which white space stands next to a space;
texts that hold a special token's string, and all other vocabularies, go to the tokenizers library.
"""

from __future__ import annotations

import base64
import ctypes
import json
import os
from array import array

import public_tokenizers

#: Chunks that a worker remembers; when full it starts again.
CACHE = 100_000
LONGEST = 48


class _Uneven(Exception):
    """White space at a chunk's edge: the text is encoded as a whole."""


class Encoder(dict):
    """A mapping from a chunk that follows a space to its ids as unsigned 32-bit integers in native (little-endian) order."""

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.tokenizer = path, None
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.fast = self.exact
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary

    def library(self):
        """The library's tokenizer: loaded by the first text that needs it."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer

    @property
    def size(self) -> int:
        return self.library().get_vocab_size()

    def exact(self, text: str) -> list[int]:
        return self.library().encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bytes:
        return array("I", self.fast(text)).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Uneven
        ids = self.whole(" " + chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return array("I", self.exact(text)).tobytes()
        first, *rest = text.split(" ")
        if not rest or not first or first[0].isspace() or first[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(first) + b"".join(map(self.__getitem__, rest))
        except _Uneven:
            return self.whole(text)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One for each worker process; name: what public_tokenizers.path takes."""
    if name not in _encoders:
        _encoders[name] = Encoder(public_tokenizers.path(name))
    return _encoders[name]


def release() -> None:
    """Forget the chunks and hand freed memory back: a worker process serves other stages after this one."""
    for e in _encoders.values():
        e.clear()
        e.tokenizer = None
    if os.name == "posix":
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # not glibc
            pass
