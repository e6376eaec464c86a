"""Token ids of whole texts by the tokenizers library, with ids of words kept between documents.

Encoding a whole text costs about a CPU second a megabyte, nearly all of it in splitting words that
came before. Both vocabularies cut a text into words first and encode each word on its own, so a
worker keeps the ids of words it has seen and hands only unseen words to the library. Texts whose
white space could make a cut ambiguous go to the library whole, and so do words with a character that
this Python's Unicode tables don't know and the library's may. A tokenizer file whose normalizer and
cutting aren't those assumed here is refused. The ids equal those of
``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import regex
from tokenizers import Tokenizer

#: Bounds of the two stores of a worker: words as they stand between spaces, and the parts the
#: tokenizer itself cuts them into. At about 200 bytes an entry. Full stores only stop growing.
MOST_WORDS, MOST_PARTS = 500_000, 500_000

BYTE_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Python takes these for white space, the tokenizers don't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
SIGMA = "Σ"
#: What a file must say for the cutting here to be its own.
CUTS = {
    "byte": (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
    "word": (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
    ),
}


def known(word: str) -> bool:
    return word.isascii() or all(unicodedata.category(c) != "Cn" for c in word)


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself where it is
    printable, else one after 255 in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in printable else next(rest)) for b in range(256)}


class Parts(dict):
    """Ids of the parts that a tokenizer's own cutting makes, by its library's model."""

    def __init__(self, library: Tokenizer):
        super().__init__()
        self.model = library.model
        # Looked up here already; its own store would only be written to.
        self.model._resize_cache(0)
        self.letters = byte_letters()

    def __missing__(self, part: str) -> bytes:
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))
        ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        if len(self) < MOST_PARTS:
            self[part] = ids
        return ids


class Words(dict):
    """Ids of words as they stand between spaces; None for one that begins or ends with white space."""

    def __init__(self, library: Tokenizer, kind: str):
        super().__init__()
        self.library, self.kind = library, kind
        self.special = [t.content for t in library.get_added_tokens_decoder().values()]
        self.parts = Parts(library)

    def __missing__(self, word: str) -> bytes | None:
        ids = self.find(word)
        if len(self) < MOST_WORDS:
            self[word] = ids
        return ids

    def find(self, word: str) -> bytes | None:
        if "<" in word and any(s in word for s in self.special):
            return None if word[-1].isspace() else self.whole(word)
        if not known(word):
            return None if word[-1].isspace() or self.kind == "byte" else self.whole(word)
        if self.kind == "byte":
            cut = BYTE_PARTS.findall(word)
            if cut[0].isspace() or cut[-1].isspace():
                return None
        elif not word.isascii() and (SIGMA in word or not unicodedata.is_normalized("NFC", word)):
            return self.whole(word)
        else:
            cut = WORD_PARTS.findall(word.lower())
        return b"".join(map(self.parts.__getitem__, cut))

    def whole(self, text: str) -> bytes:
        ids = self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. kind: "byte" for byte-level vocabularies
    (a space belongs to the word after it), "word" for those that drop white space."""

    def __init__(self, path: str, kind: str):
        self.library = Tokenizer.from_file(path)
        said = json.loads(self.library.to_str())
        if (said["normalizer"], said["pre_tokenizer"]) != CUTS[kind]:
            raise ValueError(f"{path} doesn't cut texts as a tokenizer of kind {kind!r} does")
        self.kind = kind
        self.words = Words(self.library, kind)

    def one(self, text: str) -> bytes:
        if self.kind == "word":
            if ODD_SPACE.search(text):
                return self.words.whole(text)
            return b"".join(map(self.words.__getitem__, text.split()))
        if not text:
            return b""
        first, space, rest = text.partition(" ")
        if not first or first[0].isspace():
            return self.words.whole(text)
        ids = [self.words.find(first)]
        if space:
            ids += map(self.words.__getitem__, [" " + w for w in rest.split(" ")])
        return self.words.whole(text) if None in ids else b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        return [self.one(t) for t in texts]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's own; it stays for later tasks."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = Encoder(path, kind)
    return _ENCODERS[path, kind]
