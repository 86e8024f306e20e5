"""Fast exact encoding with the tokenizers library.

A byte-pair encoder works on pre-tokens. A text is cut only where its
pre-tokenizer would cut it anyway, distinct pieces are encoded once by the
tokenizer itself and their ids kept in a bounded cache, so the result is the
tokenizer's own. This holds for the two kinds of file in KINDS. Files of any
other kind, and texts with the string of an added token (which the library takes
out before anything else), are encoded by the library as a whole.
"""

from __future__ import annotations

import json
import re
from array import array
from codecs import charmap_decode
from operator import attrgetter

import numpy as np

#: Bytes and pieces in either of the two generations that one Python worker keeps.
CACHE_BYTES, CACHE_PIECES = 96 << 20, 500_000
#: What an entry takes besides its characters and ids: two objects' heads and a dictionary's slot.
ENTRY_BYTES = 160
#: ASCII signs at a word's end that make a pre-token of their own after a letter.
SIGNS = ".,;:!?$%&*#()"
#: Byte-level alphabets write a byte as itself if printable in Latin-1, else as the next free code point from 256 on.
_same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
ALPHABET = {b: b for b in _same} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _same)}
#: The same as one string of 256 characters.
LATIN = "".join(chr(ALPHABET[b]) for b in range(256))
ID = attrgetter("id")
#: Between a non-space and a single space or line end that a non-space follows, byte-level pre-tokenizers always cut.
SAFE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")

#: What of a tokenizer file decides where it cuts, by whether its pieces keep white space.
KINDS = {
    True: {
        "normalizer": None,
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
        "post_processor": None,
        "suffix": None,
    },
    False: {
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
        "post_processor": None,
        "suffix": "</w>",
    },
}

_open: dict = {}


class Unsafe(Exception):
    """A piece that does not stand between places where every text is cut."""


class Known(dict):
    """Piece -> ids, learned on demand. Two generations: when the newer one is
    full it takes the older one's place, and what is used again comes back. Full is
    counted in bytes, so that long pieces take no more than short ones."""

    def __init__(self, learn, share: float = 1.0):
        super().__init__()
        self.learn, self.older, self.held = learn, {}, 0
        self.room, self.most = int(CACHE_BYTES * share), int(CACHE_PIECES * share)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.learn(piece)
        size = ENTRY_BYTES + len(piece) * (1 if piece.isascii() else 4) + len(ids)
        if self.held + size > self.room or len(self) > self.most:
            self.older = dict(self)
            self.clear()
            self.held = 0
        if size < self.room:
            self[piece] = ids
            self.held += size
        return ids


def is_plain(word: str) -> bool:
    return bool(word) and not word[0].isspace() and not word[-1].isspace()


def known_kind(file: dict, byte_level: bool) -> bool:
    model = file["model"]
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    return plain and not file["truncation"] and not file["padding"] and KINDS[byte_level] == {k: file[k] for k in ("normalizer", "pre_tokenizer", "post_processor")} | {"suffix": model.get("end_of_word_suffix")}


class Encoder:
    """byte_level: the pre-tokenizer keeps white space in its pieces; otherwise it
    drops white space, and texts are cut at spaces and line ends."""

    def __init__(self, path: str, byte_level: bool):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.fast = known_kind(file, byte_level)
        self.added = [t["content"] for t in file["added_tokens"]]
        self.fast &= all(x.isascii() and not t["normalized"] for x, t in zip(self.added, file["added_tokens"]))
        self.byte_level = byte_level
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.tokenize = self.tokenizer.model.tokenize
        self.kind = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.plain = Known(self.learn_spaced if byte_level else self.learn)
        self.safe = Known(self.learn_safe, 0.4)

    def whole(self, piece: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def learn_spaced(self, piece: str) -> bytes:
        """\0 and a word that no space precedes, a line end, or a word after a space.
        Most pieces are letters with signs after them or none, so these come first."""
        word = piece[1:] if piece[:1] == "\0" else piece
        base = word.rstrip(SIGNS)
        if base.isalpha():
            if len(base) == len(word):
                spaced = word if word is not piece else " " + word
                return self.letters(word, "" if word is not piece else "\u0120") or self.whole(spaced)
            n = len(base) - len(word)  # the word without its signs is kept too
            return self.plain[piece[:n]] + self.safe[piece[n:]]
        if piece == "\n":
            return self.whole(piece)
        if not is_plain(word):
            raise Unsafe
        return self.learn(word if word is not piece else " " + word)

    def learn_safe(self, piece: str) -> bytes:
        """A piece with its own white space; a word, perhaps after a space, goes the short way."""
        return self.learn(piece) if is_plain(piece[piece[:1] == " ":]) and "\0" not in piece else self.whole(piece)

    def learn(self, piece: str) -> bytes:
        base = piece.rstrip(SIGNS)
        if len(base) == len(piece):
            return self.word(piece) or self.whole(piece)
        last = base if self.byte_level else base.lower()
        if not last[-1:].isalnum():
            return self.whole(piece)
        key = base[1:] if self.byte_level and base[:1] == " " else "\0" + base if self.byte_level else base
        return self.plain[key] + self.safe[piece[len(base):]]  # the word without its signs is kept too

    def word(self, piece: str) -> bytes | None:
        """The ids of letters with perhaps a space before them, one pre-token; else None."""
        spaced = self.byte_level and piece[:1] == " "
        letters = piece[1:] if spaced else piece
        if not self.byte_level:
            letters = letters.lower()
        return self.letters(letters, "\u0120" if spaced else "") if letters.isalpha() else None

    def letters(self, letters: str, before: str) -> bytes | None:
        """The ids of letters after what the alphabet has for ``before``; None from U+0250 on."""
        if not letters.isascii():
            coded = letters.encode()
            if max(coded) > 0xC9:  # the first byte of U+024F
                return None
            letters = charmap_decode(coded, "strict", LATIN)[0]
        return array(self.kind, list(map(ID, self.tokenize(before + letters)))).tobytes()

    def encoded(self, text: str) -> bytes:
        """The ids of a text as the library gives them without adding special tokens, in this encoder's dtype."""
        if not self.fast or any(x in text for x in self.added):
            return self.whole(text)
        if not self.byte_level:
            return b"".join(map(self.plain.__getitem__, text.replace("\n", " ").split(" ")))
        if "\0" not in text:
            try:
                return b"".join(map(self.plain.__getitem__, ("\0" + text.replace("\n", " \n \0")).split(" ")))
            except Unsafe:  # white space in a row, or at an end
                pass
        return b"".join(map(self.safe.__getitem__, SAFE.split(text)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.encoded(x) if x else b"", self.dtype) for x in texts]


def encoder(path: str, byte_level: bool) -> Encoder:
    """One encoder for each worker and file."""
    if (path, byte_level) not in _open:
        _open[path, byte_level] = Encoder(path, byte_level)
    return _open[path, byte_level]
