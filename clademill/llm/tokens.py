"""Token ids by the tokenizers library, remembered by word.

A text of plain Latin letters, digits and signs is split here, as the tokenizer's own steps would split it, and each word
goes to the library's merges once in a while: a worker remembers the ids of its words. Any other text is cut into chunks
at places where the tokenizers' patterns always end a match, so that the ids of the text are those of its chunks, one
after another; what isn't plain in it goes through the library whole. A text with the string of an added token goes to the
library as it is, which gives that token, as its own call does by default.
"""

from __future__ import annotations

import os
import re
import struct
from array import array

#: Before white space that follows something else, a byte-level pattern always ends a match: no match holds white space
#: after another character. Characters that only Python takes for white space make such places uncertain.
BYTE_CHUNK = re.compile(r"\s*\S+|\s+")
UNCERTAIN = re.compile("[\x1c-\x1f\x85᠎]")
#: The word-level pattern drops white space, and none of its normalisers joins characters across it.
WORD_CHUNK = re.compile(r"[^ \t\n\x0b\x0c\r]+")
REMEMBERED, LONGEST = 200_000, 48

# Classes of the characters U+0021 to U+007E and U+00A1 to U+00FF, where all libraries agree and no normaliser but the
# lower case changes anything.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
PLAIN_BYTES = bytes([*b"\t\n\r ", *range(0x21, 0x7F), *range(0xA1, 0x100)])
# The patterns' alternatives, of which the more frequent ones stand first: no two of them but the last ones of each can
# match at one place.
BYTE_WORD = re.compile(rf" ?[{LETTER}]+| ?[{NUMBER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
WORD_WORD = re.compile(rf"[{LETTER}]+|[{NUMBER}]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{LETTER}{NUMBER}]+")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 onwards in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


class Words(dict):
    """word -> its ids as little-endian unsigned 32-bit integers, by the library's merges."""

    def __init__(self, model):
        super().__init__()
        self.merge, self.letters = model.tokenize, byte_letters()
        self.blank, self.swap = self.letters[0x20], memoryview(b"\1\0").cast("H")[0] != 1

    def merged(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():
            word = self.blank + word[1:] if word[0] == " " else word
        else:
            word = word.encode().decode("latin-1")
        if not word.isalpha():  # bytes that are letters stand for themselves
            word = word.translate(self.letters)
        ids = array("I", [t.id for t in self.merge(word)])
        if self.swap:
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, word: str) -> bytes:
        out = self.merged(word)
        if len(word) <= LONGEST:
            self[word] = out
        return out


class Ids(dict):
    """chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, by_word: bool, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.lower() if by_word else t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.words, self.by_word = Words(self.tokenizer.model), by_word
        self.chunks = (WORD_CHUNK if by_word else BYTE_CHUNK).findall
        self.split = (WORD_WORD if by_word else BYTE_WORD).findall

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def plain(self, text: str) -> bytes | None:
        """Ids of a text if it is plain."""
        try:
            if text.encode("latin-1").translate(None, PLAIN_BYTES):
                return None
        except UnicodeEncodeError:
            return None
        return b"".join(map(self.words.__getitem__, self.split(text.lower() if self.by_word else text)))

    def __missing__(self, chunk: str) -> bytes:
        out = self.plain(chunk)
        if out is None:
            out = self.whole(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = out
        return out

    def text(self, text: str | None) -> bytes:
        """Ids of a whole text; of a null one, none."""
        if not text:
            return b""
        for held_ in (self, self.words):
            if len(held_) > self.remembered:
                held_.clear()
        if any(map((text.lower() if self.by_word else text).__contains__, self.added)):
            return self.whole(text)
        out = self.plain(text)
        if out is not None:
            return out
        if not self.by_word and UNCERTAIN.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, self.chunks(text)))


_held: dict[tuple[str, bool], Ids] = {}


def held(path: str, by_word: bool = False, remembered: int = REMEMBERED) -> Ids:
    """One for each worker process and file."""
    if (path, by_word) not in _held:
        _held[path, by_word] = Ids(path, by_word, remembered)
    return _held[path, by_word]
