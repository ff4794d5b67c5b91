"""Token ids of whole texts, looked up by word.

A tokenizer file is the user's parameter. Both kinds used here split a text into pre-tokens that
never reach over the blocks formed below, so the ids of a text are the ids of its blocks in order:

* ``word``: white space is dropped, so a block is a run of non-space bytes;
* ``byte``: one space belongs to the word behind it, so a block is a word with its space or the
  rest of a run of white space. Texts with special strings or with white space beyond ASCII, where
  this does not hold, are encoded whole.

Every distinct block is encoded once in a worker; tables are emptied when they reach ``LIMIT``
entries, so memory stays bounded whatever the input's vocabulary.
"""

from __future__ import annotations

import codecs
import re
import struct
import unicodedata
import zlib

from .common import _KEPT, worker_for

LIMIT = 900_000
BLOCK = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]+")
ODD_SPACE = re.compile(rb"[\t\x0b\f\r]")
# UTF-8 forms of the Unicode white space beyond ASCII
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
# The two pre-token patterns of the tokenizer files.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


MARKS = frozenset(".,;:!?")


def byte_alphabet() -> list[str]:
    """The printable stand-in of every byte: itself when printable Latin-1, else the next code
    point from 256 on."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < 64 else struct.pack(f"<{len(ids)}I", *ids)


class Tokens(dict):
    """Block of a text (bytes) -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer
        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.kind = "word" if self.tok.normalizer is not None else "byte"
        self.find = regex.compile(WORD_PIECES if self.kind == "word" else BYTE_PIECES).findall
        self.alphabet = "".join(byte_alphabet())
        self.space = self.alphabet[32]
        self.tokenize = self.tok.model.tokenize
        self.marks = {m.encode(): self.piece(m) for m in sorted(MARKS)}
        self.behind_space = _BehindSpace(self)
        self.specials = re.compile(b"|".join(re.escape(s.encode()) for s in self.special) or b"(?!)")

    def pretokens(self, word: str) -> list[str] | None:
        """Pre-tokens of one block in the byte alphabet; None where only the library may tell
        (special strings, scripts beyond Latin)."""
        plain = word.isascii()
        if not plain and max(word) >= "ɐ" or "<|" in word:
            return None
        if self.kind == "word":
            word = (word if plain else unicodedata.normalize("NFC", word)).lower()
            body = word
        else:
            body = word[1:] if word[0] == " " else word
        # letters alone are one pre-token, and so is the mark behind them
        if body.isalpha():  # below U+0250 these are the letters of \p{L}
            pieces = [word]
        elif body[-1:] in MARKS and body[:-1].isalpha():
            pieces = [word[:-1], body[-1]]
        else:
            pieces = self.find(word)
        if plain and word.isprintable():
            return pieces if " " not in word else [p.replace(" ", self.space) for p in pieces]
        return [codecs.charmap_decode(p.encode(), "strict", self.alphabet)[0] for p in pieces]

    def whole(self, text: bytes) -> bytes:
        return _packed(self.tok.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        """Ids of one pre-token in the byte alphabet."""
        return _packed([t.id for t in self.tokenize(piece)])

    def encoded(self, block: bytes) -> bytes:
        pieces = self.pretokens(block.decode("utf-8", "replace"))
        if pieces is None:
            return self.whole(block)
        return self.piece(pieces[0]) if len(pieces) == 1 else b"".join(map(self.piece, pieces))

    def __missing__(self, block: bytes) -> bytes:
        # a word with a mark behind it is the word and the mark
        mark = self.marks.get(block[-1:])
        out = self[block[:-1]] + mark if mark and block[:-1].isalpha() else self.encoded(block)
        if len(block) <= 64:
            self[block] = out
        return out

    def blocks(self, text: bytes) -> list[bytes] | None:
        """Blocks of a text, or None where it must be encoded whole."""
        if self.kind == "word":
            return text.split()
        if WIDE_SPACE.search(text) or self.specials.search(text):
            return None
        return BLOCK.findall(text)

    def trim(self) -> None:
        for held in (self, self.behind_space):
            if len(held) > LIMIT:
                held.clear()

    def ids(self, text: bytes) -> bytes:
        """Ids of a whole text."""
        if self.kind == "word":
            return b"".join(map(self.__getitem__, text.split()))
        if WIDE_SPACE.search(text) or self.specials.search(text):
            return self.whole(text)
        out, line_end, behind_space = [], b"", self.behind_space.__getitem__
        for line in text.split(b"\n"):
            words = line.split(b" ")
            if b"" in words or ODD_SPACE.search(line):  # longer runs of white space
                return b"".join(map(self.__getitem__, BLOCK.findall(text)))
            if line_end:
                out.append(self[line_end])
            line_end = b"\n"
            out.append(self[words[0]])
            out.extend(map(behind_space, words[1:]))
        return b"".join(out)


class _BehindSpace(dict):
    """Word (bytes) -> ids of the block that one space and the word are."""

    def __init__(self, table: Tokens):
        super().__init__()
        self.table = table

    def __missing__(self, word: bytes) -> bytes:
        table = self.table
        mark = table.marks.get(word[-1:])
        if word.isalpha():
            out = table.piece(table.space + word.decode())
        elif mark and word[:-1].isalpha():
            out = self[word[:-1]] + mark
        else:
            out = table.encoded(b" " + word)
        if len(word) <= 64:
            self[word] = out
        return out


_LOADED: dict[str, Tokens] = {}
_KEPT.append(_LOADED)


def tokens(path: str) -> Tokens:
    """The worker's table for a tokenizer file; it is kept from task to task of such operators."""
    worker_for("tokens")
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def crc(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
