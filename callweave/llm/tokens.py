"""Exact token ids for texts, with a cache of the ids of pieces between spaces and line breaks.

Two kinds of tokenizers split a text before they merge, so that the ids of a text are those of its pieces one after another:

* byte-level BPE: a split stands before a space that is followed by a character that is no white space; the space belongs
  to the piece after it. A single line break between two such characters is a piece of its own. A text with other white
  space (two spaces or line breaks in a row, a space at the end or beside a line break) is encoded as a whole.
* word-end BPE: white space separates and is dropped, so every space and line break is a split.

Which kind a tokenizer is, is read from its own description (model, normalizer, pre-tokenizer). Any other tokenizer, and a
text that holds one of the tokenizer's added tokens, is encoded as a whole.

Every id comes from the tokenizers library. A piece of Latin letters, with at most one mark after it, goes straight to
the library's BPE model, because its pre-tokenization is known: the letters, then the mark. All other pieces go through
the whole tokenizer. The cache is bounded; it saves encoding frequent words again.
"""

from __future__ import annotations

import json
import os
import re
from array import array

CACHE_PIECES = 500_000  # of both kinds together, some 100 MB
LATIN_END = "ɏ"  # letters up to here are their own normal form, and lower case goes letter by letter
DOTTED_I = "İ"
SPACE = chr(288)  # how byte-level vocabularies spell a space
MARKS = frozenset(".,;:!?")
# The descriptions that mark the two kinds.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END_NORMAL = ["NFC", "Replace", "Lowercase"]
_ENCODERS: dict[tuple[str, bool], "PieceEncoder"] = {}


def kind_of(path: str) -> str:
    """``bytes`` or ``words``, the two kinds that can be encoded by pieces, or ``other``."""
    with open(path, encoding="utf-8") as file:
        about = json.load(file)
    model, split, normal = about["model"], about["pre_tokenizer"] or {}, about["normalizer"] or {}
    if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or about.get("truncation") or about.get("padding"):
        return "other"
    if not normal and not model.get("end_of_word_suffix") and {k: split.get(k) for k in BYTE_LEVEL} == BYTE_LEVEL:
        return "bytes"
    steps = split.get("pretokenizers", [])
    words = len(steps) == 2 and steps[0].get("pattern") == {"Regex": WORD_END_PATTERN} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[1].get("type") == "ByteLevel" and not steps[1].get("use_regex")
    if words and model.get("end_of_word_suffix") and [x["type"] for x in normal.get("normalizers", [])] == WORD_END_NORMAL:
        return "words"
    return "other"


def vocabulary_size(path: str) -> int:
    """One more than the largest id that the tokenizer can give."""
    with open(path, encoding="utf-8") as file:
        about = json.load(file)
    return 1 + max([*about["model"]["vocab"].values(), *(t["id"] for t in about["added_tokens"])])


class WholeText(Exception):
    """A piece whose ids depend on what stands around it: its text must be encoded at once."""


class Pieces(dict):
    """The ids of each piece met so far, learned on the first look."""

    def __init__(self, owner: "PieceEncoder", space: str):
        self.owner, self.space = owner, space

    def __missing__(self, piece: str) -> bytes:
        mark = piece[-1:] if piece[-1:] in MARKS else ""
        word = piece[:-1] if mark else piece
        kept = not mark or word in self  # a rare word takes one place, whatever mark follows it
        if word.isalpha() and max(word) <= LATIN_END and DOTTED_I not in word:
            ids = self[word] + self.owner.marks[mark] if mark else self.owner.word(word, self.space)
        elif self.owner.space_joins_piece and (not piece or piece[0].isspace() or piece[-1].isspace()):
            raise WholeText
        else:
            ids = self.owner.whole(self.space + piece)
        if kept and len(self.owner.first) + len(self.owner.rest) < CACHE_PIECES:
            self[piece] = ids
        return ids


class PieceEncoder:
    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text  # if set, their strings in a text are ordinary text
        self.kind = kind_of(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values() if not (special_as_text and t.special)]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model, self.space_joins_piece = self.library.model, self.kind == "bytes"
        if self.kind == "other":
            return
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
        self.letters = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(kept))}
        self.marks = {m: self.whole(m) for m in MARKS} | {"": b""}
        self.line = self.whole("\n")
        self.first = Pieces(self, "")
        self.rest = Pieces(self, " " if self.space_joins_piece else "")

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str, space: str) -> bytes:
        """The ids of a word of Latin letters with ``space`` before it."""
        if not self.space_joins_piece:
            word = word.lower()
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(SPACE + word if space else word)]).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as unsigned little-endian 32-bit integers."""
        if not text:
            return b""
        if self.kind == "other" or self.added and self.added.search(text):
            return self.whole(text)
        first, rest = self.first, self.rest
        try:
            lines = []
            for line in text.split("\n"):
                parts = line.split(" ")
                lines.append(first[parts[0]] + b"".join([rest[x] for x in parts[1:]]))
            return self.line.join(lines)
        except WholeText:
            return self.whole(text)


def encoder(path: str, special_as_text: bool = False) -> PieceEncoder:
    """One encoder per Python worker; its cache serves the worker's later tasks too."""
    key = (path, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, special_as_text)
    return _ENCODERS[key]


def encoded(texts: list[str | None], path: str, end_id: int, special_as_text: bool = False):
    """The ids of each text (null: none) with ``end_id`` after them."""
    tail, worker = array("I", [end_id]).tobytes(), encoder(path, special_as_text)
    for text in texts:
        yield worker.encode(text or "") + tail
