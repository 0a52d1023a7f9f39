"""Ids of whole texts by a file of the ``tokenizers`` library, remembering words.

The tokenizers here cut a text into words by a pattern and encode each word by itself.  A text of
common characters is cut by the same pattern here, and only words that the worker has not seen
go to the library's model.

Classes and normal forms of other characters depend on the library.  A text with any is cut
where both kinds of tokenizer cut, before a space that precedes a visible character; pieces with
such characters are encoded by the library whole.  So is a text that may hold a special token.
"""

from __future__ import annotations

import re
from array import array

from tidemark.llm.common import process_memo

#: Words remembered by one Python worker; the memory is emptied when full, which changes no result.
WORDS = 500_000
#: Letters below U+02B0, and characters with no doubt about their class: these, digits, signs and plain white space.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
COMMON = re.compile("[\t\n\r -~¡-¬®-±´-¸º»¿-ʯ]*")
#: What the tokenizers' patterns (fixed values) say for common characters; letters first, as they are most frequent.
SPACED = rf" ?(?:[{LETTERS}]+|[0-9]+)|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
UNSPACED = rf"[{LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\s{LETTERS}0-9]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabularies of byte-level BPE: visible Latin-1
    characters stand for themselves, the others follow from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Words(dict):
    """Ids of words; a new one is encoded when it is asked for."""

    def __init__(self, model):
        self.model, self.letters = model, byte_letters()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        known = self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
        ids = self[word] = array("I", [t.id for t in known]).tobytes()
        return ids


class PieceEncoder:
    """Little-endian unsigned 32-bit ids of texts."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: whether a word keeps the space before it; the vocabulary is not made a text again for this
        self.spaced = json.loads(self.tokenizer.pre_tokenizer.__getstate__())["type"] == "ByteLevel"
        self.cut_words = re.compile(SPACED if self.spaced else UNSPACED).findall
        self.words = _Words(self.tokenizer.model)
        self.cut = re.compile(r" (?=\S)")

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def common(self, text: str) -> bytes:
        """Ids of a text of common characters."""
        return b"".join(map(self.words.__getitem__, self.cut_words(text if self.spaced else text.lower())))

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.whole(text)
        if COMMON.fullmatch(text):
            return self.common(text)
        head, *rest = self.cut.split(text)
        pieces = [head, *(" " + piece for piece in rest)]
        return b"".join(self.common(p) if COMMON.fullmatch(p) else self.whole(p) for p in pieces)


def encoder(path: str) -> PieceEncoder:
    """The encoder of this worker for ``path``."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    memo = process_memo("encoders")
    if path not in memo:
        memo[path] = PieceEncoder(path)
    return memo[path]
