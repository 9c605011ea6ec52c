"""Token ids of whole texts with a public tokenizer, word by word.

Byte-pair tokenizers cut a text into words first and encode each by itself, so the ids of a text are those
of its words. Most words of a corpus repeat; a task keeps the ids of frequent ones. ``Encoder`` cuts only
where the tokenizer itself cuts, and gives everything it is not sure of to the tokenizer as a whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Letters, digits and white space up to U+00FF, as the tokenizers' expressions see them.
L, N, S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
CONTRACTIONS = "'(?:[sdmt]|ll|ve|re)"
SPACED = re.compile(rf" ?[{L}]+|{CONTRACTIONS}| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
BARE = re.compile(rf"[{L}]+|{CONTRACTIONS}|[{N}]|[^{S}{L}{N}]+")
SAFE_SPACE = re.compile(r"(?<=\S) ")
BLANK_BEFORE_SPACE = re.compile(r"\s ")
#: Bounds of what a task remembers, in words and in pieces of words.
WORDS, PIECES, LONGEST = 400_000, 400_000, 40


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the others
    for the code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(hidden)}


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Same ids as ``Tokenizer.encode(text, add_special_tokens=False)``, as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before, normal = kind.get("pre_tokenizer") or {}, json.dumps(kind.get("normalizer"))
        split = json.dumps(before)
        self.kind = "whole"
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and normal == "null":
            self.kind = "spaced"
        elif "Lowercase" in normal and "NFC" in normal and '"Removed"' in split and "[^\\\\s\\\\p{L}\\\\p{N}]+" in split:
            self.kind = "bare"
        self.marks = [t["content"] for t in kind.get("added_tokens", [])]
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.space = chr(self.letters[32])
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        """By the tokenizer as a whole."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            if piece[-1].isalpha() and piece.isascii():  # an optional space and letters
                letters = piece.replace(" ", self.space)
            else:
                letters = piece.encode().decode("latin-1").translate(self.letters)
            found = array("H" if self.dtype.itemsize == 2 else "I", [t.id for t in self.model.tokenize(letters)]).tobytes()
            if len(self.pieces) < PIECES and len(piece) <= LONGEST:
                self.pieces[piece] = found
        return found

    def _word(self, word: str, space: str, latin: bool) -> bytes:
        """Ids of a word that no cut goes through; ``space`` is what the tokenizer sees before it."""
        if not latin and not is_latin(word):
            return self._ids(space + word)
        if self.kind == "bare":
            word = word.lower()
        if word.isalpha():
            return self._piece(space + word)
        if word[-1:] in {".", ","} and word[:-1].isalpha():
            return self._piece(space + word[:-1]) + self._piece(word[-1])
        found = SPACED.findall(space + word) if self.kind == "spaced" else BARE.findall(word)
        return b"".join(map(self._piece, found))

    def encode(self, text: str) -> bytes:
        if self.kind == "whole" or any(m in text for m in self.marks):
            return self._ids(text)
        latin = is_latin(text)
        if self.kind == "bare":
            text = text.lower() if latin else text
            first, space, words = b"", "", text.replace("\n", " ").split(" ")
        else:
            # a space is a place to cut only where no white space stands before it
            cut = SAFE_SPACE.split(text) if BLANK_BEFORE_SPACE.search(text) else text.split(" ")
            first, space, words = self._word(cut[0], "", latin), " ", cut[1:]
        found = list(map(self.words.get, words))
        if None in found:
            for i in [i for i, ids in enumerate(found) if ids is None]:
                found[i] = ids = self._word(words[i], space, latin)
                if len(self.words) < WORDS and len(words[i]) <= LONGEST and "\n" not in words[i]:
                    self.words[words[i]] = ids
        return first + b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker, so that its tasks share what they remember."""
    return Encoder(path)
