"""Token ids by a public tokenizer, with a cache of words that gives the same ids faster."""

from __future__ import annotations

import json
from array import array

import numpy as np

MOST_WORDS = 300_000
#: The pre-tokenizer of byte-level BPE vocabularies of this kind; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _Words(dict):
    """Word -> its ids as little-endian 32-bit bytes."""

    def __init__(self, encode, piece, prefix: str):
        """encode takes any text; piece takes the bytes of one piece of the pre-tokenizer, if there is such a function."""
        super().__init__()
        self.encode, self.piece, self.prefix = encode, piece, prefix

    def __missing__(self, word: str) -> bytes:
        text = self.prefix + word
        # Letters alone, with a blank before them or none, are one piece.
        ids = array("I", self.piece(text.encode()) if self.piece and word.isalpha() else self.encode(text)).tobytes()
        if len(self) < MOST_WORDS:
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts as bytes, exactly those of tokenizer.encode(text, add_special_tokens=False).

    The byte-level pre-tokenizer starts a new piece at every single space or newline that stands between
    two characters that are not white space, so words with their leading space can be encoded one by one.
    Texts with other white space or control strings go to the tokenizer whole. Single words go through
    ranked merges, which give the same ids wherever the file's merges stand in the order of their ids
    (this is checked; the tokenizer encodes the words of other files).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        encode, piece = _ranked(path) or (lambda word: self.tokenizer.encode(word, add_special_tokens=False).ids, None)
        self.first, self.rest = _Words(encode, piece, ""), _Words(encode, piece, " ")
        self.newline = self.whole("\n")

    def words(self, text: str) -> tuple[list[str], list[bytes]] | None:
        """Words and their ids, newlines as words of their own; None for a text that must be encoded whole."""
        if not text or "<|" in text:
            return None
        # As many separators as words have gaps, each one blank or newline and one character long.
        words, breaks = text.split(), text.count("\n")
        if text.count(" ") + breaks != len(words) - 1 or sum(map(len, words)) + len(words) - 1 != len(text):
            return None
        if not breaks:
            return words, [self.first[words[0]], *map(self.rest.__getitem__, words[1:])]
        words, ids = [], []
        for line in text.split("\n"):
            if words:
                words.append("\n")
                ids.append(self.newline)
            own = line.split(" ")
            words += own
            ids.append(self.first[own[0]])
            ids.extend(map(self.rest.__getitem__, own[1:]))
        return words, ids

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""

    def encode(self, text: str) -> bytes:
        found = self.words(text)
        return b"".join(found[1]) if found else self.whole(text)


def _letters() -> dict[str, int]:
    """Byte-level BPE writes bytes 33-126, 161-172 and 174-255 as themselves, the others as 256, 257, ... in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def _ranked(path: str):
    """Fast encoders of words and of single pieces, or None if ids don't stand in the order of merges."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    at = [vocab.get(a + b, -1) for a, b in merges]
    if at != sorted(at) or at[:1] == [-1] or len(at) + 256 > len(vocab):
        return None
    back = _letters()
    ranks = {bytes(back[c] for c in text): i for text, i in vocab.items() if all(c in back for c in text) and (len(text) == 1 or i >= at[0]) and i <= at[-1]}
    found = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return found.encode_ordinary, getattr(getattr(found, "_core_bpe", None), "encode_single_piece", None)


def byte_table(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE vocabulary file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    back, vocab, added = _letters(), model["model"]["vocab"], model.get("added_tokens", [])
    table = [b""] * (max([*vocab.values(), *(x["id"] for x in added)]) + 1)
    for text, i in vocab.items():
        table[i] = bytes(back[c] for c in text) if all(c in back for c in text) else text.encode()
    for x in added:
        table[x["id"]] = x["content"].encode()
    return table
