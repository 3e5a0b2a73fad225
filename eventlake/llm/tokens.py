"""Token ids of a public word-level byte-pair vocabulary, a slice of texts at a time.

White space separates the pre-tokens of this vocabulary, so a text's ids are those of
its words one after another. Words are numbered; those that a worker hasn't seen are
encoded together: pieces of plain letters by one call of tiktoken over the same merges,
other pieces by the vocabulary's own model, and words that need normalising by the whole
tokenizer. The ids of a slice are then gathered from an array.

tiktoken joins two neighbours if their concatenation is a token, the tokenizer if the
vocabulary has that merge. Both do the same wherever the tokenizer's merges turn each
token's own characters into that token, for neighbours meet with all that lies inside of
them already settled; tokens of which this isn't so are left out of the table (of the
default vocabulary none), as no text can have them.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import regex
import tiktoken
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: The vocabulary's pre-token pattern and its mark of a word's end.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_OF_WORD = "</w>"
#: Words of these characters alone need no normalisation but lower case.
_LINES = re.compile(r"[\n\x21-\x7E\xA1-\xAC\xAE-įı-ňŊ-ž]+")
#: Pieces of these letters alone go through tiktoken: each byte of theirs has a character of its
#: own, and another one at a word's end, so that a piece is a string of one-byte characters.
_LETTERS = re.compile("[a-zß-öø-ÿ]{1,100}")


def _byte_characters() -> dict[int, str]:
    """Byte-level BPE writes a printable byte as itself and the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


def _settles(parts: list[str], rank: dict[tuple[str, str], int]) -> bool:
    """Whether the merges turn these symbols into one."""
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
        if (parts[best], parts[best + 1]) not in rank:
            return False
        parts = [*parts[:best], parts[best] + parts[best + 1], *parts[best + 2 :]]
    return True


class LetterPieces:
    """Ids of many pieces of plain letters in one call. ``check`` leaves tokens out that no merges
    lead to; the default vocabulary has none (tests/llm), so its workers save the second."""

    def __init__(self, path: str, *, check: bool = True):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        rank = {pair: i for i, pair in enumerate(pairs)}
        letters = [bytes([b]) for b in range(0x61, 0x7B)] + [bytes([b]) for b in range(0x9F, 0xC0)]
        free = [chr(c) for c in range(1, 0x7F) if c not in (0x20, *range(0x41, 0x5B), *range(0x61, 0x7B))]
        shown = _byte_characters()
        inner = {shown[b[0]]: chr(b[0]) if b[0] < 0x80 else free.pop() for b in letters} | {shown[0xC3]: free.pop()}
        last = {shown[b[0]]: chr(b[0] - 0x20) if b[0] < 0x80 else free.pop() for b in letters}
        ranks, self.ids, self.ends = {}, np.zeros(len(pairs) + 1000, np.uint32), np.zeros(len(pairs) + 1000, bool)

        def add(token: str, at: int) -> None:
            end = token.endswith(END_OF_WORD)
            body = token.removesuffix(END_OF_WORD)
            symbols = [*body[:-1], body[-1] + END_OF_WORD] if end else list(body)
            known = all(c in inner for c in body[:-1]) and body[-1] in (last if end else inner)
            if known and (not check or _settles(symbols, rank)):
                ranks["".join(inner[c] for c in body[:-1]).encode() + (last if end else inner)[body[-1]].encode()] = at
                self.ids[at], self.ends[at] = model["vocab"][token], end

        at = 0
        for c in inner:
            add(c, at)
            at += 1
        for c in last:
            add(c + END_OF_WORD, at)
            at += 1
        for a, b in pairs:
            add(a + b, at)
            at += 1
        self.coder = tiktoken.Encoding("pieces", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.inner = str.maketrans({chr(b[0]) if b[0] < 0x80 else chr(b[0] + 0x40): inner[shown[b[0]]] if b[0] < 0x80 else inner[shown[0xC3]] + inner[shown[b[0]]] for b in letters})
        self.last = {chr(b[0]) if b[0] < 0x80 else chr(b[0] + 0x40): last[shown[b[0]]] if b[0] < 0x80 else inner[shown[0xC3]] + last[shown[b[0]]] for b in letters}

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, how many each has)."""
        line = " ".join([p[:-1].translate(self.inner) + self.last[p[-1]] for p in pieces])
        at = np.array(self.coder.encode_ordinary(line), np.int64)
        return self.ids[at], np.diff(np.flatnonzero(self.ends[at]) + 1, prepend=0)


class _Places(dict):
    """Word to its number; a new word gets the next one."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Known:
    """Words or pieces by number, with the ids of each in one array."""

    def __init__(self):
        self.places, self.filled, self.used = _Places(), 0, 0
        self.flat, self.start, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def numbers(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, words), np.int64, len(words))

    def new(self) -> list:
        return list(self.places)[self.filled :] if len(self.places) > self.filled else []

    def fill(self, ids: np.ndarray, size: np.ndarray) -> None:
        """The ids of the next words."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.filled + len(size) > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        at = slice(self.filled, self.filled + len(size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[at], self.start[at] = size, self.used + np.cumsum(size) - size
        self.used, self.filled = self.used + len(ids), self.filled + len(size)

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of these words one after another, how many each has)."""
        size = self.size[numbers]
        upto = np.cumsum(size)
        return self.flat[np.repeat(self.start[numbers] - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)], size


def _sums(size: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs that end at ``ends``."""
    return np.diff(np.append(0, np.cumsum(size))[ends], prepend=0)


class WordEncoder:
    """Ids of texts as uint32; one for each worker process. It forgets its words when they are
    over ``cached`` (between slices)."""

    def __init__(self, path: str | None = None, cached: int = 250_000):
        own = path is not None
        path = path or public_tokenizers.path(VOCABULARY)
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cached = self.tokenizer.model, cached
        self.letters = LetterPieces(path, check=own)
        self.pattern = regex.compile(PATTERN + r"|\n")
        self.table = str.maketrans({chr(b): c for b, c in _byte_characters().items()})
        self.words, self.pieces = _Known(), _Known()

    def _plain_words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lower-case words that each end with a line feed."""
        if len(self.pieces.places) > self.cached:
            self.pieces = _Known()
        numbers = self.pieces.numbers(self.pattern.findall(text))
        new = self.pieces.new()
        plain = [p for p in new if _LETTERS.fullmatch(p)]
        ids, size = self.letters.encode(plain)
        other = {}
        for p in new:
            if not _LETTERS.fullmatch(p):
                shown = p if p.isascii() else p.encode().decode("latin-1").translate(self.table)
                other[p] = [] if p == "\n" else [t.id for t in self.model.tokenize(shown)]
        if other:
            stops, made, sizes, k = np.cumsum(size), [], [], 0
            for p in new:
                if p in other:
                    made.append(np.array(other[p], np.uint32))
                else:
                    made.append(ids[stops[k] - size[k] : stops[k]])
                    k += 1
                sizes.append(len(made[-1]))
            ids, size = np.concatenate(made), np.array(sizes)
        self.pieces.fill(ids, size)
        ids, size = self.pieces.gather(numbers)
        return ids, _sums(size, np.flatnonzero(numbers == self.pieces.places["\n"]) + 1)

    def _learn(self) -> None:
        new = self.words.new()
        text = (b"\n".join(new) + b"\n").decode("utf-8", "replace")
        if _LINES.fullmatch(text) and "<|" not in text:
            self.words.fill(*self._plain_words(text.lower()))
            return
        each = text[:-1].split("\n")
        plain = [bool(_LINES.fullmatch(w)) and "<|" not in w for w in each]
        ids, size = self._plain_words("".join(f"{w.lower()}\n" for w, p in zip(each, plain, strict=True) if p))
        stops, made, k = np.cumsum(size), [], 0
        for w, p in zip(each, plain, strict=True):
            if p:
                made.append(ids[stops[k] - size[k] : stops[k]])
                k += 1
            else:
                made.append(np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32))
        self.words.fill(np.concatenate(made), np.array(list(map(len, made)), np.int64))

    def batch(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, how many each has); a null text has none.
        Bytes that aren't UTF-8 count as U+FFFD."""
        if len(self.words.places) > self.cached:
            self.words = _Known()
        each = [self.words.numbers(t.split() if t else []) for t in texts]
        if self.words.new():
            self._learn()
        ids, size = self.words.gather(np.concatenate([*each, np.zeros(0, np.int64)]))
        return ids, _sums(size, np.cumsum(list(map(len, each)), dtype=np.int64))

    def ids(self, text: str | None) -> np.ndarray:
        return self.batch([text.encode("utf-8", "surrogatepass") if text else None])[0]


_ENCODERS: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """The worker's encoder for a vocabulary file (its path is a parameter; never copied)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
