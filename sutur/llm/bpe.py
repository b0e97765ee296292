"""Byte-level BPE in linear time.

A text is cut into pieces by the tokenizer's public pattern; merges never cross pieces. Within a
piece the token sequence of BPE is found left to right: take the longest token that matches (an
Aho-Corasick automaton over the vocabulary, bytes mapped to Latin-1 characters), accept it if the
pair with the token before is one BPE itself would leave (adjacent-token compatibility, memoised),
else try the next shorter token that is a prefix, else step back over the last token. Positions
given up are never visited twice, so the work is linear in the piece. Results equal the exact
merge order.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass, field

import ahocorasick
import regex

# Fixed value: the public pattern that cuts a text into pieces before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces longer than this are not kept in the piece cache, and the cache holds at most so many.
CACHED_LENGTH = 48
CACHED_PIECES = 400_000
CACHED_PAIRS = 1_000_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a ``.tiktoken`` file by id; ids must be 0..n-1 and merges ranked by id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    tokens = [b""] * len(ranks)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


@dataclass
class BytePairEncoder:
    """Encoder over tokens ordered by merge rank; the 256 single bytes are among them."""

    tokens: list[bytes]
    pattern: str = PATTERN
    _ids: dict[bytes, int] = field(init=False, repr=False)
    _pieces: dict[str, tuple[int, ...]] = field(init=False, default_factory=dict, repr=False)
    _fits: dict[tuple[int, int], bool] = field(init=False, default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        self._ids = {token: rank for rank, token in enumerate(self.tokens)}
        self._cut = regex.compile(self.pattern)
        automaton = ahocorasick.Automaton()
        for rank, token in enumerate(self.tokens):
            automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        self._automaton = automaton
        self._length = [len(token) for token in self.tokens]
        self._split, self._pair = self._merges()
        self._shorter = [self._prefix(token) for token in self.tokens]

    def _merges(self) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
        """The two tokens that each token is merged from last, replayed in rank order."""
        split: list[tuple[int, int]] = []
        pair: dict[tuple[int, int], int] = {}
        for rank, token in enumerate(self.tokens):
            if len(token) == 1:
                split.append((rank, rank))
                continue
            parts = [self._ids[token[i : i + 1]] for i in range(len(token))]
            while len(parts) > 2:  # replay merges below this rank, lowest first
                best = min(
                    (pair.get((a, b), len(self.tokens)), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                )
                if best[0] >= rank:
                    raise ValueError(f"token {rank} is not reachable by merges")
                parts[best[1] : best[1] + 2] = [best[0]]
            split.append((parts[0], parts[1]))
            pair[parts[0], parts[1]] = rank
        return split, pair

    def _prefix(self, token: bytes) -> int:
        """The longest token that is a proper prefix, or -1."""
        for end in range(len(token) - 1, 0, -1):
            if (found := self._ids.get(token[:end])) is not None:
                return found
        return -1

    def _compatible(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` side by side: undoing their merges from the
        highest rank down, no pair across the border may have been merged earlier."""
        key = (left, right)
        known = self._fits.get(key)
        if known is not None:
            return known
        limit = len(self.tokens) + 1
        fits = True
        while True:
            merged = self._pair.get((left, right))
            if merged is not None and merged < limit:
                fits = False
                break
            undo_left = left > right
            outer = left if undo_left else right
            inner = self._split[outer][1 if undo_left else 0]
            if inner != outer:
                limit = outer if undo_left else outer + 1
                left, right = (inner, right) if undo_left else (left, inner)
                continue
            other = right if undo_left else left  # one side is a single byte; undo the other
            inner = self._split[other][0 if undo_left else 1]
            if inner == other:
                break
            limit = other + 1 if undo_left else other
            left, right = (left, inner) if undo_left else (inner, right)
        if len(self._fits) >= CACHED_PAIRS:
            self._fits.clear()
        self._fits[key] = fits
        return fits

    def _longest(self, text: str) -> list[int]:
        """The longest token that starts at every position, from one run of the automaton."""
        longest = [-1] * len(text)
        length, most = self._length, [0] * len(text)
        for end, rank in self._automaton.iter(text):
            size = length[rank]
            begin = end - size + 1
            if size > most[begin]:
                most[begin] = size
                longest[begin] = rank
        return longest

    def _encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        whole = self._ids.get(raw)
        if whole is not None:
            return (whole,)
        longest = self._longest(raw.decode("latin-1"))
        length, shorter, compatible = self._length, self._shorter, self._compatible
        n = len(raw)
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at = 0
        token = longest[0]
        while at < n or token >= 0:
            last = out[-1] if out else -1
            while token >= 0 and not (open_at[at + length[token]] and (last < 0 or compatible(last, token))):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < n else -1
            else:
                open_at[at] = 0
                out.pop()
                at -= length[last]
                token = last
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; a null or empty text has none. Special-token strings are ordinary text."""
        if not text:
            return []
        out: list[int] = []
        pieces = self._pieces
        for piece in self._cut.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self._encode_piece(piece)
                if len(piece) <= CACHED_LENGTH:
                    if len(pieces) >= CACHED_PIECES:
                        pieces.clear()
                    pieces[piece] = ids
            out.extend(ids)
        return out


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary files lie, unless ``SUTUR_TOKENIZERS`` names another folder."""
    return os.path.join(os.environ.get("SUTUR_TOKENIZERS", "/opt/tokenizers"), name)
