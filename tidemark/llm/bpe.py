"""Byte-level BPE by backtracking: exact merges in linear time, and decoding by an offset table.

The longest tokens at each byte of a pre-token come from one Aho-Corasick pass. The encoder takes
the longest token at its place, checks it against the token before it in the pair-compatibility
table, falls back to that token's next shorter prefix, and steps back where none fits. The result
is what applying the merges in their order gives.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: The same pattern for the faster standard module, and the characters for which the
#: two would differ (separators that only Python takes for white space, superscripts, fractions,
#: all beyond Latin-1).
PLAIN_PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
NOT_PLAIN = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]"
#: Pre-tokens whose ids a worker remembers; when as many are held, it starts anew.
CACHE = 300_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A vocabulary file of the tokenizers library with a ByteLevel BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        raw = lambda token: bytes(letters[c] for c in token)
        # Inside, a token's number is its place in the order of merges, single bytes first.
        single = {b: c for c, b in letters.items()}
        self.tokens = [bytes([b]) for b in range(256)] + [raw(a + b) for a, b in merges]
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        if len(self.rank) != len(self.tokens):
            raise ValueError("two merges make the same token")
        self.ids = [vocab[single[b]] for b in range(256)] + [vocab[a + b] for a, b in merges]
        self.halves = [(i, i) for i in range(256)] + [(self.rank[raw(a)], self.rank[raw(b)]) for a, b in merges]
        self.merged = {pair: i for i, pair in enumerate(self.halves) if i >= 256}
        self.shorter = [self._prefix(t) for t in self.tokens]
        self.fits: dict[tuple[int, int], bool] = {}
        self.find = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.find.add_word(t.decode("latin-1"), (len(t), i))
        self.find.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.words = regex.compile(PRE_TOKEN).findall
        self.plain_words, self.not_plain = re.compile(PLAIN_PRE_TOKEN).findall, re.compile(NOT_PLAIN).search
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache: dict[str, bytes] = {}
        # Decoding: where each id's bytes lie in one string of bytes.
        table = dict(zip(self.ids, self.tokens, strict=True)) | {i: s.encode() for s, i in self.special.items()}
        parts = [table.get(i, b"") for i in range(max(table) + 1)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _prefix(self, token: bytes) -> int:
        return next((self.rank[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.rank), -1)

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether the merges of the joined bytes leave the two tokens apart: no earlier merge
        joins pieces across the border while either token is still being built."""
        key = (left, right)
        if (known := self.fits.get(key)) is not None:
            return known
        fits = self._apart(left, right, len(self.tokens))
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge before ``limit`` joins pieces across the border."""
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            # Undo the later of the two tokens' last merges; single bytes can't be undone.
            if left > right and left >= 256:
                limit, left = left, self.halves[left][1]
            elif right >= 256:
                limit, right = right + 1, self.halves[right][0]
            elif left >= 256:
                limit, left = left, self.halves[left][1]
            else:
                return True

    def check(self) -> None:
        """Fail if the merges of a token's bytes give something else than the token: longest matches
        would then find what merging never makes. Each token's last merge is looked at; its halves
        were before it."""
        for i in range(256, len(self.tokens)):
            if not self._apart(*self.halves[i], i):
                raise ValueError(f"the vocabulary has {self.tokens[i]!r}, which its merges never make")

    def encode_word(self, word: bytes) -> list[int]:
        """Ranks of one pre-token's tokens."""
        if (whole := self.rank.get(word)) is not None:
            return [whole]
        n = len(word)
        longest = [-1] * (n + 1)
        size = [0] * n
        for end, (length, i) in self.find.iter(word.decode("latin-1")):
            at = end - length + 1
            if length > size[at]:
                size[at], longest[at] = length, i
        tokens, shorter, fits = self.tokens, self.shorter, self.pair_fits
        open_ = bytearray(b"\x01" * (n + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while token >= 0:
            last = out[-1] if out else -1
            while True:
                end = at + len(tokens[token])
                if open_[end] and (last < 0 or fits(last, token)):
                    out.append(token)
                    at, token = end, longest[end]
                    break
                if shorter[token] >= 0:
                    token = shorter[token]
                    continue
                open_[at] = 0
                out.pop()
                at -= len(tokens[last])
                token = last
                break
        return out

    def _miss(self, word: str) -> bytes:
        ids = self.ids
        got = np.array([ids[r] for r in self.encode_word(word.encode("utf-8", "surrogatepass"))], "<u4").tobytes()
        if len(self.cache) >= CACHE:
            self.cache.clear()
        if len(word) <= 64:
            self.cache[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.split is None or not any(s in text for s in self.special):
            return self._encode_plain(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._encode_plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._encode_plain(text[at:])])

    def _encode_plain(self, text: str) -> bytes:
        get, miss = self.cache.get, self._miss
        words = self.words(text) if self.not_plain(text) else self.plain_words(text)
        return b"".join([get(w) or miss(w) for w in words])

    def decode_bytes(self, ids: bytes) -> bytes:
        out = []
        for at in range(0, len(ids), 4 << 16):
            some = np.frombuffer(ids[at : at + (4 << 16)], "<u4").astype(np.int64)
            n = self.lengths[some]
            ends = np.cumsum(n)
            if len(ends) and ends[-1]:
                where = np.repeat(self.starts[some] - ends + n, n)
                where += np.arange(ends[-1])
                out.append(self.blob[where].tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One vocabulary a worker process, kept between tasks."""
    return ByteBPE(path)


@lru_cache(maxsize=2)
def checked(path: str) -> str:
    """The path of a vocabulary that the method is right for; looked at once on the driver."""
    load(path).check()
    return path


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode and decode every whole text.

    Adds token_ids (binary: little-endian unsigned 32-bit ids), n_tokens (long) and decoded
    (string); they replace columns of the same names. A null text counts as empty: no ids, 0 and
    "". Texts of any length are taken whole; repeated rows stay; an empty table gives no rows.
    ``path`` must be readable on every executor.
    """
    checked(path)

    def make():
        bpe = load(path)

        def do(texts: list[bytes | None]) -> list[list]:
            ids = [bpe.encode(t.decode("utf-8", "replace")) if t else b"" for t in texts]
            return [ids, [len(i) // 4 for i in ids], [bpe.decode(i) for i in ids]]

        return do

    fields = [T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]
    return map_text(df, text, fields, make, keep)


def decode(df: DataFrame, path: str, ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Add decoded (string) from a binary column of ids; null ids decode to ""."""

    def make():
        bpe = load(path)
        return lambda rows: [[bpe.decode(i) if i else "" for i in rows]]

    return map_text(df, ids, [T.StructField("decoded", T.StringType())], make, keep)
