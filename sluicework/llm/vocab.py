"""Byte-level BPE vocabularies read from tokenizer files, and exact splitting of texts into pre-tokens.

A vocabulary file is a parameter everywhere; the driver reads it once and broadcasts its bytes (a few MB,
whatever the corpus size), so executors need no copy of it.

Splitting has two ways with one result. Texts of common characters (most of Latin and punctuation), for
which the character classes below are known to equal the tokenizer library's, are split with ``re``.
Any other text is normalised and split by the library's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

COMMON = "\x00-\x1b\x20-\x84\x86-ſ‐-‧‰-⁞₠-₿"
"""Characters that need no library: precomposed, with the same classes and lower case everywhere.

Left out are control characters that ``str.split`` takes for white space and the tokenizers do not."""
ODD = re.compile(f"[^{COMMON}]")


def _span(kind: str) -> str:
    found = [c for c in range(0x2100) if unicodedata.category(chr(c))[0] == kind and not ODD.match(chr(c))]
    out, start = [], None
    for c in [*found, 10**9]:
        if start is not None and c != last + 1:
            out.append(f"\\u{start:04x}-\\u{last:04x}")
            start = None
        start, last = (c if start is None else start), c
    return "".join(out)


LETTER, NUMBER = _span("L"), _span("N")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and added tokens of a BPE file, as lookups for arrays."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        model = spec["model"]
        ids = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.text_of = {i: t for t, i in ids.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        alphabet = byte_alphabet()
        self.byte_of = {ord(c): b for b, c in alphabet.items()}
        self.inner = np.array([ids[alphabet[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([ids[alphabet[b] + self.suffix] for b in range(256)], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.width = max(self.text_of) + 1
        left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))
        self.no_rank = len(keys)
        self.one_merge_each = len(np.unique(self.merged)) == len(pairs)
        """Every token has one merge, so a merge never makes way for one of lower rank."""
        self.added_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``no_rank`` where it does not merge."""
        want = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], self.no_rank)

    def symbols(self, token: bytes) -> np.ndarray:
        """Starting symbols of a pre-token given as its bytes."""
        raw = np.frombuffer(token, dtype=np.uint8)
        out = self.inner[raw]
        out[-1] = self.final[raw[-1]]
        return out

    def pieces(self, text: str) -> list[tuple[str, int | None]]:
        """The text between added tokens (id None), and those tokens with their ids, in order."""
        if self.added_pattern is None or "<" not in text:
            return [(text, None)] if text else []
        out, at = [], 0
        for m in self.added_pattern.finditer(text):
            out += [(text[at : m.start()], None)] if m.start() > at else []
            out.append((m[0], self.added[m[0]]))
            at = m.end()
        return out + ([(text[at:], None)] if at < len(text) else [])


class LibrarySplitter:
    """Normaliser and pre-tokeniser of the tokenizers library, made when a text first needs them."""

    def __init__(self, data: bytes, vocab: Vocabulary) -> None:
        self.data, self.vocab, self.made = data, vocab, None

    def __call__(self, text: str) -> list[bytes]:
        if self.made is None:
            from tokenizers import Tokenizer

            self.made = Tokenizer.from_str(self.data.decode())
        if self.made.normalizer is not None:
            text = self.made.normalizer.normalize_str(text)
        table = self.vocab.byte_of
        return [bytes(map(table.__getitem__, map(ord, t))) for t, _ in self.made.pre_tokenizer.pre_tokenize_str(text)]
