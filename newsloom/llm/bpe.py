"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a pre-token exactly one vocabulary token ends its encoding. The tokens that end at a position come
from an automaton over the vocabulary; a token may follow the last token of the prefix before it if the two survive
next to each other, that is if merging their joint bytes gives back just these two. The back-pointers from the end give
the exact ids. No merge loop runs over the text.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import ahocorasick
import numpy as np
import regex

#: Fixed value: the split pattern that belongs to the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class Vocabulary:
    """tokens by id, and of each the two parts of its last merge (a single byte: its own id twice)."""

    tokens: list[bytes]
    left: np.ndarray
    right: np.ndarray


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return ranks[parts[0]], ranks[parts[1]]


_loaded: dict[str, Vocabulary] = {}


def load_vocabulary(tokenizer_dir: str = TOKENIZER_DIR, name: str = VOCABULARY) -> Vocabulary:
    """Read a rank file (base64 token, rank per line); about 0.8 MB, a fixed size whatever the corpus."""
    path = f"{tokenizer_dir}/{name}"
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * len(ranks)
        left, right = np.empty(len(ranks), np.int32), np.empty(len(ranks), np.int32)
        for t, r in ranks.items():
            tokens[r] = t
            left[r], right[r] = (r, r) if len(t) == 1 else _last_merge(t, ranks)
        _loaded[path] = Vocabulary(tokens, left, right)
    return _loaded[path]


class PrefixEncoder:
    def __init__(self, vocabulary: Vocabulary, memo_limit: int = 300_000):
        self.tokens = vocabulary.tokens
        self.left, self.right = vocabulary.left.tolist(), vocabulary.right.tolist()
        self.joined = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if len(self.tokens[i]) > 1}
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.finditer = regex.compile(PATTERN).finditer
        self.memo: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo_limit = memo_limit

    def stays_apart(self, a: int, b: int) -> bool:
        """True if encoding the bytes of ``a`` and ``b`` together gives [a, b].

        Undoes merges from the latest one back; the border is safe unless two parts that meet at it could have merged
        before the merge that hid one of them.
        """
        key = (a, b)
        known = self.pairs.get(key)
        if known is not None:
            return known
        left, right, joined = self.left, self.right, self.joined
        before = 1 << 60
        while True:
            m = joined.get((a, b))
            if m is not None and m < before:
                ok = False
                break
            if a > b:
                before, a = a, right[a]
                if a == before:
                    before, b = b + 1, left[b]
                    if b + 1 == before:
                        ok = True
                        break
            else:
                before, b = b + 1, left[b]
                if b + 1 == before:
                    before, a = a, right[a]
                    if a == before:
                        ok = True
                        break
        if len(self.pairs) >= 1_000_000:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode_bytes(self, data: bytes) -> list[int]:
        n = len(data)
        last, length = [-1] * (n + 1), [0] * (n + 1)
        for end, (token, size) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start == 0 or self.stays_apart(last[start], token):
                last[end], length[end] = token, size
        ids = []
        while n > 0:
            ids.append(last[n])
            n -= length[n]
        ids.reverse()
        return ids

    def encode_word(self, word: str) -> list[int]:
        ids = self.memo.get(word)
        if ids is None:
            ids = self.encode_bytes(word.encode("utf-8", "replace"))
            if len(word) <= 64:
                if len(self.memo) >= self.memo_limit:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; the strings of special tokens count as ordinary text. '' and None give []."""
        out: list[int] = []
        if text:
            get, miss = self.memo.get, self.encode_word
            for w in self.split(text):
                out += get(w) or miss(w)
        return out


_encoders: dict[str, PrefixEncoder] = {}


def worker_encoder(key: str, shared) -> PrefixEncoder:
    """The encoder of this Python worker for the rank file ``key``, built once from the broadcast vocabulary."""
    if key not in _encoders:
        _encoders[key] = PrefixEncoder(shared.value)
    return _encoders[key]
