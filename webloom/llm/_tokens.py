"""Token counts under a public byte-pair vocabulary, without encoding every word anew.

The vocabulary's splitting rule never joins a word to the white space behind it, so a text's
count is the sum over its words, each with the white space before it.  Such units are hashed
in bulk; only those not met before are encoded, and their counts kept in two sorted arrays.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from webloom.llm import _text as X

#: The splitting rule that goes with the byte-level vocabularies of 50k entries.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII, which the rule may join to its neighbours: such texts are encoded whole.
_ODD = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    def __init__(self, path: str, most: int = 2_000_000):
        self.encode, self.most = encoding(path).encode_ordinary, most
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.uint32)

    def _of(self, text: bytes) -> int:
        return len(self.encode(text.decode("utf-8", "replace")))

    def __call__(self, col: pa.Array) -> np.ndarray:
        """Tokens of each row; none for a null."""
        data, starts, ends, first = X.units(col)
        if not len(starts):
            return np.zeros(len(col), np.int64)
        coded = pa.array(X.span_hashes(data, starts, ends)).dictionary_encode()
        uniq, back = np.asarray(coded.dictionary), np.asarray(coded.indices)
        at = np.flatnonzero(np.diff(np.maximum.accumulate(back), prepend=-1))  # entries are in the order in which they come first
        order, slot = np.argsort(uniq), np.empty(len(uniq), np.int64)
        slot[order] = np.searchsorted(self.keys, uniq[order])
        known = np.zeros(len(uniq), bool)
        inside = slot < len(self.keys)
        known[inside] = self.keys[slot[inside]] == uniq[inside]
        counts = np.empty(len(uniq), np.uint32)
        counts[known] = self.counts[slot[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            counts[new] = [self._of(raw[a:b]) for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            if len(self.keys) > self.most:
                self.keys, self.counts = uniq[order], counts[order]
            else:
                new = new[np.argsort(uniq[new])]
                self.keys, self.counts = np.insert(self.keys, slot[new], uniq[new]), np.insert(self.counts, slot[new], counts[new])
        run = np.concatenate([[0], np.cumsum(counts[back], dtype=np.int64)])
        out = run[first[1:]] - run[first[:-1]]
        odd = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(col, _ODD), False)))
        for i in odd:
            out[i] = len(self.encode(col[i].as_py()))
        return out


@cache
def counter(path: str) -> Counter:
    return Counter(path)
