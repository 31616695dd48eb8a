"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch of texts are held as one flat array of symbols with the number of the sequence that each belongs to. Every
round looks up the rank of all neighbouring pairs at once, takes each sequence's lowest rank, and merges all its occurrences
simultaneously (of overlapping ones every second, from the left). Sequences without a known pair leave. The symbols that
survive are counted. As a merge makes only pairs of higher rank, the order of merges is that of merging one pair at a time.

Memory: texts come some MB at a time; distinct pre-tokens are merged in groups of bounded symbols; counts of words are kept in
two caches of CACHE / 2 entries: when the younger is full the older goes, and words that are met again move to the younger. A
pre-token of over LONG symbols is merged with a heap, for the same result.

Specifications: byte-level BPE with an end-of-word suffix after NFC, white space and lower case, and one split pattern, as the JSON
must say; any other is an error, not a wrong count.

Defined results: null text counts as empty (0 tokens); special strings inside texts are single tokens, as the library's default
has it; other columns stay unless their names are those added; rows are independent.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

CACHE, LONG, GROUP = 600_000, 4_000, 1 << 20
_NONE = np.int64(1) << 40


def _bytes_to_chars() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def supported(spec: dict) -> None:
    """Raises ValueError for a specification that this module does not follow."""
    def kinds(x: dict | None, parts: str) -> list[dict]:
        return [] if x is None else x[parts] if x["type"] == "Sequence" else [x]

    model, normal, pre = spec["model"], kinds(spec.get("normalizer"), "normalizers"), kinds(spec.get("pre_tokenizer"), "pretokenizers")
    space = [x for x in normal if x["type"] == "Replace"]
    wrong = [
        model["type"] != "BPE" or not model.get("end_of_word_suffix") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token")),
        [x["type"] for x in normal] != ["NFC", "Replace", "Lowercase"] or space[0]["pattern"] != {"Regex": r"\s+"} or space[0]["content"] != " ",
        [x["type"] for x in pre] != ["Split", "ByteLevel"] or "Regex" not in pre[0]["pattern"] or (pre[0]["behavior"], pre[0]["invert"]) != ("Removed", True),
        len(pre) == 2 and (pre[1].get("add_prefix_space") or pre[1].get("use_regex")),
        any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")) or not all("<|" in t["content"] for t in spec["added_tokens"]),
    ]
    if any(wrong):
        raise ValueError(f"tokenizer parts that are not supported: {[n for n, w in zip(('model', 'normalizer', 'pre_tokenizer', 'pre_tokenizer', 'added_tokens'), wrong, strict=True) if w]}")


class Merger:
    """A byte-level BPE with an end-of-word suffix, read from a tokenizer's JSON."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = _bytes_to_chars()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.final = np.array([vocab[chars[b] + suffix] for b in range(256)], np.int64)
        self.base = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.split_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        # the library's white space is the Unicode property, without U+001C to U+001F
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.cache: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token, none being empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, last = self.inner[raw], np.cumsum(size) - 1
        sym[last] = self.final[raw[last]]
        seq = np.repeat(np.arange(len(words)), size)
        out = np.zeros(len(words), np.int64)
        while len(sym):
            rank = np.full(len(sym), _NONE)
            same = seq[:-1] == seq[1:]
            at = np.flatnonzero(same)
            rank[at] = self._rank(sym[at], sym[at + 1])
            first = np.flatnonzero(np.r_[True, ~same])
            least = np.minimum.reduceat(rank, first)
            count = np.diff(np.r_[first, len(sym)])
            over = least == _NONE
            out[seq[first[over]]] = count[over]
            hit = np.flatnonzero((rank == np.repeat(least, count)) & (rank < _NONE))
            if len(hit):  # of a run of adjacent hits (a pair overlapping itself) every second, from the left
                new = np.r_[True, hit[1:] != hit[:-1] + 1]
                start = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            keep = ~np.repeat(over, count)
            sym[hit] = self.made[rank[hit]]
            keep[hit + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out

    def long(self, word: bytes) -> int:
        """The same count for one long pre-token, by a heap of pairs over a linked list."""
        raw = np.frombuffer(word, np.uint8)
        sym = self.inner[raw]
        sym[-1] = self.final[raw[-1]]
        rank = self._rank(sym[:-1], sym[1:])
        sym, right, left, n = sym.tolist(), list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1)), len(sym)
        right[-1] = -1
        known = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        heap = [(r, i) for i, r in enumerate(rank.tolist()) if r < _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if sym[i] >= 0 else -1
            if j < 0 or known.get(sym[i] * self.base + sym[j]) != r:
                continue
            sym[i], sym[j], n = int(self.made[r]), -1, n - 1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (k := known.get(sym[a] * self.base + sym[b])) is not None:
                    heapq.heappush(heap, (k, a))
        return n

    def learn(self, words: list[bytes]) -> None:
        """Put the counts of new words (runs of anything but ASCII white space, which no pre-token crosses) into the cache."""
        for start in range(0, len(words), 50_000):
            group = words[start : start + 50_000]
            total, pieces, at = [0] * len(group), [], []
            for i, w in enumerate(group):
                parts = [w.decode()]
                if self.split_special and b"<|" in w:
                    parts = self.split_special.split(parts[0])
                    total[i] = len(parts) - 1
                for p in parts:
                    found = self.split.findall(self.normal(p))
                    pieces += found
                    at += [i] * len(found)
            distinct = dict.fromkeys(pieces)
            short: list[str] = []
            size = 0
            for k in [*distinct, None]:
                if k is None or size > GROUP:
                    distinct.update(zip(short, self.lengths([x.encode() for x in short]).tolist() if short else [], strict=True))
                    short, size = [], 0
                if k is not None:
                    if len(k.encode()) > LONG:
                        distinct[k] = self.long(k.encode())
                    else:
                        short.append(k)
                        size += len(k)
            for i, k in zip(at, pieces, strict=True):
                total[i] += distinct[k]
            self.cache.update(zip(group, total, strict=True))

    def normal(self, text: str) -> str:
        """NFC, then each code point's own lower case (a final sigma is no special case). White space only separates."""
        return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()

    def counts(self, texts: list[bytes]) -> list[int]:
        bags = [Counter(t.split()) for t in texts]
        if len(self.cache) > CACHE // 2:
            self.older, self.cache = self.cache, {}
        new = set().union(*bags).difference(self.cache)
        again = new.intersection(self.older)
        self.cache.update((w, self.older[w]) for w in again)
        self.learn(list(new - again))
        get = self.cache.__getitem__
        return [sum(map(int.__mul__, map(get, b), b.values())) for b in bags]


_loaded: dict[int, Merger] = {}


def _merger(spec: str) -> Merger:
    """One for each worker process; it outlives tasks."""
    key = hash(spec)
    if key not in _loaded:
        _loaded[key] = Merger(json.loads(spec))
    return _loaded[key]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit instead of the text. tokenizer: the JSON's path on the driver; its content goes with the tasks."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    supported(spec)
    shipped = docs.sparkSession.sparkContext.broadcast(json.dumps({k: spec[k] for k in ("model", "added_tokens", "pre_tokenizer")}))

    def compute(texts: list[bytes]) -> list:
        n = _merger(shipped.value).counts(texts)
        return [[len(t) for t in texts], n, [x > limit for x in n]]

    return map_texts(docs, text_col, [("n_bytes", pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("over_limit", pa.bool_(), "boolean")], compute, drop=(text_col,))
