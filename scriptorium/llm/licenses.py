"""License notices by fuzzy search: exact seeds propose places, bounded-error matching confirms them.

A text is lower-cased (A-Z), cut into words (runs of ASCII letters and digits and of anything beyond ASCII) and joined by single
spaces. A notice of which `errors` characters may differ is split into errors + 1 pieces: of any text within that edit distance one
piece stands there unchanged (pigeonhole), so the pieces, found in one pass by an automaton, lead to every place. Around each the
regex library matches the notice with at most that many errors, at word boundaries; what follows a fixed head ("mit", "gnu") may
differ, the head may not, as short names are one letter from other words.

Base notices are those with `base`; their places count if they stand word by word. Spans: first and last word (from 0), code points of
the text [start, end), errors. Where spans of one notice overlap, the one with the fewest errors stays (then the first, then the
shortest): every other one within the bound overlaps it or one that was chosen before it. Score: 1 for a text with a span without errors,
else the largest 1 - errors / length, 0 without spans.

Defined results: null counts as empty: no words, no spans; texts of any length go whole, in time linear in their words and seeds;
rows are independent, so ties and repeats are irrelevant; other columns stay unless their names are those added.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Each byte of a text as its words see it: lower case, and a space for what is in no word.
_SEEN = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())
SPACE = 0x20


@dataclass(frozen=True)
class Notice:
    label: str
    text: str
    errors: int = 0
    head: int = 0  # characters at the start that must stand as they are
    base: bool = False

    def pattern(self) -> regex.Pattern:
        head, rest = regex.escape(self.text[: self.head], literal_spaces=True), regex.escape(self.text[self.head :], literal_spaces=True)
        return regex.compile(f"(?:{head}(?:{rest}){{e<={self.errors}}})(?= |$)" if self.errors else f"{head}{rest}(?= |$)", regex.BESTMATCH if self.errors else 0)

    def seeds(self) -> list[tuple[int, str]]:
        """The errors + 1 pieces with their places in the notice."""
        edges = [round(i * len(self.text) / (self.errors + 1)) for i in range(self.errors + 2)]
        return [(a, self.text[a:b]) for a, b in zip(edges, edges[1:])]


#: One error for about eight characters that may differ, five at most.
NOTICES = (
    Notice("gpl", "gnu general public license", 3, 4, True),
    Notice("apache", "apache license", 1, 0, True),
    Notice("cc-by", "cc by", 0, 0, True),
    Notice("mit", "mit license", 1, 4, True),
    Notice("lgpl", "gnu lesser general public license", 3, 4),
    Notice("lgpl", "gnu library general public license", 3, 4),
    Notice("agpl", "gnu affero general public license", 3, 4),
    Notice("gpl", "gpl license", 1, 4),
    Notice("lgpl", "lgpl license", 1, 5),
    Notice("agpl", "agpl license", 1, 5),
    Notice("bsd", "bsd license", 1, 4),
    Notice("isc", "isc license", 1, 4),
    Notice("mpl", "mozilla public license", 2),
    Notice("epl", "eclipse public license", 2),
    Notice("cddl", "common development and distribution license", 4),
    Notice("cc-by", "creative commons attribution", 3),
    Notice("cc-by-sa", "cc by sa"),
    Notice("cc-by-nc", "cc by nc"),
    Notice("cc-by-nd", "cc by nd"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 5),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 5),
    Notice("unlicense", "this is free and unencumbered software released into the public domain", 5),
)


@dataclass
class Finder:
    notices: tuple[Notice, ...]

    def __post_init__(self):
        by_seed: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(self.notices):
            for at, seed in n.seeds():
                by_seed.setdefault(seed, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for seed, places in by_seed.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()
        self.patterns = [n.pattern() for n in self.notices]

    def candidates(self, text: str) -> set[tuple[int, int]]:
        """(notice, from): word starts from which a match may run, as one of the notice's pieces stands where it would."""
        out = set()
        for end, (size, places) in self.seeds.iter(text):
            for i, at in places:
                n, here = self.notices[i], end + 1 - size - at
                start, last = here - n.errors, here + n.errors
                if start <= 0:
                    out.add((i, 0))
                start = text.find(" ", max(start - 1, 0), max(last, 0)) + 1
                while start:
                    out.add((i, start))
                    start = text.find(" ", start, last) + 1
        return out

    def match(self, i: int, text: str, at: int) -> tuple[int, int, int] | None:
        """(errors, from, to) of the notice's best match from a word's start to a word's end."""
        n = self.notices[i]
        if not text.startswith(n.text[: n.head], at):
            return None
        m = self.patterns[i].match(text, at, min(len(text), at + len(n.text) + n.errors + 1))
        return (sum(m.fuzzy_counts), at, m.end()) if m and (m.end() == len(text) or text[m.end()] == " ") else None

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(notice, from, to, errors) in a text of words joined by single spaces, by notice and place."""
        found: dict[int, set[tuple[int, int, int]]] = {}
        for i, at in self.candidates(text):
            if m := self.match(i, text, at):
                found.setdefault(i, set()).add(m)
        out = []
        for i in sorted(found):
            taken: list[tuple[int, int]] = []
            for errors, a, b in sorted(found[i], key=lambda m: (m[0], m[1], m[2])):
                at = bisect_left(taken, (a, b))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
                    taken.insert(at, (a, b))
                    out.append((i, a, b, errors))
        return sorted(out)


@cache
def finder(notices: tuple[Notice, ...]) -> Finder:
    return Finder(notices)


def spans(text: bytes, notices: tuple[Notice, ...] = NOTICES) -> tuple[int, list[dict], float]:
    """The number of words, the spans in order, and the score of one text."""
    seen = text.translate(_SEEN)
    words = seen.split()
    plain = b" ".join(words).decode("utf-8", "replace")
    found = finder(notices).find(plain)
    if not found:
        return len(words), [], 0.0
    starts = np.cumsum([0, *(len(w.decode("utf-8", "replace")) + 1 for w in words)])  # of words in plain
    letters = np.frombuffer(seen, np.uint8) != SPACE
    edge = np.flatnonzero(np.diff(np.r_[False, letters, False].astype(np.int8)))  # first byte of a word, then the byte after it
    points = np.cumsum(np.r_[0, (np.frombuffer(text, np.uint8) & 0xC0) != 0x80])  # code points before a byte
    out = []
    for i, a, b, errors in found:
        first, last = int(np.searchsorted(starts, a)), int(np.searchsorted(starts, b + 1)) - 1
        n = notices[i]
        exact = errors == 0
        out.append({"label": n.label, "notice": n.text, "first_word": first, "last_word": last, "start": int(points[edge[2 * first]]), "end": int(points[edge[2 * last + 1]]), "errors": errors, "base": n.base and exact})
    return len(words), sorted(out, key=lambda s: (s["first_word"], s["label"], s["last_word"], s["notice"])), max(1 - s["errors"] / len(s["notice"]) for s in out)


_SPAN = pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("errors", pa.int32()), ("base", pa.bool_())])
_FIELDS = [("n_words", pa.int64(), "bigint"), ("notices", pa.list_(_SPAN), "array<struct<label:string,notice:string,first_word:bigint,last_word:bigint,start:bigint,end:bigint,errors:int,base:boolean>>"), ("score", pa.float64(), "double")]


def scan(docs: DataFrame, text_col: str = "text", notices: tuple[Notice, ...] = NOTICES, keep_text: bool = False) -> DataFrame:
    """docs with n_words, notices (the spans) and score; the text goes unless keep_text."""
    return map_texts(docs, text_col, _FIELDS, lambda texts: list(zip(*(spans(t, notices) for t in texts), strict=True)), drop=() if keep_text else (text_col,))
