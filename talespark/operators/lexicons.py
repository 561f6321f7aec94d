"""All keywords of a lexicon found in one pass: an Aho-Corasick automaton with word borders, phrases and a negation window."""

from __future__ import annotations

import re
from bisect import bisect, bisect_right
from collections.abc import Iterable
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from talespark.sources.shared import bound_batches

EDGES = r""".,!?;:"'()[]{}"""
#: Letters that count as others when case is ignored, as the patterns of Python have it (fixed values).
ALIKE = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "ς": "σ", "µ": "μ", "K": "k", "Å": "å"})
#: Tokens before a keyword's own in which a negation denies it.
DENYING = 3
MATCH = "struct<label: string, keyword: string, start: int, end: int, negated: boolean>"


class Match(NamedTuple):
    label: str
    keyword: str
    start: int
    end: int
    negated: bool


def folded(text: str) -> str:
    """The text in lower case, as long as it was."""
    return text.lower() if text.isascii() else text.translate(ALIKE).lower()


def _flat(text: str) -> tuple[str, list[int], list[int]]:
    """The text with one blank for each run of white space; from places[k] on, what was cut before is shifts[k] long."""
    if not re.search(r"\s\s|[^\S ]", text):
        return text, [0], [0]
    parts, places, shifts, size, at = [], [0], [0], 0, 0
    for m in re.finditer(r"\s+", text):
        parts += [text[at : m.start()], " "]
        size += m.start() - at + 1
        at = m.end()
        places.append(size)
        shifts.append(at - size)
    return "".join([*parts, text[at:]]), places, shifts


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


class Lexicon:
    """Labels with their keywords, in order; negations are tokens that deny what follows.

    A keyword is found in any case, with any white space between its words, and beside no letter, digit or underscore
    where it begins or ends with a letter or digit. Of one keyword's overlapping places the first counts.
    """

    def __init__(self, labels: Iterable[tuple[str, tuple[str, ...]]], negations: Iterable[str]):
        self.labels, self.denied, self.entries, words = [], frozenset(negations), [], {}
        for k, (label, keywords) in enumerate(labels):
            self.labels.append(label)
            for keyword in sorted(dict.fromkeys(keywords), key=lambda w: (-len(w.split()), -len(w))):
                if parts := keyword.split():
                    words.setdefault(folded(" ".join(parts)), []).append(len(self.entries))
                    self.entries.append((k, keyword, 2 if len(parts) > 1 else 1, keyword[:1].isalnum(), keyword[-1:].isalnum()))
        self.phrases = any(" " in w for w in words)
        self.automaton = ahocorasick.Automaton()
        for word, of in words.items():
            self.automaton.add_word(word, (len(word), of))
        if words:
            self.automaton.make_automaton()

    def _found(self, text: str) -> list[tuple[int, int, int]]:
        """(entry, start, end) of each place, in the order of entries, then of places."""
        if not self.entries or not text:
            return []
        flat, places, shifts = _flat(text) if self.phrases else (text, [0], [0])
        hits = []
        for last, (size, of) in self.automaton.iter(folded(flat)):
            start = last - size + 1
            inside = _in_word(flat, start - 1), _in_word(flat, last + 1)
            hits += [(e, start, last) for e in of if not (inside[0] and self.entries[e][3]) and not (inside[1] and self.entries[e][4])]
        hits.sort()
        out, before = [], (-1, -1)
        for e, start, last in hits:
            if e != before[0] or start > before[1]:
                before = e, last
                out.append((e, start + shifts[bisect_right(places, start) - 1], last + shifts[bisect_right(places, last) - 1] + 1))
        return out

    def _denials(self, text: str, starts: list[int]) -> list[bool]:
        """Whether a negation is among the tokens before the one that each place begins in."""
        heads, deny = [], []
        for t in re.finditer(r"\S+", text):  # one at a time: a text has far more tokens than keywords
            heads.append(t.start())
            deny.append(t[0].lower().strip(EDGES) in self.denied)
        return [any(deny[max(0, at - DENYING) : at]) for at in (bisect(heads, s) - 1 for s in starts)]

    def matches(self, text: str | None) -> list[Match]:
        found = self._found(text or "")
        denied = self._denials(text, [s for _, s, _ in found]) if found else []
        return [Match(self.labels[self.entries[e][0]], self.entries[e][1], s, t, no) for (e, s, t), no in zip(found, denied)]

    def scores(self, text: str | None) -> list[int]:
        """For each label, 1 for each word and 2 for each phrase that nothing denies."""
        out = [0] * len(self.labels)
        found = self._found(text or "")
        for (e, _, _), no in zip(found, self._denials(text, [s for _, s, _ in found]) if found else ()):
            if not no:
                out[self.entries[e][0]] += self.entries[e][2]
        return out


@lru_cache(4)
def _lexicon(labels: tuple[tuple[str, tuple[str, ...]], ...], negations: tuple[str, ...]) -> Lexicon:
    return Lexicon(labels, negations)


def _key(lexicon: dict[str, list[str]], negations: Iterable[str]) -> tuple:
    return tuple((label, tuple(words)) for label, words in lexicon.items()), tuple(sorted(negations))


def lexicon_matches(text: Column, lexicon: dict[str, list[str]], negations: Iterable[str]) -> Column:
    """Every place of every keyword in ``text``: (label, keyword, start, end, negated), in the lexicon's order.

    Arrow-batched, a few MB at a time, so that a worker's memory follows neither rows nor table; it builds the automaton
    once. Spark broadcasts a large lexicon with the function. A null or empty text has no matches.
    """
    key = _key(lexicon, negations)
    bound_batches(SparkSession.active())

    @F.arrow_udf(f"array<{MATCH}>")
    def found(texts: pa.Array) -> pa.Array:
        known, ends, fields = _lexicon(*key), [0], tuple([] for _ in Match._fields)
        for text in texts.to_pylist():
            for match in known.matches(text):
                for field, value in zip(fields, match):
                    field.append(value)
            ends.append(len(fields[0]))
        columns = [pa.array(v, t) for v, t in zip(fields, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_()))]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, list(Match._fields)))

    return found(text)


def lexicon_scores(text: Column, lexicon: dict[str, list[str]], negations: Iterable[str]) -> Column:
    """The score of each label, in the lexicon's order, by the same pass as lexicon_matches()."""
    key = _key(lexicon, negations)
    bound_batches(SparkSession.active())

    @F.arrow_udf("array<int>")
    def scored(texts: pa.Array) -> pa.Array:
        known = _lexicon(*key)
        return pa.array([known.scores(text) for text in texts.to_pylist()], pa.list_(pa.int32()))

    return scored(text)
