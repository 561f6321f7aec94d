"""Who speaks each line: an ordered fold over each story, fed with evidence that does not depend on order (speaker_blocks runs it over blocks).

A story's state is small: the last speaker, the subject that narration last named, and how many more speeches a woman
outside the cast may still be speaking. Everything else is a property of a line and its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talespark.functions.text import bind, normalize_name

#: Stems of speech verbs with their forms, pronouns and cues.
VERB_FORMS = (
    "say", "says", "said", "ask", "asks", "asked", "reply", "replies", "replied", "whisper", "whispers", "whispered",
    "shout", "shouts", "shouted", "yell", "yells", "yelled", "mutter", "mutters", "muttered", "sigh", "sighs", "sighed",
    "cry", "cries", "cried", "exclaim", "exclaims", "exclaimed", "whimper", "whimpers", "whimpered", "murmur", "murmurs",
    "murmured", "growl", "growls", "growled", "laugh", "laughs", "laughed", "sob", "sobs", "sobbed", "note", "notes",
    "noted", "add", "adds", "added", "remark", "remarks", "remarked", "curse", "curses", "cursed", "command", "commands",
    "commanded", "insist", "insists", "insisted", "warn", "warns", "warned", "tease", "teases", "teased", "coo", "coos",
    "cooed", "breathe", "breathes", "breathed", "hiss", "hisses", "hissed", "snap", "snaps", "snapped", "state",
    "states", "stated", "respond", "responds", "responded", "answer", "answers", "answered", "call", "calls", "called",
    "promise", "promises", "promised", "plead", "pleads", "pleaded", "beg", "begs", "begged",
)
VERBS = f"(?:{'|'.join(VERB_FORMS)})"
FEMALE_WORDS = ("she", "her", "hers", "herself", "girl", "woman", "wife")
FEMALE_NOUNS = ("kitten", "princess", "queen", "mistress", "lover", "pet", "baby girl", "little one", "brat")
OPENERS = "said|asked|whispered|replied|murmured|sighed|laughed|sobbed|shouted|cried|whined|breathed|cursed"
INLINE = "said|asked|whispered|replied|murmured|sighed|laughed|sobbed"
#: A woman outside the cast, as the subject; speeches that stay open after her.
OUTSIDER, OPEN_SPEECHES = "\0outsider", 3

_OPENING = rf"^\s*(?:\w+[, ]+)?(?:{OPENERS})\b|\b's (?:voice|whisper)\b"
_OPENS = re.compile(_OPENING, re.I)
_ATTRIBUTIVE = re.compile(rf"{_OPENING}|{VERBS}", re.I)
#: Verb forms without those that hold a shorter one.
_STEMS = tuple(v for v in VERB_FORMS if not any(w in v for w in VERB_FORMS if w != v))
_QUOTED = re.compile(r"""["'“”‘’].*?["'“”‘’]""")
_INLINE = (re.compile(rf"\b[A-Z][\w'-]{{1,40}}\s+(?:{INLINE})\b"), re.compile(rf"\b(?:{INLINE})\s+[A-Z][\w'-]{{1,40}}\b"))
_VERB = re.compile(VERBS, re.I)
_NAMED = (
    re.compile(rf"\b{VERBS}\s+([A-Z][\w\-']{{1,40}})\b", re.I),
    re.compile(rf"\b([A-Z][\w\-']{{1,40}})\s+{VERBS}\b", re.I),
    re.compile(rf"\b([A-Z][\w\-'.]{{1,40}}),\s*{VERBS}"),
)
_I, _HE, _SHE = re.compile(r"\bI\b"), ("he", "him", "his"), ("she", "her", "hers")
_WORD, _MARKS, _INNER, _NOT_INNER = re.compile(r"\w+"), re.compile(r"[()\[\].,'\"!?-]+"), re.compile(r"[^\w\-'\s]"), re.compile(r"[^\w\-']")
_FIRST = re.compile(r"\b(I|I'm|I’m|me|my|mine)\b", re.I)


def normal(name: str | None) -> str:
    return " ".join(_MARKS.sub(" ", (name or "").lower()).split())


def words_of(low: str) -> set[str]:
    """The words of a lower-cased text, for what can only stand between word borders."""
    return set(_WORD.findall(low))


def shown(name: str) -> str:
    return re.sub(r"(\A|[\s-])(\S)", lambda m: m[1] + m[2].upper(), name)


def attributive(text: str) -> bool:
    """Whether a text tells who speaks: a speech verb anywhere, or an opening. Plain texts are looked through for the verbs' stems first."""
    if not text or not text.isascii():
        return bool(text and _ATTRIBUTIVE.search(text))
    low = text.lower()
    return any(v in low for v in _STEMS) or bool(_OPENS.search(text))


def _word_in(word: str, low: str) -> bool:
    """Whether ``word`` stands in the lower-cased text between word borders."""
    return word in low and bool(re.search(rf"\b{re.escape(word)}\b", low))


@dataclass
class Cast:
    """Names in order with genders M, F or U; state holds their normalised forms."""

    members: list[tuple[str, str]]
    catalog: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self):
        self.gender: dict[str, str] = {}
        self.display: dict[str, str] = {}
        for name, gender in [*self.catalog, *self.members]:
            if key := normal(name):
                self.display.setdefault(key, shown(name))
                if gender in ("M", "F") or key not in self.gender:
                    self.gender[key] = gender if gender in ("M", "F") else "U"
        self.known = list(self.gender)
        self.padded = [(n, f" {n} ") for n in self.known]
        self.single = [n for n in self.known if " " not in n]
        self.whole = set(self.single)
        self.heads = {m[0] for n in self.single if (m := _WORD.match(n))}
        self.users = list(dict.fromkeys(k for n, _ in self.members if (k := normal(n))))
        self.originals = {normal(n): n for n, _ in self.members}
        self.owned = [(n, [t + end for t in n.split() for end in ("'s", "’s", "s")]) for n in self.users]
        self.firsts = [(n, n.split()[0]) for n in self.users]
        self.member_keys = set(self.users)
        self.forms: dict[bool | None, list[tuple[str, str, re.Pattern]]] = {}

    def is_user(self, name: str) -> bool:
        return name in self.member_keys

    def of(self, gender: str, among: list[str] | None = None) -> list[str]:
        return [n for n in (self.users if among is None else among) if self.gender.get(n) == gender]

    def named(self, text: str) -> str | None:
        """The first known name that stands in the text as whole words."""
        return self.named_in(normal(text))

    def named_in(self, whole: str) -> str | None:
        """named() of a text in its normal form."""
        padded = f" {whole} "
        return next((n for n, p in self.padded if p in padded), None)

    def by_verb(self, text: str, low: str, words: set[str]) -> str | None:
        """A known one-word name beside a speech verb, or within three tokens of one. low, words: the text lower-cased, and its words.

        A name beside a verb begins with a word of the text, so most texts need no pattern. Letters whose lower case is longer
        or depends on their neighbours are not told by words.
        """
        if not any(n in low for n in self.single):
            return None
        odd = "Σ" in text or "İ" in text
        if odd or not self.heads.isdisjoint(words):
            for pattern in _NAMED:
                if (m := pattern.search(text)) and m[1].lower() in self.gender:
                    return m[1].lower()
        if not odd and self.whole.isdisjoint(_INNER.sub("", low).split()):
            return None
        tokens = text.split()
        for i, token in enumerate(tokens):
            bare = _NOT_INNER.sub("", token).lower()
            if bare in self.gender and _VERB.search(" ".join(tokens[max(0, i - 3) : i + 4])):
                return bare
        return None

    def subject(self, low: str, words: set[str]) -> str | None:
        """Whom a narration sentence, lower-cased and stripped, is about: a name at its start, a possessive, the one member a pronoun can mean."""
        if not self.users or not low:
            return None
        for name, first in self.firsts:
            if low.startswith(first) and not low[len(first) : len(first) + 1].isalpha():
                return name
        for name, owned in self.owned:
            if any(o in low for o in owned):
                return name
        if words.isdisjoint((*_HE, *_SHE)):
            return None
        padded = f" {low} "
        if not any(f" {w} " in padded for w in (*_HE, *_SHE)):
            return None
        free = [n for n in self.users if not any(_word_in(t, low) for t in n.split())]
        for gender, words in (("M", _HE), ("F", _SHE)):
            if any(f" {w} " in padded for w in words) and len(one := self.of(gender, free)) == 1:
                return one[0]
        if any(f" {w} " in padded for w in _SHE) and not self.of("F", free):
            return OUTSIDER
        return None

    def variants(self, initials: bool) -> list[tuple[str, str, re.Pattern]]:
        """Each member's forms of the name, lower-cased and as patterns."""
        if initials not in self.forms:
            self.forms[initials] = self._variants(initials)
        return self.forms[initials]

    def full_names(self) -> list[tuple[str, str, re.Pattern]]:
        """Each member's name as it was given, lower-cased and as a pattern."""
        if None not in self.forms:
            self.forms[None] = [(n, self.originals.get(n, n).lower(), re.compile(rf"\b{re.escape(self.originals.get(n, n))}\b", re.I)) for n in self.users]
        return self.forms[None]

    def _variants(self, initials: bool) -> list[tuple[str, str, re.Pattern]]:
        out = []
        for name in self.users:
            tokens = name.split()
            letters = "".join(t[0] for t in tokens)
            forms = [self.originals.get(name, name), name, tokens[0], tokens[-1], *([letters, ".".join(letters) + "."] if initials else [])]
            out += [(name, f, re.compile(rf"\b{re.escape(f)}\b", re.I)) for f in dict.fromkeys(f.strip().lower() for f in forms) if f]
        return out


class Signs(NamedTuple):
    """What a text says of names and persons: a known name in it, a member's name within its words, a name by a verb, pronouns.

    What is weaker than the first that is there counts for nothing and is left out, so like texts have equal signs.
    """

    named: str | None
    inside: str | None = None
    verb: str | None = None
    i: bool = False
    he: bool = False
    she: bool = False


class Evidence(NamedTuple):
    """All that a line and its neighbours say, whatever the state: own text, attribution, whom narration is about, members met, feminine cues."""

    kind: str
    spoken: bool
    own: Signs
    said: Signs | None = None
    about: str | None = None
    met: tuple[str, ...] = ()
    first: bool = False
    woman: str | None = None
    cue: bool = False


@dataclass
class Fold:
    """The state of one story and its rules. mode: generic, strict or aggressive (see detect_speakers)."""

    cast: Cast
    mode: str = "generic"
    auto_assign: bool = True
    initials: bool = True
    mentions: list[str] = field(default_factory=list)
    speaker: str | None = None
    subject: str | None = None
    open: int = 0
    before: str = ""

    # What lines say ---------------------------------------------------------------------------------------------------

    def _signs(self, text: str, low: str, words: set[str]) -> Signs:
        whole = normal(low)
        if named := self.cast.named_in(whole):
            return Signs(named)
        inside, verb = next((n for n in self.cast.users if n in whole), None), self.cast.by_verb(text, low, words)
        if verb:
            return Signs(None, inside, verb)
        return Signs(None, inside, None, "I" in text and bool(_I.search(text)), not words.isdisjoint(_HE), not words.isdisjoint(_SHE))

    def _attribution(self, row: dict, after: dict | None) -> str | None:
        said = (row.get("attribution") or "").strip()
        found = said
        if not found and (raw := (row.get("raw") or "").strip()):
            told = _QUOTED.sub(" ", raw)
            found = next((m[0] for p in _INLINE if (m := p.search(told))), None) if any(v in told for v in INLINE.split("|")) else None
            found = found or (told.strip() if attributive(told) else "")
        if not found and after and after["type"] in ("narration", "attribution"):
            text = (after["text"] or "").strip()
            found = text if text and len(text.split()) <= 12 and attributive(text) else ""
        if not found or not after:
            return found or None
        text = (after["text"] or "").strip()
        if text and found.strip().lower() == text.lower() and not attributive(found):
            return None
        # An attribution found in the paragraph may be that of the next speech, which names the same person itself.
        if not said and (ahead := (after.get("attribution") or "").strip()) and (name := self.cast.named(found)) and name in normal(f"{ahead} {after['text']}"):
            return None
        return found

    def _feminine(self, row: dict, after: dict | None) -> tuple[str | None, bool]:
        """(a woman of the cast whom the neighbourhood points to, whether it points to any woman)."""
        women, cue = self.cast.of("F"), False
        for text in (self.before, row.get("attribution") or "", (after or {}).get("text") or ""):
            low = text.lower()
            found = next((n for n in women if any(_word_in(t, low) for t in n.split())), None)
            here = any(f" {w} " in f" {low} " for w in FEMALE_WORDS) or any(w in low for w in FEMALE_NOUNS)
            cue = cue or here
            if found or (here and len(women) == 1):
                return found or women[0], True
        return None, cue

    def look(self, row: dict, after: dict | None) -> Evidence:
        """What the line says; ``before`` is the text of the line before it."""
        text, kind, spoken = (row["text"] or "").strip(), row["type"] or "dialogue", row["type"] == "dialogue"
        low = text.lower()
        words = words_of(low)
        own = self._signs(text, low, words)
        if kind == "narration":
            return Evidence(kind, spoken, own, about=self.cast.subject(low, words) if self.cast.users else None)
        said = self._attribution(row, after) if kind == "dialogue" else None
        signs = self._signs(said, said.lower(), words_of(said.lower())) if said else None
        if self.mode == "generic" or not self.cast.users:
            return Evidence(kind, spoken, own, signs)
        forms = self.cast.variants(self.initials) if self.mode == "aggressive" else self.cast.full_names()
        met = tuple(dict.fromkeys(n for n, form, p in forms if (form in low or not text.isascii()) and p.search(text)))
        first = not met and bool(_FIRST.search(text))
        woman, cue = self._feminine(row, after) if not met and (first or spoken) else (None, False)
        return Evidence(kind, spoken, own, signs, None, met, first, woman, cue)

    # What the state makes of it ---------------------------------------------------------------------------------------

    def _recent(self, gender: str | None = None) -> Iterator[str]:
        return (n for n in reversed(self.mentions) if gender is None or self.cast.gender.get(normal(n)) == gender)

    def _take(self, name: str) -> str:
        self.speaker = self.subject = name
        self.open = 0
        if self.mentions:  # a history is kept only where one was given
            self.mentions.append(name)
        return name

    def _pronoun(self, signs: Signs) -> str | None:
        if signs.i:
            return self.speaker or next(self._recent(), None)
        for gender, here in (("M", signs.he), ("F", signs.she)):
            if not here:
                continue
            if found := next(self._recent(gender), None):
                return normal(found)
            if len(own := self.cast.of(gender)) == 1:
                return own[0]
            every = self.cast.of(gender, self.cast.known)
            if len(every) == 1:
                if gender == "F" and self.speaker and self.cast.gender.get(normal(self.speaker)) == "M":
                    return None
                return every[0]
            return every[0] if 1 < len(every) <= 3 and not self.mentions else None
        return None

    def _other(self) -> str | None:
        found = next(self._recent(), None)
        return found or (next((n for n in self._recent() if n != self.speaker), None) if self.speaker else None)

    def _named_or_meant(self, signs: Signs) -> str | None:
        return signs.named or signs.verb or self._pronoun(signs)

    def _from_attribution(self, signs: Signs) -> str | None:
        if found := signs.named or signs.inside or signs.verb or self._pronoun(signs):
            return found
        if self.subject and self.subject != OUTSIDER:
            gender = self.cast.gender.get(self.subject)
            if signs.she != signs.he:
                return self.subject if (gender == "F" if signs.she else gender != "F") else None
            return None if signs.she else self.subject
        return None

    def _narration(self, seen: Evidence) -> str:
        earlier = self.subject
        if seen.about:
            self.subject = seen.about
            if seen.about == OUTSIDER:
                self.open = OPEN_SPEECHES
        known = (n for n in (seen.about, earlier, self.speaker) if n and n not in (OUTSIDER, "Ambiguous", "Narrator"))
        found = self._named_or_meant(seen.own) or next(known, None) or self._other()
        return self._take(found) if found else "Narrator"

    def _of_cast(self, seen: Evidence) -> str:
        """Strict and aggressive modes: only members of the cast can speak."""
        if seen.spoken:
            if self.subject == OUTSIDER:
                self.open = self.open - 1 if self.open > 0 else OPEN_SPEECHES - 1
                return "Ambiguous"
            if self.open > 0:
                self.open -= 1
                return "Ambiguous"
        if len(seen.met) > 1:
            found = next((n for r in self._recent() for n in seen.met if n == normal(r)), seen.met[0])
            self._take(found)
            return found if self.mode == "aggressive" else "Narrator"  # the strict mode counts the speaker but names none
        if seen.met:
            return self._take(seen.met[0])
        if seen.spoken and not seen.first and not self.auto_assign:
            return "Ambiguous"
        if seen.first or seen.spoken:
            if self.subject and self.cast.is_user(self.subject) and self.cast.gender.get(self.subject) == "F":
                return self._take(self.subject)
            if seen.woman:
                return self._take(seen.woman)
            if seen.cue and not self.cast.of("F"):
                self.open = OPEN_SPEECHES - 1
                return "Ambiguous"
        if self.speaker and self.cast.is_user(normal(self.speaker)):
            return self._take(self.speaker)
        return "Ambiguous"

    def tell(self, seen: Evidence) -> tuple[str, list[str]]:
        """(speaker, candidates) of a line of which all this has been seen."""
        candidates: list[str] = []
        if seen.kind == "narration":
            found = self._narration(seen)
        else:
            found = None
            if seen.kind == "dialogue":
                found = self._from_attribution(seen.said) if seen.said else None
                if found and self.cast.users and not self.cast.is_user(normal(found)):
                    found = None
                if found:
                    self._take(found)
                elif self.subject == OUTSIDER:
                    self.open, found = OPEN_SPEECHES - 1, "Ambiguous"
                elif self.subject and (self.mode == "generic" or self.cast.is_user(self.subject)):
                    found = self._take(self.subject)
            if not found and self.mode != "generic" and self.cast.users:
                found = self._of_cast(seen)
            if not found:
                found = self._named_or_meant(seen.own) or self._other()
                if found:
                    self._take(found)
                else:
                    found = "Ambiguous"
                    candidates = list(dict.fromkeys(self._recent()))[:3] or sorted(self.cast.known)[:5]
        if found == "Narrator":
            self.speaker = found
        return (found if found in ("Ambiguous", "Narrator") else self.cast.display.get(normal(found), shown(found))), candidates

    def step(self, row: dict, after: dict | None) -> tuple[str, list[str]]:
        """(speaker, candidates) of the next line."""
        out = self.tell(self.look(row, after))
        self.before = (row["text"] or "").strip()
        return out


def carry_subject(lines: DataFrame, evidence: str) -> DataFrame:
    """``lines`` with ``carried``: the line's own evidence, else the story's last one before it. A window, for evidence known beforehand."""
    back = F.last(evidence, ignorenulls=True).over(W.partitionBy("story_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    return lines.withColumn("carried", F.coalesce(F.col(evidence), back))


def has_feminine_cue(text: Column) -> Column:
    """Whether a text has a feminine word between blanks, or a feminine noun anywhere."""
    low = F.lower(F.coalesce(text, F.lit("")))
    padded = F.concat(F.lit(" "), low, F.lit(" "))
    return padded.rlike(f" (?:{'|'.join(FEMALE_WORDS)}) ") | low.rlike("|".join(FEMALE_NOUNS))


def looks_like_attribution_text(text: Column) -> Column:
    """Whether a text tells who speaks: see attributive(). A speech verb counts anywhere, so it is looked for as it is."""
    told = F.coalesce(text, F.lit(""))
    return bind(F.lower(told), lambda low: reduce(or_, (F.contains(low, F.lit(v)) for v in _STEMS))) | told.rlike(f"(?iU){_OPENING}")


def preferred(candidates: Column, names: list[str]) -> Column:
    """The first of ``candidates`` that is one of the preferred ``names``, both normalised; null for none."""
    wanted = sorted({n for n in map(normal, names) if n})
    return F.get(F.filter(candidates, lambda c: normalize_name(c).isin(wanted)), F.lit(0)) if wanted else F.lit(None).cast("string")


def recent_speakers(lines: DataFrame, size: int = 50) -> DataFrame:
    """``lines`` with last_speaker before each line and the known speakers of the last ``size`` lines, the line's own included."""
    order = W.partitionBy("story_id").orderBy("line_no")
    known = F.when(F.col("character") != "Ambiguous", F.col("character"))
    return lines.withColumns({"last_speaker": F.last(known, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), "recent": F.collect_list(known).over(order.rowsBetween(1 - size, 0))})
