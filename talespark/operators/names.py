"""Names in prose: which capitalised phrases are characters, and which catalog names a text has."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talespark.functions.text import normalize_name
from talespark.operators.lexicons import folded
from talespark.operators.speakers import VERB_FORMS, VERBS
from talespark.sources.shared import bound_batches

#: Words that are no names, words for relations, particles within names, words that begin sentences,
#: words that are often capitalised, and verbs that a person does.
STOPWORDS = frozenset(
    "the and but not just no every like one please say says said together control controlled controlling god mom mother "
    "father dad brother sister baby love dear she he they his her hers him their theirs we you your yours i it its a an "
    "this that those these chapter scene moment hours minutes after before once then now today tonight yesterday tomorrow "
    "monday tuesday wednesday thursday friday saturday sunday summer winter spring autumn fall morning evening noon "
    "midnight dawn dusk section prologue epilogue preface mama papa parents aunt uncle grandma grandpa child children yes "
    "my two three four five six seven eight nine ten first second third only always never maybe still again already "
    "suddenly slowly quickly instantly truly honestly finally really barely nearly almost power strength soft calm gentle "
    "angry furious dominant commanding submissive fragile cold warm dark light deep shallow long short wide narrow tired "
    "restless burning aching throbbing fading hungry thirsty".split()
)
RELATIONS = frozenset("mom mother dad father mama papa parents brother sister aunt uncle grandma grandpa child baby son daughter husband wife man woman boy girl".split())
PARTICLES = frozenset("de del della di la le van von da dos las los".split())
SENTENCE_STARTERS = frozenset(
    "after before once then so but and however meanwhile suddenly eventually later when while as for because if though yet "
    "now still in on at from toward towards with without around between inside outside".split()
)
OFTEN_CAPITALISED = frozenset(
    "After Before Once Then So But And However Meanwhile Suddenly Eventually Later When While As For Because If Though Yet "
    "Now Still In On At From Toward Towards With Without Around Between Inside Outside Chapter Section Prologue Epilogue "
    "Preface Morning Evening Night Midnight Noon".split()
)
ACTIONS = (
    "reached|walked|ran|strode|smiled|grinned|laughed|stared|gazed|looked|leaned|touched|grabbed|kissed|held|took|pressed|"
    "wrapped|cupped|slid|moved|bent|whispered|murmured|moaned|sighed|shivered|gasped|nodded|shrugged|rose|sat|stood|approached"
)
MOST = 12

_PHRASE = re.compile(r"\b[A-Z][A-Za-z'\-]+(?:\s+[A-Z][A-Za-z'\-]+){0,2}\b")
#: A run of letters, digits and underscores.
RUN = r"(?U)(\w+)"
_TOKEN = r"[A-Za-z][A-Za-z'\-]*"


def looks_like_name(name: Column) -> Column:
    """One to four words, none of them a stop word or a relation, each capitalised or a particle."""
    tokens = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(f"({_TOKEN})"), F.lit(1))
    low = lambda t: F.lower(t)
    good = lambda t: ~low(t).isin(*sorted(STOPWORDS | RELATIONS)) & (t.rlike("^[A-Z]") | low(t).isin(*sorted(PARTICLES)))
    return F.size(tokens).between(1, 4) & F.forall(tokens, good)


def _is_name(name: str) -> bool:
    tokens = re.findall(_TOKEN, name)
    low = [t.lower() for t in tokens]
    return 0 < len(tokens) <= 4 and not any(t in STOPWORDS or t in RELATIONS for t in low) and all(t[0].isupper() or t.lower() in PARTICLES for t in tokens)


_AFTER = re.compile(rf"'s\b|,\s+{VERBS}\b|\b\s+(?:{VERBS}|{ACTIONS})\b", re.I)
_BEFORE = re.compile(rf"{VERBS}\Z", re.I)


def in_context(name: str, text: str, low: str | None = None) -> bool:
    """Whether a name stands beside a speech verb, before an action, or in the possessive. low: the folded text, if it is known.

    Only what lies next to the name is matched, so a text is searched for the name alone, without a pattern for each.
    """
    low, own, at = folded(text) if low is None else low, folded(name), 0
    while (start := low.find(own, at)) >= 0:
        if start and (text[start - 1].isalnum() or text[start - 1] == "_"):  # names begin with a letter
            at = start + 1
            continue
        at = start + len(own)
        if _AFTER.match(text, at):
            return True
        k = start
        while k and text[k - 1].isspace():
            k -= 1
        if k < start and low[max(0, k - 16) : k].endswith(VERB_FORMS) and not text[at : at + 1].isalnum() and text[at : at + 1] != "_":
            return True
    return False


def is_no_name(token: str, text: str, at: int) -> bool:
    """Whether a capitalised phrase found at ``at`` is a common word, or begins a sentence with a word that often does."""
    low = token.replace("’", "'").strip().lower()
    # All trailing apostrophes and s go, not one ending: this is the rule that results must match.
    if token in OFTEN_CAPITALISED or low in STOPWORDS or low.rstrip("'s") in STOPWORDS:
        return True
    before = text[:at].rstrip() if low in SENTENCE_STARTERS else "x"
    return not before or before[-1] in ".!?\"'\n\r;:()[]"


def phrases_of(text: str, most: int = 2 * MOST) -> list[tuple[str, int, bool]]:
    """(phrase, uses, kept) of the ``most`` most used capitalised phrases that may be names; of equal ones the first in the text.

    kept: used twice, or in the context of speech or action.
    """
    uses = Counter(m[0].strip() for m in _PHRASE.finditer(text) if _is_name(m[0].strip()) and not is_no_name(m[0].strip(), text, m.start()))
    low = folded(text) if uses else ""
    return [(name, n, n > 1 or in_context(name, text, low)) for name, n in uses.most_common(most)]


def catalog_hits(stories: DataFrame, catalog: DataFrame, text_col: str = "text") -> DataFrame:
    """(story_id, display, ord, uses, inside) of catalog entries (display, ord) whose words a text has.

    uses counts the lower-cased name between word borders; inside says whether the normalised name stands in the
    normalised text as whole words. Entries are posted under their first word, in either reading; a text looks up its distinct words, and what it
    meets comes back to it as one array, so texts are not copied for each entry. A text that meets nothing gives no row.
    """
    norm = normalize_name(F.col("display"))
    entries = catalog.select("display", "ord", norm.alias("norm"), F.lower("display").alias("low")).filter("norm <> ''")
    first = F.array_distinct(F.array(F.substring_index("norm", " ", 1), F.regexp_extract("low", RUN, 1)))
    posted = entries.select("display", "ord", "norm", "low", F.explode(first).alias("word")).filter("word <> ''")
    own = F.array_distinct(F.concat(F.split(normalize_name(F.col(text_col)), " "), F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(RUN), F.lit(1))))
    words = stories.select("story_id", F.explode(own).alias("word"))
    met = words.join(posted, "word").groupBy("story_id").agg(F.collect_set(F.struct("display", "ord", "norm", "low")).alias("met"))
    padded = F.concat(F.lit(" "), normalize_name(F.col("__text")), F.lit(" "))
    rows = stories.select("story_id", F.col(text_col).alias("__text")).join(met, "story_id").select("story_id", F.lower("__text").alias("low_text"), padded.alias("padded"), F.explode("met").alias("e"))
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.col("e.low"), F.lit(r"\E\b"))
    found = rows.select("story_id", "e.display", "e.ord", F.regexp_count("low_text", quoted).alias("uses"), F.contains("padded", F.concat(F.lit(" "), F.col("e.norm"), F.lit(" "))).alias("inside"))
    return found.filter("uses > 0 or inside")


def first_names(stories: DataFrame, catalog: DataFrame, text_col: str = "text") -> DataFrame:
    """``stories`` with ``name``: the first catalog entry (display, ord) in the catalog's order that a text has, or null."""
    first = catalog_hits(stories, catalog, text_col).filter("inside").groupBy("story_id").agg(F.min(F.struct("ord", "display"))["display"].alias("name"))
    return stories.join(first, "story_id", "left")


def name_candidates(stories: DataFrame, catalog: DataFrame, most: int = MOST, text_col: str = "text") -> DataFrame:
    """(story_id, place, name, uses): up to ``most`` likely characters of each text.

    Catalog names that the text has come first, by uses, then name; then its capitalised phrases by uses, then place in the
    text, if used twice, in the context of speech or action, or known to the catalog. Names that are one after everything
    but letters is dropped count once. Null and blank texts have none.
    """

    bound_batches(stories.sparkSession)

    @F.pandas_udf("array<struct<name: string, uses: int, kept: boolean>>")
    def phrases(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"name": n, "uses": u, "kept": c} for n, u, c in phrases_of(t or "")], na_action=None)

    hits = catalog_hits(stories, catalog.filter(looks_like_name(F.col("display"))), text_col).filter("uses > 0")
    hits = hits.select("story_id", F.lit(0).alias("kind"), (-F.col("uses")).alias("a"), F.col("display").alias("name"), "uses", F.lit(0).alias("at"))
    known = catalog.select(F.lower("display").alias("low")).distinct().withColumn("known", F.lit(True))
    told = stories.select("story_id", F.posexplode(phrases(F.col(text_col))).alias("at", "p")).select("story_id", "at", "p.*").withColumn("low", F.lower("name")).join(known, "low", "left")
    told = told.filter("kept or known").select("story_id", F.lit(1).alias("kind"), F.col("at").alias("a"), "name", "uses", "at")
    key = F.trim(F.regexp_replace(F.lower("name"), "[^a-z]+", " "))
    every = hits.unionByName(told).withColumn("key", key).filter("key <> ''")
    once = every.groupBy("story_id", "key").agg(F.min(F.struct("kind", "a", "name", "uses")).alias("c")).select("story_id", "c.*")
    place = F.row_number().over(W.partitionBy("story_id").orderBy("kind", "a", "name"))
    return once.withColumn("place", place).filter(F.col("place") <= most).select("story_id", "place", "name", "uses")


def model_names(cast: DataFrame, most: int = MOST) -> DataFrame:
    """Rows of a model's cast (story_id, ord, name, ...) that look like names, once by their letters, the first ``most`` of a story."""
    key = F.trim(F.regexp_replace(F.lower("name"), "[^a-z]+", " "))
    rows = cast.filter(looks_like_name(F.col("name"))).withColumn("__key", key).filter("__key <> ''")
    first = W.partitionBy("story_id", "__key").orderBy("ord")
    once = rows.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "__key")
    return once.withColumn("__n", F.row_number().over(W.partitionBy("story_id").orderBy("ord"))).filter(F.col("__n") <= most).drop("__n")
