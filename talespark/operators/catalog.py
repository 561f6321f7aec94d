"""Character and emotion catalogs: flattening, gender, name mapping, contains joins, candidate phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talespark.functions.text import candidate_key, display_name, normalize_name, strip
from talespark.sources.shared import cut


def flatten_catalog(groups: DataFrame, column: str = "groups", by: tuple[str, ...] = ()) -> DataFrame:
    """(``by``, name_norm, display, voice_id, gender, ord) of a map group -> name -> (voice_id, gender); ``by``: what tells the catalogs apart, if there are many.

    Of names that are one after normalisation the first is kept; what it lacks is taken from later ones.
    """
    entries = groups.select(*by, F.posexplode(F.map_entries(column)).alias("g", "group")).select(*by, "g", F.posexplode(F.map_entries("group.value")).alias("k", "entry"))
    rows = entries.select(*by, normalize_name(F.col("entry.key")).alias("name_norm"), F.col("entry.key").alias("display"), F.col("entry.value.voice_id").alias("voice_id"), F.col("entry.value.gender").alias("gender"), F.struct("g", "k").alias("ord"))
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("ord", c)))[c].alias(c)
    return rows.filter("name_norm <> ''").groupBy(*by, "name_norm").agg(F.min(F.struct("ord", "display"))["display"].alias("display"), first("voice_id"), first("gender"), F.min("ord").alias("ord"))


def flatten_tags(tags: DataFrame, column: str = "tags") -> DataFrame:
    """(category, emotion, tag) of a map category -> name -> tag."""
    return tags.select(F.explode(column).alias("category", "names")).select("category", F.explode("names").alias("emotion", "tag"))


def genders(names: DataFrame, catalog: DataFrame, name_col: str = "name") -> DataFrame:
    """``names`` with the gender of the catalog entry of the same normalised name, M or F, else null."""
    known = catalog.filter(F.col("gender").isin("M", "F")).select(F.col("name_norm").alias("__norm"), F.col("gender").alias("catalog_gender"))
    return names.withColumn("__norm", normalize_name(F.col(name_col))).join(known, "__norm", "left").drop("__norm")


def display_names(rows: DataFrame, catalog: DataFrame, name_col: str = "character") -> DataFrame:
    """``rows`` with ``display``: the catalog's spelling of the name, else its parts capitalised."""
    known = catalog.select(F.col("name_norm").alias("__norm"), F.col("display").alias("__display"))
    return rows.withColumn("__norm", normalize_name(F.col(name_col))).join(known, "__norm", "left").withColumn("display", F.coalesce("__display", display_name(F.col(name_col)))).drop("__norm", "__display")


def map_names(users: DataFrame, catalog: DataFrame, user_col: str = "name") -> DataFrame:
    """(name, canonical): the catalog entry that each user name means best.

    The whole name goes before its tokens; equal before a token's equality, a token's beginning, containment; then the
    longer entry, then the alphabet. Equalities and beginnings meet by hashed keys (each token's beginnings are posted), each
    with its best entry alone; containment is looked up only for names that nothing better has matched, by an index of
    three-letter runs. What is posted of the catalog is many times its size, so it is shuffled and never broadcast.
    """
    norm = users.select(F.col(user_col).alias("name"), normalize_name(F.col(user_col)).alias("norm")).filter("norm <> ''").distinct()
    whole = norm.select("name", F.lit(0).alias("part"), F.col("norm").alias("variant"))
    tokens = norm.select("name", "norm", F.explode(F.array_distinct(F.split("norm", " "))).alias("variant")).filter("variant <> norm").select("name", F.lit(1).alias("part"), "variant")
    asked = whole.unionByName(tokens)
    # Dealt by number: a catalog of a few MB would otherwise be one part, and what is posted of it one task's work.
    dealt = int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = cut(catalog.select("name_norm").repartition(dealt, "name_norm").distinct())
    each = entries.select("name_norm", F.explode(F.array_distinct(F.split("name_norm", " "))).alias("token"))
    keys = entries.select("name_norm", F.lit(0).alias("kind"), F.col("name_norm").alias("variant"))
    keys = keys.unionByName(each.select("name_norm", F.lit(1).alias("kind"), F.col("token").alias("variant")))
    begins = F.transform(F.sequence(F.lit(1), F.length("token")), lambda n: F.substr("token", F.lit(1), n))
    keys = keys.unionByName(each.select("name_norm", F.lit(2).alias("kind"), F.explode(begins).alias("variant")))
    posted = keys.groupBy("variant").agg(F.min(F.struct("kind", (-F.length("name_norm")).alias("less"), "name_norm")).alias("hit"))
    # An entry is judged by its best variant of the whole name, by tokens only without one; the least score does that.
    near = cut(_best(asked.join(posted.hint("merge"), "variant")))
    unmatched = whole.join(near.filter("best.score < 10").select("name"), "name", "left_anti")
    inside = cut(_best(_containing(unmatched, entries)))
    rest = tokens.join(near.select("name").unionByName(inside.select("name")).distinct(), "name", "left_anti")
    every = near.unionByName(inside).unionByName(_best(_containing(rest, entries)))
    return every.groupBy("name").agg(F.min("best")["name_norm"].alias("canonical"))


def _best(met: DataFrame) -> DataFrame:
    """(name, best): the least (score, less, name_norm) of a name's variants with their hits."""
    return met.groupBy("name").agg(F.min(F.struct((F.col("part") * 10 + F.col("hit.kind")).alias("score"), "hit.less", "hit.name_norm")).alias("best"))


def _grams(text: Column, sizes: tuple[int, ...]) -> Column:
    """Distinct runs of each of ``sizes`` characters."""
    runs = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*map(runs, sizes)))


def _containing(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """``asked`` (name, part, variant) with the ``hit`` (kind, less, name_norm) of the best entry that contains the variant, if any.

    Entries are found by the variant's rarest run of three characters, or itself if it is shorter; only runs that are asked for are posted.
    """
    variants = asked.select("variant").distinct()
    own = F.when(F.length("variant") >= 3, _grams(F.col("variant"), (3,))).otherwise(F.array("variant"))
    looked = variants.select("variant", F.explode(own).alias("gram"))
    posted = entries.select("name_norm", F.explode(_grams(F.col("name_norm"), (1, 2, 3))).alias("gram"))
    uses = posted.groupBy("gram").agg(F.count("*").alias("uses"))
    rare = looked.join(uses, "gram", "left").groupBy("variant").agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "gram")).alias("r"))
    rare = cut(rare.filter("r.uses > 0").select("variant", "r.gram"))  # a run that no entry has: nothing contains the variant
    found = posted.join(rare.select("gram").distinct(), "gram", "left_semi").hint("merge").join(rare, "gram").filter(F.contains("name_norm", "variant"))
    hits = found.groupBy("variant").agg(F.min(F.struct(F.lit(3).alias("kind"), (-F.length("name_norm")).alias("less"), "name_norm")).alias("hit"))
    return asked.join(hits, "variant")


def guess_genders(names: DataFrame, catalog: DataFrame, name_col: str = "name") -> DataFrame:
    """``names`` with ``guessed``: M, F or U of the catalog entry of exactly this name, else of one that differs in case; else null.

    catalog: (display, gender, ord). An entry that is met but has no such letter leaves the guess null.
    """
    letter = F.upper(F.trim("gender"))
    known = catalog.select("display", F.when(letter.isin("M", "F", "U"), letter).alias("letter"), "ord")
    exact = known.groupBy(F.col("display").alias("__exact")).agg(F.min(F.struct("ord", "letter"))["letter"].alias("__a"), F.lit(True).alias("__met"))
    loose = known.groupBy(F.lower("display").alias("__loose")).agg(F.min(F.struct("ord", "letter"))["letter"].alias("__b"))
    met = names.withColumns({"__exact": F.col(name_col), "__loose": F.lower(name_col)}).join(exact, "__exact", "left").join(loose, "__loose", "left")
    return met.withColumn("guessed", F.when(F.col("__met"), F.col("__a")).otherwise(F.col("__b"))).drop("__exact", "__loose", "__a", "__b", "__met")


def known_names(catalog: DataFrame, mappings: DataFrame) -> DataFrame:
    """(name): every name of the catalog (display) and of saved mappings (character), once."""
    return catalog.select(F.col("display").alias("name")).unionByName(mappings.select(F.col("character").alias("name"))).filter("name is not null and name <> ''").distinct()


def enabled_cast(cast: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a cast that have a name and are not switched off, with the trimmed name and whether ``known`` (name) has it, ignoring case."""
    rows = cast.withColumn("name", strip(F.coalesce(F.col("name").cast("string"), F.lit("")))).filter(F.col("name") != "").filter(F.coalesce(F.col("enabled"), F.lit(True)))
    hits = known.select(F.lower("name").alias("__low")).distinct().withColumn("__hit", F.lit(True))
    return rows.withColumn("__low", F.lower("name")).join(hits, "__low", "left").withColumn("exists_in_config", F.coalesce("__hit", F.lit(False))).drop("__low", "__hit")


def name_variants(name: Column) -> Column:
    """Spellings by which a cast member may be called: as given, normalised, first and last token, initials, dotted initials."""
    norm = normalize_name(name)
    tokens = F.split(norm, " ")
    letters = F.transform(tokens, lambda t: F.left(t, F.lit(1)))
    every = F.array(name, norm, F.get(tokens, F.lit(0)), F.element_at(tokens, -1), F.array_join(letters, ""), F.concat(F.array_join(letters, "."), F.lit(".")))
    trimmed = F.filter(F.transform(every, lambda v: F.trim(v)), lambda v: v != "")
    lows = F.transform(trimmed, lambda v: F.lower(v))
    return F.filter(trimmed, lambda v, i: F.array_position(lows, F.lower(v)) == i + 1)


def first_name_in(text: Column, names: list[str]) -> Column:
    """The first of ``names`` whose normalised form stands in the normalised text as whole words, or null."""
    padded = F.concat(F.lit(" "), normalize_name(text), F.lit(" "))
    return F.get(F.filter(F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>"), lambda n: F.contains(padded, F.concat(F.lit(" "), normalize_name(n), F.lit(" ")))), F.lit(0))


def candidate_phrases(stories: DataFrame, most: int = 12, least: int = 2, text_col: str = "text") -> DataFrame:
    """(story_id, phrase, uses, place): runs of one to three capitalised words used ``least`` times or more, the most used first."""
    found = stories.select("story_id", F.explode(F.regexp_extract_all(text_col, F.lit(r"(?U)\b([A-Z][a-z]+(?: [A-Z][a-z]+){0,2})\b"), F.lit(1))).alias("phrase"))
    counts = found.withColumn("key", candidate_key(F.col("phrase"))).groupBy("story_id", "key").agg(F.min("phrase").alias("phrase"), F.count("*").alias("uses")).filter(F.col("uses") >= least)
    place = F.row_number().over(W.partitionBy("story_id").orderBy(F.desc("uses"), "phrase"))
    return counts.withColumn("place", place).filter(F.col("place") <= most).drop("key")
