"""URL filters: fixed host and path rules first, then association rules mined by FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The item that marks a transaction with a bad label.
BAD = "label bad"
#: Up to this many rules the index over them is broadcast.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_after(url), r"\A[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to a question mark, a hash or the end."""
    return F.regexp_extract(_after(url), r"\A[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def url_tokens(url: Column) -> Column:
    """Distinct items of a url: labels of its host, segments of its path, names of its query."""
    query = F.regexp_extract(_after(url), r"\A[^?#]*\?([^#]*)", 1)
    named = lambda kind, a: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    names = F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])
    return F.array_distinct(F.concat(named("host ", F.split(url_host(url), r"\.")), named("path ", F.split(url_path(url), "/")), named("query ", names)))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of ``rules`` (verdict, host/path) that fits, as a struct (rule, verdict), or null."""
    fits = []
    for verdict, rule in rules:
        own, _, rest = rule.partition("/")
        fit = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size: int, rule: string, verdict: string>")


def mine_rules(pages: DataFrame, labels: DataFrame, support: float = 0.005, confidence: float = 0.8, lift: float = 1.2, least_pages: int = 8) -> DataFrame:
    """(rule_id, items, size, confidence, support): token combinations that go with bad labels, by FP-growth over all labelled urls.

    A label is bad if it is toxic or of low quality; the worst of a page's labels counts. Rules below the support,
    confidence or lift, or found on fewer than ``least_pages`` pages, go, and so do rules of which a part is a rule itself: their matches are a subset.
    """
    bad = F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad")
    rated = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").filter("id is not null").groupBy("id").agg(bad).filter("bad is not null")
    known = pages.select(F.col("page_id").cast("long").alias("id"), url_tokens(F.col("url")).alias("items")).filter("url is not null and size(items) > 0").join(rated, "id")
    baskets = cut(known.select(F.when(F.col("bad") == 1, F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")))
    least = max(support, least_pages / max(least_pages, baskets.count()))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(baskets)
    found = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BAD))) & (F.col("lift") >= lift))
    found = cut(found.select(F.array_sort("antecedent").alias("items"), "confidence", "support").withColumn("size", F.size("items")))
    # A part of a rule is found by the tokens of the whole, through the same kind of index that matching uses.
    parts = found.select(F.col("items").alias("part"), F.col("size").alias("part_size"), F.col("items")[0].alias("token"))
    wider = found.select("items", "size", F.explode("items").alias("token")).join(parts, "token").filter("part_size < size").filter(F.size(F.array_except("part", "items")) == 0)
    kept = found.join(wider.select("items").distinct(), "items", "left_anti")
    return kept.withColumn("rule_id", F.xxhash64("items"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` of ``urls`` that hold all items of a rule.

    Inverted index: each rule is posted once, under the one of its items that the fewest urls have; a url looks up its
    items and verifies what it meets. The url table is never crossed with the rules. Up to BROADCAST_RULES rules the index
    is broadcast and urls stay where they are; beyond, both sides are shuffled by item.
    """
    rules = cut(rules.select("rule_id", "items"))
    small = F.broadcast if rules.count() <= BROADCAST_RULES else (lambda x: x)
    asked = urls.select("url").filter("url is not null").distinct().withColumn("items", url_tokens(F.col("url")))
    posted = rules.select("rule_id", "items", F.explode("items").alias("token"))
    looked = asked.select(F.explode("items").alias("token")).join(small(posted.select("token").distinct()), "token", "left_semi")
    common = cut(looked.groupBy("token").agg(F.count("*").alias("n")))  # a row for each item of a rule at most
    rare = F.min_by(F.col("token"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token"))).alias("token")
    index = cut(posted.join(common, "token", "left").groupBy("rule_id").agg(rare, F.first("items").alias("needs")).drop("rule_id"))
    met = asked.select("url", "items", F.explode("items").alias("token")).join(small(index), "token")
    return met.filter(F.size(F.array_except("needs", "items")) == 0).select("url").distinct()


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], support: float = 0.005, confidence: float = 0.8) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    The longest fixed rule that fits decides; without one, a url that matches a mined rule is blocked and any other is
    allowed. A null url, or one without ://, has empty host and path, fits no rule and is allowed. Repeated rows and
    repeated or null ids each get a row. Other columns are not read. Without labels nothing is mined.
    """
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    mined = mine_rules(known, labels, support, confidence)
    left = known.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    left = left.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    left = left.withColumn("fit", fixed_rule(F.col("host"), F.col("path"), rules))
    blocked = cut(match_rules(left.filter("fit is null"), mined).withColumn("hit", F.lit(True)))  # written, so Spark can split a url that many pages share
    verdict = F.when(F.col("fit").isNotNull(), F.col("fit")["verdict"]).when(F.col("hit"), "block").otherwise("allow")
    return left.join(blocked, "url", "left").select("page_id", "host", "path", F.col("fit")["rule"].alias("rule"), verdict.alias("verdict"))
