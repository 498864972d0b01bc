"""URL filters: given rules first, then association rules mined from labelled URLs.

FP-growth finds combinations of URL tokens that come with a bad label. Tokens that stand in exactly the same labelled
URLs (the segments of one long path, say) are one item: apart they would multiply into 2**k equal combinations. A URL
has an item if it has any of its tokens, which is what the rules over single tokens would say. A combination becomes a rule if enough
labelled URLs have it (support) and nearly all of them are bad (confidence), and if no part of it does as well.
Rules are matched by an inverted index: each rule is filed under the tokens of its rarest item, a URL looks up its own
tokens, and the rest of the rule is checked on the URL's token array. Verdicts depend on the URL alone, so each distinct
URL is judged once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.llm.common import landed, task_count

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Setup:
    """Mining parameters. Frequent items, which the miner lists on the driver, number at most tokens per URL / support."""

    support: float = 0.002
    fewest: int = 8  # labelled URLs that have the rule, whatever the support
    confidence: float = 0.8
    longest: int = 4  # tokens of a rule


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest given rule that fits; nulls if none does. The rules are a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host suffixes and labels, path segments (numbers as one), query keys, fragment."""
    host, path = parts(url)
    tagged = lambda tag, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    labels = F.split(host, r"\.")
    suffix = F.array(F.regexp_extract(host, r"[^.]+$", 0), F.regexp_extract(host, r"[^.]+\.[^.]+$", 0))
    segments = F.transform(F.split(path, "/"), lambda x: F.when(x.rlike(r"^\d+$"), F.lit("9")).otherwise(x))
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    scheme = F.array(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)))
    mark = F.when(F.instr(url, "#") > 0, F.array(F.lit("#"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(tagged("s:", scheme), tagged("d:", suffix), tagged("h:", labels), tagged("p:", segments), tagged("q:", keys), mark)
    return F.array_distinct(every)


def _items(baskets: DataFrame, least: float) -> DataFrame:
    """(token, item, members): each token that ``least`` baskets (row, items) have, with the smallest token of those in the same ones."""
    each = baskets.select("row", F.explode("items").alias("token")).where(F.col("token") != BAD)
    place = [F.bit_xor(F.xxhash64("row", F.lit(i))).alias(f"s{i}") for i in (0, 1)]
    marks = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *place).where(F.col("n") >= least)
    groups = marks.groupBy("n", "s0", "s1").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return groups.select(F.explode("members").alias("token"), F.get("members", F.lit(0)).alias("item"), "members")


def mine(pages: DataFrame, labels: DataFrame, setup: Setup = Setup()) -> DataFrame:
    """(rule_id, antecedent, members, token): pruned rules for bad URLs, a row for each token of their rarest item.

    ``antecedent`` lists items, ``members`` the tokens of each. A label belongs to the page whose page_id is its doc_id;
    quality 0 is bad. Null ids, urls and labels are left out.
    """
    spark = pages.sparkSession
    named = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    named = named.groupBy(F.col("doc_id").alias("page_id")).agg(F.min("quality").alias("quality"))
    known = pages.where("url is not null").select("page_id", "url").join(named, "page_id")
    bad = F.when(F.col("quality") == 0, F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    whole = landed(known.select(F.monotonically_increasing_id().alias("row"), F.concat(tokens(F.col("url")), bad).alias("items")), "baskets")
    n = whole.count()
    empty = spark.createDataFrame([], "rule_id long, antecedent array<string>, members array<array<string>>, token string")
    if not n:
        return empty
    support = max(setup.support, setup.fewest / n)
    items = landed(_items(whole, support * n), "items")
    held = whole.select("row", F.explode("items").alias("token"))
    held = held.join(items.select("token", "item"), "token").select("row", "item").union(held.where(F.col("token") == BAD))
    baskets = landed(held.groupBy("row").agg(F.collect_set("item").alias("items")).select("items"), "projected")
    miner = FPGrowth(itemsCol="items", minSupport=min(1.0, support * n / max(1, baskets.count())), minConfidence=setup.confidence, numPartitions=task_count(spark))
    model = miner.fit(baskets)
    sets = landed(model.freqItemsets, "itemsets")
    rules = model.associationRules.where(F.array_contains("consequent", BAD) & (F.size("antecedent") <= setup.longest))
    rules = landed(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence").withColumn("rule_id", F.xxhash64("antecedent")), "rules")
    # a rule with a part that is a rule of the same confidence or more adds nothing
    smaller = rules.select(F.col("rule_id").alias("r"), F.col("antecedent").alias("a"), F.col("confidence").alias("c"), F.get("antecedent", F.lit(0)).alias("t"))
    each = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("t"))
    inside = (F.size("a") < F.size("antecedent")) & (F.size(F.array_except("a", "antecedent")) == 0) & (F.col("c") >= F.col("confidence"))
    implied = each.join(smaller, "t").where(inside).select("rule_id").distinct()
    kept = rules.join(implied, "rule_id", "left_anti").select("rule_id", "antecedent", F.explode("antecedent").alias("item"))
    single = sets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("item"), "freq")
    groups = items.select("item", "members").distinct()
    rarest = kept.join(single, "item").join(groups, "item").groupBy("rule_id", "antecedent").agg(
        F.min(F.struct("freq", "item", "members")).alias("m"), F.sort_array(F.collect_list(F.struct("item", "members"))).alias("every")
    )
    return rarest.select("rule_id", "antecedent", F.transform("every", lambda x: x["members"]).alias("members"), F.explode("m.members").alias("token"))


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url): the distinct urls of ``pages`` that have all items of some rule."""
    urls = pages.where("url is not null").select("url").distinct().withColumn("own", tokens(F.col("url")))
    met = urls.select("url", "own", F.explode("own").alias("token")).join(rules, "token")
    return met.where(F.forall("members", lambda m: F.arrays_overlap(m, F.col("own")))).select("url").distinct()


def report(pages: DataFrame, labels: DataFrame, setup: Setup = Setup(), rules=RULES) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule (null if none fits) and verdict.

    The verdict is the given rule's; without one, block if a mined rule fits, else allow. Null urls are allowed.
    Repeated rows each get a row; an empty table has none.
    """
    mined = landed(mine(pages, labels, setup), "mined")
    bad = matched(pages, mined).withColumn("mined", F.lit("block"))
    host, path = parts(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = judged.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("given"))
    return named.join(bad, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("given", "mined", F.lit("allow")).alias("verdict"))
