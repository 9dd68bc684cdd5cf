"""Operator 8: URL filter by association rules, with DataFrame operations only.

Labelled URLs become baskets of tokens and a label; Spark's FP-growth mines the combinations that are frequent, and
rules `tokens => label` under the least support or confidence are pruned. An inverted index holds each rule under its
rarest token; a URL's tokens are looked up there and the rule applies if the URL holds all its tokens. Listed rules
(host, path prefix) come first; the longest that fits decides. Unless other labels are given, the verdicts of listed
rules are what the mined ones learn from.

A null URL, or one without `://`, has an empty host and path, no tokens, and gets the default verdict, as does a URL
that no rule matches. Repeated rows each get a verdict. Labels that are null teach nothing; without labels there are no
mined rules. Further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import work

#: Listed rules: verdict, and host followed by path prefix.
LISTED = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Items of a basket up to which FP-growth mines it (larger ones are counted by lengths), and of a rule's antecedent.
MOST_ITEMS, LONGEST = 12, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: -len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is None else (rule, verdict)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens, sorted: suffixes of the host, its first label, path words with digits as #, keys of the query, the fragment's presence."""
    labels = F.split(host, r"\.")
    last = F.concat(F.lit("tld:"), F.element_at(labels, -1))
    site = F.concat(F.lit("site:"), F.concat_ws(".", F.slice(labels, -2, 2)))
    first = F.concat(F.lit("first:"), F.element_at(labels, 1))
    names = F.transform(F.when(F.size(labels) > 3, F.slice(labels, F.lit(2), F.size(labels) - 3)), lambda x: F.concat(F.lit("label:"), x))
    names = F.coalesce(names, F.array().cast("array<string>"))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key:"), F.split(x, "=")[0]))
    ends = F.when(path.endswith("/"), F.array(F.lit("end:/"))).otherwise(F.array().cast("array<string>"))
    fragment = F.when(F.coalesce(url, F.lit("")).contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.when(F.size(labels) >= 2, F.array(last, site, first)).otherwise(F.array(last, first)), names, parts, keys, ends, fragment)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(every)))


def baskets_of(labelled: DataFrame, least: Column, tokens: str = "tokens") -> DataFrame:
    """tokens, items of each distinct token set: the items that rules are made of, the most frequent first.

    Tokens in fewer than least labelled URLs are left out, and tokens that always occur together count as one item (the
    first in order).
    """
    sets = labelled.groupBy(tokens).agg(F.count("*").alias("n"))
    each = sets.select(tokens, "n", F.xxhash64(tokens).alias("h"), F.explode(tokens).alias("token"))
    stats = each.groupBy("token").agg(F.sum("n").alias("freq"), F.count("*").alias("sets"), F.bit_xor("h").alias("sign")).where(F.col("freq") >= least)
    together = ["freq", "sets", "sign"]
    named = stats.join(stats.groupBy(*together).agg(F.min("token").alias("item")), together).select("token", "item", "freq")
    kept = each.join(named, "token").groupBy(tokens).agg(F.array_sort(F.collect_set(F.struct((-F.col("freq")).alias("f"), "item"))).alias("x"))
    return kept.select(tokens, F.col("x.item").alias("items"))


def of_large_baskets(sets: DataFrame, least: int, tables: work.WorkTables) -> DataFrame:
    """antecedent, label, hits, whole: every antecedent of LONGEST items at most that a large basket holds and that occurs
    least times or more with some label; counted over all sets(id, label, n, items), large ones and small ones.

    Length by length: an antecedent is counted only if those without its first and without its last item were kept.
    """
    rows = sets.select("id", "label", "n", (F.size("items") > MOST_ITEMS).alias("large"), F.explode("items").alias("item"))
    rows, found, items, by = rows.withColumn("antecedent", F.array("item")), None, None, "antecedent"
    for length in range(1, LONGEST + 1):
        hits = rows.groupBy(by, "label").agg(F.sum("n").alias("hits"), F.bool_or("large").alias("large"))
        whole = hits.groupBy(by).agg(F.sum("hits").alias("whole"), F.max("hits").alias("most"), F.bool_or("large").alias("large"), F.collect_list(F.struct("label", "hits")).alias("x"))  # an entry a label
        often = tables.keep(whole.where(F.col("large") & (F.col("most") >= least)).select(by, "whole", "x"), f"antecedents-{length}")
        own = often.select(by, "whole", F.explode("x").alias("x")).select(by, "x.label", "x.hits", "whole")
        found = own if found is None else found.unionByName(own)
        if length == LONGEST:
            return found
        rows = rows.join(often.select(by), by, "left_semi")
        items = rows.select("id", F.col("item").alias("next")) if items is None else items
        grown = rows.join(items, "id").where("next > item").withColumns({by: F.array_append(by, F.col("next")), "item": F.col("next")}).drop("next")
        rows = grown.join(often.select(F.col(by).alias("rest")), F.slice(by, 2, length) == F.col("rest"), "left_semi")


def mine(labelled: DataFrame, tokens: str = "tokens", label: str = "label", min_support: float = 0.01, min_confidence: float = 0.8, min_lift: float = 1.2) -> DataFrame:
    """Rules from labelled token sets: antecedent, verdict, confidence, support, and key, the antecedent's rarest item.

    A combination must occur in min_support of the labelled URLs with the label, its share of the label be min_confidence
    and min_lift times the label's own share. Antecedents have LONGEST items at most, so that the rules are few whatever
    URLs have in common.

    FP-growth lists subsets of every length, 2 ^ items of them at worst, so it gets baskets of up to MOST_ITEMS. What
    larger ones hold is counted up to LONGEST items only, over all baskets, and stands for what FP-growth says of it.
    """
    tables = work.WorkTables(labelled.sparkSession, "urls")
    known = labelled.where(F.col(label).isNotNull() & (F.size(tokens) > 0)).select(F.col(tokens).alias("tokens"), F.col(label).alias("label"))
    many = known.count()
    chosen = tables.keep(baskets_of(known, F.lit(min_support * many)), "baskets")
    mark = F.concat(F.lit("verdict="), F.col("label"))
    # A label alone is a basket too: supports are shares of all labelled URLs.
    items = F.array_append(F.coalesce(F.when(F.size("items") <= MOST_ITEMS, F.col("items")), F.array().cast("array<string>")), mark)
    grown = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(known.join(chosen, "tokens", "left").select(items.alias("items")))
    rules = grown.associationRules.where(F.col("lift") >= min_lift).where(F.startswith(F.col("consequent")[0], F.lit("verdict="))).where(F.size("antecedent") <= LONGEST)
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), F.substring_index(F.col("consequent")[0], "=", -1).alias("verdict"), "confidence", "support")
    often = grown.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    if not chosen.where(F.size("items") > MOST_ITEMS).isEmpty():
        counts = known.groupBy("tokens", "label").agg(F.count("*").alias("n")).join(chosen, "tokens").groupBy("items", "label").agg(F.sum("n").alias("n"))
        sets = tables.keep(counts.withColumn("id", F.monotonically_increasing_id()), "sets")
        counted = tables.keep(of_large_baskets(sets, math.ceil(min_support * many), tables), "counted")
        shares = known.groupBy("label").agg((F.count("*") / F.lit(many)).alias("share"))
        confidence = F.col("hits") / F.col("whole")
        good = counted.join(shares, "label").where((F.col("hits") >= math.ceil(min_support * many)) & (confidence >= min_confidence) & (confidence / F.col("share") >= min_lift))
        good = good.select("antecedent", F.col("label").alias("verdict"), confidence.alias("confidence"), (F.col("hits") / F.lit(many)).alias("support"))
        rules = rules.join(counted.select("antecedent").distinct(), "antecedent", "left_anti").unionByName(good)
        often = sets.select("n", F.explode("items").alias("token")).groupBy("token").agg(F.sum("n").alias("freq"))
    rarest = rules.select("antecedent", "verdict", "confidence", "support", F.explode("antecedent").alias("token")).join(often, "token")
    return rarest.groupBy("antecedent", "verdict", "confidence", "support").agg(F.min(F.struct("freq", "token"))["token"].alias("key"))


def mined_verdicts(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """For each distinct token set that a rule matches: verdict, mined_rule and confidence of the best rule.

    Best is the highest confidence, then the highest support, then the most tokens, then the first in order.
    """
    found = token_sets.select("tokens", F.explode("tokens").alias("key")).join(rules, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct((-F.col("confidence")).alias("a"), (-F.col("support")).alias("b"), (-F.size("antecedent")).alias("c"), F.concat_ws(" ", "antecedent").alias("rule"), "verdict", "confidence")
    best = found.groupBy("tokens").agg(F.min(rank).alias("best"))
    return best.select("tokens", F.col("best.verdict").alias("mined"), F.col("best.rule").alias("mined_rule"), F.col("best.confidence").alias("mined_confidence"))


def judge(pages: DataFrame, labels: DataFrame | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url", listed=LISTED, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule.

    labels: page_id and label (`allow`, `block` or null) of the URLs to learn from. Without them, the listed rules teach:
    the URLs that they decide are labelled by them, and what is mined from those judges the URLs that no listed rule decides.
    """
    host, path = F.col("host"), F.col("path")
    rule, verdict = listed_rule(host, path, listed)
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens_of(F.col("url"), host, path).alias("tokens"))
    # Each token set is looked up once, however many pages share it.
    if labels is None:
        labelled = rows.select("tokens", F.col("listed").alias("label"))
    else:
        labelled = rows.select("page_id", "tokens").join(labels.select(F.col("page_id"), F.col("label")).where("label is not null"), "page_id")
    chosen = mined_verdicts(rows.where("listed is null").select("tokens").distinct(), mine(labelled, **mining))
    found = rows.join(chosen, "tokens", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit(default)).alias("verdict"), F.when(F.col("listed").isNull(), F.col("mined_rule")).alias("mined_rule"))
