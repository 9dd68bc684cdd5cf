"""The written ordering doctrine where it is mechanical."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import natural_key, norm_text, suffix_index
from .ranking import ranked

#: How texts cite codes and laws.
CODE = r"(?i)\bcode\s+(?:général\s+|de\s+|du\s+|des\s+|d['’]\s*)*([a-zéèàêûîôç' -]{3,40})"
LAW = r"(?i)\bloi\s+n°\s*([0-9]{2,4})-([0-9]+)"


def author_key(auteurs: Column) -> Column:
    return F.array_join(F.array_sort(F.coalesce(auteurs, F.array().cast("array<string>"))), "|")


def same_text(df: DataFrame) -> DataFrame:
    """Adds members, author_sets, copy (place among the rows of one author) and genre: doublon for later copies by one
    author, identiques where the authors differ, else null.
    """
    keyed = df.withColumns({"__a": norm_text("article"), "__d": F.nullif(norm_text("dispositif"), F.lit("")), "__who": author_key(F.col("auteurs"))})
    groups = keyed.groupBy("__a", "__d").agg(F.count("*").alias("members"), F.count_distinct("__who").alias("author_sets")).where("members > 1 and __d is not null")
    number = natural_key("numero")
    copies = ranked(keyed, [number, F.col("_pos")], "copy", within={"a": F.col("__a"), "d": F.coalesce("__d", F.lit("")), "who": F.col("__who")})
    genre = F.when(F.col("members").isNull(), None).when(F.col("copy") > 1, "doublon").when(F.col("author_sets") > 1, "identiques").when(F.col("members") > 1, "doublon")
    return copies.join(groups, ["__a", "__d"], "left").withColumn("genre", genre).drop("__a", "__d", "__who")


def order_of_identiques(df: DataFrame) -> DataFrame:
    """Adds place inside identical texts: the rapporteur first, then by number."""
    number, later = natural_key("numero"), ~F.coalesce("rapporteur", F.lit(False))
    return ranked(df, [later, number, F.col("_pos")], "place", within={"a": norm_text("article"), "d": norm_text("dispositif")})


def common_discussions(df: DataFrame) -> DataFrame:
    """Adds groupe_id for rows of one article, alinéa and impact that are two at least and not all of one text."""
    keys = ["article", "alinea", "action"]
    groups = df.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_distinct(norm_text("dispositif")).alias("__texts")).where("__n >= 2 and __texts >= 2 and alinea is not null")
    return df.join(groups.select(*keys, F.lit(True).alias("__dc")), keys, "left").withColumn("groupe_id", F.when(F.col("__dc"), group_name("discussion-commune", F.col("article"), F.col("alinea")))).drop("__dc")


def group_name(kind: str, article: Column, alinea: Column | None = None) -> Column:
    """discussion-commune-art28-al3"""
    parts = [F.lit(kind), F.concat(F.lit("art"), F.replace(article, F.lit(" "), F.lit("")))]
    if alinea is not None:
        parts.append(F.concat(F.lit("al"), alinea.cast("string")))
    return F.concat_ws("-", *parts)


def group_type(doublon: Column, identique: Column, commune: Column, additionnel: Column) -> Column:
    return F.when(doublon, "doublon").when(identique, "identiques").when(commune, "discussion_commune").when(additionnel, "additionnel").otherwise("isole")


def consecutive(df: DataFrame, group: str, rank: str) -> DataFrame:
    """Adds a new rank by which a group's rows follow its first: the order of (group's least rank, own rank)."""
    least = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(rank).alias("__lead"))
    return df.join(least, group, "left").withColumn("ordre", F.struct(F.coalesce("__lead", F.col(rank)).alias("lead"), F.col(rank).alias("own"))).drop("__lead")


def mechanical_falls(df: DataFrame) -> DataFrame:
    """One row a cause with the number of rows that fall if it is adopted: cause, kind, fallen.

    A suppressed article makes all its others fall; a rewritten alinéa those of lower rank on it; a suppressed alinéa all
    on it. Rows to fall are counted by key first, so no pairs are formed.
    """
    article = df.groupBy("article").agg(F.count("*").alias("n"))
    alinea = df.where("alinea is not null").groupBy("article", "alinea").agg(F.count("*").alias("n"), F.count_if(F.col("priorite") == 5).alias("lower"))
    whole = df.where("priorite = 1").join(article, "article").select(F.col("id").alias("cause"), F.lit("article").alias("kind"), (F.col("n") - 1).alias("fallen"))
    gone = df.where("priorite = 3").join(alinea, ["article", "alinea"]).select(F.col("id").alias("cause"), F.lit("alinea").alias("kind"), (F.col("n") - 1).alias("fallen"))
    anew = df.where("priorite = 4").join(alinea, ["article", "alinea"]).select(F.col("id").alias("cause"), F.lit("redaction").alias("kind"), F.col("lower").alias("fallen"))
    return whole.unionByName(gone).unionByName(anew).where("fallen > 0")


def fall_classes(df: DataFrame) -> DataFrame:
    """article, alinea, kind, causes: the classes of causes, and how many rows are in each. A class with the alinéa null is of a whole article."""
    kind = F.when(F.col("priorite") == 1, "article").when(F.col("priorite") == 3, "alinea").when(F.col("priorite") == 4, "redaction")
    rows = df.withColumn("kind", kind).where("kind = 'article' or kind is not null and alinea is not null")
    return rows.groupBy("article", F.when(F.col("kind") != "article", F.col("alinea")).alias("alinea"), "kind").agg(F.count("*").alias("causes"))


def fallen_members(df: DataFrame) -> DataFrame:
    """id and, for each kind of class, by how many causes the row falls: by_article, by_alinea, by_redaction. No pairs are formed."""
    classes = fall_classes(df)
    whole = classes.where("kind = 'article'").select("article", F.col("causes").alias("a"))
    parts = classes.where("kind <> 'article'").groupBy("article", "alinea").agg(F.sum(F.when(F.col("kind") == "alinea", F.col("causes"))).alias("l"), F.sum(F.when(F.col("kind") == "redaction", F.col("causes"))).alias("r"))
    own = lambda p: F.when(F.col("priorite") == p, 1).otherwise(0)
    rows = df.join(whole, "article", "left").join(parts, ["article", "alinea"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("id", zero(F.col("a") - own(1)).alias("by_article"), zero(F.col("l") - own(3)).alias("by_alinea"), zero(F.when(F.col("priorite") == 5, F.col("r"))).alias("by_redaction"))


def fallen_pairs(df: DataFrame) -> DataFrame:
    """cause and fallen ids, for the rows of one article; as large as the falls themselves. See fall_classes() and fallen_members() for all."""
    causes = df.where("priorite in (1, 3, 4)").select(F.col("id").alias("cause"), "article", F.col("alinea").alias("cause_alinea"), F.col("priorite").alias("cause_priorite"))
    applies = (F.col("cause_priorite") == 1) | (F.col("alinea") == F.col("cause_alinea")) & ((F.col("cause_priorite") == 3) | (F.col("priorite") == 5))
    return causes.join(df, "article").where(applies & (F.col("id") != F.col("cause"))).select("cause", F.col("id").alias("fallen"))


#: How texts name one alinéa or several.
ALINEAS = r"(?i)alin[ée]as?\s+([0-9]{1,9})(?:er)?(?:\s*(?:à|et|-)\s*(?:l['’]alin[ée]a\s+)?([0-9]{1,9}))?"


def impact_range(text: Column, alinea: Column | None = None) -> Column:
    """Struct(first, last) of the alinéas that a text is about, or else of the one given; null if there is none."""
    first, last = (F.regexp_extract(text, ALINEAS, i).try_cast("int") for i in (1, 2))
    other = F.coalesce(last, first)
    found = F.when(first.isNotNull(), F.struct(F.least(first, other).alias("first"), F.greatest(first, other).alias("last")))
    return found if alinea is None else F.coalesce(found, F.when(alinea.isNotNull(), F.struct(alinea.cast("int").alias("first"), alinea.cast("int").alias("last"))))


def range_discussions(df: DataFrame, impact: str = "impact") -> DataFrame:
    """Adds overlaps, how many other rows of the article have a range that meets the row's own, and groupe_id of rows whose
    ranges hang together in a chain of such, two rows at least.

    Rows are counted by article and range first, and an article has as many starts and ends of ranges as alinéas at most,
    however many rows it has. Those that meet a range are all but those that end before it or start after it, so running
    counts of ends and starts give overlaps without pairs. A chain ends where all ranges so far have ended.
    """
    first, last = F.col(f"{impact}.first"), F.col(f"{impact}.last")
    counted = df.where(F.col(impact).isNotNull()).groupBy("article", first.alias("first"), last.alias("last")).agg(F.count("*").alias("n"))
    points = counted.select("article", F.explode(F.array(F.struct(F.col("first").alias("point"), F.col("n").alias("starts"), F.lit(0).cast("long").alias("ends"), F.col("last").alias("upto")), F.struct(F.col("last").alias("point"), F.lit(0).cast("long").alias("starts"), F.col("n").alias("ends"), F.lit(None).cast("int").alias("upto")))).alias("x"))
    points = points.groupBy("article", "x.point").agg(F.sum("x.starts").alias("starts"), F.sum("x.ends").alias("ends"), F.max("x.upto").alias("upto"))
    up = Window.partitionBy("article").orderBy("point")
    before, down = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("article").orderBy(F.desc("point")).rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("point") > F.max("upto").over(before), F.lit(True)) & (F.col("starts") > 0)
    points = points.select("article", "point", "starts", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("ended"), F.coalesce(F.sum("starts").over(down), F.lit(0)).alias("later"), new.cast("int").alias("new"), "upto")
    points = points.withColumn("chain", F.sum("new").over(up))
    chains = points.groupBy("article", "chain").agg(F.min("point").alias("from"), F.max("upto").alias("to"), F.sum("starts").alias("members"))
    left = points.join(chains, ["article", "chain"]).select("article", F.col("point").alias("first"), "ended", "from", "to", "members")
    right = points.select("article", F.col("point").alias("last"), "later")
    of_range = counted.join(left, ["article", "first"]).join(right, ["article", "last"])
    total = counted.groupBy("article").agg(F.sum("n").alias("whole"))
    name = F.concat(group_name("discussion-commune", F.col("article"), F.col("from")), F.when(F.col("to") > F.col("from"), F.concat(F.lit("-"), F.col("to").cast("string"))).otherwise(""))
    of_range = of_range.join(total, "article").select("article", F.struct("first", "last").alias(impact), (F.col("whole") - F.col("ended") - F.col("later") - 1).alias("overlaps"), F.when(F.col("members") > 1, name).alias("groupe_id"))
    return df.drop("overlaps", "groupe_id").join(of_range, ["article", impact], "left").withColumn("overlaps", F.coalesce("overlaps", F.lit(0)))


def falls_in_order(df: DataFrame, rank: str = "rang") -> DataFrame:
    """id, cause and kind of the rows that fall when all are put to the vote in the order of rank and whatever has not
    fallen is adopted: a fallen row makes nothing fall.

    An article's first suppression fells all later rows of it; an alinéa's first suppression, if it has not fallen, all
    later rows on it; an alinéa's first rewriting, if it has not fallen, the later ones of lower rank on it. Only first ones
    matter, as what comes later has fallen or changes nothing. The first cause fells. Least ranks are aggregated and joined
    back, so no pairs are formed and no window sees an article.
    """
    first = lambda priority, name: F.min(F.when(F.col("priorite") == priority, F.struct(F.col(rank).alias("at"), F.col("id").alias("cause")))).alias(name)
    articles = df.groupBy("article").agg(first(1, "whole"))
    alineas = df.where("alinea is not null").groupBy("article", "alinea").agg(first(3, "gone"), first(4, "anew"))
    rows = df.join(articles, "article", "left").join(alineas, ["article", "alinea"], "left")
    stands = lambda cause, *others: F.when(reduce(Column.__and__, (F.coalesce(F.col(f"{cause}.at") < F.col(f"{o}.at"), F.lit(True)) for o in others)), F.col(cause))
    rows = rows.withColumn("gone", stands("gone", "whole")).withColumn("anew", stands("anew", "whole", "gone"))
    hit = lambda cause, kind, more=F.lit(True): F.when((F.col(rank) > F.col(f"{cause}.at")) & more, F.struct(F.col(f"{cause}.at").alias("at"), F.col(f"{cause}.cause").alias("cause"), F.lit(kind).alias("kind")))
    fell = F.array_min(F.array_compact(F.array(hit("whole", "article"), hit("gone", "alinea"), hit("anew", "redaction", F.col("priorite") == 5))))
    return rows.select("id", fell.alias("fell")).where("fell is not null").select("id", "fell.cause", "fell.kind")


def additional_key(text: Column, article: Column, rank: Column) -> Column:
    """Struct that sorts additional articles: by code, then law (oldest first), then the rest, then reports."""
    code = F.lower(F.trim(F.regexp_extract(text, CODE, 1)))
    year, number = (F.regexp_extract(text, LAW, i).try_cast("int") for i in (1, 2))
    full = F.when(year < 100, year + 1900).otherwise(year)
    report = F.lower(text).rlike("rapport")
    kind = F.when(code != "", 1).when(year.isNotNull(), 2).when(report, 4).otherwise(3)
    return F.struct(kind.alias("kind"), code.alias("code"), F.coalesce(full, F.lit(0)).alias("year"), F.coalesce(number, F.lit(0)).alias("law"), natural_key(article).alias("article"), rank.alias("impact"))


def is_additional(article: Column) -> Column:
    return article.rlike(r"(?i)\(nouveau\)|^\s*après\b") | (suffix_index(article) > 0) & article.rlike(r"(?i)additionnel")
