"""Text expressions. All run in the JVM but unescape_html() and unescape_all()."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: All white space that a script engine trims: ASCII, next line, separators, byte-order mark.
SPACE = r"[\s\u0085\p{Z}﻿]"
#: The suffixes of inserted articles, in legal order.
SUFFIXES = ("bis", "ter", "quater", "quinquies", "sexies", "septies", "octies", "nonies", "decies")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truthy(*choices: Column | str, default: str | None = None) -> Column:
    """The first choice that is neither null nor empty."""
    found = [F.nullif(col(x), F.lit("")) for x in choices]
    return F.coalesce(*found, F.lit(default))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^{SPACE}+|{SPACE}+$", "")


def lower_strip(text: Column | str) -> Column:
    return F.lower(strip(text))


def norm_text(text: Column | str) -> Column:
    """White space runs become one space, ends are trimmed, letters lower-cased; null is as empty."""
    return F.lower(strip(F.regexp_replace(F.coalesce(col(text), F.lit("")), f"{SPACE}+", " ")))


#: Digits that say how many digits a number has.
LENGTH_DIGITS = 10


def natural_key(text: Column | str) -> Column:
    """A string that sorts runs of digits as numbers, however long: each is written after the number of its digits."""
    runs = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))

    def one(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+", "")
        return F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), LENGTH_DIGITS, "0"), digits)).otherwise(x)

    return F.array_join(F.transform(runs, one), "")


def suffix_index(text: Column | str) -> Column:
    """0 without a suffix, 1 for bis, 2 for ter, ..."""
    found = F.lower(F.regexp_extract(col(text), r"(?i)\b(" + "|".join(SUFFIXES) + r")\b", 1))
    return F.coalesce(F.array_position(F.array(*map(F.lit, SUFFIXES)), found), F.lit(0)).cast("int")


def legal_key(article: Column | str) -> Column:
    """Struct that sorts articles as in a bill: 5 A, 5, 5 bis, 22, 22 bis, 22 ter, 22 quater, 23; without a number last."""
    article = F.coalesce(col(article), F.lit(""))
    digits = F.regexp_extract(article, r"([0-9]+)", 1)
    number = F.coalesce(digits.try_cast("int"), F.lit(2147483647))
    letter = F.regexp_extract(article, r"^\s*[0-9]+\s+([A-Z]{1,2})\b", 1)
    return F.struct(number.alias("number"), F.when(letter == "", 1).otherwise(0).alias("plain"), letter.alias("letter"), suffix_index(article).alias("suffix"), natural_key(article).alias("rest"))


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "<[^>]+>", "")


def excerpt(text: Column | str, most: int = 90) -> Column:
    """White space flattened; longer texts cut with an ellipsis; a dash for none."""
    flat = strip(F.regexp_replace(F.coalesce(col(text), F.lit("")), f"{SPACE}+", " "))
    return F.when(flat == "", "—").when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def capped(text: Column | str, most: int) -> Column:
    return F.substring(col(text), 1, most)


def line_estimate(text: Column | str, width: int = 100) -> Column:
    """Lines that a text takes at so many characters a line."""
    lines = F.transform(F.split(F.coalesce(col(text), F.lit("")), "\n"), lambda x: F.greatest(F.lit(1), F.ceil(F.length(x) / width).cast("int")))
    return F.aggregate(lines, F.lit(0), lambda a, x: a + x)


def is_long(text: Column | str) -> Column:
    return line_estimate(text) > 20


def rtf_escape(text: Column | str) -> Column:
    """Backslash and braces escaped, other than ASCII as signed 16-bit \\u escapes; beyond 16 bits as a surrogate pair."""
    def one(c: Column) -> Column:
        code, over = F.ascii(c), F.ascii(c) - 0x10000
        unit = F.concat(F.lit("\\u"), (code - F.when(code > 32767, 65536).otherwise(0)).cast("string"), F.lit("?"))
        # As signed numbers the halves of a pair start at -10240 and -9216.
        pair = F.concat(F.lit("\\u"), (F.shiftright(over, 10) - 10240).cast("string"), F.lit("?\\u"), (over % 1024 - 9216).cast("string"), F.lit("?"))
        return F.when(c.isin("\\", "{", "}"), F.concat(F.lit("\\"), c)).when(code < 128, c).when(code < 0x10000, unit).otherwise(pair)

    return F.array_join(F.transform(F.split(F.coalesce(col(text), F.lit("")), ""), one), "")


def section_header(article: Column | str) -> Column:
    """`APRÈS L'ARTICLE n` for new inserted articles, else `ARTICLE x`."""
    article = col(article)
    new = F.regexp_extract(article, r"(?i)^([0-9]+)\s*(?:" + "|".join(SUFFIXES) + r")?\s*\(nouveau\)", 1)
    return F.when(new != "", F.concat(F.lit("APRÈS L'ARTICLE "), new)).otherwise(F.concat(F.lit("ARTICLE "), article))


def content_line(numero: Column | str, rectification: Column | str, auteurs: Column | str) -> Column:
    """`Adt n° 7 Rect. de A, B`; without authors `de la commission`."""
    names = truthy(F.array_join(col(auteurs), ", "), default="la commission")
    rect = F.coalesce(F.concat(F.lit(" "), F.nullif(col(rectification), F.lit(""))), F.lit(""))
    return F.concat(F.lit("Adt n° "), col(numero), rect, F.lit(" de "), names)


def rtf_line(label: Column | str, glyph: Column | str, content: Column | str) -> Column:
    """Three tabs, label, tab, glyph, tab, content."""
    tab, slot = F.lit("\\tab "), lambda x: rtf_escape(F.coalesce(x, F.lit("")))
    glyph = F.when(truthy(glyph).isNotNull(), F.concat(col(glyph), F.lit(" ")))
    return F.concat(tab, tab, tab, slot(col(label)), tab, slot(glyph), tab, slot(col(content)))


def plural(n: Column | str, ending: str = "s") -> Column:
    return F.when(col(n) > 1, ending).otherwise("")


def trim_base_url(url: Column | str) -> Column:
    """Without trailing slashes, then without a last /v1."""
    return F.regexp_replace(F.regexp_replace(col(url), "/+$", ""), "(?i)/v1$", "")


def thought_and_answer(reply: Column | str) -> Column:
    """Struct(thought, answer) of a reply with <think> ... </think>; an open tag makes all the rest thought."""
    reply = F.coalesce(col(reply), F.lit(""))
    thought = F.regexp_extract(reply, r"(?s)<think>(.*?)(?:</think>|$)", 1)
    return F.struct(strip(thought).alias("thought"), strip(F.regexp_replace(reply, r"(?s)<think>.*?(?:</think>|$)", "")).alias("answer"))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_html(text: Column | str) -> Column:
    """All named and numeric entities. Of texts without & Python sees a null only."""
    text = col(text)
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _unescape_each(texts: pd.Series) -> pd.Series:
    return texts.map(lambda own: None if own is None else [None if x is None else html.unescape(x) for x in own])


def unescape_all(texts: Column | str) -> Column:
    """unescape_html() of each element of an array, in one pass of Python."""
    texts = col(texts)
    return F.coalesce(_unescape_each(F.when(F.exists(texts, lambda x: x.contains("&")), texts)), texts)
