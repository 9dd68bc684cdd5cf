"""One JSON document of any size as many records, read by many tasks.

Spark's text reader cuts a file at each comma, by byte ranges of files. What a piece does to an automaton that knows
whether it is within a string, and how deep, is computed for both states that the piece may begin in; ranges are then
composed in order by prefix sums, first of quotes, then of depths, then of elements. So each comma's depth is known
without reading the document from its start, and commas at the depth of the records' array part the records. One record
must fit in a row.

Pieces are written once as a table, which fixes their order. Sums run within units of consecutive pieces, then over the
units, which are few: two passes shuffle numbers alone and leave a row a unit, the last shuffles each text once by unit and
once by record. Rows a file and rows a unit are broadcast; tasks get about as many pieces at any size, so no sort spills.

A document may also be given as the files of a folder, which follow one another in the order of their names, as
report.write_json_document() writes it.

Documents whose records are in no array (one amendment, or an object that is one) are single records and are unwrapped
as whole texts; see documents.unwrap().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, stored
from . import documents

#: Heads of arrays of records and of single ones, the first that fits first: how deep a comma may be for the head to follow
#: it (or the document's start), the depth of the records, and the pattern; {{ }} stands for a brace at the start.
HEADS = (
    (0, 1, r"^\s*\["),
    (1, 2, r'^\s*\{?\s*"amendments"\s*:\s*\['),
    (1, 0, r'^\s*\{?\s*"amendments"\s*:\s*\{'),
    (1, 2, r'^\s*\{?\s*"amendements"\s*:\s*\['),
    (1, 3, r'^\s*\{?\s*"amendements"\s*:\s*\{\s*"amendement"\s*:\s*\['),
    (2, 3, r'^\s*"amendement"\s*:\s*\['),
    (1, 0, r'^\s*\{?\s*"amendements"\s*:\s*\{'),
    (1, 2, r'^\s*\{?\s*"amendement"\s*:\s*\['),
)
#: Which of them count only within a member that the last but one begins.
NESTED = 5
#: How deep the deepest of them may be.
DEEPEST = max(deep for _, deep, _ in HEADS)
#: What closes the array and the objects around it.
TAIL = r"\s*\](\s*\})*\s*$"
#: A unit has up to 2 ** UNIT pieces, a task about TASK.
UNIT, TASK = 14, 500_000
#: A unit: the number of its file in the order of names, the file's range, and which of the range's.
KEY = ("part", "block", "unit")


def pieces(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file and its bytes, block, at (order in the block), value and its octets, quotes, what the piece adds to the depth if
    it begins outside (d0) or inside (d1) a string, and fits, bits of the heads that its value may be."""
    raw = spark.read.option("lineSep", ",").option("pathGlobFilter", glob).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    # Without escapes a string is all that is between two quotes; in JSON no escape holds a comma.
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    count = lambda x, chars: F.length(x) - F.length(F.translate(x, chars, ""))
    deeper = lambda x: count(x, "{[") - count(x, "}]")
    outside = lambda x: F.regexp_replace(x, '"[^"]*("|$)', "")
    fits = sum((F.when(F.col("value").rlike(pattern), 1 << k).otherwise(0) for k, (_, _, pattern) in enumerate(HEADS)), F.lit(0))
    fits = F.when(F.col("value").rlike("|".join(pattern for _, _, pattern in HEADS)), fits).otherwise(0)
    own = raw.withColumn("plain", plain)
    return own.select("file", "bytes", "block", "at", "value", F.octet_length("value").alias("octets"), fits.alias("fits"), count(F.col("plain"), '"').alias("quotes"), deeper(outside("plain")).alias("d0"), deeper(outside(F.concat(F.lit('"'), "plain"))).alias("d1"))


def parts(own: DataFrame, joined: bool) -> DataFrame:
    """A row a file: file, part (its number in the order of names), doc (the document's), n (pieces), start (at of the first
    piece, in block 0), and joint, whether that follows no comma, but the end of a file."""
    by_name = Window.orderBy("file")  # a row a file
    # A comma at the end of a file leaves no piece behind it, but a byte of the file's size.
    files = own.groupBy("file").agg(F.min(F.when(F.col("block") == 0, F.col("at"))).alias("start"), F.count("*").alias("n"), (F.sum("octets") + F.count("*") == F.max("bytes")).alias("comma"))
    files = files.withColumn("part", F.row_number().over(by_name))
    joint = F.coalesce(~F.lag("comma").over(by_name), F.lit(False)) if joined else F.lit(False)
    return files.select("file", "part", (F.lit(1) if joined else F.col("part")).alias("doc"), "n", "start", joint.alias("joint"))


def numbered(own: DataFrame, files: DataFrame) -> DataFrame:
    """The pieces of these files with part and unit instead of the file's name, and joint."""
    own = own.join(F.broadcast(files.select("file", "part", "start", F.col("joint").alias("__joint"))), "file")
    joint = F.col("__joint") & (F.col("block") == 0) & (F.col("at") == F.col("start"))
    return own.withColumns({"unit": F.shiftright("at", UNIT), "joint": joint}).drop("file", "bytes", "octets", "start", "__joint")


def summed(value: Column, own: bool = False) -> Column:
    """The sum of value over the pieces of the unit before each piece (own: and of it)."""
    rows = Window.partitionBy(*KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow if own else -1)
    return F.coalesce(F.sum(value.cast("int")).over(rows), F.lit(0))


def before(value: Column) -> Column:
    """The sum of value over the units of the document before each unit."""
    return F.coalesce(F.sum(value).over(Window.partitionBy("doc").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed(own: DataFrame) -> DataFrame:
    """Adds to the pieces of units that begin inside a string or not (opens), and at depth above: depth before the piece,
    after it, and free, whether the piece follows a comma outside strings."""
    own = own.withColumn("inside", ((summed(F.col("quotes")) % 2) == 1) != F.col("opens"))
    own = own.withColumn("more", F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0")))
    own = own.withColumn("depth", F.col("above") + summed(F.col("more")))
    return own.select("*", (F.col("depth") + F.col("more")).alias("after"), (~F.col("inside") & ~F.col("joint")).alias("free"))


def text_of(rows: Column) -> Column:
    """The pieces of an array of (part, block, at, joint, value) as one text."""
    return F.array_join(F.transform(F.array_sort(rows), lambda x, i: F.when((i == 0) | x["joint"], x["value"]).otherwise(F.concat(F.lit(","), x["value"]))), "")


def read_large_documents(spark: SparkSession, path: str, glob: str = "*.json", joined: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) as read_json_documents() gives them: file, _index and raw of records, file and reason of the rest.

    joined: the files are the parts of one document, whose name is the path. A record that is no JSON goes to the quarantine alone, also where that makes the document invalid.
    """
    own = stored(pieces(spark, path, glob), "pieces")
    files = cut(parts(own, joined))
    tasks = 1 + (files.agg(F.sum("n")).first()[0] or 0) // TASK
    docs = F.broadcast(files.select("part", "doc"))
    dealt = numbered(own, files).repartition(tasks, *KEY)

    # How each unit begins, from what units do to both states.
    inside = dealt.withColumn("inside", (summed(F.col("quotes")) % 2) == 1)
    d0, d1, one = F.col("d0"), F.col("d1"), F.col("inside")
    units = inside.groupBy(*KEY).agg(F.sum("quotes").alias("quotes"), F.sum(F.when(one, d1).otherwise(d0)).alias("t0"), F.sum(F.when(one, d0).otherwise(d1)).alias("t1")).join(docs, "part")
    units = units.withColumn("opens", before(F.col("quotes")) % 2 == 1)
    units = cut(units.select("doc", *KEY, "opens", before(F.when(F.col("opens"), F.col("t1")).otherwise(F.col("t0"))).alias("above")))

    # Commas by depth (0 stands for all that is no deeper) up to each unit and each head.
    levels = [f"n{k}" for k in range(DEEPEST + 1)]
    free, depth = F.col("free"), F.col("depth")
    counted = placed(dealt.join(F.broadcast(units.drop("doc")), list(KEY))).withColumns({n: summed(free & ((depth == k) if k else (depth <= 0)), own=True) for k, n in enumerate(levels)})
    may = lambda k, most: free & ((depth == most) if most > 1 else (depth <= most)) & (F.col("fits").bitwiseAND(1 << k) != 0)
    head = F.coalesce(*(F.when(may(k, most), k) for k, (most, _, _) in enumerate(HEADS)))
    found = F.collect_list(F.when(head.isNotNull(), F.struct(head.alias("head"), "at", *levels))).alias("heads")
    counts = counted.groupBy(*KEY).agg(*(F.max(n).alias(n) for n in levels), found)
    units = cut(units.join(counts, list(KEY)).withColumns({n: before(F.col(n)) for n in levels}))
    heads = units.select("doc", "part", "block", *levels, F.explode("heads").alias("h"))
    heads = heads.select("doc", "h.head", "part", "block", "h.at", *((F.col(n) + F.col(f"h.{n}")).alias(n) for n in levels)).withColumn("member", F.col("n0") + F.col("n1"))
    around = heads.where(F.col("head") == len(HEADS) - 2).select("doc", "member").distinct().withColumn("within", F.lit(True))
    heads = heads.join(around, ["doc", "member"], "left").where((F.col("head") != NESTED) | F.col("within"))
    deep = F.element_at(F.array(*(F.lit(d) for _, d, _ in HEADS)), F.col("x.head") + 1)
    chosen = heads.groupBy("doc").agg(F.min(F.struct("head", "part", "block", "at", *levels)).alias("x"))
    chosen = cut(chosen.withColumn("deep", deep).where("deep > 0"))

    # Regions and elements are counted from the head.
    since = [F.col(n) - F.col(f"x.{n}") for n in levels]
    region = sum((F.when(F.col("deep") > k, n).otherwise(0) for k, n in enumerate(since)), F.lit(0))
    begun = units.join(F.broadcast(chosen), "doc").select("doc", *KEY, "opens", "above", "deep", F.col("x.head").alias("head"), F.struct("x.part", "x.block", "x.at").alias("first"), region.alias("region"), F.element_at(F.array(*since), F.col("deep") + 1).alias("element"))
    inner = placed(dealt.join(F.broadcast(cut(begun)), list(KEY)))
    inner = inner.withColumns({"region": F.col("region") + summed(free & (depth < F.col("deep")), own=True), "_index": F.col("element") + summed(free & (depth == F.col("deep")), own=True)})
    rows = F.collect_list(F.struct("part", "block", "at", "joint", "value"))
    texts = inner.where("region = 0").groupBy("doc", "_index").agg(
        text_of(rows).alias("text"), F.bool_or(F.struct("part", "block", "at") == F.col("first")).alias("begins"), F.bool_or(F.col("after") < F.col("deep")).alias("ends"), F.first("head").alias("head")
    )  # a record's pieces
    named = lambda df: df.withColumn("file", F.lit(path)) if joined else df.join(F.broadcast(files.select("doc", "file")), "doc")
    opened = F.coalesce(*(F.when(F.col("head") == k, F.regexp_replace("text", pattern, "")) for k, (_, _, pattern) in enumerate(HEADS)))
    text = F.when(F.col("begins"), opened).otherwise(F.col("text"))
    texts = texts.withColumn("text", text).withColumn("text", F.when(F.col("ends"), F.regexp_replace("text", TAIL, "")).otherwise(F.col("text")))
    parsed = named(texts).where(~F.col("text").rlike(r"^\s*$")).withColumn("raw", F.try_parse_json("text"))
    others = files.join(F.broadcast(chosen.select("doc")), "doc", "left_anti")
    whole = named(numbered(own, others).join(docs, "part").groupBy("doc").agg(text_of(rows).alias("value")))
    single, bad = documents.unwrap(whole)
    records = parsed.where("raw is not null").select("file", F.col("_index").cast("int").alias("_index"), "raw")
    broken = parsed.where("raw is null").select("file", F.lit("not JSON").alias("reason"))
    # A file without a byte has no piece; its name and length are known without reading it.
    none = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).where("length = 0").select(F.col("_metadata.file_path").alias("file"), F.lit("not JSON").alias("reason"))
    return records.unionByName(single), bad.unionByName(broken) if joined else bad.unionByName(broken).unionByName(none)
