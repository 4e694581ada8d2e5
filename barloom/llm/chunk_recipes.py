"""Exact duplicates by content-defined chunk recipes (operator 11, DataFrame functions only).

A text is normalised (each run of blank, tab, line feed, vertical tab, form feed and carriage return
becomes one blank) and cut into chunks where its own bytes say so: three bytes of three classes in a
row end a chunk of LEAST to MOST bytes. An insertion therefore moves the borders near it alone, and
documents share the chunks of their common passages. The identifier of a chunk is a pair of hashes.
Identifiers are verified: the distinct chunks of all documents meet by hash and content, each chunk
going out at most once from a task that has it many times, and a pair of hashes that more than one
content has is told apart by the order of the contents. A document is then its recipe, the ordered
list of its chunks' identifiers, and only recipes are grouped and compared: a long document is never
moved as a whole, and its content at most once.

Rows: a null text counts as empty, and all empty texts are equal; a text of blanks alone is one blank,
which differs from the empty text. Of equal texts the row with the smallest doc_id stays, null doc_ids
last; if several rows have that doc_id, exactly one of them. Repeated rows count as rows of their
group. An empty table has an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of

#: Bytes of a chunk; after LEAST of them three bytes of the classes end it, on average after some hundreds more.
LEAST, MOST = 512, 8192
#: A run that is not one blank already.
BLANKS = r"[ \t-\r]{2,}|[\t-\r]"


def _byte_class(turn: int) -> str:
    """Every eighth byte value, so that digits, letters and the bytes of other scripts all have their share."""
    return "[" + "".join(f"\\x{b:02x}" for b in range((3 * turn + 2) % 8, 256, 8)) + "]"


#: Texts as their UTF-8 bytes, one letter a byte. What no border ends is cut at MOST, or is the last chunk.
CHUNK = rf"(?s).{{{LEAST},{MOST - 3}}}?{_byte_class(1)}{_byte_class(2)}{_byte_class(3)}|.{{1,{MOST}}}"


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(text_of(column), BLANKS, " ")


def chunks(text: Column) -> Column:
    """The chunks of a text, whose bytes they hold as letters; none of an empty text."""
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0))


def fingerprint(chunk: Column) -> Column:
    """128 bits: two hashes of one content with different seeds."""
    return F.struct(F.xxhash64(chunk).alias("a"), F.xxhash64(F.lit(1), chunk).alias("b"))


def _distinct_chunks(docs: DataFrame, mark: Callable[[Column], Column]) -> DataFrame:
    """(id, chunk), each content once."""
    pieces = docs.select(F.explode(chunks(normalised())).alias("chunk"))
    return pieces.select(mark(F.col("chunk")).alias("id"), "chunk").distinct()


def recipes(docs: DataFrame, scratch: Scratch, mark: Callable[[Column], Column] = fingerprint) -> DataFrame:
    """doc_id, row (a number of the row), recipe, text_sha256 of every document, written once."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), normalised().alias("text"))
    plain = rows.select("doc_id", "row", F.transform(chunks(F.col("text")), lambda c: F.struct(mark(c).alias("id"), F.lit(0).alias("turn"))).alias("recipe"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
    several = scratch.keep(_distinct_chunks(docs, mark).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "several")
    if several.isEmpty():
        return scratch.keep(plain, "recipes")
    # the exact way for hashes that several contents share: numbered by content, and looked up by it
    found = _distinct_chunks(docs, mark).join(several, "id", "left_semi")
    turns = found.select("id", "chunk", F.row_number().over(Window.partitionBy("id").orderBy("chunk")).alias("turn"))
    kept = scratch.keep(rows.select("doc_id", "row", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks")), "chunked")
    pieces = kept.select("row", F.posexplode("chunks").alias("at", "chunk")).withColumn("id", mark(F.col("chunk")))
    named = pieces.join(turns, ["id", "chunk"], "left").select("row", "at", F.struct("id", F.coalesce("turn", F.lit(0)).alias("turn")).alias("part"))
    lists = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
    made = kept.select("doc_id", "row", "text_sha256").join(lists, "row", "left")
    return scratch.keep(made.select("doc_id", "row", F.coalesce(F.col("parts.part"), F.array().cast(plain.schema["recipe"].dataType)).alias("recipe"), "text_sha256"), "recipes")


def copies(docs: DataFrame, mark: Callable[[Column], Column] = fingerprint) -> DataFrame:
    """A row a document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    A group's size and its first row are an aggregation, whose partial rows take a hot group together
    before the shuffle. It is written, so that it meets the documents in a join between two shuffles,
    whose hot recipes adaptive execution can split.
    """
    scratch = Scratch(docs.sparkSession, "recipes")
    made = recipes(docs, scratch, mark)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = scratch.keep(made.groupBy("recipe").agg(first.alias("first"), F.count("*").alias("group_size")), "groups")
    return made.join(groups, "recipe").select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))
