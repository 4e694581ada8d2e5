"""How far the sources of a language are from each other, by term counts (operator 12).

Terms are runs of ASCII letters, lower-cased, and of all characters beyond ASCII. A language keeps the
terms that at least `least_documents` of its documents hold, V of them. A source's share of a term is
p = 1 + floor(1e9 (count + 2) / (N + 2 V)), N its counts of kept terms; the divergence of two shares is
floor((p - q)^2 / (p + q)), and that of two sources the sum over all kept terms.

Baseline and corrections: if no term occurred, a pair of sources would have V times the divergence of
two zero counts. What an inverted index of the counts adds to that are the terms that occur:

- a term in one of the two, whatever it is: the correction depends on its count alone, so it is taken
  once for each distinct count of a source (times how many terms have it) and each other source;
- a term in both: its postings, met by term, give what both corrections above get wrong together.

Terms that neither has are never touched. All is integer arithmetic: shares by long division in steps
of a thousand, which holds up to N + 2 V = 9e15.

Rows: null text, lang and source count as empty; every (lang, source) that occurs has its pairs, with
or without terms; a language without kept terms has pairs of value 0 and no terms; a source that is
alone in its language has no pairs. Repeated rows are documents like others. Ranks go by value,
then by the bytes of the item. An empty table has an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of

TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Terms that a task holds before it passes them on, and what a document adds to a term's number, whose rest is
#: its occurrences.
HELD, DOCUMENT = 400_000, 1 << 40
#: Parts of one language's pairs.
SALTS = 32
UNIT = 1_000_000_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a partition, in parts; the empty term stands for the group itself."""
    held: dict[tuple[str, str], dict[bytes, int]] = {}  # occurrences, and DOCUMENT for each document
    size = 0

    def out() -> pa.RecordBatch:
        terms = [t for own in held.values() for t in own]
        values = np.fromiter((v for own in held.values() for v in own.values()), np.int64, len(terms))
        of = np.repeat(np.arange(len(held), dtype=np.int32), [len(own) for own in held.values()])
        names = [pa.DictionaryArray.from_arrays(pa.array(of), pa.array([k[i] for k in held], pa.string())).cast(pa.string()) for i in (0, 1)]
        held.clear()
        return pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(values % DOCUMENT), pa.array(values // DOCUMENT)], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = held.setdefault((lang, source), {})
            size -= len(own)
            own[b""] = own.get(b"", 0) + DOCUMENT
            for term, n in Counter(TERM.findall(text.encode("utf-8").lower())).items():  # of bytes, so A-Z alone
                own[term] = own.get(term, 0) + n + DOCUMENT
            size += len(own)
            if size > HELD:
                yield out()
                size = 0
    if held:
        yield out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents); the empty term has 0 and the group's documents."""
    whole = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of("text").alias("text"))
    parts = whole.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, whole: Column) -> Column:
    """1 + floor(1e9 (n + 2) / whole), for n + 2 up to `whole`."""
    out, rest = F.lit(0).cast("long"), n + 2
    for _ in range(3):
        out, rest = out * 1000 + _div(rest * 1000, whole), (rest * 1000) % whole
    return out + 1


def _div(a: Column, b: Column) -> Column:
    """Whole division of longs that are not negative."""
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def index(docs: DataFrame, scratch: Scratch, least_documents: int) -> tuple[DataFrame, DataFrame]:
    """Postings (lang, term, source, n, p, zero, q) of kept terms with a count, and groups (lang, source, whole,
    terms, zero): `whole` is N + 2 V, `zero` the share of a zero count, q the language's share. Both are written."""
    counts = scratch.keep(term_counts(docs), "counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_documents)
    found = scratch.keep(counts.where("term <> ''").join(kept.select("lang", "term", "lang_n"), ["lang", "term"]), "found")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_n"))
    sizes = found.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    terms = F.coalesce("terms", F.lit(0).cast("long"))
    whole = F.coalesce("n", F.lit(0).cast("long")) + 2 * terms
    zero = F.when(terms > 0, share(F.lit(0).cast("long"), whole))
    groups = scratch.keep(groups.select("lang", "source", whole.alias("whole"), (F.coalesce("lang_n", F.lit(0).cast("long")) + 2 * terms).alias("lang_whole"), terms.alias("terms"), zero.alias("zero")), "groups")
    near = found.join(groups, ["lang", "source"])
    postings = near.select("lang", "term", "source", "n", share(F.col("n"), F.col("whole")).alias("p"), "zero", share(F.col("lang_n"), F.col("lang_whole")).alias("q"))
    return scratch.keep(postings, "postings"), groups


def pairs(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each source and each other one of its language."""
    salted = F.pmod(F.xxhash64("source"), F.lit(SALTS))
    mine = groups.select("lang", "source", "terms", "zero", salted.alias("salt"))
    every = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"), F.explode(F.array([F.lit(i).cast("long") for i in range(SALTS)])).alias("salt"))
    level = F.coalesce(F.col("terms") * divergence(F.col("zero"), F.col("other")), F.lit(0).cast("long"))
    meeting = mine.join(every, ["lang", "salt"]).where("source <> item")
    baseline = meeting.select("lang", "source", "item", level.alias("value"))
    # what occurs in one, against a zero count of the other: by distinct counts
    levels = postings.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("terms")).withColumn("salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)))
    alone = levels.join(every, ["lang", "salt"]).where("source <> item")
    change = F.col("terms") * (divergence(F.col("p"), F.col("other")) - divergence(F.col("zero"), F.col("other")))
    once = alone.groupBy("lang", "source", "item").agg(F.sum(change).alias("value"))
    one_sided = once.union(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    # what occurs in both
    other = postings.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("other_p"), F.col("zero").alias("other"))
    both = postings.select("lang", "term", "source", "p", "zero").join(other, ["lang", "term"]).where("source < item")
    joint = divergence(F.col("p"), F.col("other_p")) - divergence(F.col("p"), F.col("other")) - divergence(F.col("zero"), F.col("other_p")) + divergence(F.col("zero"), F.col("other"))
    half = both.groupBy("lang", "source", "item").agg(F.sum(joint).alias("value"))
    shared = half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    return baseline.union(one_sided).union(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_documents: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: for each source all others of its language by divergence ('pair'),
    and the `top` terms that it has more of than its language, by their divergence ('term')."""
    postings, groups = index(docs, Scratch(docs.sparkSession, "divergence"), least_documents)
    over = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return _ranked(pairs(postings, groups), "pair").union(_ranked(over, "term").where(F.col("rank") <= top))
