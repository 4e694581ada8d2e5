"""Benchmark decontamination by pigeonhole edit matching (operator 2).

Texts and test items are compared in small letters with every run of other characters than letters
and digits as one blank, and with a blank at both ends, so layout, punctuation and marks tied to
words make no difference, and an item that stands inside a longer word costs the blanks that are
missing. An item of n characters may occur with up to `error_rate` * n edits. It is cut, blanks
included, into one piece more than that: any such occurrence holds a piece unchanged. One
Aho-Corasick pass over a text finds all pieces; the windows around the hits that an occurrence must
lie in are joined where they touch, and Myers's bit-parallel edit distance is taken at each of
their places. Items without an edit to spend must occur unchanged.

A row is an item's unbroken run of ends at which the distance is within the budget: the least
distance in it, the first end that has this, and the last start that gives it. Runs that touch make
one row.

The automaton is broadcast. Its size is bounded: items come in groups of at most `group_chars`
characters, and each group makes a pass of its own over the documents. Nothing else is collected.

Null texts and items match nothing, nor do items without letters and digits. Items of equal text
each give their rows; so do repeated documents. Other columns of the inputs are not read by the
match; `clean` keeps them.
"""

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

OTHER = re.compile(r"[\W_]+")
SCHEMA = "doc_id long, item_id long, edits int, start long, stop long"


def normal(text: str) -> str:
    return OTHER.sub(" ", text.lower()).strip()


def padded(text: str) -> str:
    """The normal form between blanks; empty if there is none."""
    plain = normal(text)
    return f" {plain} " if plain else ""


def pieces(n: int, budget: int) -> list[tuple[int, int]]:
    """The borders of the pieces of n characters: one more than the edits."""
    cuts = [n * k // (budget + 1) for k in range(budget + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def distances(pattern: str, text: str, most: int, anchored: bool = False) -> list[tuple[int, int]]:
    """(end, edit distance of the pattern to the nearest substring of the text that ends there) where
    that is `most` at most; to the prefix of that length if anchored."""
    n = len(pattern)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, out = full, 0, n, []
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1) & full | anchored
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score <= most:
            out.append((j + 1, score))
    return out


class Items:
    """A group of test items and the automaton of their pieces."""

    def __init__(self, rows: list[tuple[int, str]], error_rate: float):
        self.rows = [(key, text) for key, text in rows if text]
        self.budget = [int(error_rate * (len(text) - 2)) for _, text in self.rows]
        found: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(self.rows):
            for a, b in pieces(len(text), self.budget[number]):
                found.setdefault(text[a:b], []).append((number, b))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """item_id, edits, and the place in the padded text, of each run of ends."""
        if not self.rows or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, places in self.automaton.iter(text):
            for number, stop in places:
                size, budget = len(self.rows[number][1]), self.budget[number]
                lo = end + 1 - stop - budget
                windows.setdefault(number, []).append((max(0, lo), min(len(text), lo + size + 2 * budget)))
        out = []
        for number, own in windows.items():
            item, budget = self.rows[number][1], self.budget[number]
            if not budget:
                out += [(number, 0, lo, hi) for lo, hi in own]
                continue
            joined: list[list[int]] = []
            for lo, hi in sorted(own):
                if joined and lo <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], hi)
                else:
                    joined.append([lo, hi])
            for lo, hi in joined:
                runs: list[tuple[int, int]] = []
                before = -1
                for end, edits in distances(item, text[lo:hi], budget):
                    if end != before + 1:
                        runs.append((end, edits))
                    elif edits < runs[-1][1]:
                        runs[-1] = (end, edits)
                    before = end
                for end, edits in runs:
                    back = text[max(0, lo + end - len(item) - budget) : lo + end][::-1]
                    out.append((number, edits, lo + end - distances(item[::-1], back, edits, anchored=True)[0][0], lo + end))
        return [(self.rows[number][0], *rest) for number, *rest in sorted(set(out))]


def item_groups(items: DataFrame, group_chars: int) -> Iterator[Broadcast]:
    """The items in broadcasts of about so many characters: one, unless the benchmark is larger."""
    sized = items.select("item_id", text_of().alias("text"))
    groups = -(-(sized.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // group_chars)
    for group in range(groups):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == group).collect()
        yield items.sparkSession.sparkContext.broadcast([(r["item_id"], padded(r["text"])) for r in rows])


def matches(docs: DataFrame, items: DataFrame, error_rate: float = 0.05, group_chars: int = 1 << 24) -> DataFrame:
    """doc_id, item_id, edits, and start and stop in the padded text: a row for each run of ends."""
    texts = docs.select("doc_id", text_of().alias("text"))
    passes = []
    for shared in item_groups(items, group_chars):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            group = Items(shared.value, error_rate)
            for batch in batches:
                out = [(key, *m) for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True) for m in group.matches(padded(text.as_py()))]
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "item_id", "edits", "start", "stop"])

        passes.append(texts.mapInArrow(run, SCHEMA))
    return reduce(DataFrame.union, passes) if passes else docs.sparkSession.createDataFrame([], SCHEMA)


def _holds_an_item(shared: Broadcast, error_rate: float):
    @F.pandas_udf("boolean")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        group = Items(shared.value, error_rate)
        for texts in parts:
            yield pd.Series([bool(group.matches(padded(x))) for x in texts], dtype=bool)

    return found(text_of())


def clean(docs: DataFrame, items: DataFrame, error_rate: float = 0.05, group_chars: int = 1 << 24) -> DataFrame:
    """The rows in which no test item occurs, with all their columns; each row is judged by its own text."""
    for shared in item_groups(items, group_chars):
        docs = docs.where(~_holds_an_item(shared, error_rate))
    return docs
