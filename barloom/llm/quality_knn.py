"""Quality scores by nearest-neighbour voting among latent-semantic vectors (operator 8).

A text's terms are its words, hashed to 65,536 places and weighed by how few documents have them (counted in
Spark over all documents), the runs of three character kinds (letters, capitals, digits, blanks, single signs and
so on), and how often a word repeats the word before it or the one before that; each group is taken as
root frequencies. A singular value decomposition of labelled training texts gives the latent space.
The labelled vectors are broadcast; every document is compared with all of them by exact cosine, in
blocks, and its `neighbours` nearest vote with weights that fall with the angle. The score is the
weighted share of label 1.

The labelled rows used are at most `reference_rows`, those with the smallest hash of doc_id, so the
broadcast is bounded by that parameter; everything else covers all documents. Scores depend on the
text and on the counts of words alone. Null and empty texts, and texts without usable terms, get the
share of label 1 among the reference rows; so do all texts when no label can be learned from (0.5
without any row). Several labels of one doc_id count as their mean; null labels are left out. A row is
returned for each document row.
"""

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

KINDS = 12
GRAMS = KINDS**3
WORDS = 1 << 16
FORMS = GRAMS + 3
TERMS = FORMS + WORDS
#: Entries of words that are multiplied at once.
AT_ONCE = 1 << 14
CHUNK = 1 << 20
#: How much words count against the forms of a text.
WORD_SHARE = 0.5


def _kinds() -> np.ndarray:
    table = np.full(256, 11, np.int64)
    table[128:] = 5
    for code in range(128):
        c = chr(code)
        kind = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c == " " else 4 if c.isspace() else {".": 6, ",": 7, "!": 8, "|": 9}.get(c)
        table[code] = kind if kind is not None else 10 if c in "#$%&*@^~+=<>" else 11
    return table


KIND_OF = _kinds()


def word_counts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The places that words fall on, in order, and how many do, in small letters."""
    seen = Counter(words)
    at = np.fromiter((xxhash.xxh64_intdigest(w.lower()) % WORDS for w in seen), np.int32, len(seen))
    places, of = np.unique(at, return_inverse=True)
    return places, np.bincount(of, np.fromiter(seen.values(), np.float64, len(seen)), len(places))


def terms(text: str, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root frequencies of the forms (grams and repeats, each group of length one or zero), and of the words by place."""
    raw = text.encode("utf-8")
    counts = np.zeros(GRAMS, np.int64)
    for at in range(0, max(0, len(raw) - 2), CHUNK):
        k = KIND_OF[np.frombuffer(raw, np.uint8)[at : at + CHUNK + 2]]
        counts += np.bincount((k[:-2] * KINDS + k[1:-1]) * KINDS + k[2:], minlength=GRAMS)
    words = raw.split()
    again = sum(map(bytes.__eq__, words[1:], words))
    later = sum(map(bytes.__eq__, words[2:], words))
    repeats = np.array([again, later, max(0, 2 * len(words) - 3 - again - later)], np.float64)
    root = lambda x, share: np.sqrt(x / max(1e-300, x.sum()) * share).astype(np.float32)
    places, said = word_counts(words)
    return np.concatenate([root(counts, 1.0), root(repeats, 1.0)]), places, root(said * rarity[places], WORD_SHARE)


class Features:
    """Terms of several texts: forms as a table, words as the places and weights of each row."""

    def __init__(self, rows: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], sizes: list[int]):
        """Rows of `terms`, one after another, and how many words each has."""
        self.shape, ends = (len(sizes), TERMS), np.cumsum([0, *sizes])
        self.forms = np.zeros((len(sizes), FORMS), np.float32)
        self.places, self.weights = np.zeros(ends[-1], np.int32), np.zeros(ends[-1], np.float32)
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        for k, row in enumerate(rows):
            self.forms[k], self.places[ends[k] : ends[k + 1]], self.weights[ends[k] : ends[k + 1]] = row

    def times(self, q: np.ndarray) -> np.ndarray:
        out, words = self.forms @ q[:FORMS], q[FORMS:]
        _add_rows(out, self.row, self.places, self.weights, words)
        return out

    def turned(self) -> "Features":
        """The entries of the words by place, for turned_times."""
        order = np.argsort(self.places, kind="stable")
        self.by_place = tuple(x[order] for x in (self.places, self.row, self.weights))
        return self

    def turned_times(self, y: np.ndarray) -> np.ndarray:
        out = np.zeros((TERMS, y.shape[1]), np.float32)
        out[:FORMS] = self.forms.T @ y
        _add_rows(out[FORMS:], *self.by_place, y)
        return out


def _add_rows(out: np.ndarray, to: np.ndarray, of: np.ndarray, weights: np.ndarray, table: np.ndarray) -> None:
    """out[to] += weights * table[of], where equal values of `to` stand together."""
    for a in range(0, len(to), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        lead = np.flatnonzero(np.concatenate([[True], to[part][1:] != to[part][:-1]]))
        out[to[part][lead]] += np.add.reduceat(table[of[part]] * weights[part, None], lead, axis=0)


def rarities(docs: DataFrame) -> np.ndarray:
    """For each place of words the logarithm of all documents by those that have one there; sums of so many numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = np.zeros(WORDS, np.int64), 0
        for batch in batches:
            for x in batch.column("text"):
                have[word_counts(x.as_py().encode("utf-8").split())[0]] += 1
            n += batch.num_rows
        at = np.flatnonzero(have)
        yield pa.RecordBatch.from_arrays([pa.array([*at, WORDS], pa.int64()), pa.array([*have[at], n], pa.int64())], names=["at", "n"])

    got = docs.select(text_of().alias("text")).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(WORDS + 1)
    counts[got["at"].to_numpy(np.int64)] = got["n"].to_numpy()
    return np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 0.1


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def orthonormal(q: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns, made from their small table of products, twice for its rounding."""
    for _ in range(2):
        size, turn = np.linalg.eigh((q.T @ q).astype(np.float64))
        there = size > 1e-9 * max(size[-1], 1e-30)
        q = q @ (turn[:, there] / np.sqrt(size[there])).astype(np.float32)
    return q


def leading_directions(x: Features, count: int, rounds: int = 12) -> np.ndarray:
    """The first right singular vectors of x, as columns, by repeated multiplication of a start that is fixed."""
    count = min(count, *x.shape)
    x.turned()
    q = np.random.default_rng(5).standard_normal((x.shape[1], min(count + 12, *x.shape))).astype(np.float32)
    for _ in range(rounds if count else 0):
        q = orthonormal(x.turned_times(x.times(q)))
    if not count:
        return q[:, :0]
    y = x.times(q)
    _, vectors = np.linalg.eigh((y.T @ y).astype(np.float64))
    return (q @ vectors[:, ::-1][:, :count]).astype(np.float32)


class Voters:
    """Labelled vectors in the latent space."""

    def __init__(self, features: Features, labels: np.ndarray, rarity: np.ndarray, dimensions: int, neighbours: int, sharpness: float):
        self.neighbours, self.sharpness, self.rarity = min(neighbours, len(labels)), sharpness, rarity
        self.labels, self.prior = labels.astype(np.float64), float(labels.mean()) if len(labels) else 0.5
        self.basis = leading_directions(features, dimensions)
        self.vectors = _unit(features.times(self.basis))

    def terms(self, texts: list[str]) -> Features:
        made = [terms(x, self.rarity) for x in texts]
        return Features(made, [len(m[1]) for m in made])

    def score(self, features: Features) -> np.ndarray:
        if not self.neighbours:
            return np.full(features.shape[0], self.prior)
        own = _unit(features.times(self.basis))
        near = own @ self.vectors.T
        best = np.argpartition(-near, self.neighbours - 1, axis=1)[:, : self.neighbours]
        weight = np.exp(self.sharpness * (np.take_along_axis(near, best, axis=1).astype(np.float64) - 1))
        share = (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)
        return np.where(np.abs(own).sum(axis=1) > 0, share, self.prior)


def is_held_out(remainder_of: int = 5) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % remainder_of == 0


def _features(docs: DataFrame, rarity: np.ndarray, keep: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [packed(terms(x.as_py(), rarity)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(made, pa.binary())], names=[keep, "terms"])

    return docs.mapInArrow(run, f"{keep} {kind}, terms binary")


#: A term that a text has: a form's number, or FORMS and a word's place, and its weight.
TERM = np.dtype([("at", "<i4"), ("weight", "<f4")])


def packed(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    forms, places, weights = found
    there = np.flatnonzero(forms)
    out = np.empty(len(there) + len(places), TERM)
    out["at"], out["weight"] = np.concatenate([there, FORMS + places]), np.concatenate([forms[there], weights])
    return out.tobytes()


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    held = np.frombuffer(blob, TERM)
    of_form = held["at"] < FORMS
    forms = np.zeros(FORMS, np.float32)
    forms[held["at"][of_form]] = held["weight"][of_form]
    return forms, held["at"][~of_form] - FORMS, held["weight"][~of_form]


def fit_voters(docs: DataFrame, labels: DataFrame, reference_rows: int = 6000, dimensions: int = 48, neighbours: int = 15, sharpness: float = 60.0) -> Voters:
    """Learns from the rows that aren't held out. What comes to the driver is reference_rows vectors at most."""
    rarity = rarities(docs)
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("label")).where(~is_held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(reference_rows)
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").where("text <> ''")
    # repeated rows of a document count once
    rows = _features(texts.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text"), rarity, "label", "double").toPandas()
    labelled = rows["label"].to_numpy()
    blobs = list(rows.pop("terms"))
    held = Features(map(unpacked, blobs), [int((np.frombuffer(b, TERM)["at"] >= FORMS).sum()) for b in blobs])
    del blobs
    return Voters(held, labelled, rarity, dimensions, neighbours, sharpness)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fit) -> DataFrame:
    """All columns of `docs` but those named like the added ones, then held_out, score and predicted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit_voters(docs, labels, **fit))
    held = [c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted", "_text")]

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        voters = shared.value
        for texts in parts:
            out = [voters.score(voters.terms(texts.iloc[k : k + 512])) for k in range(0, len(texts), 512)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    scored = docs.select(*held, is_held_out().alias("held_out"), score(text_of()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
