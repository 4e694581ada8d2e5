"""Language-model scores of documents: context mixing against a word baseline (operator 5).

Training documents are those whose crc32 of doc_id as text leaves another remainder by `fold_of`
than `held_out`. Their words are counted in Spark, in blobs by the leading bits of a 64-bit hash.
The byte model of context_mixing takes its Huffman trees from all training bytes and its slot counts
from all training documents. Its first weights are fitted, by Newton steps over sums from all tasks,
while a fifth of those of one further remainder is kept out of the counts; these are counted in
afterwards. Each order's table has a line for every 512 to 1024 training bytes, at least
2**`least_bits` and at most 2**`most_bits`, so what is counted, shuffled and broadcast grows with
the corpus up to that bound (22: 96 MB for three orders), and beyond it contexts share lines.
What else reaches the driver is bounded by `most_common` words.

Baseline: the sum over a text's tokens (its words in small letters, then one end) of
log10((c + 1) / (N + V + 1)), where N + V + 1 is N + 1 * (V + 1). Words that are at least one in
`most_common` of all tokens are broadcast, at most so many; the rest, of which no word is frequent,
are looked up where their counts are, by shuffle. Words are told apart by XXH64, whose collisions
among V words have a chance of V * V / 2**65.

Null texts count as empty; they have the end alone. Rows with equal doc_ids are scored each; they
train alike. A null doc_id trains nothing, and its row has held_out false. With no training rows
the byte model is uniform. All results but the last digits of sums are the same for every layout.
"""

from __future__ import annotations

from collections import Counter as Words
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of
from .context_mixing import Counter, Mixer, Trees, newton_step, predictions

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
END = b"\n"  # no word holds white space
FLUSH_WORDS = 250_000
#: Counts in a blob, and tasks whose blobs are summed before all are.
PART, TASKS = 1 << 16, 256
COUNTS = "part long, salt long, c binary"
BLOBS = "bucket long, h binary, c binary, n long, distinct long"


def groups(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes, so many bytes or one text at a time, with the number of the first."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        held.append(text.as_py().encode())
        size += len(held[-1])
        if size >= most:
            yield first, held
            held, size, first = [], 0, k + 1
    if held:
        yield first, held


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(LOWER).split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def remainder(fold_of: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold_of


def _sum_equal(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def _blob_rows(bucket: list[int], h: list[np.ndarray], c: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([x.tobytes() for x in h], pa.binary()), pa.array([x.tobytes() for x in c], pa.binary()), pa.array([int(x.sum()) for x in c], pa.int64()), pa.array([len(x) for x in c], pa.int64())], names=["bucket", "h", "c", "n", "distinct"])


def byte_pairs(held: bytearray) -> np.ndarray:
    """Counts of 256 times a byte plus the next; each text has a zero before and the end byte behind it."""
    x = np.frombuffer(bytes(held), np.uint8).astype(np.int64)
    return np.bincount(x[:-1] * 256 + x[1:], minlength=1 << 16) if len(x) else np.zeros(1 << 16, np.int64)


def count_words(texts: DataFrame, buckets: int) -> DataFrame:
    """Sorted hashes and counts of the words by bucket; bucket -1 counts pairs of bytes instead."""
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Words = Words()
        held = bytearray()
        octets = np.zeros(1 << 16, np.int64)

        def flush() -> pa.RecordBatch:
            h = np.fromiter(map(word_hash, seen), np.uint64, len(seen))
            h, c = _sum_equal(h, np.fromiter(seen.values(), np.int64, len(seen)))
            bucket = (h >> shift).astype(np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            seen.clear()
            return _blob_rows(bucket[cuts].tolist(), np.split(h, cuts[1:]), np.split(c, cuts[1:]))

        for batch in batches:
            for text in batch.column("text"):
                raw = text.as_py().encode()
                seen.update(words_of(raw))
                seen[END] += 1
                held += b"\0" + raw + b"\xff"
                if len(held) > 1 << 16:
                    octets += byte_pairs(held)
                    held = bytearray()
            if len(seen) > FLUSH_WORDS:
                yield flush()
        if seen:
            yield flush()
            yield _blob_rows([-1], [np.arange(1 << 16, dtype=np.uint64)], [octets + byte_pairs(held)])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for bucket, h, c in zip(batch.column("bucket").to_pylist(), batch.column("h").to_pylist(), batch.column("c").to_pylist(), strict=True):
                own = held.setdefault(bucket, ([], []))
                own[0].append(np.frombuffer(h, np.uint64))
                own[1].append(np.frombuffer(c, np.int64))
                if len(own[0]) >= 64:
                    summed = _sum_equal(np.concatenate(own[0]), np.concatenate(own[1]))
                    held[bucket] = ([summed[0]], [summed[1]])
        for bucket, own in held.items():
            h, c = _sum_equal(np.concatenate(own[0]), np.concatenate(own[1]))
            yield _blob_rows([bucket], [h], [c])

    return texts.mapInArrow(count, BLOBS).repartition("bucket").mapInArrow(total, BLOBS)


def _squeeze(part: np.ndarray) -> bytes:
    top = part.max(initial=0)
    kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<i8"
    return kind.encode() + zstandard.compress(part.astype(kind).tobytes(), 1)


def _loose(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob[3:]), blob[:3].decode()).astype(np.int64)


def _count_row(part: int, salt: int, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([salt], pa.int64()), pa.array([_squeeze(c)], pa.binary())], names=["part", "salt", "c"])


def summed(counts: DataFrame, *within: str) -> DataFrame:
    """One row of counts for each part, and each salt if that is named. Rows come sorted, so that a task
    holds one part at a time, however many parts were dealt to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for part, salt, c in zip(*(batch.column(n) for n in ("part", "salt", "c")), strict=True):
                key, c = (part.as_py(), salt.as_py() if within else 0), _loose(c.as_py())
                if at == key:
                    held += c
                    continue
                if held is not None:
                    yield _count_row(*at, held)
                at, held = key, c
        if held is not None:
            yield _count_row(*at, held)

    return counts.repartition("part", *within).sortWithinPartitions("part", *within).mapInArrow(run, COUNTS)


def count_slots(texts: DataFrame, trees: Trees, orders: tuple[int, ...], bits: int) -> DataFrame:
    """The summed slot counts, a row for each part of each order's table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            for _, raws in groups(batch.column("text")):
                counter = counter or Counter(trees, orders, bits)
                counter.add(raws)
        if counter:
            for part, c in counter.parts(PART, empty=False):
                if c.any():
                    yield _count_row(part, TaskContext.get().partitionId() // TASKS, c)

    return summed(summed(texts.mapInArrow(count, COUNTS), "salt"))


def tables_of(counts: DataFrame, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """The predictions of all orders from summed counts; a byte a slot comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [zstandard.compress(predictions(_loose(c)).tobytes(), 1) for c in batch.column("c").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(made, pa.binary())], names=["part", "p"])

    size = PART // 2
    tables = np.zeros((max(1, (len(orders) * (8 << bits)) // size), min(size, 8 << bits)), np.int8)
    for row in counts.mapInArrow(run, "part long, p binary").toLocalIterator():
        tables[row["part"]] = np.frombuffer(zstandard.decompress(row["p"]), np.int8)
    return tables.reshape(len(orders), -1)


def table_bits(n_bytes: int, least: int, most: int) -> int:
    """The binary logarithm of an order's lines: one for each 512 to 1024 training bytes."""
    return min(most, max(least, (n_bytes >> 9).bit_length() - 1))


def fit_weights(texts: DataFrame, mixer_of, steps: int) -> np.ndarray:
    """Newton steps; each task sends one small array of sums."""
    spark, weights = texts.sparkSession, mixer_of(None).weights
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(weights)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mixer, out = mixer_of(shared.value), 0.0
            for batch in batches:
                for _, raws in groups(batch.column("text")):
                    out = out + mixer.newton_sums(raws)
            if not np.isscalar(out):
                flat = out.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "s"])

        got = texts.mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
        if got:
            weights = newton_step(weights, np.array([r["s"] for r in got]).reshape(*weights.shape, -1))
    return weights


def score_documents(docs: DataFrame, fold_of: int = 7, held_out: int = 2, orders: tuple[int, ...] = (2, 4, 6), least_bits: int = 21, most_bits: int = 22, newton_steps: int = 2, buckets: int = 256, most_common: int = 400_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-scoring")
    texts = docs.select("doc_id", text_of().alias("text"), remainder(fold_of).alias("fold"))
    trained = texts.where(F.col("fold") != held_out)
    weighed = (F.col("fold") == (held_out + 1) % fold_of) & (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0)

    vocabulary = scratch.keep(count_words(trained.select("text"), buckets), "vocabulary")
    octets = np.zeros(1 << 16, np.int64)
    for row in vocabulary.where("bucket = -1").select("c").collect():  # at most one
        octets = np.frombuffer(row["c"], np.int64)
    words = vocabulary.where("bucket >= 0")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c in zip(batch.column("h").to_pylist(), batch.column("c").to_pylist(), strict=True):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                keep = c * most_common >= n
                yield pa.RecordBatch.from_arrays([pa.array([h[keep].tobytes()], pa.binary()), pa.array([c[keep].tobytes()], pa.binary())], names=["h", "c"])

    frequent = words.mapInArrow(common, "h binary, c binary").toPandas()
    hot_h = np.frombuffer(b"".join(frequent["h"]), np.uint64)
    hot_c = np.frombuffer(b"".join(frequent["c"]), np.int64)
    order = np.argsort(hot_h)
    hot = spark.sparkContext.broadcast((hot_h[order], np.log10(hot_c[order] + 1.0)))

    trees = Trees(octets)
    bits = table_bits(int(octets.sum()), least_bits, most_bits)
    counts = scratch.keep(count_slots(trained.where(~weighed).select("text"), trees, orders, bits), "counts")
    tables = spark.sparkContext.broadcast(tables_of(counts, orders, bits))
    weights = fit_weights(trained.where(weighed).select("text"), lambda weights: Mixer(trees, orders, bits, tables.value, weights), newton_steps)
    tables.unpersist()
    # what the weights were fitted on is counted in afterwards
    both = counts.union(count_slots(trained.where(weighed).select("text"), trees, orders, bits))
    shared = spark.sparkContext.broadcast(tables_of(summed(both), orders, bits))
    mixer_of = lambda weights: Mixer(trees, orders, bits, shared.value, weights)
    shift = np.uint64(64 - (buckets - 1).bit_length())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = mixer_of(weights)
        hashes, common_logs = hot.value
        known: dict[bytes, int] = {}  # places of words in the two arrays
        own_h, own_log = np.zeros(0, np.uint64), np.zeros(0)
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            first, rare_h, rare_row = key, [], []
            for k, raws in groups(batch.column("text")):
                nats = mixer.costs(raws)
                split = [words_of(raw) for raw in raws]
                for words in split:
                    words.append(END)
                if len(known) > FLUSH_WORDS:
                    known.clear()
                    own_h, own_log = np.zeros(0, np.uint64), np.zeros(0)
                new = list(set(chain.from_iterable(split)) - known.keys())
                if new:
                    h = np.fromiter(map(word_hash, new), np.uint64, len(new))
                    at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
                    log = np.where(hashes[at] == h, common_logs[at], -1.0) if len(hashes) else np.full(len(new), -1.0)
                    known.update(zip(new, range(len(own_h), len(own_h) + len(new)), strict=True))
                    own_h, own_log = np.concatenate([own_h, h]), np.concatenate([own_log, log])
                m, tokens = len(raws), np.array([len(words) for words in split], np.int64)
                at = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(tokens.sum()))
                row, log = np.repeat(np.arange(m), tokens), own_log[at]
                is_common = log >= 0
                rare_h.append(own_h[at[~is_common]])
                rare_row.append((row[~is_common] + (key - first)).astype(np.int64))
                base = np.bincount(row, np.where(is_common, log, 0.0), m)
                key += m
                yield pa.RecordBatch.from_arrays([pa.array([None] * m, pa.int64()), pa.array(range(key - m, key), pa.int64()), batch.column("doc_id")[k : k + m], batch.column("fold")[k : k + m], pa.array(tokens), pa.array(np.bincount(row, is_common, m).astype(np.int64)), pa.array(base), pa.array(nats), pa.array([len(r) for r in raws], pa.int64()), *[pa.array([None] * m, pa.binary())] * 3], names=NAMES)
            h, row = np.concatenate(rare_h or [own_h[:0]]), np.concatenate(rare_row or [np.zeros(0, np.int64)])
            if len(h):
                order = np.lexsort((row, h))
                h, row = h[order], row[order]
                start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
                times = np.diff(np.append(start, len(h))).astype(np.int32)
                h, row = h[start], row[start].astype(np.int32)
                bucket = (h >> shift).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                split_at = lambda x: pa.array([y.tobytes() for y in np.split(x, cuts[1:])], pa.binary())  # noqa: E731, B023
                m = len(cuts)
                none = lambda t: pa.array([None] * m, t)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array([first] * m, pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64()), none(pa.int64()), split_at(h), split_at(row), split_at(times)], names=NAMES)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by bucket, each bucket's counts before what asks for them."""
        at, counts = (None, None), None
        for batch in batches:
            for bucket, base, h, row, times, c in zip(*(batch.column(x).to_pylist() for x in ("bucket", "key", "h", "row", "times", "c")), strict=True):
                h = np.frombuffer(h, np.uint64)
                if c is not None:
                    at, counts = bucket, (h, np.frombuffer(c, np.int64))
                    continue
                row, times = np.frombuffer(row, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
                have, own = counts if at == bucket else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                place = np.minimum(np.searchsorted(have, h), max(0, len(have) - 1))
                c_of = np.where(have[place] == h, own[place], 0) if len(have) else np.zeros(len(h), np.int64)
                rows, back = np.unique(row, return_inverse=True)
                more = np.bincount(back, times * np.log10(c_of + 1.0), len(rows))
                hits = np.bincount(back, times * (c_of > 0), len(rows)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(base + rows.astype(np.int64)), pa.array(hits), pa.array(more)], names=["key", "more_known", "more"])

    scored = scratch.keep(texts.select("doc_id", "text", "fold").mapInArrow(score, SCORED), "scored")
    asked = scored.where("bucket is not null").select("bucket", "key", "h", "row", "times", F.lit(None).cast("binary").alias("c"))
    counted = words.select("bucket", F.lit(-1).cast("long").alias("key"), "h", F.lit(None).cast("binary").alias("row"), F.lit(None).cast("binary").alias("times"), "c")
    looked = counted.union(asked).repartition("bucket").sortWithinPartitions("bucket", "key").mapInArrow(look_up, "key long, more_known long, more double")
    # whole numbers of 1e-9, so that the order of the sum makes no difference
    looked = looked.groupBy("key").agg(F.sum("more_known").alias("more_known"), (F.sum(F.round(F.col("more") * 1e9).cast("long")) / 1e9).alias("more"))
    out = scored.where("bucket is null").join(looked, "key", "left")
    return out.select(
        "doc_id",
        F.coalesce(F.col("fold") == held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
        (F.col("nats") / float(-np.log(10))).alias("score"),
        (F.col("nats") / float(np.log(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


NAMES = ["bucket", "key", "doc_id", "fold", "n_tokens", "known", "base", "nats", "n_bytes", "h", "row", "times"]
SCORED = "bucket long, key long, doc_id long, fold long, n_tokens long, known long, base double, nats double, n_bytes long, h binary, row binary, times binary"
