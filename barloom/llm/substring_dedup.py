"""Removal of repeated 50-byte strings by suffix arrays (operator 4).

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
doc_id. Strings are judged on the input. Documents with an equal text of which one has a smaller
doc_id go whole, so that each distinct text is worked on once; then:

1. Each string is keyed by the least hash of the `gram`-byte runs in it. Neighbouring strings mostly
   share the key and make one segment. Keys are counted in Spark; only those in more than one
   document are followed further, so what no other document has costs no more than its keys.
2. Segments with shared keys are dealt out by key, so equal strings meet; equal segments of a chunk
   of documents travel once, with their smallest doc_id. Strings of a key in very many documents go
   by a hash of the whole string instead, so no task gets a key's unbounded surroundings.
3. Each share of segments is cut into shards of a few megabytes. A shard's suffix array (refined as
   Larsson and Sadakane do) and common prefixes (Kasai) give its distinct strings in order, each
   with the smallest doc_id; the shards' sorted lists are merged by binary search.
4. The smallest doc_ids go back to the chunks, which turn them into the bytes to remove, and these
   meet the texts.

Nulls count as the empty text. Rows with a null doc_id neither remove nor lose anything. Rows with
equal doc_ids don't remove from one another. Each row gives a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of
from .suffix_arrays import common_prefixes, suffix_array

B1, B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
WORD = 1 << 64
#: Text worked on at once, text of a share of documents and of segments, and bytes under one suffix array.
CHUNK, SHARE, SHARD, TILE = 4 << 20, 16 << 20, 2 << 20, 1 << 16
#: A key in more documents than this is followed by whole strings.
HOT = 2000


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of the `gram` bytes from each position on."""
    width = 0
    powers: dict[int, np.ndarray] = {}
    x = text.astype(np.uint64) + np.uint64(1)
    while True:
        powers[1 << width] = x
        if 2 << width > gram:
            break
        step = 1 << width
        x = x[:-step] * np.uint64(pow(B1, step, WORD)) + x[step:]
        width += 1
    out, at = None, 0
    for size in sorted(powers, reverse=True):
        if gram & size:
            part = powers[size][at:]
            out = part if out is None else out[: len(part)] * np.uint64(pow(B1, size, WORD)) + part
            at += size
    out = out[: len(text) - gram + 1] if len(text) >= gram else out[:0]
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(B2)
    return out ^ (out >> np.uint64(32))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    if len(x) < width:
        return x[:0]
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


class Chunk:
    """Some texts in one buffer, cut into runs of strings that share a key."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        strings = np.maximum(0, sizes - length + 1)
        # by tiles, whose arrays fit the processor's cache
        self.gram, self.grams, least = gram, [], []
        for k in range(0, max(1, len(self.text) - gram + 1), TILE):
            h = gram_hashes(self.text[k : k + TILE + length - 1], gram)
            self.grams.append(h[:TILE])
            least.append(sliding_least(h, length - gram + 1)[:TILE])
        self.grams, least = np.concatenate(self.grams), np.concatenate(least)
        at = np.repeat(self.starts - (np.cumsum(strings) - strings), strings) + np.arange(strings.sum())
        key = least[at]
        cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (np.diff(at) != 1)])) if len(at) else np.zeros(0, np.int64)
        self.first, self.key = at[cut], key[cut]
        self.count = np.diff(np.append(cut, len(at)))
        self.owner = np.searchsorted(self.starts, self.first, side="right") - 1

    def take(self, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The bytes of some stretches, one after another."""
        return self.text[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def hashes(self, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each stretch, from those of the runs that it is laid out with."""
        one, two = sizes.astype(np.uint64), sizes.astype(np.uint64)
        left, at = np.arange(len(first)), np.zeros(len(first), np.int64)
        while len(left):
            h = self.grams[first[left] + np.minimum(at, sizes[left] - self.gram)]
            one[left] = (one[left] ^ h) * np.uint64(B1)
            two[left] = (two[left] * np.uint64(B2) + h) ^ (h >> np.uint64(23))
            go = at + self.gram < sizes[left]
            left, at = left[go], at[go] + self.gram
        return one ^ (one >> np.uint64(31)), two


def chunks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            held.append(row)
            size += len(row[-1] or "")
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _blobs(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.array([y.tobytes() for y in np.split(x, cuts[1:])] if len(cuts) else [], pa.binary())


def _runs_of(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def shared_keys(texts: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """The keys that more than one text has, as (share, keys, hot): by share of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in chunks(batches, ("share", "text")):
            made = Chunk([r[1].encode() for r in rows], length, gram)
            share = np.array([r[0] for r in rows], np.int64)[made.owner]
            order = np.lexsort((made.owner, share, made.key))
            key, share, owner = made.key[order], share[order], made.owner[order]
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (share[1:] != share[:-1])])) if len(key) else np.zeros(0, np.int64)
            new_owner = np.concatenate([[1], (owner[1:] != owner[:-1]).astype(np.int64)]) if len(key) else np.zeros(0, np.int64)
            new_owner[cut] = 1
            docs = np.add.reduceat(new_owner, cut).astype(np.int64) if len(cut) else new_owner
            key, share = key[cut], share[cut]
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = _runs_of(bucket[order])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cuts]), _blobs(key[order], cuts), _blobs(share[order].astype(np.int32), cuts), _blobs(docs[order].astype(np.int32), cuts)], names=["bucket", "keys", "shares", "docs"])

    def total(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        key, share, docs = read("keys", np.uint64), read("shares", np.int32), read("docs", np.int32)
        order = np.lexsort((share, key))
        key, share, docs = key[order], share[order], docs[order].astype(np.int64)
        cut = _runs_of(key)
        sums = np.add.reduceat(docs, cut) if len(cut) else docs
        sums = np.repeat(sums, np.diff(np.append(cut, len(key))))
        keep = sums > 1
        key, share, hot = key[keep], share[keep], sums[keep] > HOT
        order = np.argsort(share, kind="stable")
        key, share, hot = key[order], share[order], hot[order]
        cuts = _runs_of(share)
        return pa.table({"share": pa.array(share[cuts].astype(np.int64)), "keys": _blobs(key, cuts), "hot": _blobs(hot, cuts)})

    counted = texts.select("share", "text").mapInArrow(count, "bucket long, keys binary, shares binary, docs binary")
    return counted.groupBy("bucket").applyInArrow(total, "share long, keys binary, hot binary")


SEGMENTS = "part long, share long, chunk long, segment binary, strings binary, least binary, bytes binary, doc_ids binary, shas binary, used binary, used_doc binary, used_at binary"
NAMES = [x.split()[0] for x in SEGMENTS.split(", ")]


def cut_segments(texts: DataFrame, keys: DataFrame, length: int, gram: int, parts: int) -> DataFrame:
    """For each chunk of texts its distinct segments with shared keys by part, and (part null) where they are used."""

    def segments(rows: list[tuple], share: int, number: int, keys: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        made = Chunk([r[2].encode() for r in rows], length, gram)
        place = np.minimum(np.searchsorted(keys, made.key), len(keys) - 1)
        found = np.flatnonzero(keys[place] == made.key)
        is_hot = hot[place[found]]
        plain, single = found[~is_hot], found[is_hot]
        n = made.count[single]
        first = np.concatenate([made.first[plain], np.repeat(made.first[single] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        strings = np.concatenate([made.count[plain], np.ones(n.sum(), np.int64)])
        owner = np.concatenate([made.owner[plain], np.repeat(made.owner[single], n)])
        if not len(first):
            return
        h, check = made.hashes(first, strings + length - 1)
        key = np.concatenate([made.key[plain], h[len(plain) :]])
        part = (key % np.uint64(parts)).astype(np.int64)
        doc_ids = np.array([r[0] for r in rows], np.int64)
        order = np.lexsort((doc_ids[owner], check, h, part))
        first, strings, owner, part, h, check = first[order], strings[order], owner[order], part[order], h[order], check[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1]) | (part[1:] != part[:-1])])
        lead = np.flatnonzero(new)
        used = np.cumsum(new) - 1
        cuts = _runs_of(part[lead])
        sizes = strings[lead] + length - 1
        ends = np.cumsum(sizes)
        body = made.take(first[lead], sizes)
        bounds = np.append(ends[cuts] - sizes[cuts], len(body))
        m = len(cuts)
        none = pa.array([None] * m, pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(part[lead][cuts]), pa.array([share] * m, pa.int64()), pa.array([number] * m, pa.int64()), _blobs(np.arange(len(lead), dtype=np.int32), cuts), _blobs(strings[lead].astype(np.int32), cuts), _blobs(doc_ids[owner[lead]], cuts), pa.array([body[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()), none, none, none, none, none], names=NAMES
        )
        blank = [pa.array([None], pa.int64())] + [pa.array([x], pa.int64()) for x in (share, number)]
        at = first - made.starts[owner]
        yield pa.RecordBatch.from_arrays([*blank, pa.array([None], pa.binary()), pa.array([strings[lead].astype(np.int32).tobytes()]), *[pa.array([None], pa.binary())] * 2, pa.array([doc_ids.tobytes()]), pa.array(["".join(r[1] for r in rows).encode()]), pa.array([used.astype(np.int32).tobytes()]), pa.array([owner.astype(np.int32).tobytes()]), pa.array([at.astype(np.int64).tobytes()])], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A share's keys come before its texts."""
        share, keys, hot, held, size, number = None, [], [], [], 0, 0
        ready: tuple | None = None
        for batch in batches:
            for own, ks, hs, doc_id, sha, text in zip(*(batch.column(c).to_pylist() for c in ("share", "keys", "hot", "doc_id", "sha", "text")), strict=True):
                if own != share:
                    if held:
                        yield from segments(held, share, number, *ready)
                    share, keys, hot, held, size, number, ready = own, [], [], [], 0, 0, None
                if ks is not None:
                    keys.append(np.frombuffer(ks, np.uint64))
                    hot.append(np.frombuffer(hs, bool))
                    continue
                if ready is None:
                    if not keys:
                        continue
                    all_keys, all_hot = np.concatenate(keys), np.concatenate(hot)
                    order = np.argsort(all_keys)
                    ready, keys, hot = (all_keys[order], all_hot[order]), [], []
                held.append((doc_id, sha, text))
                size += len(text)
                if size >= CHUNK:
                    yield from segments(held, share, number, *ready)
                    held, size, number = [], 0, number + 1
        if held:
            yield from segments(held, share, number, *ready)

    nothing = lambda kind: F.lit(None).cast(kind)
    told = keys.select("share", F.lit(0).alias("kind"), "keys", "hot", nothing("long").alias("doc_id"), nothing("string").alias("sha"), nothing("string").alias("text"))
    asked = texts.select("share", F.lit(1).alias("kind"), nothing("binary").alias("keys"), nothing("binary").alias("hot"), "doc_id", "sha", "text")
    return told.union(asked).repartition("share").sortWithinPartitions("share", "kind").mapInArrow(run, SEGMENTS)


def shard_firsts(text: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings at some positions in order, each one's smallest doc_id, and which each position has."""
    order = suffix_array(text, length)
    common = common_prefixes(text, order, length)
    number = np.full(len(text), -1)
    number[at] = np.arange(len(at))
    place = np.flatnonzero(number[order] >= 0)
    own = number[order[place]]
    least = np.minimum.reduceat(common[: place[-1] + 1], np.concatenate([[0], place[:-1] + 1]))
    new = least < length
    new[0] = True
    lead = np.flatnonzero(new)
    smallest = np.minimum.reduceat(doc[own], lead)
    which = np.empty(len(at), np.int64)
    which[own] = np.cumsum(new) - 1
    strings = np.lib.stride_tricks.sliding_window_view(text, length)[at[own[lead]]]
    return np.ascontiguousarray(strings).view(f"S{length}").ravel(), smallest, which


def merge_shards(lists: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The smallest doc_id over all shards, for each string of each shard's sorted list."""
    out = [d.copy() for _, d in lists]
    for i in range(len(lists)):
        for j in range(i):
            if len(lists[i][0]) and len(lists[j][0]):
                place = np.minimum(np.searchsorted(lists[j][0], lists[i][0]), len(lists[j][0]) - 1)
                same = np.flatnonzero(lists[j][0][place] == lists[i][0])
                both = np.minimum(out[i][same], out[j][place[same]])
                out[i][same], out[j][place[same]] = both, both
    return out


def smallest_documents(segments: DataFrame, length: int) -> DataFrame:
    """For each segment that a chunk sent, the smallest doc_id of each string in it, in runs."""

    def run(table: pa.Table) -> pa.Table:
        share, chunk = table.column("share").to_numpy(), table.column("chunk").to_numpy()
        blobs = {c: table.column(c).to_pylist() for c in ("segment", "strings", "least", "bytes")}
        strings = [np.frombuffer(x, np.int32).astype(np.int64) for x in blobs["strings"]]
        row = np.repeat(np.arange(len(strings)), [len(x) for x in strings])
        segment = np.frombuffer(b"".join(blobs["segment"]), np.int32)
        sent, least = np.concatenate(strings), np.frombuffer(b"".join(blobs["least"]), np.int64)
        # what several chunks have sent is sorted once
        seen: dict[bytes, int] = {}
        which = np.empty(len(sent), np.int64)
        at = 0
        for body, n in zip(blobs.pop("bytes"), strings, strict=True):
            ends = np.cumsum(n + length - 1).tolist()
            which[at : at + len(n)] = [seen.setdefault(body[a:b], len(seen)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            at += len(n)
        count = np.array([len(x) - length + 1 for x in seen], np.int64)
        first_of = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(first_of, which, least)
        least, text = first_of, np.frombuffer(b"".join(seen), np.uint8)
        del seen
        sizes = count + length - 1
        ends = np.cumsum(sizes)
        firsts: list[tuple] = []
        a = 0
        while a < len(count):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] - sizes[a] + SHARD, side="right")))
            base = ends[a] - sizes[a]
            n = count[a:b]
            at = np.repeat(ends[a:b] - sizes[a:b] - base - (np.cumsum(n) - n), n) + np.arange(n.sum())
            firsts.append(shard_firsts(text[base : ends[b - 1]], at, np.repeat(least[a:b], n), length))
            a = b
        merged = merge_shards([f[:2] for f in firsts]) if len(firsts) > 1 else [firsts[0][1]]
        smallest = np.concatenate([d[f[2]] for d, f in zip(merged, firsts, strict=True)])
        of = np.repeat(np.arange(len(count)), count)
        cut = np.flatnonzero(np.concatenate([[True], (smallest[1:] != smallest[:-1]) | (of[1:] != of[:-1])]))
        length_of, value = np.diff(np.append(cut, len(smallest))), smallest[cut]
        # and told to each of them
        n = np.bincount(of[cut], minlength=len(count))[which]
        begin = np.searchsorted(of[cut], which)
        told = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        runs, value, of = length_of[told].astype(np.int32), value[told], np.repeat(np.arange(len(which)), n)
        cuts = _runs_of(row[of])
        return pa.table({"share": share[row[of][cuts]], "chunk": chunk[row[of][cuts]], "segment": _blobs(segment[of], cuts), "runs": _blobs(runs, cuts), "least": _blobs(value, cuts)})

    sent = segments.where("part is not null").select("part", "share", "chunk", "segment", "strings", "least", "bytes")
    return sent.groupBy("part").applyInArrow(run, "share long, chunk long, segment binary, runs binary, least binary")


def spans_to_remove(segments: DataFrame, smallest: DataFrame, length: int) -> DataFrame:
    """doc_id, sha and the stretches to remove (starts and stops) of the texts that lose something."""

    def run(uses: pa.Table, told: pa.Table) -> pa.Table:
        ids, shas, spans = [], [], []
        if uses.num_rows and told.num_rows:
            read = lambda t, name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind)
            strings = read(uses, "strings", np.int32).astype(np.int64)
            segment, runs, least = read(told, "segment", np.int32), read(told, "runs", np.int32), read(told, "least", np.int64)
            order = np.argsort(segment, kind="stable")
            smallest = np.repeat(least[order], runs[order])
            begins = np.cumsum(strings) - strings
            doc_ids, sha = read(uses, "doc_ids", np.int64), uses.column("shas")[0].as_py().decode()
            used, owner, at = read(uses, "used", np.int32), read(uses, "used_doc", np.int32), read(uses, "used_at", np.int64)
            n = strings[used]
            string = np.repeat(begins[used] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            gone = smallest[string] < np.repeat(doc_ids[owner], n)
            start = (np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum()))[gone]
            own = np.repeat(owner, n)[gone]
            order = np.lexsort((start, own))
            start, own = start[order], own[order]
            if len(start):
                new = np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] > start[:-1] + length)])
                lead = np.flatnonzero(new)
                a, b, who = start[lead], start[np.append(lead[1:], len(start)) - 1] + length, own[lead]
                cuts = _runs_of(who)
                ids, shas = doc_ids[who[cuts]].tolist(), [sha[64 * i : 64 * i + 64] for i in who[cuts]]
                spans = [x.tobytes() for x in np.split(np.stack([a, b], axis=1), cuts[1:])]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "sha": pa.array(shas, pa.string()), "spans": pa.array(spans, pa.binary())})

    uses = segments.where("part is null").select("share", "chunk", "strings", "doc_ids", "shas", "used", "used_doc", "used_at")
    return uses.groupBy("share", "chunk").cogroup(smallest.groupBy("share", "chunk")).applyInArrow(run, "doc_id long, sha string, spans binary")


def remove_repeats(docs: DataFrame, length: int = 50, gram: int = 20) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed, n_spans."""
    out = "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"
    return _removals(docs, length, gram, lambda kept: kept, out, pa.binary())


def digest_repeats(docs: DataFrame, length: int = 50, gram: int = 20) -> DataFrame:
    """remove_repeats with the SHA-256 of what remains in its place, kept_sha256."""
    out = "doc_id long, kept_sha256 string, n_bytes long, n_removed long, n_spans long"
    return _removals(docs, length, gram, lambda kept: hashlib.sha256(kept).hexdigest(), out, pa.string())


def _removals(docs: DataFrame, length: int, gram: int, shown, schema: str, kind: pa.DataType) -> DataFrame:
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring-dedup")
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("sha", F.sha2("text", 256))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shares = max(1, -(-size // SHARE))
    leaders = scratch.keep(texts.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id")), "leaders")
    # rows of one document and text are worked on once
    first = texts.join(leaders, ["sha", "doc_id"], "left_semi").where(F.octet_length("text") >= length).withColumn("share", F.pmod(F.xxhash64("sha"), F.lit(shares)))
    first = scratch.keep(first, "first")
    keys = scratch.keep(shared_keys(first, length, gram, max(64, 2 * shares)), "keys")
    segments = scratch.keep(cut_segments(first, keys, length, gram, max(64, 8 * shares)), "segments")
    for name in ("keys", "first"):
        scratch.drop(name)
    smallest = scratch.keep(smallest_documents(segments, length), "smallest")
    spans = scratch.keep(spans_to_remove(segments, smallest, length), "spans")
    for name in ("segments", "smallest"):
        scratch.drop(name)
    leading = leaders.join(spans, ["sha", "doc_id"], "left").withColumn("leads", F.lit(True))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, leads, blob in zip(*(batch.column(c) for c in ("doc_id", "text", "leads", "spans")), strict=True):
                raw = text.as_py().encode()
                if blob.is_valid:
                    spans = np.frombuffer(blob.as_py(), np.int64).reshape(-1, 2).tolist()
                elif leads.is_valid or doc_id.as_py() is None or len(raw) < length:
                    spans = []
                else:
                    spans = [[0, len(raw)]]
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                rest = b"".join(kept)
                rows.append((doc_id.as_py(), shown(rest), len(raw), len(raw) - len(rest), len(spans)))
            types = (pa.int64(), kind, pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[x.split()[0] for x in schema.split(", ")])

    return texts.join(leading, ["sha", "doc_id"], "left").select("doc_id", "text", "leads", "spans").mapInArrow(apply, schema)
