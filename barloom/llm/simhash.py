"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 1).

A fingerprint bit is set if more than half of a text's word shingles, counted with repeats, have
it set in their 64-bit hash. Two fingerprints of `radius` or fewer differing bits share a variant
that differs from each in at most half of that. So every distinct fingerprint emits all variants
within half the radius, variants meet in a shuffle, and fingerprints of one variant are linked.

The shuffle deals variants out by their leading bits and sends a fingerprint once to each leading
part that its variants have, not once a variant: the receiving task, which gets all fingerprints
with a variant in its part, makes the rest of the variants itself. For 10 leading bits these are 56
numbers of 8 bytes instead of 2081 rows, and a task holds about a twentieth of the fingerprints;
the number of leading bits grows with their count. What meets at a variant is linked to the
smallest of it, as all of it is within the radius of one another: links grow with the variants and
not with the square of a group, and no component changes.

A text without words has fingerprint zero and is linked like any other; null counts as the empty
text. Rows with equal doc_ids each give a row. Other columns of the input are not read.

`similar_groups` and `one_of_each` ask for a Jaccard similarity instead of a number of bits: they
verify what ball hashing finds on the whole texts, and then find the similar sets whose fingerprints
are further apart by keys that such sets share, so that no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of
from .components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at once, variants that are sorted at once, and fingerprints that a task shall hold.
SHINGLES, VARIANTS, HELD = 1 << 15, 1 << 20, 1 << 20
#: Slots by whose counts shingles are ordered, parts of these, bytes of a set's parities, members of a key that are paired by shifts.
SLOTS, SLOT_PARTS, PARITY, SHIFTED = 1 << 20, 64, 64, 32
#: Keys that a task shall hold, rows that are taken apart at once, and members that all others of a key are compared with in the first round and times more in each further one.
KEYS, SLICE, PIVOTS, MORE = 1 << 18, 1024, 4, 16


def shingle_hashes(text: str, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `size` words joined by a space; of the whole sequence if it is shorter."""
    words = text.encode("utf-8").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), SHINGLES):
        bits = np.unpackbits(hashes[k : k + SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id and its text's fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((majority(shingle_hashes(x.as_py(), words)) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, fp long")


def ball(positions: list[int], flips: int) -> np.ndarray:
    """The masks that flip at most so many of the bits."""
    return np.array([sum(1 << p for p in chosen) for n in range(flips + 1) for chosen in combinations(positions, n)], np.uint64)


def leading_bits(count: int, bits: int, flips: int) -> int:
    """The fewest leading bits, 10 or more, at which a part gets no more than HELD fingerprints."""
    for k in range(min(10, bits), min(24, bits)):
        if count * len(ball(list(range(k)), flips)) <= HELD << k:
            return k
    return min(24, bits)


def _meet(keys: np.ndarray, owners: np.ndarray, flips: np.ndarray, low: int) -> Iterator[np.ndarray]:
    """Links among owners of keys whose `low` last bits may still change in so many places each."""
    if len(keys) < 2:
        return
    sizes = np.array([len(ball(list(range(low)), n)) for n in range(int(flips.max()) + 1)])[flips]
    if sizes.sum() > VARIANTS and low > 1:  # by one bit more: a key goes to its own side, and for one flip to the other
        bit = (keys >> np.uint64(low - 1)) & np.uint64(1)
        for side in (0, 1):
            cost = (bit != side).astype(flips.dtype)
            stay = flips >= cost
            yield from _meet(keys[stay], owners[stay], (flips - cost)[stay], low - 1) if stay.any() else ()
        return
    tail = np.uint64((1 << low) - 1)
    variants, of = [], []
    for n in np.unique(flips):
        own = flips == n
        masks = ball(list(range(low)), int(n))
        variants.append(((keys[own] & tail)[:, None] ^ masks[None, :]).ravel())
        of.append(np.repeat(owners[own], len(masks)))
    variant, owner = np.concatenate(variants), np.concatenate(of)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    same = np.concatenate([[False], variant[1:] == variant[:-1]])
    if not same.any():
        return
    firsts = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(owner, firsts), np.diff(np.append(firsts, len(owner))))
    link = np.stack([least, owner], axis=1)[least != owner]
    yield np.unique(link, axis=0)


def links(prints: DataFrame, radius: int = 4, bits: int = 64) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that join all within `radius` bits of one another."""
    flips = radius // 2
    if radius % 2:
        raise ValueError("both halves of the radius need as many flips")
    top = leading_bits(prints.count(), bits, flips)
    low = bits - top

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = ball(list(range(top)), flips)
        for batch in batches:
            keys = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            part = ((keys >> np.uint64(low))[:, None] ^ masks[None, :]).ravel().astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, sent = part[order], np.repeat(keys, len(masks))[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            blobs = [x.tobytes() for x in np.split(sent, cuts[1:])] if len(cuts) else []
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(blobs, pa.binary())], names=["part", "fps"])

    def meet(table: pa.Table) -> pa.Table:
        part = np.uint64(table.column("part")[0].as_py())
        keys = np.unique(np.frombuffer(b"".join(table.column("fps").to_pylist()), np.uint64))
        left = flips - np.bitwise_count((keys >> np.uint64(low)) ^ part).astype(np.int64)
        found = list(_meet(keys, keys, left, low))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius].view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return prints.select("fp").mapInArrow(emit, "part long, fps binary").groupBy("part").applyInArrow(meet, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id that links reach)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, words), "prints")
    nodes = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, radius), scratch)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = scratch.keep(rooted.join(smallest, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def slot_levels(docs: DataFrame, words: int) -> np.ndarray:
    """For each of SLOTS leading parts of a hash the binary logarithm of the shingles counted there, once a text."""
    size = SLOTS // SLOT_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for x in batch.column("text"):
                slots, n = np.unique(np.unique(shingle_hashes(x.as_py(), words)) >> np.uint64(44), return_counts=True)
                counts[slots.astype(np.int64)] += n
        if counts.any():
            blobs = [zstandard.compress(x.tobytes(), 1) for x in np.minimum(counts, (1 << 32) - 1).astype(np.uint32).reshape(SLOT_PARTS, size)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOT_PARTS), pa.int64()), pa.array(blobs, pa.binary())], names=["part", "c"])

    def total(table: pa.Table) -> pa.Table:
        counts = np.zeros(size, np.int64)
        for blob in table.column("c"):
            counts += np.frombuffer(zstandard.decompress(blob.as_py()), np.uint32)
        return pa.table({"part": table.column("part")[:1], "c": pa.array([np.log2(counts + 1).astype(np.uint8).tobytes()], pa.binary())})

    levels = np.zeros((SLOT_PARTS, size), np.uint8)
    for row in docs.select(text_of().alias("text")).mapInArrow(count, "part long, c binary").groupBy("part").applyInArrow(total, "part long, c binary").collect():
        levels[row["part"]] = np.frombuffer(row["c"], np.uint8)
    return levels.ravel()


def prefix(hashes: np.ndarray, levels: np.ndarray, similarity: float) -> np.ndarray:
    """The first of a set's hashes in an order of all hashes, rare ones first: two similar sets share one of these."""
    least = int(np.ceil(similarity * len(hashes) - 1e-9))
    order = np.lexsort((hashes, levels[(hashes >> np.uint64(44)).astype(np.int64)]))
    return hashes[order[: len(hashes) - least + 1]] if len(hashes) else hashes


def parities(hashes: np.ndarray) -> bytes:
    """Whether an odd number of the hashes falls on each bit: two sets differ in as many elements or more."""
    at = (hashes & np.uint64(8 * PARITY - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=8 * PARITY) & 1, bitorder="little").tobytes()


def sets_of(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """A row each: doc_id, a hash of the text (h), one of the set of its shingles (id), and the set's
    fingerprint, prefix, parities and size."""
    levels = docs.sparkSession.sparkContext.broadcast(slot_levels(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py(), words)) for x in batch.column("text")]
            ids = np.fromiter((xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            prints = np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64)
            blobs = [[prefix(s, levels.value, similarity).tobytes() for s in sets], [parities(s) for s in sets]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(ids), pa.array(prints), *(pa.array(c, pa.binary()) for c in blobs), pa.array(list(map(len, sets)), pa.int64())], names=["doc_id", "h", "id", "fp", "keys", "parity", "n"])

    return docs.select("doc_id", text_hash().alias("h"), text_of().alias("text")).mapInArrow(run, "doc_id long, h long, id long, fp long, keys binary, parity binary, n long")


def text_hash() -> F.Column:
    return F.xxhash64(text_of())


def row_key(doc_id: F.Column | str, h: F.Column | str) -> F.Column:
    return F.coalesce(doc_id, h)


#: What a task sends of each key.
OWN = np.dtype([("key", "<i8"), ("id", "<i8"), ("n", "<i4"), ("place", "<i4")])


def shared_keys(nodes: DataFrame) -> DataFrame:
    """Key, id, set size and place in the prefix, of the keys that more than one node has."""
    parts = max(1, -(-int(nodes.agg(F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()[0]) // 8 // KEYS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            blobs = batch.column("keys").to_pylist()
            m = np.array([len(x) // 8 for x in blobs], np.int64)
            own = np.empty(m.sum(), OWN)
            own["key"] = np.frombuffer(b"".join(blobs), np.int64)
            own["place"] = np.arange(len(own)) - np.repeat(np.cumsum(m) - m, m)
            for c in ("id", "n"):
                own[c] = np.repeat(batch.column(c).to_numpy(zero_copy_only=False), m)
            part = (own["key"].view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(part[order][cuts]), pa.array([x.tobytes() for x in np.split(own[order], cuts[1:])] if len(cuts) else [], pa.binary())], names=["part", "own"])

    def shared(table: pa.Table) -> pa.Table:
        own = np.frombuffer(b"".join(table.column("own").to_pylist()), OWN)
        own = own[np.argsort(own["key"], kind="stable")]
        firsts = np.flatnonzero(np.diff(own["key"], prepend=own["key"][0] ^ 1))
        sizes = np.diff(np.append(firsts, len(own)))
        own = own[np.repeat(sizes > 1, sizes)]  # a node has a key once
        return pa.table({c: own[c].astype(np.int64) for c in OWN.names})

    return nodes.select("id", "n", "keys").mapInArrow(emit, "part long, own binary").groupBy("part").applyInArrow(shared, "key long, id long, n long, place long")


def compared(members: DataFrame, similarity: float, pivots: int) -> DataFrame:
    """Pairs (a, b) of different roots that share a key and can be similar; (key, null) for keys with more to compare.

    Of a key's members so many are compared with all others: those outside the largest root, which
    leaves nothing, or else those nearest to the majority of the members' parities.
    """

    def meet(table: pa.Table) -> pa.Table:
        key, ids, roots, n, place = (table.column(c).to_numpy() for c in ("key", "id", "root", "n", "place"))
        order = np.lexsort((ids, key))
        key, ids, roots, n, place = (x[order] for x in (key, ids, roots, n, place))
        bits = np.frombuffer(b"".join(table.column("parity").to_pylist()), np.uint64).reshape(len(key), -1)[order]
        firsts = np.flatnonzero(np.diff(key, prepend=key[0] ^ 1))
        sizes = np.diff(np.append(firsts, len(key)))
        out, left = [np.zeros((0, 2), np.int64)], []

        def add(i: np.ndarray, j: np.ndarray) -> None:
            go = np.flatnonzero(roots[i] != roots[j])
            i, j = i[go], j[go]
            least = similarity / (1 + similarity) * (n[i] + n[j]) - 1e-6  # of common elements
            go = np.flatnonzero(np.minimum(n[i] - place[i], n[j] - place[j]) >= least)
            i, j, least = i[go], j[go], least[go]
            go = np.flatnonzero(np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1) <= n[i] + n[j] - 2 * least)
            if len(go):
                two = np.stack([ids[i[go]], ids[j[go]]], axis=1)
                two.sort(axis=1)
                out.append(two)

        small = np.flatnonzero(np.repeat(sizes <= SHIFTED, sizes))
        for d in range(1, SHIFTED):
            small = small[small + d < len(key)]
            small = small[key[small] == key[small + d]]
            if not len(small):
                break
            add(small, small + d)
        for a, m in zip(firsts[sizes > SHIFTED].tolist(), sizes[sizes > SHIFTED].tolist(), strict=True):
            own = np.arange(a, a + m)
            kinds, count = np.unique(roots[own], return_counts=True)
            chosen = own[roots[own] != kinds[np.argmax(count)]]
            if len(chosen) > pivots:
                spread = np.unpackbits(bits[own].view(np.uint8), axis=1, bitorder="little")
                middle = np.packbits(2 * spread.sum(axis=0, dtype=np.int64) > m, bitorder="little").view(np.uint64)
                chosen = own[np.argsort(np.bitwise_count(bits[own] ^ middle).sum(axis=1), kind="stable")[:pivots]]
                left.append(key[a])
            for i in chosen.tolist():
                add(np.full(m, i), own)
            if len(out) > 256:
                out[:] = [np.unique(np.concatenate(out), axis=0)]
        both = np.unique(np.concatenate(out), axis=0)
        both = pa.table({"a": both[:, 0], "b": both[:, 1]})
        return pa.concat_tables([both, pa.table({"a": pa.array(left, pa.int64()), "b": pa.array([None] * len(left), pa.int64())})])

    parts = max(1, -(-members.count() // (KEYS // 4)))
    return members.groupBy(F.pmod("key", F.lit(parts))).applyInArrow(meet, "a long, b long").distinct()


def print_pairs(nodes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes by ball hashing of their fingerprints: each with one that is near, no more than there are nodes."""
    least = scratch.keep(nodes.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    equal = nodes.select("fp", "id").join(least, "fp").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"))
    near = links(least, radius).groupBy("b").agg(F.min("a").alias("a"))
    node = lambda side: least.select(F.col("fp").alias(side), F.col("least").alias(f"node_{side}"))
    near = near.join(node("a"), "a").join(node("b"), "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return equal.union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_sets(docs: DataFrame, words: int, similarity: float, radius: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, text hash and set (id) of each row; and for each set a row that stands for it and the root of its group."""
    sets = scratch.keep(sets_of(docs, words, similarity), "sets")
    nodes = scratch.keep(sets.groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "h")).alias("row"), *(F.min(c).alias(c) for c in ("fp", "keys", "parity", "n"))), "nodes")
    known = scratch.keep(sets.select("doc_id", "h", "id"), "rows")
    scratch.drop("sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            good = []
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if last[0] != a:
                    last = (a, np.unique(shingle_hashes(x.as_py(), words)))
                one, other = last[1], np.unique(shingle_hashes(y.as_py(), words))
                both = len(np.intersect1d(one, other, assume_unique=True))
                good.append(both >= similarity * (len(one) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def verified(pairs: DataFrame, turn: int) -> DataFrame:
        """Those whose whole texts are similar."""
        wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = nodes.join(wanted, "id", "left_semi").select("id", row_key("row.doc_id", "row.h").alias("k"), F.col("row.h").alias("h"))
        wanted = scratch.keep(wanted, f"wanted-{turn}")
        if turn == 0:  # most of those that have a similar one; later ones are few, and the texts stay where they are
            wanted = wanted.hint("merge")
        rows = docs.select(row_key("doc_id", text_hash()).alias("k"), text_hash().alias("h"), text_of().alias("text"))
        texts = scratch.keep(rows.join(wanted, ["k", "h"]).groupBy("k", "h", "id").agg(F.min("text").alias("text")), f"texts-{turn}")
        text = lambda side: texts.select(F.col("id").alias(side), F.col("text").alias(f"text_{side}"))
        found = scratch.keep(pairs.join(text("a"), "a").join(text("b"), "b").mapInArrow(verify, "a long, b long"), f"links-{turn}")
        scratch.drop(f"texts-{turn}")
        return found

    members = scratch.keep(shared_keys(nodes).withColumn("root", F.col("id")), "members-0")
    pairs, left, found, tested, turn, pivots = print_pairs(nodes, radius, scratch), None, None, None, 0, PIVOTS
    while True:
        met = scratch.keep(compared(members.join(nodes.select("id", "parity"), "id"), similarity, pivots), f"met-{turn}")
        more = met.where("b is not null")
        pairs = scratch.keep(more.union(pairs).distinct() if tested is None else more.join(tested, ["a", "b"], "left_anti"), f"pairs-{turn}")
        tested = pairs if tested is None else tested.union(pairs)
        left = scratch.keep(met.where("b is null").select(F.col("a").alias("key")), f"left-{turn}")
        scratch.drop(f"met-{turn}")
        if turn == 0 or pairs.head(1):
            found = verified(pairs, turn) if found is None else found.union(verified(pairs, turn))
            roots = scratch.keep(components(found, scratch, f"components-{turn}"), f"roots-{turn}").withColumnRenamed("node", "id")
        if not left.head(1):
            break
        turn, pivots = turn + 1, pivots * MORE  # only the keys that are left, with the roots as they are now
        again = members.join(left, "key", "left_semi").drop("root").join(roots, "id", "left")
        again = scratch.keep(again.select("key", "id", F.coalesce("root", "id").alias("root"), "n", "place"), f"members-{turn}")
        scratch.drop(f"members-{turn - 1}")
        members = again
    rooted = scratch.keep(nodes.join(roots, "id", "left").select("id", "row", F.coalesce("root", "id").alias("root")), "rooted")
    scratch.only("rows", "rooted")
    return known, rooted


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """doc_id and the smallest doc_id of its group: texts whose sets of word shingles have a Jaccard
    similarity of `similarity` or more, directly or over others.

    Near fingerprints of the sets, found by ball hashing, are verified on the whole texts. Two sets of
    the similarity asked for may yet have fingerprints far apart (at 0.8 they differ in a tenth of the
    bits and more), and all of these are found by shared keys: in an order of all shingles, rare ones
    first, both have one of the first fifth (at 0.8) of each set. All pairs of a key that are in
    different components and that sizes, places and parities do not exclude are verified too, so no
    pair is missed. Where a key has many members, those nearest to the middle are
    compared with all others first, and ever more of them in each round, until no key has components
    that were not compared. Equal sets are one node from the start; texts without words are equal.

    Every row has a group, rows with equal doc_ids each by its own text. A group of null doc_ids
    alone has group_id null. Nulls count as the empty text.
    """
    scratch = Scratch(docs.sparkSession, "similar")
    known, rooted = similar_sets(docs, words, similarity, radius, scratch)
    firsts = rooted.groupBy("root").agg(F.min("row").alias("first"))
    grouped = scratch.keep(rooted.join(firsts, "root").select("id", F.col("first.doc_id").alias("group_id")), "grouped")
    return known.select("doc_id", "id").join(grouped, "id").select("doc_id", "group_id")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """Of each group of similar rows (see similar_groups) the one with the smallest doc_id, nulls last;
    of several such rows that with the smallest hash of its text, and of equal ones of these the first
    in the order of their columns."""
    scratch = Scratch(docs.sparkSession, "similar")
    known, rooted = similar_sets(docs, words, similarity, radius, scratch)
    firsts = rooted.groupBy("root").agg(F.min("row").alias("row")).select(row_key("row.doc_id", "row.h").alias("k"), F.col("row.h").alias("h"))
    stay = known.select(row_key("doc_id", "h").alias("k"), "h").join(firsts.hint("merge"), ["k", "h"], "left_semi").groupBy("k", "h").count()
    stay = scratch.keep(stay, "stay")
    scratch.only("stay")
    marked = docs.withColumns({"__k": row_key("doc_id", text_hash()), "__h": text_hash()})
    chosen = stay.select(F.col("k").alias("__k"), F.col("h").alias("__h"))
    kept = marked.join(chosen.hint("merge"), ["__k", "__h"], "left_semi")
    if stay.where("count > 1").head(1):  # rows that repeat both
        one = F.min(F.struct(*(F.col(c) for c in docs.columns))).alias("one")
        return kept.groupBy("__k", "__h").agg(one).select("one.*")
    return kept.select(*docs.columns)
