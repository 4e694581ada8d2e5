"""The byte model of operator 5: hashed-context bit predictors, mixed in the logistic domain.

A byte is coded as the decisions on its path in a Huffman tree of the training bytes that follow the
byte before it, so common bytes take few decisions; an end byte that UTF-8 never has closes each
text. For each context order, three decisions in a row share a line of eight bytes that is found by
the hash of the bytes before and the tree node: a slot for each of their seven nodes, which gives a
log-odds prediction from its training counts, and how often the line was met. A gate, which is the
depth in the tree and how often the lines of the two longest contexts were met, selects the weights
by which predictions and a bias are summed. The first weights are fitted on training documents.
Within a document they are refined after each block, from 128 bytes doubling to 4096, by a change
for each depth, so every document starts from the same weights and its score depends on nothing
else.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

END = 255
PAD = 8
#: Places: of a document's first and largest block, worked on at once, and counted at once.
FIRST_BLOCK, LAST_BLOCK, CHUNK, BATCH = 128, 1 << 15, 1 << 16, 1 << 20
#: Decisions whose slots share a line of eight bytes; from how often on a line counts as met once, a few times and often.
LEVELS, MET, GATES = 3, np.array([1, 2, 6]), 16
#: A step's mark, and by step the bits to shift its slot's byte down by, and -1 for one and 1 for zero.
LAST = 128
SHIFT_OF, TURN_OF = np.arange(256, dtype=np.uint64) % 8 * 8, np.where(np.arange(256) & 8, np.float32(-1), np.float32(1))
#: Predictions are kept in a byte each, in steps of 1/14 up to 9.
STEP = np.float32(1 / 14)
M1, M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _paths(counts: list[int]) -> list[list[tuple[int, int]]]:
    """The (node, bit) decisions of each symbol in the Huffman tree of the counts."""
    heap = [(c + 1, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    kids: dict[int, tuple[int, int]] = {}
    for n in range(len(counts), 2 * len(counts) - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        kids[n] = (a[1], b[1])
        heapq.heappush(heap, (a[0] + b[0], n))
    paths: list = [None] * len(counts)
    left: list[tuple[int, list[tuple[int, int]]]] = [(2 * len(counts) - 2, [])]
    while left:
        at, path = left.pop()
        if at < len(counts):
            paths[at] = path
        else:
            left += [(kid, [*path, (at - len(counts), bit)]) for bit, kid in enumerate(kids[at])]
    return paths


class Trees:
    """A tree for each byte before. Pair x is 256 times that byte plus the byte. Each LEVELS of its
    decisions share a line, which root[g, x] tells apart from others of a context. step[d, x] has the
    d-th decision: its place in the line (1 to 7), 8 if its bit is one, and LAST if none follows."""

    def __init__(self, counts: np.ndarray):
        counts = counts.reshape(256, 256)
        counts = np.maximum(counts, counts.sum(axis=1, keepdims=True) >> 14)  # no path is much longer than 14
        paths = [path for row in counts.tolist() for path in _paths(row)]
        self.depth = max(map(len, paths))
        self.root = np.zeros((-(-self.depth // LEVELS), 1 << 16), np.uint32)
        self.step = np.zeros((self.depth, 1 << 16), np.uint8)
        for x, path in enumerate(paths):
            at = 1
            for d, (n, b) in enumerate(path):
                if d % LEVELS == 0:
                    self.root[d // LEVELS, x], at = n + 1 + (x >> 8 << 8), 1
                self.step[d, x] = at + 8 * b + LAST * (d == len(path) - 1)
                at = 2 * at + b
        self.root *= M2


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer, each behind zero bytes; where each starts; and their lengths with the end."""
    buffer = np.frombuffer(b"".join(b"\0" * PAD + t + bytes([END]) for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    return buffer, np.cumsum(lengths + PAD) - lengths, lengths


def pairs_of(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, orders: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For the places of some stretches, one after another: the byte with the one before, and the contexts' hashes."""
    wide = lengths + PAD
    own = buffer.take(np.repeat(starts - PAD - (np.cumsum(wide) - wide), wide) + np.arange(wide.sum()))
    at = np.repeat(np.cumsum(wide) - lengths - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    pairs = own.astype(np.intp)
    pairs[1:] += own[:-1].astype(np.intp) << 8
    return pairs.take(at), [h.take(at) for h in contexts(own, orders)]


def contexts(buffer: np.ndarray, orders: tuple[int, ...]) -> list[np.ndarray]:
    """For each order, shortest first, a hash of so many bytes before each place of the buffer (the first PAD aside)."""
    wide, n = buffer.astype(np.uint32), len(buffer)
    h, out = np.zeros(n, np.uint32), []
    for k in range(1, orders[-1] + 1):
        h[PAD:] += wide[PAD - k : n - k]
        h *= M1
        if k in orders:
            out.append(h ^ (h >> np.uint32(15)) ^ np.uint32(k * 0x2545F491 & 0xFFFFFFFF))
    return out


def lines_of(hashes: np.ndarray, roots: np.ndarray, bits: int) -> np.ndarray:
    h = hashes ^ roots
    h *= M1
    h >>= np.uint32(32 - bits)
    return h


def stretches(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of CHUNK places at most, a few of them at once."""
    n = -(-lengths // CHUNK)
    within = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * CHUNK
    a, size = np.repeat(starts, n) + within, np.minimum(np.repeat(lengths, n) - within, CHUNK)
    group = (np.cumsum(size) - 1) // CHUNK
    for rows in np.split(np.arange(len(a)), np.flatnonzero(np.diff(group)) + 1):
        yield a[rows], size[rows]


class Counter:
    """Counts of zeros and ones by slot, for each order: a byte each, with a list of what went beyond."""

    def __init__(self, trees: Trees, orders: tuple[int, ...], bits: int):
        self.trees, self.orders, self.bits = trees, orders, bits
        self.counts = np.zeros((len(orders), 16 << bits), np.uint8)
        self.beyond: list[list[np.ndarray]] = [[] for _ in orders]
        self.found: list[list[np.ndarray]] = [[] for _ in orders]
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        buffer, starts, lengths = layout(texts)
        for at, own in stretches(starts, lengths):
            pairs, hashes = pairs_of(buffer, at, own, self.orders)
            for keys, h in zip(self.found, hashes, strict=True):
                keys.append(h.astype(np.uint64) << np.uint64(16) | pairs.astype(np.uint64))
            self.size += len(pairs)
            if self.size >= BATCH:
                self._count()

    def _count(self) -> None:
        """Equal pairs of equal contexts are counted first, and only then taken apart into decisions."""
        self.size = 0
        for i, own in enumerate(self.found):
            if own:
                keys = np.concatenate(own)
                own.clear()
                keys.sort()
                last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True))
                times, keys = np.diff(last, prepend=-1).astype(np.uint64), keys[last]
                slot = self._slots((keys & np.uint64(0xFFFF)).astype(np.intp), (keys >> np.uint64(16)).astype(np.uint32), times)
                slot.sort()  # then runs are added in the order of the table
                at = slot >> np.uint64(32)
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                total = np.add.reduceat(slot & np.uint64(0xFFFFFFFF), first)
                at = at[first].astype(np.intp)
                total += self.counts[i, at]
                over = np.flatnonzero(total > 0xFF)
                if len(over):
                    self.beyond[i].append(np.stack([at[over], total[over].astype(np.intp)]))
                    total[over] = 0
                    if len(self.beyond[i]) >= 64:
                        self.beyond[i] = [self._more(i)]
                self.counts[i, at] = total.astype(np.uint8)

    def _more(self, i: int) -> np.ndarray:
        """What went beyond in an order: its slots, sorted, and the sums."""
        at, c = np.concatenate(self.beyond[i], axis=1) if self.beyond[i] else np.zeros((2, 0), np.intp)
        order = np.argsort(at, kind="stable")
        at, c = at[order], c[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return np.stack([at[first], np.add.reduceat(c, first) if len(c) else c])

    def _slots(self, pairs: np.ndarray, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Slot and times, 32 bits each, of each decision."""
        out = []
        for d in range(self.trees.depth):
            step = self.trees.step[d].take(pairs)
            line = lines_of(hashes, self.trees.root[d // LEVELS].take(pairs), self.bits).astype(np.uint64)
            own = (step & np.uint8(7)) << np.uint8(1) | step >> np.uint8(3) & np.uint8(1)
            out.append((line << np.uint64(4) | own.astype(np.uint64)) << np.uint64(32) | times)
            go = np.flatnonzero(step < LAST)
            if not len(go):
                break
            pairs, hashes, times = pairs.take(go), hashes.take(go), times.take(go)
        return np.concatenate(out)

    def parts(self, size: int, empty: bool = True) -> Iterator[tuple[int, np.ndarray]]:
        """The counts, so many at a time, with the number of each such part; those without counts too or not."""
        self._count()
        for i, own in enumerate(self.counts):
            at, more = self._more(i)
            for k in range(0, len(own), size):
                here = slice(*np.searchsorted(at, [k, k + size]))
                if not empty and not own[k : k + size].any() and not len(at[here]):
                    continue
                part = own[k : k + size].astype(np.int64)
                part[at[here] - k] += more[here]
                yield (i * len(own) + k) // size, part


def predictions(counts: np.ndarray) -> np.ndarray:
    """Lines of eight bytes from those of eight pairs of counts: how often the line was met (0 to 3), and
    the log-odds of its slots in steps."""
    zero, one = counts[0::2].reshape(-1, 8), counts[1::2].reshape(-1, 8)
    out = np.clip(np.round(np.log((one + 0.06) / (zero + 0.06)) / STEP), -126, 126).astype(np.int8)
    out[:, 0] = np.searchsorted(MET, zero[:, 1] + one[:, 1], side="right")
    return out.ravel()


class Mixer:
    """`weights` are by depth and gate: how often the lines of the last two orders were met."""

    def __init__(self, trees: Trees, orders: tuple[int, ...], bits: int, tables: np.ndarray, weights: np.ndarray | None = None, rate: float = 0.02):
        self.trees, self.orders, self.bits, self.rate = trees, orders, bits, rate
        self.lines = [np.require(t.view("<u8"), requirements="A") for t in tables]  # a copy only where a broadcast lies between words
        self.inputs = len(orders) + 1
        if weights is None:
            weights = np.zeros((trees.depth, GATES, self.inputs))
            weights[:, :, :-1] = 1 / len(orders)
        self.weights = weights

    def _walk(self, pairs: np.ndarray, hashes: list[np.ndarray], counts: np.ndarray):
        """By depth: how many decisions each document has, the gates, the inputs, and the bits as -1 and 1."""
        for d in range(self.trees.depth):
            if d % LEVELS == 0:
                if d:
                    hashes = [h.take(rows) for h in hashes]
                roots = self.trees.root[d // LEVELS].take(pairs)
                lines = own = [table.take(lines_of(h, roots, self.bits)) for table, h in zip(self.lines, hashes, strict=True)]
                gate = gates = (lines[-1] & np.uint64(3) | (lines[-2] & np.uint64(3)) << np.uint64(2)).astype(np.uint8)
            else:
                own, gates = [line.take(rows) for line in lines], gate.take(rows)
            step = self.trees.step[d].take(pairs)
            shift = SHIFT_OF.take(step)
            yield d, counts, gates, [(line >> shift).astype(np.int8).astype(np.float32) for line in own], TURN_OF.take(step)
            more = step < LAST
            go = np.flatnonzero(more)
            if not len(go):
                return
            filled = np.flatnonzero(counts)
            left = np.add.reduceat(more, (np.cumsum(counts) - counts)[filled], dtype=np.int64)
            counts = np.zeros_like(counts)
            counts[filled] = left
            pairs = pairs.take(go)
            rows = go if d % LEVELS == 0 else rows.take(go)

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """Nats of each text with its end."""
        buffer, starts, lengths = layout(texts)
        out, done, size = np.zeros(len(texts)), 0, FIRST_BLOCK
        fitted = (self.weights * np.append(np.full(self.inputs - 1, STEP), 1)).astype(np.float32)
        moved = np.zeros((len(texts), self.trees.depth, self.inputs), np.float32)
        while len(act := np.flatnonzero(lengths > done)):
            for k in range(0, len(act), max(1, CHUNK // size)):
                own = act[k : k + max(1, CHUNK // size)]
                n = np.minimum(lengths[own] - done, size)
                w, cost, step = moved[own], np.zeros(len(own)), np.zeros((len(own), self.trees.depth, self.inputs), np.float32)
                for d, counts, gates, inputs, turned in self._walk(*pairs_of(buffer, starts[own] + done, n, self.orders), n):
                    z = fitted[d, :, -1].take(gates)
                    if done:
                        z += np.repeat(w[:, d, -1], counts)
                    for i, x in enumerate(inputs):
                        part = fitted[d, :, i].take(gates)
                        if done:
                            part += np.repeat(w[:, d, i] * STEP, counts)
                        part *= x
                        z += part
                    z *= turned
                    np.minimum(z, 20, out=z)
                    e = np.exp(z, out=z)
                    filled = np.flatnonzero(counts)
                    cuts = (np.cumsum(counts) - counts)[filled]
                    e += 1
                    cost[filled] += np.add.reduceat(np.log(e), cuts)
                    error = np.reciprocal(e, out=e)  # the chance of the bit that came
                    error -= 1
                    error *= turned
                    scale = self.rate / np.sqrt(counts[filled] + 16)
                    for i, x in enumerate(inputs):
                        x *= error
                        step[filled, d, i] = np.add.reduceat(x, cuts) * STEP * scale
                    step[filled, d, -1] = np.add.reduceat(error, cuts) * scale
                out[own] += cost
                moved[own] = w + step
            done += size
            size = min(2 * size, LAST_BLOCK)
        return out

    def newton_sums(self, texts: list[bytes]) -> np.ndarray:
        """For each depth and gate the gradient and the Hessian of the costs at the first weights."""
        buffer, starts, lengths = layout(texts)
        n = self.inputs
        out = np.zeros((self.trees.depth, GATES, n, n + 1))
        for at, own in stretches(starts, lengths):
            for d, _, gates, inputs, turned in self._walk(*pairs_of(buffer, at, own, self.orders), np.array([own.sum()])):
                x = np.stack([*(v * STEP for v in inputs), np.ones(len(turned), np.float32)], axis=1)
                z = (x * self.weights[d].astype(np.float32).take(gates, axis=0)).sum(axis=1)
                e = np.exp(np.clip(turned * z, -20, 20))
                wrong = e / (1 + e)
                order = np.argsort(gates, kind="stable")
                cuts = np.flatnonzero(np.diff(gates[order], prepend=-1))
                for rows in np.split(order, cuts[1:]):
                    part, bad = x[rows], wrong[rows]
                    out[d, gates[rows[0]], :, 0] += part.T @ (-turned[rows] * bad)
                    out[d, gates[rows[0]], :, 1:] += part.T @ (part * (bad * (1 - bad))[:, None])
        return out


def newton_step(weights: np.ndarray, sums: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """The weights after one damped step; gates without decisions keep theirs."""
    eye = np.eye(weights.shape[-1]) * ridge
    return weights + np.clip(np.linalg.solve(sums[..., 1:] + eye, sums[..., :1])[..., 0], -1, 1)
