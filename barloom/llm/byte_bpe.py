"""Byte-level BPE encoding and decoding by longest matches and backtracking (operator 9).

The vocabulary's byte strings are read as Latin-1 text and put in one Aho-Corasick automaton. A
piece is encoded from the left with the longest token that matches there. A token may follow
another only if merging their joined bytes by rank keeps the border between them; that answer
depends on the two tokens alone and is remembered. Where a longest token doesn't fit, its longest
proper prefix in the vocabulary is tried, and when none is left the last token is taken back. An
end position that has once been left is never entered again, so the work is linear in the piece,
and the one sequence with only compatible neighbours is the one that merging by rank gives.

Nulls count as the empty text: no ids, and the hashes of nothing. Repeated rows and repeated
doc_ids give one result row each. Other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import text_of

#: Pieces up to this many characters are remembered by a task, up to this many of them at a time.
MEMO_CHARS, MEMO_PIECES = 40, 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class BacktrackingBpe:
    """Encodes pieces of text to the ids that merging by rank gives, and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token, (rank, len(token)))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, rank in sorted(self.ids.items(), key=lambda x: x[1]):
            parts = self._merge_below(token, rank)
            if len(parts) == 2:
                self.halves[rank] = (self.ids[parts[0]], self.ids[parts[1]])
                self.merged[self.halves[rank]] = rank
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}

    def _merge_below(self, token: str, rank: int) -> list[str]:
        """What plain merging makes of a token's bytes with the ranks under its own."""
        parts = list(token)
        while len(parts) > 1:
            best = min(((self.ids.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(rank, 0))
            if best[0] >= rank:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens by rank ends in exactly these two tokens.

        The tokens are taken apart in the reverse order of their merges. At each step the two
        parts at the border would have been merged, had their joint rank come before the merge
        that is just being undone (a tie goes to the left one).
        """
        if (known := self.fits.get((left, right))) is not None:
            return known
        a, b, before, good = left, right, 1 << 62, True
        while True:
            if self.merged.get((a, b), before) < before:
                good = False
                break
            undo_left = a in self.halves and (a > b or b not in self.halves)
            if undo_left:
                before, a = a, self.halves[a][1]
            elif b in self.halves:
                before, b = b + 1, self.halves[b][0]
            else:
                break
        self.fits[left, right] = good
        return good

    def _next_shorter(self, token: int) -> int | None:
        if token not in self.shorter:
            text = self.bytes_of[token].decode("latin-1")
            self.shorter[token] = next((self.ids[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ids), None)
        return self.shorter[token]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8").decode("latin-1")
        if (whole := self.ids.get(raw)) is not None:
            return (whole,)
        longest: list[int | None] = [None] * len(raw)
        for end, (rank, n) in self.automaton.iter(raw):
            longest[end - n + 1] = rank
        out: list[int] = []
        left: set[int] = set()
        at, token, size = 0, longest[0], len(raw)
        while at < size or token is None:
            while token is not None:
                end = at + self.length[token]
                if end not in left and (not out or self._compatible(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < size else None
                    break
                token = self._next_shorter(token)
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                left.add(at)
                token = out.pop()
                at -= self.length[token]
                token = self._next_shorter(token)
                continue
            if at == size:
                break
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        pieces, memo = self.pattern.findall(text), self.memo
        if len(memo) > MEMO_PIECES:
            memo.clear()
        distinct = set(pieces)
        for piece in distinct:
            if piece not in memo:
                memo[piece] = self.encode_piece(piece)
        out = list(chain.from_iterable(map(memo.__getitem__, pieces)))
        for piece in distinct:
            if len(piece) > MEMO_CHARS:
                del memo[piece]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded binary"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _codec(sc, ranks_path: str, pattern: str):
    """The ranks go to each task once, as one broadcast: the vocabulary's size bounds them."""
    shared = sc.broadcast((read_ranks(ranks_path), pattern))


    def codec() -> BacktrackingBpe:
        if _LATEST[:1] != [shared.value]:
            _LATEST[:] = [shared.value, BacktrackingBpe(*shared.value)]
        return _LATEST[1]

    return codec


#: The last vocabulary that this Python worker has used, and its codec: building one takes 0.6 s.
_LATEST: list = []


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the bytes that decoding those ids gives back."""
    codec = _codec(docs.sparkSession.sparkContext, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [bpe.encode(x) for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, SCHEMA)


def digest_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """encode_documents with hashes in place of ids and bytes, which so never leave the task."""
    codec = _codec(docs.sparkSession.sparkContext, ranks_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec()
        decimal = {i: str(i) for i in bpe.bytes_of}
        for batch in batches:
            sizes, coded, plain = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py())
                sizes.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                plain.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(plain, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, DIGEST)
