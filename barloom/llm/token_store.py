"""Token ids in bit-packed files that numpy reads in blocks (operator 3).

File format, little endian: the magic `BLTOKEN1`, then unsigned 64-bit numbers: bits an id, ids a
block, documents, ids, and the byte places of the four parts. Parts: the packed blocks (each id in
the fewest bits that hold the vocabulary, each block padded to whole bytes), the blocks' byte
offsets (one more than blocks), the documents' doc_ids with a null mask, and their first ids (one
more than documents). Any range of ids is read by unpacking the blocks that it touches.

Files follow one another in ascending doc_id order, by name. A file ends at the first document end
past a set number of ids, so memory is bounded but for a single document of more ids than that.
A task writes each file under a name of its own attempt and then renames it, so a repeated or
speculative task leaves the same files. The whole texts are dealt out by ranges of doc_id before
they are encoded; equal doc_ids are ordered by text.

Ids are those of the tokenizer's `encode` with its own settings, so the strings of its added tokens
get their ids where a text quotes them. Nulls count as the empty text, which has the end id alone;
documents with a null doc_id come first.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, text_of

MAGIC = b"BLTOKEN1"
BLOCK_IDS, FILE_IDS = 4096, 1 << 21
#: Pieces up to this many characters are remembered by a task, up to this many of them at a time.
MEMO_CHARS, MEMO_PIECES = 40, 400_000

_WORDS = re.compile(r"[^\t-\r ]+").findall
_BEYOND = re.compile("[^\x00-\u024f]").search


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id under `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in `bits` bits each, lowest bit first, padded to whole bytes."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(raw, "<u2", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def file_bytes(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray, bits: int) -> bytes:
    blocks = [pack(ids[k : k + BLOCK_IDS], bits) for k in range(0, len(ids), BLOCK_IDS)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks], dtype=np.int64)]).astype("<i8").tobytes()
    known = np.array([x is not None for x in doc_ids], np.uint8).tobytes()
    keys = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    starts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype("<i8").tobytes()
    places = np.cumsum([72, sum(map(len, blocks)), len(offsets), len(keys) + len(known)]).tolist()
    return b"".join([MAGIC, struct.pack("<8Q", bits, BLOCK_IDS, len(doc_ids), len(ids), *places), *blocks, offsets, keys, known, starts])


class TokenFile:
    """Random access to the ids of one file, from its bytes or a memory map of it."""

    def __init__(self, raw: bytes | memoryview):
        self.raw = memoryview(raw)
        if bytes(self.raw[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block, n, self.n_ids, self.at, offsets, keys, starts = struct.unpack("<8Q", self.raw[8:72])
        self.offsets = np.frombuffer(self.raw, "<i8", -(-self.n_ids // self.block) + 1, offsets)
        self.doc_ids = np.frombuffer(self.raw, "<i8", n, keys)
        self.known = np.frombuffer(self.raw, np.uint8, n, keys + 8 * n).astype(bool)
        self.starts = np.frombuffer(self.raw, "<i8", n + 1, starts)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first to last - 1 of the file."""
        if first >= last:
            return np.zeros(0, np.uint32)
        lo, hi = first // self.block, (last - 1) // self.block + 1
        parts = [unpack(self.raw[self.at + self.offsets[k] : self.at + self.offsets[k + 1]], self.bits, min(self.block, self.n_ids - k * self.block)) for k in range(lo, hi)]
        return np.concatenate(parts)[first - lo * self.block : last - lo * self.block]


def store_file(folder: str, name: str, data: bytes) -> None:
    """Writes a file whole or not at all; repeating it changes nothing."""
    where = urlparse(folder)
    own = f"{name}.{uuid.uuid4().hex}.tmp"
    if where.scheme in ("", "file"):
        os.makedirs(where.path, exist_ok=True)
        with open(f"{where.path}/{own}", "wb") as out:
            out.write(data)
        os.replace(f"{where.path}/{own}", f"{where.path}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        with store.open_output_stream(f"{path}/{own}") as out:
            out.write(data)
        store.move(f"{path}/{own}", f"{path}/{name}")


def _latin_pieces() -> re.Pattern:
    """What the tokenizer's own split takes from lower-case text of characters under U+0250."""
    of = {kind: "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind) for kind in "LN"}
    blank = "\t-\r \x85\xa0"
    return re.compile(f"[{of['L']}]+|'(?:s|t|re|ve|m|ll|d)|[{of['N']}]|[^{blank}{of['L']}{of['N']}]+")


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level models write bytes as: printable ones as they are, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in plain)}


#: The steps that `_latin_pieces` and `_byte_letters` take, as a definition names them.
SPLIT_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class PieceEncoder:
    """Encodes texts by pieces that no token crosses, each distinct piece once.

    Texts of characters under U+0250, which all are in composed form, are lower-cased and split as
    the tokenizer's definition does it, and the pieces go to its model; other texts are split at
    ASCII white space alone, and those words go to the whole tokenizer. A text that holds the string
    of an added token goes to the whole tokenizer undivided, as do all texts where the definition
    has other steps than SPLIT_STEPS.
    """

    def __init__(self, definition: str):
        self.tokenizer = Tokenizer.from_str(definition)
        said = json.loads(definition)
        self.known_steps = all(said.get(step) == known for step, known in SPLIT_STEPS.items())
        added = [x["content"] for x in said.get("added_tokens") or []]
        self.added = re.compile("|".join(map(re.escape, added)), re.I).search if added else lambda text: None
        self.memo: dict[str, bytes] = {}
        self.latin, self.model, self.letters = _latin_pieces().findall, self.tokenizer.model, _byte_letters()

    def pieces(self, text: str) -> list[str]:
        """What goes to the whole tokenizer is marked by a leading blank."""
        if not self.known_steps or self.added(text):
            return [" " + text]
        return [" " + x for x in _WORDS(text)] if _BEYOND(text) else self.latin(text.lower())

    def encode_piece(self, piece: str) -> bytes:
        if piece[0] == " ":
            return array("I", self.tokenizer.encode(piece[1:], add_special_tokens=False).ids).tobytes()
        written = piece if piece.isascii() and piece.isprintable() else piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array("I", [x.id for x in self.model.tokenize(written)]).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.pieces(text) for text in texts]
        distinct = set(chain.from_iterable(split))
        own = {x: self.encode_piece(x) for x in distinct if x not in self.memo}
        self.memo.update(own)
        out = [np.frombuffer(b"".join(map(self.memo.__getitem__, pieces)), "<u4") for pieces in split]
        if len(self.memo) > MEMO_PIECES:  # what came first, and so most often, stays
            for piece in own:
                del self.memo[piece]
        else:
            for piece in own:
                if len(piece) > MEMO_CHARS:
                    del self.memo[piece]
        return out


#: The last tokenizer that this Python worker has used.
_LATEST: list = []


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the files of `docs` and returns a row for each: file, n_docs, n_ids (made when read).

    The folder must be one that all executors share. It holds nothing else afterwards.
    """
    with open(tokenizer_path, encoding="utf-8") as lines:
        definition = lines.read()
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    bits = bits_for(Tokenizer.from_str(definition).get_vocab_size())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if _LATEST[:1] != [shared.value]:
            _LATEST[:] = [shared.value, PieceEncoder(shared.value)]
        encoder, part, number = _LATEST[1], TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list = []
        count = 0

        def flush() -> pa.RecordBatch:
            name = f"ids-{part:09d}-{number:09d}.bin"  # in the order of names
            store_file(folder, name, file_bytes(doc_ids, [len(x) for x in held], np.concatenate(held), bits))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(doc_ids)], pa.int64()), pa.array([count], pa.int64())], names=["file", "n_docs", "n_ids"])

        for part_of in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            for doc_id, ids in zip(part_of.column("doc_id").to_pylist(), encoder.encode(part_of.column("text").to_pylist()), strict=True):
                doc_ids.append(doc_id)
                held.append(np.append(ids, np.uint32(end_id)))
                count += len(held[-1])
                if count >= FILE_IDS:
                    yield flush()
                    doc_ids, held, count, number = [], [], 0, number + 1
        if doc_ids:
            yield flush()

    texts = docs.select("doc_id", text_of().alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, "file string, n_docs long, n_ids long")


def read_documents(files: DataFrame) -> DataFrame:
    """file, place in it, doc_id, ids before the document in its file, n_tokens, ids_crc32.

    `files` is what Spark's binaryFile source gives for a folder of token files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("file"), batch.column("content"), strict=True):
                f = TokenFile(content.as_buffer())
                n = len(f.doc_ids)
                sums = [zlib.crc32(f.ids(a, b).astype("<u4").tobytes()) for a, b in zip(f.starts[:-1].tolist(), f.starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array(f.doc_ids, mask=~f.known), pa.array(f.starts[:-1]), pa.array(np.diff(f.starts)), pa.array(sums, pa.int64())], names=["file", "place", "doc_id", "before", "n_tokens", "ids_crc32"])

    schema = "file string, place long, doc_id long, before long, n_tokens long, ids_crc32 long"
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(run, schema)


def encode_and_read_back(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Writes all documents as token files, then gives per document, from those files: doc_id,
    start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-files")
    folder = scratch.path("files")
    made = scratch.keep(write_token_files(docs, folder, tokenizer_path, end_id), "manifest")
    # a row a file, that is for millions of ids: small enough for one ordered sum
    starts = made.select("file", (F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")).alias("first"))
    if not made.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return read_documents(files).join(starts, "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
