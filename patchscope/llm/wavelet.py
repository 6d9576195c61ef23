"""Token ids in files: a wavelet matrix per shard.

A shard holds whole documents in id order. Its token ids are kept as bit-planes, one per
bit, highest first; each plane orders the ids by the bits above it, zeros before ones, and
has a directory of ones per block. From these, the token at any place, the count of a token
before a place and the place of its k-th occurrence come by one rank or select per plane.
A shard is one row of a Parquet table (codec zstd) in the shared folder, so files are
committed by Spark, live in any store Spark writes to, and one row is one readable file.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from patchscope.llm.common import Recent, worker_state
from patchscope.session import shared_folder

MAGIC = b"WVM1"
BLOCK = 512
SHARD_TOKENS = 1 << 19
#: Bytes of text that are split into pieces at a time.
BLOCK_BYTES = 1 << 23
MARK = "\x00"
#: Latin letters that normal form C keeps and whose lower case is one letter, with ASCII marks (no apostrophe) before and after.
PLAIN = re.compile("([-.,;:!?|()*\"]*)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([-.,;:!?|()*\"]*)")
#: Bytes as the printable characters of byte-level tokenizers: themselves where printable, else 256 and up in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LEVEL = {b: b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)}
SAMPLE = ("The", "résumé", "ÉTÉ", "straße", "ČESKÁ", "naïve", "Zażółć", "a", "I", "internationalization", "œuvre", "(end).", "what?!", "--x|")
SHARD_SCHEMA = "part int, shard int, first_doc long, n_docs long, n_tokens long, payload binary"


class WaveletMatrix:
    """Succinct sequence of unsigned 16-bit ids."""

    def __init__(self, n: int, width: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.width, self.zeros, self.planes, self.ranks = n, width, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        ids = np.asarray(ids, np.uint16)
        n = len(ids)
        width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        zeros, planes, ranks = [], [], []
        for level in range(width - 1, -1, -1):
            bit = (ids & np.uint16(1 << level)) != 0
            plane = np.packbits(bit, bitorder="little")
            planes.append(plane)
            ranks.append(cls.directory(plane))
            # places, then take: random masks are slow to index by
            low = np.flatnonzero(~bit)
            zeros.append(len(low))
            ids = ids.take(np.concatenate([low, np.flatnonzero(bit)]))
        return cls(n, width, zeros, planes, ranks)

    @staticmethod
    def directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block."""
        step = BLOCK // 8
        ones = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), step), dtype=np.int64) if len(plane) else np.zeros(0, np.int64)
        return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sIQ", MAGIC, self.width, self.n)
        return head + np.array(self.zeros, "<u8").tobytes() + b"".join(p.tobytes() for p in self.planes) + b"".join(r.tobytes() for r in self.ranks)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, width, n = struct.unpack_from("<4sIQ", data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix")
        at, size, blocks = 16 + 8 * width, (n + 7) // 8, (n + BLOCK - 1) // BLOCK + 1
        zeros = np.frombuffer(data, "<u8", width, 16).tolist()
        planes = [np.frombuffer(data, np.uint8, size, at + i * size) for i in range(width)]
        ranks = [np.frombuffer(data, "<u4", blocks, at + width * size + 4 * i * blocks) for i in range(width)]
        return cls(n, width, zeros, planes, ranks)

    def _ones(self, level: int, place: int) -> int:
        """Ones of a plane before a place."""
        block = place // BLOCK
        plane, start, stop = self.planes[level], block * (BLOCK // 8), place // 8
        count = int(self.ranks[level][block]) + int(np.bitwise_count(plane[start:stop]).sum())
        return count + (int(plane[stop]) & ((1 << place % 8) - 1)).bit_count() if place % 8 else count

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for level in range(self.width):
            ones = self._ones(level, place)
            bit = int(self.planes[level][place // 8]) >> place % 8 & 1
            value = value << 1 | bit
            place = self.zeros[level] + ones if bit else place - ones
        return value

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of an id before a place lie in the order of the last plane."""
        start = 0
        for level in range(self.width):
            a, b = self._ones(level, start), self._ones(level, stop)
            start, stop = (self.zeros[level] + a, self.zeros[level] + b) if value >> (self.width - 1 - level) & 1 else (start - a, stop - b)
        return start, stop

    def count(self, value: int, stop: int | None = None) -> int:
        """How often an id occurs before a place."""
        if value >> self.width or value < 0:
            return 0
        a, b = self._range(value, self.n if stop is None else stop)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th zero or one of a plane."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            ones = self._ones(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def find(self, value: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of an id."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        place = self._range(value, self.n)[0] + k
        for level in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - level) & 1
            place = self._select(level, bit, place - self.zeros[level] if bit else place)
        return place

    def ids(self) -> np.ndarray:
        """The whole sequence: the planes undone from the last to the first."""
        ids = np.zeros(self.n, np.uint16)
        for level in range(self.width - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(ids)
            ids[self.zeros[level]:] |= np.uint16(1 << (self.width - 1 - level))
            back[np.concatenate([np.flatnonzero(~bit), np.flatnonzero(bit)])] = ids
            ids = back
        return ids


def pack(docs: list[tuple[int, bytes]]) -> bytes:
    """A shard's file: document ids, their ends in tokens, the wavelet matrix."""
    ends = np.cumsum([len(x) // 2 for _, x in docs], dtype=np.int64)
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u2")
    return struct.pack("<Q", len(docs)) + np.array([i for i, _ in docs], "<i8").tobytes() + ends.astype("<i8").tobytes() + WaveletMatrix.build(ids).to_bytes()


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, ends and matrix of a shard's file."""
    n = struct.unpack_from("<Q", payload)[0]
    return np.frombuffer(payload, "<i8", n, 8), np.frombuffer(payload, "<i8", n, 8 + 8 * n), WaveletMatrix.from_bytes(payload[8 + 16 * n :])


class PieceEncoder:
    """Whole texts through the tokenizers library, each white-space separated piece once.

    The tokenizer drops white space, and no merge crosses it. New pieces go through in one
    call, with a mark between them that has an id of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.mark = self._plain(MARK)
        # the short way holds for tokenizers that lower-case, split at letters and map bytes; others fail this comparison
        self.letters = False
        sample = list(SAMPLE)
        self.two = [i.to_bytes(2, "little") for i in range(1 << 16)]
        whole = self._whole(sample)
        self.letters = True
        self.words = Recent(self._model, 300_000)
        self.letters = self._fill(sample) == whole
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Recent(self._fill, 700_000)

    def _plain(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _model(self, words: list[str]) -> list[bytes]:
        """Lower-case words and marks, as the pre-tokenizer would hand them over, through the model."""
        tokenize, two = self.tokenizer.model.tokenize, self.two
        shown = (w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LEVEL) for w in words)
        return [b"".join([two[t.id] for t in tokenize(w)]) for w in shown]

    def _fill(self, new: list[str]) -> list[bytes]:
        """Words of plain letters, with marks around them, go to the model, each word and mark once; the others through the whole tokenizer."""
        found = list(map(PLAIN.fullmatch, new)) if self.letters else [None] * len(new)
        parts = [m.groups() for m in found if m is not None]
        before, words, after = zip(*parts) if parts else ((), (), ())
        words = list(map(str.lower, words))
        marks = list({*before, *after} - {""})
        marks = {"": b"", **dict(zip(marks, self._model(marks)))}
        known = iter([marks[a] + ids + marks[b] for a, ids, b in zip(before, self.words.look_up(words), after)])
        others = iter(self._whole([piece for piece, m in zip(new, found) if m is None]))
        return [next(others if m is None else known) for m in found]

    def _whole(self, new: list[str]) -> list[bytes]:
        out = []
        for start in range(0, len(new), 20_000):
            block = new[start : start + 20_000]
            ids = np.array(self._plain(f" {MARK} ".join(block)), "<u2")
            cuts = np.flatnonzero(ids == self.mark[0]) if len(self.mark) == 1 else np.zeros(0, int)
            if len(cuts) == len(block) - 1:
                packed, at = ids.tobytes(), [0, *(2 * cuts + 2).tolist(), 2 * len(ids) + 2]
                out += [packed[a : b - 2] for a, b in zip(at, at[1:])]
            else:
                out += [np.array(self._plain(x), "<u2").tobytes() for x in block]
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit integers; each distinct piece of all texts is looked up once."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        numbered = split.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        ids = self.pieces.hold(pieces)
        flat, size = np.frombuffer(b"".join(ids), "<u2"), np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        start = np.cumsum(size) - size
        number = numbered.indices.to_numpy()
        count = size[number]
        ends = np.concatenate([[0], np.cumsum(count)])
        packed = flat[np.repeat(start[number] - ends[:-1], count) + np.arange(ends[-1])].tobytes()
        # the first text of a slice need not begin at piece 0
        offsets = split.offsets.to_numpy()
        cuts = (2 * ends[offsets - offsets[0]]).tolist()
        out = [packed[a:b] for a, b in zip(cuts, cuts[1:])]
        for special in self.special:  # a special token can stand inside white space rules of its own
            for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, special), False).to_numpy(zero_copy_only=False)):
                out[i] = np.array(self._plain(texts[int(i)].as_py()), "<u2").tobytes()
        return out


def in_blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[pa.Array]:
    """Texts in order, in slices of about ``size`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
    start = 0
    while start < len(texts):
        stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size)) + 1
        yield texts.slice(start, stop - start)
        start = stop


def piece_encoder(path: str) -> PieceEncoder:
    return worker_state(("pieces", path), lambda: PieceEncoder(path))


def write(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None, shard_tokens: int = SHARD_TOKENS) -> str:
    """Encode ``docs`` (doc_id, text) and write shards in ascending id order; returns the folder.

    NULL text is empty. Rows with a NULL id come first; repeated ids stay, in any order. A
    shard closes with the document that fills it, so its size is bounded by ``shard_tokens``
    and one document.
    """
    folder = folder or f"{shared_folder(docs.sparkSession)}/wavelet-{uuid.uuid4().hex}"

    def run(batches):
        from pyspark import TaskContext

        own, part, shard, held, size = piece_encoder(path), TaskContext.get().partitionId(), 0, [], 0
        end = np.array([end_id], "<u2").tobytes()

        def row():
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "first_doc": pa.array([held[0][0]], pa.int64()),
                "n_docs": pa.array([len(held)], pa.int64()), "n_tokens": pa.array([size], pa.int64()), "payload": pa.array([pack(held)], pa.binary())})

        for batch in batches:
            encoded = (ids for block in in_blocks(batch.column("text")) for ids in own.encode(block))
            for i, ids in zip(batch.column("doc_id").to_pylist(), encoded):
                ids += end
                held.append((i, ids))
                size += len(ids) // 2
                if size >= shard_tokens:
                    yield row()
                    shard, held, size = shard + 1, [], 0
        if held:
            yield row()

    ordered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), "text")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(folder)
    return folder


def read(spark, folder: str, outputs: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32; with ``outputs`` also ids.

    The start is the sum of three parts: tokens of earlier partitions (one row each), of
    earlier shards of the partition, of earlier documents of the shard.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    parts = parts.select("part", (F.sum("__n").over(W.orderBy("part")) - F.col("__n")).alias("__before"))
    sizes = shards.select("part", "shard", "n_tokens").join(F.broadcast(parts), "part")  # as many rows as write partitions
    start = F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard")) - F.col("n_tokens") + F.col("__before")
    sizes = sizes.select("part", "shard", start.alias("__start"))
    schema = "part int, shard int, doc_id long, __at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * outputs

    def run(batches):
        for batch in batches:
            for part, shard, payload in zip(*(batch.column(c) for c in ("part", "shard", "payload"))):
                docs, ends, matrix = unpack(payload.as_py())
                ids, starts = matrix.ids().astype("<u4"), np.concatenate([[0], ends[:-1]])
                cut = [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
                out = {
                    "part": pa.array([part.as_py()] * len(docs), pa.int32()), "shard": pa.array([shard.as_py()] * len(docs), pa.int32()), "doc_id": pa.array(docs),
                    "__at": pa.array(starts, pa.int64()), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array([zlib.crc32(x) for x in cut], pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array([x.astype(np.int32) for x in cut], pa.list_(pa.int32()))} if outputs else {}))

    docs = shards.select("part", "shard", "payload").mapInArrow(run, schema).join(sizes, ["part", "shard"])
    doc_id = F.when(F.col("doc_id") != -(2**63), F.col("doc_id"))
    return docs.select(doc_id.alias("doc_id"), (F.col("__start") + F.col("__at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * outputs)


def encode_to_files(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Write the shards and read them back."""
    return read(docs.sparkSession, write(docs, path, end_id))
